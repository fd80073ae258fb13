"""JSON containment of a constant pattern, compiled to a Column.

An object contains a pattern object when it has every key with a containing
value; an array contains a pattern array when each element of the pattern is in
some element; scalars are equal as JSON values (1.0 equals 1, "1" does not).
Works on VARIANT and on typed columns (structs, maps, arrays, scalars).
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contains(value: Column, kind: T.DataType, pattern: Any) -> Column:
    """True where ``value`` contains ``pattern``; never null (a missing value contains nothing)."""
    found = _variant(value, pattern) if isinstance(kind, T.VariantType) else _typed(value, kind, pattern)
    return F.coalesce(found, F.lit(False))


def condition_met(value: Column, kind: T.DataType, required: dict | None, forbidden: dict | None) -> Column:
    """Required pattern (if any) contained, and forbidden one (if any) not."""
    met = F.lit(True) if required is None else contains(value, kind, required)
    return met if forbidden is None else met & ~contains(value, kind, forbidden)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _some(items: Column, kind: T.DataType, pattern: Any) -> Column:
    """Whether some element contains the pattern."""
    return F.coalesce(F.exists(items, lambda x: contains(x, kind, pattern)), F.lit(False))


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _variant(value: Column, pattern: Any) -> Column:
    shape = F.schema_of_variant(value)
    if isinstance(pattern, dict):
        parts = [F.startswith(shape, F.lit("OBJECT"))]
        for key, sub in pattern.items():
            parts.append(F.coalesce(_variant(F.try_variant_get(value, _path(key), "variant"), sub), F.lit(False)))
        return value.isNotNull() & _all(parts)
    if isinstance(pattern, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = [_some(items, T.VariantType(), sub) for sub in pattern]
        return value.isNotNull() & F.startswith(shape, F.lit("ARRAY")) & _all(each)
    if pattern is None:
        return F.is_variant_null(value)
    # A cast would turn "1" into 1, so the value's own kind is asked first.
    if isinstance(pattern, bool):
        return (shape == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == pattern)
    if isinstance(pattern, str):
        return (shape == "STRING") & (F.try_variant_get(value, "$", "string") == pattern)
    number = (shape == "BIGINT") | F.startswith(shape, F.lit("DECIMAL")) | shape.isin("DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    if isinstance(pattern, int):
        return number & (F.try_variant_get(value, "$", "decimal(38,9)") == F.lit(str(pattern)).cast("decimal(38,9)"))
    return number & (F.try_variant_get(value, "$", "double") == float(pattern))


def _typed(value: Column, kind: T.DataType, pattern: Any) -> Column:
    if isinstance(kind, T.VariantType):
        return _variant(value, pattern)
    if isinstance(pattern, dict):
        if isinstance(kind, T.StructType):
            known = {f.name: f.dataType for f in kind.fields}
            if not set(pattern) <= set(known):
                return F.lit(False)
            return value.isNotNull() & _all([F.coalesce(_typed(value[k], known[k], sub), F.lit(False)) for k, sub in pattern.items()])
        if isinstance(kind, T.MapType):
            has = [F.coalesce(F.map_contains_key(value, k) & F.coalesce(_typed(F.try_element_at(value, F.lit(k)), kind.valueType, sub), F.lit(False)), F.lit(False)) for k, sub in pattern.items()]
            return value.isNotNull() & _all(has)
        return F.lit(False)
    if isinstance(pattern, list):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        each = [_some(value, kind.elementType, sub) for sub in pattern]
        return value.isNotNull() & _all(each)
    if pattern is None:
        return value.isNull()
    if isinstance(pattern, bool):
        return value == pattern if isinstance(kind, T.BooleanType) else F.lit(False)
    if isinstance(pattern, str):
        return value == pattern if isinstance(kind, T.StringType) else F.lit(False)
    return value == pattern if isinstance(kind, T.NumericType) else F.lit(False)


def has_key(value: Column, key: str) -> Column:
    """Whether a VARIANT object has a key, whatever its value (null included); never null."""
    found = F.startswith(F.schema_of_variant(value), F.lit("OBJECT")) & F.try_variant_get(value, _path(key), "variant").isNotNull()
    return F.coalesce(found, F.lit(False))


def contains_value(value: Any, pattern: Any) -> bool:
    """The same rule on Python values; the oracle of the tests."""
    if isinstance(pattern, dict):
        return isinstance(value, dict) and all(k in value and contains_value(value[k], v) for k, v in pattern.items())
    if isinstance(pattern, list):
        return isinstance(value, list) and all(any(contains_value(x, p) for x in value) for p in pattern)
    if isinstance(pattern, bool) or isinstance(value, bool):
        return value is pattern
    if isinstance(pattern, int | float):
        return isinstance(value, int | float) and value == pattern
    return type(value) is type(pattern) and value == pattern


def parse_pattern(text: str | None) -> dict | None:
    pattern = json.loads(text) if text is not None else None
    if pattern is not None and not isinstance(pattern, dict):
        raise ValueError("a condition's pattern must be an object")
    return pattern
