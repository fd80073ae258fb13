"""Scalar functions of the workflow model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slugs that the model reserves, and the longest slug.
RESERVED_SLUGS = ("run",)
MAX_SLUG = 128
SLUG_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]*\z"


def valid_slug(slug: Column) -> Column:
    """True for a usable name; null, empty, long, reserved and malformed ones give false."""
    fine = (F.length(slug) > 0) & (F.length(slug) <= MAX_SLUG) & slug.rlike(SLUG_PATTERN) & ~slug.isin(*RESERVED_SLUGS)
    return F.coalesce(fine, F.lit(False))


def retry_delay(base: Column, attempts: Column) -> Column:
    """Seconds before a task is tried again: base * 2^attempts, rounded down."""
    return F.floor(base * F.pow(F.lit(2.0), attempts)).cast("int")


def message_retry_delay(base: Column, reads: Column, cap: int = 300, exponential: bool = True) -> Column:
    """Seconds before a plain message is delivered again; reads count from one."""
    return F.least(F.floor(base * F.pow(F.lit(2.0), reads - 1)), F.lit(cap)).cast("int") if exponential else base.cast("int")


def json_text(value: Column) -> Column:
    """A value of any type as JSON text; SQL null becomes ``null``."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def json_kind(text: Column) -> Column:
    """The kind of a JSON text by its first character; SQL null is ``null``."""
    first = F.substring(F.ltrim(text), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(text.isNull(), "null").otherwise(kind)


def json_object(pairs: list[tuple[str, Column, Column]]) -> Column:
    """JSON object text of (key, value, present) in the given order; absent keys are left out."""
    entries = [F.when(present, F.concat(F.lit(f'"{key}":'), json_text(value))) for key, value, present in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))).cast("double") / 1e6


def visible_at(now: Column, seconds: Column) -> Column:
    """``now`` moved by a whole number of seconds; keeps the kind of timestamp."""
    return now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; null where either has length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
