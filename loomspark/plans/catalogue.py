"""All named queries of the library with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans import analytics, relational, workflows  # noqa: F401  all three register with the same decorator

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES
ORACLES: dict[str, str] = relational.ORACLES
