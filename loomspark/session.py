"""Spark session factory with the settings this library assumes, and the shared folder of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, StructType

#: Settings that results depend on; the rest is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
}

#: Values, rows times columns, in a file of an intermediate table.
FILE_VALUES = 500_000


def get_session(app_name: str = "loomspark", master: str | None = None, **conf: str) -> SparkSession:
    """Return the active session, or build one; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether the session runs in one process, where all enabled functions are woken at once."""
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, as in tests, may go without the setting; it then gets
    a temporary folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomspark.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="loomspark-")
    spark.conf.set("loomspark.shared.dir", found)
    return found


def _leaves(kind: DataType) -> int:
    """The columns that a file has for a type."""
    if isinstance(kind, StructType):
        return sum(_leaves(f.dataType) for f in kind.fields)
    return _leaves(kind.elementType) if isinstance(kind, ArrayType) else 1


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan starts anew, and a lost executor costs a re-read.

    A reader's task takes files up to some bytes on disk, which can be a fortieth of
    those in memory. Files of ``FILE_VALUES`` values bound it, as each counts as a few MB to open.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", max(1000, FILE_VALUES // _leaves(df.schema))).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
