"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.session import shared_folder

#: The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WORD_SPACE = b" \t\n\x0b\x0c\r"


#: Rows of an Arrow batch while a table is written: texts are long, and a batch is held on both sides of the pipe.
ARROW_ROWS = 2000
_ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release() -> None:
    """Give memory that a task has freed back to the machine; workers live on and would keep it from other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that releases memory when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read of its files, never a recomputation,
    and rows that Python made are made once.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_ARROW_ROWS_KEY)
    conf.set(_ARROW_ROWS_KEY, min(int(before) if int(before) > 0 else ARROW_ROWS, ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(_ARROW_ROWS_KEY, before)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no result reads any more."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
