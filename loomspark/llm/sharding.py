"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a dense number in a deterministic order, a keyed permutation of
0..n-1 moves that number, and the moved number alone says the shard (remainder)
and the slot in it (quotient).  Nothing is sorted globally and no row count
besides the bounded table of bucket counts leaves the executors.  Only DataFrame
functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import materialise

#: Buckets that rows are numbered in.  A fixed number, so that the order of rows does not
#: depend on the cluster; their counts are all that the driver ever sees.
BUCKETS = 4096
ROUNDS = 6
#: Cycle-walking steps that are unrolled for every row; almost no row needs more.
UNROLLED = 3


def feistel(number: Column, left: int, right: int, seed: int) -> Column:
    """A bijection of 0..left*right-1, as an alternating Feistel network on two digits."""
    a, b = F.expr(f"{left}L"), F.expr(f"{right}L")
    hi, lo = F.call_function("div", number, b), number % b
    for k in range(ROUNDS):
        if k % 2 == 0:
            hi = F.pmod(hi + F.pmod(F.xxhash64(lo, F.lit(k), F.lit(seed)), a), a)
        else:
            lo = F.pmod(lo + F.pmod(F.xxhash64(hi, F.lit(k), F.lit(seed)), b), b)
    return hi * b + lo


def permute(df: DataFrame, number: str, n: int, seed: int) -> DataFrame:
    """Replace the long column ``number`` (0..n-1) by its place in a keyed permutation of 0..n-1.

    The network permutes the smallest digit grid that holds n numbers; a result
    outside is permuted again until it falls inside.  A walk meets each of the
    grid's outside numbers at most once, so that many steps always end it.
    """
    if n <= 1:
        return df
    left = math.isqrt(n - 1) + 1
    right = -(-n // left)
    outside = left * right - n
    inside = F.col(number) < F.expr(f"{n}L")
    df = df.withColumn(number, feistel(F.col(number), left, right, seed))
    for _ in range(min(UNROLLED, outside)):
        df = df.withColumn(number, F.when(inside, F.col(number)).otherwise(feistel(F.col(number), left, right, seed)))
    if outside > UNROLLED:
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(outside)),
            F.col(number),
            lambda at, _: F.when(at < F.expr(f"{n}L"), at).otherwise(feistel(at, left, right, seed)),
        )
        df = df.withColumn(number, F.when(inside, F.col(number)).otherwise(walk))
    return df


def number_rows(df: DataFrame, key: str, number: str, ties: list[str], seed: int) -> tuple[DataFrame, int]:
    """Add the dense global row number ``number``; returns the frame and the row count.

    Rows go to ``BUCKETS`` buckets by a hash of ``key`` and of the columns
    ``ties``; within a bucket the same columns order them.  Rows that are equal
    in all of these are interchangeable.  One pass reads the counts.
    """
    bucket, columns = "__bucket", [key, *ties]
    hashed = df.withColumn(bucket, F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(BUCKETS)).cast("int"))
    counts = {r[0]: r[1] for r in hashed.groupBy(bucket).count().collect()}
    starts, total = [], 0
    for b in range(BUCKETS):
        starts.append(total)
        total += counts.get(b, 0)
    offsets = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(*columns)).cast("long") - 1
    return hashed.withColumn(number, within + offsets[F.col(bucket)]).drop(bucket), total


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 20240229) -> DataFrame:
    """Deal the rows of ``df`` into ``shards`` shards in a reproducible random order.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``.  The law
    is ``rows``: shard sizes differ by one row at most, slots are gapless from 0.
    ``size`` is the text's UTF-8 bytes plus one; a null text counts as empty
    (size 1, checksum 0) and a null id is a key like any other.  Rows with the
    same id are told apart by checksum and size; fully equal rows take
    consecutive numbers in either order, with the same result.  An empty table
    gives no rows.  No other column of ``df`` is read, so clashing names are harmless.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = materialise(rows, "shard-keys")  # the texts are read once; both passes below read these few bytes a row
    numbered, n = number_rows(rows, id_col, "__number", ["text_crc32", "size"], seed)
    placed = permute(numbered, "__number", n, seed)
    at, by = F.col("__number"), F.expr(f"{shards}L")
    return placed.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"),
        (at % by).cast("int").alias("shard"), F.call_function("div", at, by).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
