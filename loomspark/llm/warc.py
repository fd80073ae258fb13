"""Content-addressed web archive.

Payloads are stored once, under the SHA-256 of their bytes; the exact bytes of
every record's header are stored apart and name the digest.  A join puts an
original record together again, and reading verifies digest and length of what
it joined.  A record whose payload another record already has is a revisit.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import discard, materialise
from loomspark.session import shared_folder

#: Payloads below this many bytes are never revisits.
SMALLEST_SHARED = 100
#: Bytes of payloads in one bucket of the store, and the most buckets that Spark's writer takes.
BUCKET_BYTES, MAX_BUCKETS = 256 << 20, 100_000
CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: Column) -> Column:
    """A header value without line breaks, which would end the header."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\\r\\n]+", " ")


def _header(id_: Column, url: Column, digest: Column, kind: Column, refers_to: Column, size: Column, date: str) -> Column:
    """The exact header bytes, up to and with the empty line; ids are percent-encoded, so that none can break a line."""
    name = lambda x: F.url_encode(F.coalesce(x.cast("string"), F.lit("")))
    id_text = name(id_)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), name(refers_to), F.lit(">"))))
    return F.encode(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), id_text, F.lit(">"))),
            line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _clean(url)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
            F.when(kind == "revisit", revisit).otherwise(F.lit("")),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("X-Payload-Length", size.cast("string")), line("Content-Length", F.when(kind == "revisit", "0").otherwise(size.cast("string"))), F.lit(CRLF),
        ),
        "UTF-8",
    )


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``path/payloads`` (digest, payload) and ``path/headers`` (id, digest, header bytes, small).

    Of records with equal payloads of at least SMALLEST_SHARED bytes the one with
    the smallest id is the response; rows that repeat that id are responses too.
    Smaller payloads are all responses and lie beside their header (``small``), so
    that no join meets a third of all rows under the digest of nothing.  A null
    payload is empty; a null id counts as larger than any other, and a group of
    null ids only has responses only.  Ids may hold any characters.  No other
    column is read.
    """
    raw = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    large = F.col("size") >= SMALLEST_SHARED
    # Digests are made once for the headers; payloads do not travel with them.
    named = materialise(rows.select("id", "url", "digest", "size", F.when(~large, F.col("payload")).alias("small")), "digests")
    # The smallest id of a digest is aggregated before the shuffle: a payload of a third of all rows is a row a task.
    first = named.filter(large).groupBy("digest").agg(F.min("id").alias("first_id"), F.first("size").alias("bytes"))
    stored = first.agg(F.sum("bytes")).first()[0] or 0
    keyed = named.filter(large).join(first.drop("bytes"), "digest").unionByName(named.filter(~large).withColumn("first_id", F.lit(None).cast(named.schema["id"].dataType)))
    revisit = large & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    kind, refers = F.when(revisit, "revisit").otherwise("response"), F.when(revisit, F.col("first_id"))
    header = _header(F.col("id"), F.col("url"), F.col("digest"), kind, refers, F.col("size"), date)
    keyed.select("id", "digest", header.alias("header"), "small").write.parquet(f"{path}/headers")
    # One copy a digest, bucketed by it: payloads are shuffled here once, copies before that dropped
    # within each task, and no later join by digest moves them again.  Buckets follow the bytes.
    buckets = min(MAX_BUCKETS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // BUCKET_BYTES)))
    store = rows.filter(large).select("digest", "payload").dropDuplicates(["digest"])
    store.repartition(buckets, "digest").write.bucketBy(buckets, "digest").option("path", f"{path}/payloads").saveAsTable(_table_name(path))
    discard(named)


def _table_name(path: str) -> str:
    """The name under which the session's catalog knows the buckets of an archive."""
    return f"warc_payloads_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload; with its buckets where this session's catalog has them, else as plain files."""
    name = _table_name(path)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(f"{path}/payloads")


def _field(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, f"(?:^|\\n){name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers as stored and their fields as parsed from the bytes."""
    held = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    return held.select(
        "id", "header", "small", F.regexp_extract(_field(text, "WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        _field(text, "WARC-Type").alias("record_type"), _field(text, "X-Payload-Length").cast("long").alias("payload_bytes"),
        F.url_decode(F.regexp_extract(F.coalesce(_field(text, "WARC-Refers-To"), F.lit("")), "^<urn:page:(.*)>$", 1)).alias("refers"),
    )


def read_archive(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """Records put together again: header fields, ``payload``, ``record`` bytes and ``verified``.

    A revisit's record has no body; with ``full`` its payload is joined all the
    same, so that every original payload is there.  ``verified`` says that the
    joined payload has the digest and the length that the header names.
    """
    headers, payloads = read_headers(spark, path), read_payloads(spark, path)
    wanted = F.col("small").isNull() & (F.lit(True) if full else F.col("record_type") == "response")
    joined = headers.filter(wanted).join(payloads, F.col("payload_digest") == F.col("digest"), "left").drop("digest")
    joined = joined.unionByName(headers.filter(~wanted).withColumn("payload", F.col("small"))).drop("small")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    verified = (F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    return joined.withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n"))).withColumn("verified", verified)


def archive_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages to an archive in the shared folder, read it back and report each record.

    Columns: id, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``.  For responses, size and digest are computed anew from the
    record bytes that were read; a payload that fails its check is an error.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(df, path, id_col, url_col, payload_col)
    kind = df.schema[id_col].dataType
    records = read_archive(spark, path)
    start = F.octet_length("header")
    body = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    response = F.col("record_type") == "response"
    sound = F.when(response & ~F.coalesce(F.col("verified"), F.lit(False)), F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("payload_digest"))).cast("long"))
    return records.withColumn("start", start).select(
        F.col("id").alias(id_col),
        F.coalesce(sound, F.when(response, F.octet_length(body)).otherwise(F.col("payload_bytes")).cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2(body, 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(~response, F.col("refers").cast(kind)).alias("refers_to"),
    )
