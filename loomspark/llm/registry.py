"""The queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.embeddings import link_embeddings
from loomspark.llm.jaccard import link_ngrams
from loomspark.llm.mixing import Mixture, mix
from loomspark.llm.packing import pack
from loomspark.llm.pii import detect_pii
from loomspark.llm.quality import score_quality
from loomspark.llm.sharding import shard_rows
from loomspark.llm.suffixes import remove_repeats
from loomspark.llm.toxicity import score_toxicity
from loomspark.llm.warc import archive_round_trip

#: The production mixture: the hot source is cut back, languages are evened out, long texts are preferred.
MIXTURE = Mixture(
    source={f"src{k}": 0.05 for k in range(20)},
    lang={"en": 0.55, "fr": 0.17, "de": 0.16, "es": 0.12},
    topic={"note": 0.05, "article": 0.45, "longread": 0.46, "table": 0.04},
    fraction=0.5,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file that packing uses; its package lies beside the other libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), MIXTURE)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(_table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"), shards=8)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_ngrams(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_embeddings": op2_embeddings,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_suffixes": op10_suffixes,
}

#: Those that SQL can express in full; the others are fitted, need a tokenizer or a hash that SQL lacks.
ORACLES: dict[str, str] = {
    "op2_embeddings": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id""",
    "op3_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages), f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
        SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM p JOIN f USING (digest)""",
}
