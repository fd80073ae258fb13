"""The pipeline's stages against plain versions, one by one and on odd rows."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline
from loomspark.llm.pii import mask

D = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, each run on what its predecessor kept."""
    docs, found = spark.read.parquet(f"{D}/documents.parquet"), {}
    found["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, D).collect(), docs.schema) if name != "packing" else stage(spark, docs, D)
        found[name] = docs.collect()
    return found


def test_stages_keep_the_columns_of_documents(stages):
    columns = stages["documents"][0].__fields__
    assert all(stages[name][0].__fields__ == columns for name, _ in corpus_pipeline.STAGES[:-1])


def test_quality_drops_what_fails_the_base_rules(stages):
    kept = {r.doc_id for r in stages["quality_rules"]}
    for r in stages["documents"]:
        if brute.quality(r.text)[5]:
            assert r.doc_id not in kept
    assert len(kept) > 0.5 * len(stages["documents"])


def test_one_of_each_group_of_near_copies_stays(stages):
    before = [(r.doc_id, r.text) for r in stages["quality_rules"]]
    part = brute.jaccard(before, 5, 80)
    assert sorted(r.doc_id for r in stages["ngram_jaccard"]) == sorted({p for _, p in part.values()})


def test_personal_data_is_masked(stages):
    text = {r.doc_id: r.text for r in stages["ngram_jaccard"]}
    for r in stages["pii"]:
        assert r.text == mask(text[r.doc_id]) and r.n_chars == len(r.text)
        assert brute.pii(r.text)[0] == [0, 0, 0, 0]
    assert len(stages["pii"]) == len(text)


def test_mixing_samples_and_packing_keeps_all(stages):
    mixed = {r.doc_id for r in stages["mixing"]}
    assert mixed <= {r.doc_id for r in stages["pii"]} and mixed
    tokens = Counter()
    for r in stages["packing"]:
        tokens[r.doc_id] += r.length
    assert set(tokens) == mixed and all(tokens[r.doc_id] == r.doc_tokens for r in stages["packing"])


def test_run_equals_its_stages(spark, stages):
    key = lambda r: (r.doc_id, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, D).collect())) == sorted(map(key, stages["packing"]))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, 1, "x")] * 2 + [(1, "", "en", "src1", 0, 1, "x"), (2, "word " * 30000, None, "new", 9, 2, "y")]])
def test_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS + ", row int, __row string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        assert name == "packing" or docs.columns == columns
    docs.collect()
