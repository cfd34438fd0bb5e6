"""The pipeline on a fixture with planted cases, each stage against its rule."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm.common import materialize


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest tables with planted rows and an extra column whose name an operator uses too."""
    path = str(tmp_path_factory.mktemp("planted"))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    leak = b.orderBy("item_id").first()["text"]
    base = d.where("lang = 'en' and n_chars between 2000 and 6000").orderBy("doc_id").first()
    rows = [(9001, base["text"], "en", "s", 1), (9002, "x. " + base["text"], "en", "s", 1), (9003, "the and of that with " + leak + " this was for", "en", "s", 1), (9004, "the mail of this is joe@acme.org and that was it for them", "en", "s", 1), (9005, "12 34 --", "en", "s", 1), (9006, None, "en", "s", 1)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.unionByName(extra).withColumn("score", F.lit("mine")).write.parquet(f"{path}/documents.parquet")
    b.write.parquet(f"{path}/benchmark.parquet")
    return path, base["doc_id"]


def test_stages(spark, folder):
    path, base = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, path), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe" or docs.columns == names
    assert 9005 not in seen["language_id"] and 9006 not in seen["language_id"] and 9004 in seen["language_id"]
    assert seen["language_id"][9004].score == "mine"
    assert base in seen["ngram_join"] and 9001 not in seen["ngram_join"] and 9002 not in seen["ngram_join"]
    assert 9003 in seen["ngram_join"] and 9003 not in seen["decontaminate"] and 9004 in seen["decontaminate"]
    assert "[EMAIL]" in seen["pii"][9004].text and seen["pii"][9004].n_chars == len(seen["pii"][9004].text)
    assert set(seen["bpe"]) == set(seen["pii"]) and all(r.n_tokens == len(r.ids) for r in seen["bpe"].values())


def test_empty(spark, folder, tmp_path):
    path, _ = folder
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_go_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (2, b), (7, c), (7, a + " zz"), (7, c), (8, None), (8, None), (9, "  "), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_doc", F.lit("mine"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, a), (0, a), (1, a), (2, b), (7, c), (8, ""), (9, "  ")]
