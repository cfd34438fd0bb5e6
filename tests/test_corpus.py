"""Corpus trees, sinks, and the errors of chapter operators."""

import json

import pytest
from pyspark.errors import PySparkException

from folio.errors import EngineError
from folio.operators import corpus, ingest
from folio.sources import files, tree
from pyspark.sql import functions as F


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


@pytest.fixture
def made(tmp_path):
    put(tmp_path / "manifest.json", json.dumps({"works": [{"slug": "a b", "title": "A"}, {"slug": "c", "title": "C"}, {"slug": "empty", "title": "E"}]}))
    for work, chapter, n in (("a b", "01-x", 1), ("a b", "02-y", 2), ("c", "01-z", 1)):
        at = tmp_path / "works" / work / "chapters" / chapter
        put(at / "meta.json", json.dumps({"chapter_number": n, "chapter_slug": chapter, "default_variant": "translation.md", "variants": [{"file": "translation.md", "content_type": "translation"}]}))
        put(at / "translation.md", f"---\ntitle: T{n}\n---\n\nbody {work} {n}")
    put(tmp_path / "works/a b/chapters/01-x/translation.paragraphs.json", json.dumps([{"id": "p-1", "pos": 0, "offset": 0, "text": "body"}]))
    put(tmp_path / "works/c/chapters/01-z/translation.paragraphs.json", json.dumps({"paragraphs": []}))
    put(tmp_path / "works/c/chapters/02-no-meta/translation.md", "no header")
    return str(tmp_path)


def test_root(spark, made, tmp_path):
    assert tree.root(spark, [f"{made}/nowhere", made]) == made
    with pytest.raises(EngineError) as e:
        tree.root(spark, [f"{made}/nowhere"])
    assert e.value.code == "CORPUS_NOT_FOUND"


def test_tree(spark, made):
    assert [r["slug"] for r in tree.manifest(spark, made).collect()] == ["a b", "c", "empty"]
    assert sorted((r["work"], r["chapter_number"]) for r in tree.metas(spark, made).collect()) == [("a b", 1), ("a b", 2), ("c", 1)]
    v = tree.variants(spark, made)
    got = {(r["work"], r["chapter"]): (r["header"].get("title"), r["body"]) for r in v.collect()}
    assert got[("a b", "02-y")] == ("T2", "body a b 2") and got[("c", "02-no-meta")] == (None, "no header") and len(got) == 4
    listed = {(r["work"], r["chapter"]): [p["id"] for p in r["paragraphs"]] for r in tree.with_paragraphs(v, tree.sidecars(spark, made)).collect()}
    assert listed == {("a b", "01-x"): ["p-1"], ("a b", "02-y"): [], ("c", "01-z"): [], ("c", "02-no-meta"): []}
    assert sorted((r["work"], r["chapter_number"], r["layout"]) for r in tree.loaded(spark, made).collect()) == [("a b", 1, "prose"), ("c", 1, "prose")]
    assert [r["work"] for r in tree.loaded(spark, made, only="c").collect()] == ["c"]


def test_tree_without_files(spark, tmp_path):
    assert tree.sidecars(spark, str(tmp_path)).count() == 0 and tree.metas(spark, str(tmp_path)).count() == 0


def test_pool(spark, tmp_path):
    put(tmp_path / "a.json", '[{"id": 1},\n {"id": 2}]')
    put(tmp_path / "a.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    for name in ("a.json", "a.jsonl"):
        assert sorted(r["id"] for r in tree.pool(spark, str(tmp_path / name)).collect()) == [1, 2]


def test_sink_writes_only_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert files.write_if_changed(one, path)
    assert not files.write_if_changed(one.orderBy(F.desc("k")), path)
    assert files.write_if_changed(one.union(one.limit(1)), path)  # a repeated row is a change
    assert files.write_if_changed(spark.read.parquet(path).where("k = 1"), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 2
    assert not files.exists(spark, path + ".backup") and not files.exists(spark, path + ".staging")


def test_swap_mends_a_broken_run(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(3)
    files.swapped(old, path)
    files.move(spark, path, path + ".backup")  # broke off between the moves
    files.swapped(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not files.exists(spark, path + ".backup")


def test_changed_rows_of_nulls(spark):
    new = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    old = spark.createDataFrame([(1, None), (2, "z")], "k long, v string")
    assert sorted(r["k"] for r in files.changed(new, old, "k", "v").collect()) == [2, 3]


def test_plan_needs_one_folder(spark):
    sliced = spark.createDataFrame([("w", "a.md", 2), ("w", "b.md", 1), ("w", "b.md", 2)], "work string, file string, chapter long")
    one = spark.createDataFrame([("w", "x")], "work string, folder string")
    r = corpus.planned(one, sliced).first()
    assert (r["chapters"], r["n_chapters"], r["n_variants"]) == ([1, 2], 2, 2)
    with pytest.raises(PySparkException, match="expected 1 chapter folder"):
        corpus.planned(one.union(spark.createDataFrame([("w", "y")], one.schema)), sliced).collect()


def test_wiki_errors(spark):
    works = spark.createDataFrame([("w",), ("v",)], "slug string")
    cards = spark.createDataFrame([("w", None, "card", "# w")], "work string, chapter long, kind string, markdown string")
    assert corpus.read_wiki(cards, works, "w").first()["path"] == "works/w/wiki/_work.card.md"
    for args, code in ((("x",), "WORK_NOT_FOUND"), (("v",), "WIKI_NOT_BUILT"), (("w", 1), "WIKI_FILE_MISSING"), (("w", None, "full"), "WIKI_FILE_MISSING")):
        with pytest.raises(EngineError) as e:
            corpus.read_wiki(cards, works, *args)
        assert e.value.code == code


def test_heading_forms(spark):
    text = spark.createDataFrame([("## Adhyāya 1\nx\n## Adhyaya 2\n## Canto 3",), ("no heading",)], "t string")
    assert [(r[0]["n"], r[0]["form"]) for r in text.select(ingest.strongest_heading(F.col("t"))).collect()] == [(3, "h2"), (0, None)]
