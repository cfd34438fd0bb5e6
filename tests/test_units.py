"""Unit vectors: identities, tokens, links, ranks, refrains, markers, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.errors import EngineError
from folio.functions import text as tx
from folio.operators import catalog, evals, ingest, rank, search, signatures, similarity
from folio.plans.queries import QUERIES


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_paragraph_identity(spark):
    assert one(spark, tx.fnv1a(F.col("t")), t="Fixture body.") == "d6c69fac"
    assert one(spark, tx.paragraph_id(F.col("t")), t="  Fixture body.\n") == "p-d6c69f"


def test_offsets(spark):
    got = one(spark, tx.with_offsets(tx.paragraphs(F.col("t"))), t="a\n\n  bc \n \n\n\nd")
    assert [(p["offset"], p["text"]) for p in got] == [(0, "a"), (3, "bc"), (7, "d")]
    assert one(spark, tx.offsets_of(F.col("t"), F.lit("ab")), t="xxabyabab") == [2, 5, 7]
    assert one(spark, tx.offsets_of(F.col("t"), F.lit(r"\E.")), t=r"a\E.b") == [1]


def test_tokens(spark):
    assert one(spark, tx.term_tokens(F.col("t")), t="The Don't-stop of  duty ab") == ["don't", "stop", "duty"]
    assert one(spark, tx.language_tokens(F.col("t"), F.lit("fr")), t="L’âme au-delà, les Êtres") == ["âme", "au-delà", "êtres"]
    with pytest.raises(Exception, match="unknown language"):
        one(spark, tx.language_tokens(F.col("t"), F.lit("xx")), t="a")


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])])
def test_ngrams(spark, n, want):
    assert one(spark, tx.ngrams(F.col("t"), n), t=["a", "b", "c"]) == want


def test_scripts_and_titles(spark):
    assert one(spark, tx.script(F.col("t")), t="नमस्ते ab") == "devanagari"
    assert one(spark, tx.script(F.col("t")), t=" \n") == "empty"
    assert one(spark, tx.generic_title(F.col("t")), t=" Chapter  12") is True
    assert one(spark, tx.fold("t"), t="Viṣṇu É") == "visnu e"
    assert one(spark, tx.work_slug(F.lit("Ünï Author"), F.col("t"), F.lit("12-34-5678")), t="A Title!") == "uni-author-a-title-123456"


def test_tfidf_and_links(spark):
    d = spark.createDataFrame([(1, ["dharma", "creation", "alpha"]), (2, ["dharma", "creation", "beta"]), (3, ["dharma", "gamma", "gamma"])], "doc_id long, tokens array<string>")
    w = {(r.doc_id, r.term): r.w for r in similarity.weights(d).collect()}
    assert "dharma" not in {t for _, t in w} and w[3, "gamma"] == pytest.approx(2 * np.log(3))
    pairs = similarity.cosine_pairs(similarity.weights(d)).collect()
    a, b = np.log(1.5), np.log(3)
    assert [(r.a, r.b) for r in pairs] == [(1, 2)] and pairs[0].cosine == pytest.approx(a * a / (a * a + b * b))


def test_ranks():
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 0.9
    r, v = rank.ranked(star, 0.1)
    assert r.sum() == pytest.approx(1) and r.argmax() == 0 and v > 0.005
    even, flat = rank.ranked(np.full((3, 3), 0.5), 0.1)
    assert np.allclose(even, 1 / 3) and flat < 0.005
    assert rank.page_rank(np.zeros((0, 0))).tolist() == [] and rank.page_rank(np.zeros((1, 1))).tolist() == [1.0]


def test_refrains():
    long = [str(i) for i in range(40)]
    near, nearer = long[:-1] + ["x"], long[:-2] + ["y", "x"]
    assert rank.refrain_groups([long, ["a"], near, nearer, ["a"], ["b"]]) == [[0, 2, 3], [1, 4]]
    assert rank.common_prefix([["a", "b", "c"], ["a", "b"], ["a", "b", "d"]]) == ["a", "b"]
    assert rank.edit_distance([], []) == 0 and rank.edit_distance(["a"], []) == 1


def test_npmi_universal_pair_dropped(spark):
    g = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["a", "b"]), (1, 2, ["a", "b", "c"])], "key long, unit long, tokens array<string>")
    got = {(r.a, r.b): r.npmi for r in signatures.npmi(g).collect()}
    assert ("a", "b") not in got and all(-1 <= v <= 1 for v in got.values())


def test_running_max_equals_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(d, p, "Mn", int(c), int(v)) for d in range(5) for p, (c, v) in enumerate(rng.integers(1, 9, (80, 2)))]
    m = spark.createDataFrame(rows, "doc long, pos long, prefix string, chapter long, verse long")
    want = set()
    for d in range(5):
        last = (0, 0)
        for dd, p, _, c, v in rows:
            if dd == d and (c, v) > last:
                last = (c, v)
                want.add((d, p))
    assert {(r.doc, r.pos) for r in ingest.monotone(m).collect()} == want


def test_inline_citation_is_no_marker(spark):
    b = spark.createDataFrame([(1, "one Mn_1.1\n\nsee Mn_1.2 here\n\ntwo || Mn_1.3 ||")], "doc long, body string")
    assert [(r.pos, r.chapter, r.verse) for r in ingest.markers(b).orderBy("pos").collect()] == [(0, 1, 1), (2, 1, 3)]


def test_strategies():
    assert search.strategies("a b") == ["a b", "a* b*"] and search.strategies("") == []
    assert search.strategies('"x" y*') == ['"x" y*']


def test_errors(spark, sf):
    with pytest.raises(EngineError) as e:
        catalog.passage(spark.read.parquet(f"{sf}/documents.parquet"), start=3, end=1)
    assert e.value.code == "BAD_QUERY" and e.value.payload()["error"]["hint"]


def test_null_cost_poisons_a_case(spark):
    s = spark.createDataFrame([("a", 1, 2.0), ("a", 1, None), ("b", 1, 1.5)], "k string, tokens long, cost double")
    assert {r.k: r.cost for r in evals.usage(s, "k").collect()} == {"a": None, "b": 1.5}


def tables(spark, path, rows):
    """A folder with documents of (doc_id, text, source)."""
    d = spark.createDataFrame([(i, t, "en", src, len(t)) for i, t, src in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_read_chapter_reads_every_id(spark, tmp_path):
    sf = tables(spark, tmp_path, [(5, "a", "src5"), (400, "b", "src5"), (90_000, "c", "src5"), (6, "d", "src6")])
    assert sorted(r.doc_id for r in QUERIES["o026_read_chapter"](spark, sf).collect()) == [5, 400, 90_000]


def test_drift_beyond_the_first_characters(spark, tmp_path):
    sf = tables(spark, tmp_path, [(11, "1" * 250 + "end", "s"), (22, "1" * 250, "s"), (13, "1" * 250 + "end", "s")])
    assert [(r.doc_id, r.drift) for r in QUERIES["o014_drift"](spark, sf).collect()] == [(11, "changed")]


def test_unknown_work_or_chapter(spark, sf):
    from folio.errors import EngineError
    from folio.operators import catalog
    from folio.sources.tables import documents

    d = documents(spark, sf)
    for call in (catalog.list_chapters, catalog.metadata, catalog.read_chapter):
        with pytest.raises(EngineError) as e:
            call(d, "nowhere")
        assert e.value.payload()["error"]["code"] == "WORK_NOT_FOUND"
    with pytest.raises(EngineError) as e:
        catalog.read_chapter(d, "src5", -1)
    assert e.value.code == "CHAPTER_NOT_FOUND"


@pytest.mark.parametrize("rows", [0, 1, 3, 7, 30])
def test_spread_has_one_schema(spark, rows):
    from folio.operators import evals

    df = evals.spread(spark.range(rows).selectExpr("id + 100 as k", "'x' as other"), "k", 7)
    want = sorted({i * rows // 7 for i in range(7)}) if rows else []
    assert df.columns == ["k", "place"] and sorted((r.k, r.place) for r in df.collect()) == [(100 + p, p) for p in want]


def test_containing_equals_brute_force(spark, monkeypatch):
    from folio.errors import EngineError
    from folio.operators import search

    texts = {1: "The quick brown fox. It ran", 2: "a quick  brown fox", 3: None, 4: "", 5: "xthe QUICK brown foxes", 6: "fox"}
    needles = {1: "the quick brown fox", 2: "quick brown", 3: "FOX", 4: "", 5: None, 6: "quick  brown fox", 7: "e quick brown f", 8: "no such words here"}
    d = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    n = spark.createDataFrame([*needles.items()], "id long, needle string")
    got = sorted(map(tuple, search.containing(d, n, "id").select("id", "doc_id").collect()))
    assert got == sorted((i, k) for i, x in needles.items() for k, t in texts.items() if x and t and x.lower() in t.lower())
    monkeypatch.setattr(search, "SHORT_NEEDLES", 1)
    with pytest.raises(EngineError):
        search.containing(d, n, "id")


def test_spread_of_many_rows(spark):
    """Places fit the rows whatever the partitions; equal keys and nulls (last) have places too."""
    from folio.operators import evals

    many = 300_000
    df = spark.range(0, many, 1, 9).selectExpr("pmod(id * 7919, 300000) as k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for a table too large for one partition
    try:
        assert sorted((r.k, r.place) for r in evals.spread(df, "k", 7).collect()) == [(i * many // 7,) * 2 for i in range(7)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    few = spark.createDataFrame([(k,) for k in [5] * 6 + [9] + [None] * 3], "k long")
    assert [(r.k, r.place) for r in evals.spread(few, "k", 5).orderBy("place").collect()] == [(5, 0), (5, 2), (5, 4), (9, 6), (None, 8)]


def test_ends_of_many_slices_are_no_loss(spark):
    """60 chapters have 59 blank lines between them; content that is lost is still reported."""
    b = spark.createDataFrame([(1, "\n\n".join(f"{'words and more words ' * 4}// Mn_{c}.1 //" for c in range(1, 61)))], "doc long, body string")
    source = ingest.native(ingest.markers(b))
    kept = ingest.monotone(source)
    s = ingest.slices(b, kept)
    assert ingest.validated(b, source, s, kept).collect() == []
    assert ("content-conservation", "98") in {(r.validator, r.detail) for r in ingest.validated(b, source, s.where("chapter <> 7"), kept).collect()}


def most_rows(df):
    """The rows that the plan node with most of them made."""
    df.collect()

    def walk(p):
        while hasattr(p, "executedPlan") and p.nodeName() == "AdaptiveSparkPlan" or "QueryStage" in p.nodeName():
            p = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan()
        m = p.metrics().get("numOutputRows")
        own = [m.get().value()] if m.isDefined() else []
        return max(own + [walk(p.children().apply(k)) for k in range(p.children().size())], default=0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_burrows_delta_rows_grow_with_the_words(spark):
    """As brute force; a chapter does not meet all words of its work."""
    rng = np.random.default_rng(2)
    rows = [(d, f"src{d % 2}", [f"own{d}x{k}" for k in range(60)] + [f"c{k}" for k in rng.geometric(0.1, 40)]) for d in range(80)] + [(80, "src2", ["alone"]), (81, "src1", [])]
    toks = spark.createDataFrame(rows, "doc_id long, source string, tokens array<string>")
    df = signatures.burrows_delta(toks, 20)
    want = {}
    for d, source, ts in rows:
        others = [x for x in rows if x[1] == source and x[0] != d]
        freq = {t: [x[2].count(t) / len(x[2]) if x[2] else 0.0 for x in others] for t in {t for x in others for t in x[2]}}
        best = sorted(freq, key=lambda t: (-round(sum(freq[t]), 12), t))[:20]
        z = [abs(((ts.count(t) / len(ts)) if ts else 0.0) - np.mean(freq[t])) / np.std(freq[t]) for t in best if np.std(freq[t]) > 1e-9]
        want[d] = np.mean(z) if z else 0.0
    assert {r.doc_id: r.delta for r in df.collect()} == {d: pytest.approx(v, abs=1e-4) for d, v in want.items()}
    assert most_rows(df) < 30_000  # 80 chapters of about 70 words; the works have 2,400 words
