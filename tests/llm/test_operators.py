"""The training-data operators against brute force, exact round trips and held-out rows."""

import itertools
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import bpe, common, decontaminate, embedding_dedup, langid, licenses, ngram_join, pii, quotes, sharding, toxicity


@pytest.fixture(autouse=True, scope="module")
def tuned(spark):
    common.tune(spark)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "word " * 30_000), (6, "a"), (None, "null id"), (7, "é🙂 中文 " * 50)]


# -- 1 ------------------------------------------------------------------------------------------------------------------


def cover(item, text, least=5):
    """The most words of item in non-overlapping common runs, marked from the longest, by comparing every pair of places."""
    free_i, free_t, total = set(range(len(item))), set(range(len(text))), 0
    while True:
        best = (0, 0, 0)
        for a, b in itertools.product(sorted(free_i), sorted(free_t)):
            n = 0
            while a + n in free_i and b + n in free_t and item[a + n] == text[b + n]:
                n += 1
            best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return total
        free_i -= set(range(a, a + n))
        free_t -= set(range(b, b + n))
        total += n


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(1)
    for n in [24] * 30 + list(range(5, 61, 5)) * 2:
        item, text = rng.integers(0, 3, n).tolist(), rng.integers(0, 3, 40).tolist()
        text += item[n // 4 : n // 2 + 3] + [7] + item[: n // 2] + [8] + item[n // 4 :]  # fragments that overlap and repeat
        tiles = decontaminate.tile(item, text)
        assert all(item[a : a + n] == text[b : b + n] and n >= 5 for a, b, n in tiles)
        spans = [set(range(a, a + n)) for a, _, n in tiles]
        assert sum(map(len, spans)) == len(set().union(*spans)) if spans else True
        assert sum(n for _, _, n in tiles) == cover(item, text)


def test_remainder_of_a_covered_match_is_a_tile(spark):
    item = [f"w{i}" for i in range(20)]
    text = " ".join(["x", *item[5:14], "y", *item[:8], "z", *item[5:10], "v"])
    got = decontaminate.leaks(docs(spark, [(1, text)]), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched_words) for r in got] == [(1, 9, 14)]


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"b{i}w{k}" for k in range(12))) for i in range(20)] + [(3, "again one two three four five")], "item_id long, text string")
    d = docs(spark, [(i, " ".join(f"b{i}w{k}" for k in range(12))) for i in range(25)] + [(30, "x again one two three four five"), (None, None)])
    want = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, bench).collect()) == want == [(i, i) for i in range(20)] + [(30, 3)]
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(d, bench).collect()) == [0, 20, 21, 22, 23, 24]


def test_leaks_reordered_passages(spark):
    item = " ".join(f"w{i}" for i in range(20))
    moved = " ".join(["x"] + [f"w{i}" for i in range(10, 20)] + ["y", "z"] + [f"W{i}," for i in range(10)])
    bench = spark.createDataFrame([(9, item), (8, None), (7, "too short")], "item_id long, text string")
    d = docs(spark, [*ODD, (20, moved), (21, " ".join(f"w{i}" for i in range(6))), (22, item), (22, item)])
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in decontaminate.leaks(d, bench).collect())
    assert got == [(20, 9, 1.0, 2), (22, 9, 1.0, 1), (22, 9, 1.0, 1)]
    extra = d.withColumn("leaks", F.lit(1)).withColumn("coverage", F.lit("c"))
    kept = decontaminate.clean(extra, bench)
    assert kept.columns == extra.columns and kept.count() == d.count() - 3
    assert decontaminate.leaks(d, bench.where("false")).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    mine, theirs = bpe.ByteBpe(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    letters = list("abcde  \n\té'sτ中🙂²_-.,!\x1c\x85\xa0　") + ["'ll", "<|endoftext|>", "the"]
    texts = ["", " ", "<|endoftext|>", "a" * 3000, " " * 500, "x  y", "a \n b", *("".join(rng.choice(letters, rng.integers(1, 120))) for _ in range(300))]
    for t, ids, e in zip(texts, mine.encode_batch(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids and mine.decode(ids) == theirs.decode(e.ids, skip_special_tokens=False) == t


def test_bpe_columns(spark):
    path = bpe.default_vocabulary()
    d = docs(spark, ODD).withColumn("n_tokens", F.lit("kept by nobody"))
    ids = bpe.encode(d, path, keep=["doc_id", "text"])
    back = bpe.decode(ids, path)
    assert all((r.text or "") == r.decoded and (r.doc_id != 1 or r.ids == []) for r in back.collect())
    assert bpe.digest(d.where("false"), path).count() == 0
    one = {r.doc_id: r for r in bpe.digest(d, path, keep=["doc_id"], out="ids").collect()}
    assert one[1].n_tokens == 0 and one[5].n_tokens == len(one[5].ids)


# -- 3 ------------------------------------------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    k, lengths = 3, [1, 4, 6]
    psi, step = rng.random((11, k)) + 0.1, rng.random((k, k)) + 0.1
    got, at = langid.blocked_marginals(psi, np.array(lengths), step, block=2), 0
    for n in lengths:
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            w = step.sum(0)[y[0]] * psi[at, y[0]]
            for t in range(1, n):
                w *= step[y[t - 1], y[t]] * psi[at + t, y[t]]
            for t in range(n):
                want[t, y[t]] += w
        assert np.allclose(want / want.sum(1, keepdims=True), got[at : at + n])
        at += n


def test_languages_held_out(spark, sf):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(big)
    got = langid.identify(big.withColumn("h", langid.held_out()), model, keep=["lang", "h"]).where("h").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    odd = {r.doc_id: r for r in langid.identify(docs(spark, [*ODD, (8, "12 34")]), model, keep=["doc_id"]).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3, 8))
    mixed = [x[2] for x in model.label_words("the of and that with der die das und nicht von les des que dans")]
    assert mixed[:4] == ["en"] * 4 and "de" in mixed and 0 <= odd[5].score <= 1
    none = langid.identify(docs(spark, ODD), langid.fit([]), keep=["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


# -- 4 ------------------------------------------------------------------------------------------------------------------


def test_licences():
    t = licenses.Templates()
    assert min(licenses.collision(g.least_similarity(k)) for g in t.groups for k, _ in g.members) > 0.999
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "the", "under", "gamma", "license"]
    texts = []
    for _ in range(60):
        pad = lambda: " ".join(rng.choice(words, rng.integers(0, 30)))
        texts.append(f"{pad()} é {licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))][1]} {pad()}")

    def brute(text):
        w = licenses.shingles(ngram_join.word_hashes(text.encode().translate(licenses.FOLD))[0])
        return {licenses.TEMPLATES[k][0] for g in t.groups for k, s in g.members if any(len(np.intersect1d(w[a : a + len(s)], g.sets[k])) == len(g.sets[k]) for a in range(len(w)))}

    for text, found in zip(texts, t.scan(texts), strict=True):
        assert {m["license"] for m in found} & brute(text) and all(m["containment"] >= licenses.CONTAINMENT for m in found)
        assert all(text[m["start"] : m["end"]].strip() == text[m["start"] : m["end"]] for m in found)
    assert t.scan([None, "", " ", "permission to license the software"]) == [[], [], [], []]


# -- 5 ------------------------------------------------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.05
    x = np.concatenate([base, near, base[:10], base[50:51].repeat(60, 0) + rng.normal(size=(60, 16)) * 0.02])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [1.0] * 8), (None, [1.0] * 16)]
    got = {r.vec_id: r for r in embedding_dedup.dedupe(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    comp = np.arange(len(x))
    for _ in range(20):
        comp = np.array([min(comp[i], comp[s[i]].min(initial=comp[i])) for i in range(len(x))])
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.99 * s.sum() and all(got[i].n_links <= s[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) > 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert got[None].n_links == 0 and not got[None].kept
    assert embedding_dedup.dedupe(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_of_one_id_are_one_node(spark):
    v = np.random.default_rng(3).normal(size=(3, 8)).tolist()
    rows = [(5, v[0]), (5, v[1]), (5, v[0]), (1, v[0]), (2, v[1]), (9, v[2]), (7, None), (7, v[2])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.dedupe(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (5, 1, 1), (5, 1, 1), (5, 1, 1), (7, 0, 7), (7, 1, 7), (9, 1, 7)]


def test_an_audit_without_links_measures_neighbours():
    x = np.random.default_rng(5).normal(size=(400, 8))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    unit = unit[(unit @ unit.T > 0.949).sum(1) == 1]
    g = embedding_dedup.Hnsw(unit, np.arange(len(unit))).build()
    norms = np.ones(len(unit))
    assert embedding_dedup.base_beam(g, unit, unit, norms, norms, embedding_dedup.BEAM, g.ids) > 0
    g.search = lambda q, start, beam, layer=0: (np.zeros((len(q), 1), int), np.zeros((len(q), 1)))
    assert embedding_dedup.base_beam(g, unit, unit, norms, norms, embedding_dedup.BEAM, g.ids) == 0


def skewed(hot, pairs=40):
    """Vectors (one large group, and pairs) and a graph of them whose searches find no vector outside the group."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(pairs, 16))
    x = np.concatenate([rng.normal(size=(1, 16)).repeat(hot, 0) + rng.normal(size=(hot, 16)) * 0.01, base, base + rng.normal(size=(pairs, 16)) * 0.01])
    g = embedding_dedup.Hnsw(x / np.linalg.norm(x, axis=1)[:, None], np.arange(len(x))).build()
    whole = g.within
    g.within = lambda *k: tuple(v[whole(*k)[1] < hot] for v in whole(*k))
    s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T >= embedding_dedup.THRESHOLD
    return g, x, s


@pytest.mark.parametrize("hot", [60, 300])  # of all links the group has 96 and over 99 %
def test_a_failed_audit_leads_to_brute_force(hot):
    g, x, s = skewed(hot)
    a, b = embedding_dedup.links(g, x, x)
    assert {*zip(a.tolist(), b.tolist(), strict=True)} == {*zip(*(v.tolist() for v in np.nonzero(s)), strict=True)}


def test_the_audit_is_by_query():
    truth = np.zeros((41, 400), bool)
    truth[0] = truth[1:21, 0] = truth[21:41, :100] = True
    hit = truth.copy()
    hit[1:21] = False  # 20 of 2,420 links, all of the small groups
    assert embedding_dedup.passes(truth, truth) and not embedding_dedup.passes(truth, hit)
    hit = truth.copy()
    hit[1] = False
    assert not embedding_dedup.passes(truth, hit)


# -- 6 ------------------------------------------------------------------------------------------------------------------


def jaccard_components(rows):
    own = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        own[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in own}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(own), 2):
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
            p, q = root(a), root(b)
            comp[max(p, q)] = min(p, q)
    return {i: (len(own[i]), root(i)) for i in own}


def test_ngram_join_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, " \n"), (6, "word " * 5000), (7, "word " * 7)]
    for g in range(25):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(8, 90)))]
        for c in range(int(rng.integers(1, 9))):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = f"e{rng.integers(1 << 30)}"
            rows.append((100 + 20 * g + c, " ".join(own) + (" " + shared if g % 3 == 0 else "")))
    want = jaccard_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, [*rows, (None, "a B")])).collect() if r.doc_id is not None}
    assert got == want
    assert ngram_join.link(docs(spark, [])).count() == 0


def test_divide_skip_and_probe():
    a, b = np.arange(0, 100), np.arange(10, 100)
    assert ngram_join.linked(a, b) and not ngram_join.linked(a, b[:60]) and not ngram_join.linked(a[:0], a[:0])
    own = np.array([(100 + p, 5, 5, 2, 10, p) for p in (0, 1, 5)])  # shingle, key, component, weight, n, place
    others = np.array([(100, 1, 1, 1, 10, 0), (100, 2, 2, 1, 10, 0), (101, 2, 2, 1, 10, 1), (105, 3, 3, 2, 10, 5), (105, 4, 5, 2, 10, 5), (105, 6, 6, 1, 90, 5), (105, 7, 4, 3, 10, 5)])
    u, v, *counts = ngram_join.tally(own, others)
    assert list(zip(u.tolist(), v.tolist(), counts[0].tolist(), strict=True)) == [(5, 1, 1), (5, 2, 2), (5, 3, 1)]
    assert ngram_join.may_link(*counts).tolist() == [True, True, False]  # the last one's sets have missed five shingles each


def test_parity_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(11)
    for n, m, common in ((100, 90, 80), (500, 400, 390), (40, 35, 0), (3, 3, 3), (1000, 1300, 900)):
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, n + m, dtype=np.int64))
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:common], x[n : n + m - common]]))
        got, true = ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b)), len(np.setxor1d(a, b))
        assert true / 3 <= got <= true


def test_ngram_join_of_repeated_ids_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 4)
    monkeypatch.setattr(ngram_join, "PAIRS", 10)
    monkeypatch.setattr(ngram_join, "STAR", 99)  # nothing is joined early
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[:39] + [f"own{i}"])) for i in range(30)] + [(100 + i, " ".join(words + [f"x{i}_{j}" for j in range(i)])) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, rows)).collect()}
    assert got == jaccard_components(rows)
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, a), (5, b), (1, a), (2, b), (9, b), (5, a), (7, None), (7, b + " x"), (None, a)]
    got = sorted((r.doc_id or 0, r.component_id) for r in ngram_join.link(docs(spark, rows)).collect())
    assert got == [(0, None)] + [(i, 1) for i in (1, 2, 5, 5, 5, 7, 7, 9)]
    kept = sorted(r.doc_id for r in ngram_join.leaders(docs(spark, rows)).collect())
    assert kept == [1, 2, 7]


def test_ngram_join_writes_few_files_of_many_partitions(spark, monkeypatch):
    written, plain = [], common.materialize

    def counted(df, label):
        out = plain(df, label)
        written.append((label, len(out.inputFiles())))
        return out

    for module in (ngram_join, common):
        monkeypatch.setattr(module, "materialize", counted)
    rows = [(10 * g + c, " ".join(f"g{g}w{i}" for i in range(c, 40))) for g in range(60) for c in range(4)]
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == jaccard_components(rows)
    few = spark.sparkContext.defaultParallelism
    assert {label for label, _ in written} >= {"heads", "stars", "pairs", "named", "sets", "links", "edges", "weights", "labels"}
    assert [x for x in written if x[0] not in ("lists", "candidates") and x[1] > few] == []


# -- 7 ------------------------------------------------------------------------------------------------------------------


def test_grammar():
    t = toxicity.Lexicon({"=moron": 5.0, "lowei": 4.0})
    kind = lambda s: [k for _, _, k, _ in t.clauses(s)]
    assert kind("x moron y") == ["plain"] and kind("you big moron") == ["aimed"] and kind("not a moron") == ["negated"]
    assert kind("She said moron. Moron!") == ["reported", "plain"] and kind("we will kill you") == ["threat"] and kind("kill") == []
    assert kind("das loweischaft") == ["plain"] and kind(None) == [] and kind("moronic") == []


def test_toxicity_held_out(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, y)
    got = toxicity.rate(d.withColumn("h", toxicity.held_out()), model, keep=["doc_id", "h"]).join(y, "doc_id").where("h").collect()
    clean = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(clean) < 0.05 and np.mean([r.score for r in got if r.toxic == 1]) > np.mean([r.score for r in got if r.toxic == 0]) + 0.3
    odd = {r.doc_id: r for r in toxicity.rate(docs(spark, ODD), model, keep=["doc_id"]).collect()}
    assert odd[1].score == odd[2].score and 0 <= odd[1].score < 0.5
    none = toxicity.fit(d, y.where("false"))
    assert {r.score for r in toxicity.rate(docs(spark, ODD), none).collect()} == {0.0}


def test_toxicity_of_every_language(spark):
    """Insults of a language with a twelfth of the toxic rows are learned; a text copied with small changes teaches nothing."""
    rng = np.random.default_rng(4)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(400)] for lang, letters in (("en", "abcdefgh"), ("es", "ijklmnop"), ("fr", "qrstuvwx"))}
    insult = {"en": "zzidiotz", "es": "ññbobo", "fr": "ççsotç"}
    prose = lambda lang: list(rng.choice(words[lang], 30))
    rows, tags = [], {}
    for lang, toxic, clean in (("en", 400, 600), ("es", 36, 300), ("fr", 36, 300)):
        for k in range(toxic + clean):
            tags[len(rows)] = lang
            rows.append((len(rows), " ".join([*prose(lang), *([insult[lang]] if k < toxic else [])]), int(k < toxic)))
    copied = [*prose("en"), "copyq"]
    for k in range(60):
        rows.append((len(rows), " ".join([*copied, f"y{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}", "zzidiotz"]), 1))
    d = docs(spark, [r[:2] for r in rows])
    model = toxicity.fit(d, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = toxicity.rate(d.withColumn("h", toxicity.held_out()), model, keep=["doc_id", "h"]).where("h").collect()
    label = {r[0]: r[2] for r in rows}
    for lang in insult:
        mine = [r for r in got if tags.get(r.doc_id) == lang]
        assert np.mean([r.predicted for r in mine if label[r.doc_id] == 1]) > 0.9, lang
        assert np.mean([r.predicted for r in mine if label[r.doc_id] == 0]) < 0.05, lang
    assert not model.lexicon.insult("copyq")


def test_fragments_of_harmless_words_give_way():
    rows = [("wor", 3.9, 103, 15), ("=worthless", 7.3, 100, 0), ("réeu", 4.0, 60, 1), ("=réeuxment", 4.2, 13, 0)]
    assert [f for f, _, _ in toxicity.distinct_marks(rows, 342, 2709)] == ["=worthless", "réeu", "=réeuxment"]


# -- 8 ------------------------------------------------------------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there everyone\nhow are you doing today"), (1, 1, "a", "> Hello there everyone\n> how are you doing today\n\nfine thanks a lot"),
        (1, 2, "u", "> > Hello there everyone\n> fine thanks a lot\n\ngreat to hear that"), (1, 3, "u", "A new topic is here"), (1, 4, "a", ">> Hello there  EVERYONE\nreply to the nested"),
        (1, 5, "u", "> A new topic is here\nok new topic reply"), (2, 0, "u", None), (2, 1, "u", ""), (None, 1, "u", "> x"), (3, 0, "u", "> nobody said this thing\nmine"), (4, 0, "u", "same words here"), (4, 0, "u", "same words here"), (4, 1, "a", "> same words here\nyes"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("clean", F.lit(1))
    got = quotes.thread(d).collect()
    key = {(r.conv_id, r.turn): (r.text, r.quote_levels, r.parent_turn, r.thread_turn, r.reply_depth) for r in got}
    assert len(got) == len(rows)
    assert key[1, 1] == ("fine thanks a lot", 1, 0, 0, 1) and key[1, 2] == ("great to hear that", 2, 1, 0, 2) and key[1, 4] == ("reply to the nested", 2, 0, 0, 1)
    assert key[1, 5] == ("ok new topic reply", 1, 3, 3, 1) and key[2, 0] == ("", 0, None, 0, 0) and key[3, 0] == ("mine", 1, None, 0, 0) and key[4, 1][2] == 0
    assert quotes.thread(d.where("false")).count() == 0
    plan = quotes.thread(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_parents(rows):
    """(conv_id, turn, text) to the turn that each row answers, by comparing words in place of hashes."""
    norm = lambda t: re.sub(r"[\s\xa0]+", " ", t.lower()).strip(" ")

    def kept(whole, parts):
        return [w for w in [norm(whole)] if w] + [w for w in map(norm, parts) if len(w) >= quotes.SHORTEST]

    read, first = [], {}
    for c, t, text in rows:
        lines = []
        for x in re.split(r"\r?\n", text or ""):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", x)
            lines.append((m.group(1).count(">"), x[m.end() :]) if m else (0, x))
        runs = []
        for k, (level, body) in enumerate(lines):
            if k and lines[k - 1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        runs = [r for r in runs if r[0]]
        clean = re.sub(r"\n{3,}", "\n\n", "\n".join(b for v, b in lines if not v)).strip() if runs else text or ""
        read.append((c, t, {(v, w) for v, b in runs for w in kept("\n".join(b), b)}))
        for w in kept(clean, clean.split("\n")):
            first[c, w] = min(t, first.get((c, w), t))
    out = []
    for c, t, quoted in read:
        letters = Counter()
        for v, w in quoted:
            if first.get((c, w), t) < t:
                letters[v, first[c, w]] += len(w)
        out.append(min(((v, -n, -at, at) for (v, at), n in letters.items()), default=(None,))[-1])
    return out


def test_quotes_against_words_compared(spark):
    rng = np.random.default_rng(8)
    words = ["yes.", "Thanks!", "ok", "the plan is fine", "see you\nat the station", "\u4f60\u597d", "#1", ".", "a  longer   answer", ""]
    rows = []
    for c in range(25):
        said = []
        for t in range(8):
            parts = [words[rng.integers(len(words))]]
            for _ in range(rng.integers(0, 3)):
                if said:
                    parts.insert(rng.integers(0, len(parts) + 1), "\n".join(rng.choice(["> ", ">"]) + x for x in said[rng.integers(len(said))].split("\n")))
            said.append("\n".join(parts))
            rows.append((c, t, "u", said[-1]))
    want = plain_parents([(c, t, x) for c, t, _, x in rows])
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[c, t] for c, t, _, _ in rows] == want and sum(x is not None for x in want) > 40


def test_short_passages_link_whole_messages_and_long_messages_parse_fast(spark):
    long = "\n".join(">" * (1 + i % 3) + f" line number {i}" for i in range(8000))
    rows = [(1, 0, "u", "Thanks!"), (1, 1, "a", "> thanks!\nwelcome"), (1, 2, "u", "no\nmore"), (1, 3, "a", "> no\nwhy"), (2, 0, "u", long)]
    start = time.time()
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_quotes) for r in quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1] == (0, 1) and got[1, 3] == (None, 1) and got[2, 0] == (None, 8000) and time.time() - start < 30


# -- 9 ------------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(s):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(s)], "ip": [m.span() for m in IP.finditer(s) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(s) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))], "phone": [m.span() for m in PHONE.finditer(s) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(9)
    letters = list("ab1234567890 .@+-()%_é") + ["4111111111111111", "10.0.0.1", "a@b.co", "@@"]
    for _ in range(3000):
        s = "".join(rng.choice(letters, rng.integers(1, 40)))
        assert pii.base_spans(s) == plain_spans(s), s


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [("mail bob (at) acme [dot] com now", "email", (5, 28)), ("x bоb@acme.com y", "email", (2, 14)), ("bob at acme dot com", "email", (0, 19)), ("card ４１１１１１１１１１１１１１１１ ok", "card", (5, 21)), ("call plus one five five five one two three four five six!", "phone", (5, 56))],
)
def test_disguises(text, kind, span):
    base, more = pii.find(text)
    assert span in more[kind]
    assert all(text[a:b] not in pii.masked(text) for a, b in [span])


def test_the_gate_opens_for_all_that_folds():
    folds = [c for c in map(chr, range(0x80, 0x110000)) if pii.plain(c) != c]
    assert len(folds) > 1000 and all(pii.TRIGGER.search(c) for c in folds) and not pii.TRIGGER.search("né 中文 Ö")


@pytest.mark.parametrize(("text", "kind"), [("bob\ufe6bacme.com", "email"), ("+①②③④⑤⑥⑦⑧⑨", "phone"), ("ana arroba acme punto com", "email"), ("uwe at acme punkt de", "email"), ("luc arroba acme point fr", "email")])
def test_disguises_need_no_other_disguise(text, kind):
    assert pii.added_spans(text, pii.base_spans(text))[kind] == [(0, len(text))]


@pytest.mark.parametrize("text", ["a dot b" + " " * 40_000, "(" * 5_000 + " " * 35_000, "x at " + "at dot " * 6_000, "( " * 20_000, "1 dot " * 7_000, "one " * 10_000 + "x"])
def test_scans_are_linear(text):
    import time

    began = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - began < 0.5


@pytest.mark.parametrize("text", ["192 dot 168 dot 1 dot 20", "one nine two dot one six eight dot one dot two zero", "10 punto 0 punto 0 punto 1"])
def test_addresses_with_words_for_dots(text):
    assert pii.find("x " + text + " y")[1]["ip"] == [(2, 2 + len(text))]


def test_at_this_point_is_no_address():
    assert pii.find("Look at this point in time; we met at that point it rained.")[1] == {k: [] for k in pii.KINDS}


def test_clean_text_is_left_alone(spark):
    for s in ("he was at the dot and zero one", "un deux", "meet at noon.", "", None):
        base, more = pii.find(s)
        assert not any(base.values()) and not any(more.values()) and pii.masked(s) == s
    d = docs(spark, [*ODD, (30, "a@b.co and a@b.co")]).withColumn("spans", F.lit("x"))
    out = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert out[30] == "[EMAIL] and [EMAIL]" and out[1] is None and out[5] == ODD[4][1]
    assert pii.detect(docs(spark, ODD), keep=["doc_id"]).where("doc_id = 1").first().spans == ""


# -- 10 -----------------------------------------------------------------------------------------------------------------


def test_sharding(spark, sf):
    out = sharding.op10_sharding(spark, sf).toPandas()
    by = out.groupby("shard")
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by) and by["size"].sum().max() - by["size"].sum().min() <= 0.05 * by["size"].sum().mean()
    sizes = {s: (s * 37) % 101 + 1 for s in range(sharding.SLOTS)}
    v1 = sharding.first_map()
    v2 = sharding.rebalance(v1, sizes)
    v3 = sharding.rebalance(v2, sizes, sharding.SHARDS + 1)
    assert sum(a != b for a, b in zip(v1, v2, strict=True)) < 100 and set(v3) == set(range(9))
    load = lambda v: [sum(sizes[s] for s, d in enumerate(v) if d == k) for k in sorted(set(v))]
    assert max(load(v3)) - min(load(v3)) <= sharding.TOLERANCE * sum(sizes.values()) / 9
    assert sharding.rebalance(v1, {}) == v1


def test_sharding_spreads_rows_without_id(spark, tmp_path):
    rows = [(None, f"text {i}") for i in range(600)] + [(5, f"again {i}") for i in range(300)] + [(6, None), (6, ""), (7, "same"), (7, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("vslot", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op10_sharding(spark, str(tmp_path)).toPandas()
    by = out.groupby("shard")
    assert len(out) == len(rows) and set(out["size"][out["doc_id"] == 6]) == {1}
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by) and by["size"].sum().max() - by["size"].sum().min() <= 0.05 * by["size"].sum().mean()
    assert out["vslot"][out["doc_id"].isna()].nunique() > 500 and out["vslot"][out["doc_id"] == 7].nunique() == 1


def test_sharding_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.op10_sharding(spark, str(tmp_path)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 160)]
    up = defaultdict(lambda: None)
    comp = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == comp and not up
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stored_maps_are_edited_never_overwritten(spark, tmp_path):
    path = f"{tmp_path}/maps"
    assert sharding.newest(spark, path) == 0
    v1 = sharding.first_map()
    sharding.save_map(spark, [v1], path)
    v2 = sharding.rebalance(sharding.read_map(spark, path), {s: s % 13 + 1 for s in range(sharding.SLOTS)})
    sharding.save_map(spark, [v2, v2], path)  # the first one is there already
    assert sharding.newest(spark, path) == 2
    assert sharding.read_map(spark, path, 1) == v1 and sharding.read_map(spark, path) == v2


def test_each_licence_is_named_by_itself():
    t = licenses.Templates()
    rng = np.random.default_rng(1)
    for name, text in licenses.TEMPLATES:
        assert [m["license"] for m in t.scan([f"some words {text} and more"])[0]] == [name], text
        words = text.split()
        if len(words) > 60:  # a twentieth of the words changed
            for k in rng.choice(len(words), len(words) // 20, replace=False):
                words[k] = "other"
            found = {m["license"] for m in t.scan([" ".join(words)])[0]}
            assert found == {name} or name == "BSD-3-Clause" and found <= {"BSD-2-Clause", name}, (name, found)


def test_licence_matches_of_many_copies_and_edges(spark):
    t = licenses.Templates()
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 2."
    found = t.scan([" x ".join([mit, gpl] * 500)])[0]
    assert [m["license"] for m in found] == ["MIT", "GPL-2.0"] * 500
    rows = [(1, mit, "a"), (None, mit, "a"), (2, None, "a"), (3, "", "a"), (1, mit, "a"), (4, "word " * 200_000 + gpl, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r["doc_id"] or 0, [m["license"] for m in r["matches"]]) for r in licenses.scan(df).collect())
    assert got == [(0, ["MIT"]), (1, ["MIT"]), (1, ["MIT"]), (2, []), (3, []), (4, ["GPL-2.0"])]
    assert licenses.scan(df.limit(0)).count() == 0
