"""Self-join of documents on the Jaccard similarity of their 5-word shingles, by T-occurrence search.

Two sets x and y of similarity 3/4 share at least T = ceil(3/4 |x|) of x's shingles. DivideSkip splits x's inverted
lists: the T - 1 longest need no merging, since a partner must occur in one of the others. So

1.  every document's set is hashed from its whole text; equal sets have equal keys and count once;
2.  keys that share STAR of their LOWEST lowest hashes with the least one of a list are compared with it (linear in the
    lists), and linked ones joined into components, so a large group of near copies never spells out its pairs;
3.  the short lists, of each set's |x| - T + 1 rarest shingles (frequent ones last, then by hash), are built, and those
    that lie in more than one component are kept;
4.  each query's short lists are merged, with those of the queries in its bucket: for each other key that it meets the
    shared shingles and the last places of one are counted (by sorting runs, which counts what a heap counts). A pair
    stays unless either set has missed more shingles, up to the last shared one, than a link allows;
5.  parity sketches of the sets give a lower bound of their difference, which ends most pairs that are not linked; for
    the rest x's other, long lists are probed: its shingles are searched for in y's sorted set, and the pair is linked
    when the overlap reaches its T.

All steps are complete: any order of the shingles gives all linked pairs of different components, and no sketch exceeds
the difference of two sets. What counts as frequent (the heaviest shingles that repeat within a partition, at most
FREQUENT) only shortens lists. A list of more than PART entries is merged in parts, each a task's group of its own.

Null, empty or blank text: an empty set, linked with nothing. Fewer than 5 words: the whole sequence is the one shingle.
Rows of one doc_id are one node, also when their texts differ. Null doc_id: its rows link with nothing and have no
component. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import begin, components, discard, files, give_back, load, materialize, tune

WORDS, SHARE_OF, SHARE = 5, 100, 75  # linked when SHARE_OF * intersection >= SHARE * union
#: Lowest hashes by which near copies find each other early, and how many they share; bound of the frequent shingles;
#: entries of a list's part; shingles that a worker counts at once; pairs that it counts at once.
LOWEST, STAR, FREQUENT, PART, COUNTED, PAIRS = 8, 3, 200_000, 2048, 4_000_000, 2_000_000
#: Rounds of the early comparisons.
ROUNDS = 2
#: Bytes of a posting (shingle, key, place), bytes of them that a bucket should hold, postings of a message to the buckets,
#: entries that a bucket of the merge should hold.
POSTING, BUCKET_BYTES, MESSAGE, ENTRIES = 18, 24_000_000, 500_000, 50_000
#: Rows with sketches, and rows with whole sets, that go into one file.
SKETCHED, WHOLE = 5_000, 2_000
#: Bits of the filter by which documents that take part are picked; it is of this size whatever the input.
FILTER_BITS = 1 << 26

#: Bytes of text that are hashed at once.
CHUNK = 1 << 18

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a lower-cased text."""
    b = np.frombuffer(raw, np.uint8)
    word = ~BLANK[b]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = ends - starts
    inner = np.flatnonzero(word)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(inner)) - np.repeat(firsts, sizes)
    powers = np.cumprod(np.concatenate([[1], np.full(int(sizes.max()), 0x5851F42D4C957F2D)]).astype(np.uint64))
    return mix(np.add.reduceat(BYTE_KEYS[b[inner]] * powers[place], firsts) ^ sizes.astype(np.uint64)), starts


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each run of WORDS words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(WORDS, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n))
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
    return mix(h)


def sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set, sorted, as signed 64-bit numbers."""
    out = []
    at = 0
    while at < len(texts):
        raw: list[bytes] = []
        size = 0
        while at + len(raw) < len(texts) and (not raw or size < CHUNK):
            raw.append((texts[at + len(raw)] or "").encode("utf-8", "surrogatepass").translate(LOWER))
            size += len(raw[-1])
        words, starts = word_hashes(b" ".join(raw))
        bounds = np.searchsorted(starts, np.cumsum([0, *[len(r) + 1 for r in raw]]))
        out += [np.unique(shingle_hashes(words[a:b]).view(np.int64)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        at += len(raw)
    return out


def least_overlap(n: int) -> int:
    """T: the shingles of a set of n that any partner shares."""
    return -(-SHARE * n // SHARE_OF)


def pair_overlap(a: int, b: int) -> int:
    """The least intersection of linked sets of a and b."""
    return -(-SHARE * (a + b) // (SHARE_OF + SHARE))


def probe(query: np.ndarray, candidate: np.ndarray) -> int:
    """How many of query's shingles a binary search finds in the candidate's."""
    at = np.searchsorted(candidate, query)
    return int((candidate[np.minimum(at, len(candidate) - 1)] == query).sum()) if len(candidate) else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or SHARE_OF * len(a) < SHARE * len(b):
        return False
    return probe(a, b) >= pair_overlap(len(a), len(b))


def sketch(s: np.ndarray) -> bytes:
    """For each of 64 or more cells, at least two for each shingle, whether it holds an odd number of them; as bits."""
    cells = 1 << max(6, int(2 * len(s) - 1).bit_length())
    odd = np.bincount(mix(s.view(np.uint64)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """No two sets of these sketches differ in fewer shingles: the larger sketch is folded to the smaller one's cells."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n)) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def tally(queries: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """query, other, shingles shared, place of the last in the query, in the other, n of the query, of the other: a row for
    each pair that meets in a list.

    queries and others have columns shingle, key, component, weight, n, place; others is sorted by shingle. Pairs are of
    the same list, of sizes that a link allows; the other one's component ranks lower, by weight and then by number.
    """
    begin, end = (np.searchsorted(others[:, 0], queries[:, 0], side) for side in ("left", "right"))
    size = end - begin
    x = np.repeat(queries, size, axis=0)
    y = others[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
    fits = ((y[:, 3] < x[:, 3]) | (y[:, 3] == x[:, 3]) & (y[:, 2] < x[:, 2])) & (SHARE_OF * np.minimum(x[:, 4], y[:, 4]) >= SHARE * np.maximum(x[:, 4], y[:, 4]))
    x, y = x[fits], y[fits]
    order = np.lexsort((y[:, 1], x[:, 1]))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:, 1] != x[:-1, 1]) | (y[1:, 1] != y[:-1, 1])])[: len(x)])
    if not len(first):
        return [np.empty(0, np.int64)] * 7
    return [x[first, 1], y[first, 1], np.diff(np.append(first, len(x))), np.maximum.reduceat(x[:, 5], first), np.maximum.reduceat(y[:, 5], first), x[first, 4], y[first, 4]]


def may_link(shared, mine, theirs, n, m):
    """Whether sets of n and m, whose short lists share so many shingles up to these places, may be linked.

    Up to the last shared one neither may have missed more than n - T or m - T, T = ceil(SHARE (n + m) / (SHARE_OF + SHARE)).
    """
    whole = SHARE_OF + SHARE
    return (whole * (n - 1 + shared - mine) >= SHARE * (n + m)) & (whole * (m - 1 + shared - theirs) >= SHARE * (n + m))


KIND = pa.list_(pa.struct([("shingle", pa.int64()), ("uses", pa.int64())]))
SEEN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("low", pa.list_(pa.int64())), ("sketch", pa.binary()), ("often", KIND)])


def key_of(s: np.ndarray) -> int | None:
    """What stands for a set: 64 bits of its digest."""
    return int.from_bytes(hashlib.md5(s.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True) if len(s) else None


def first_pass(docs: DataFrame) -> DataFrame:
    """From (doc_id, th, text): doc_id, th, n, key, low (its lowest hashes), sketch; and rows with n = -1 that hold, in
    often, the shingles that repeat in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        held: list[np.ndarray] = []
        size = 0

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 2], counts[counts > 2]
            often = pa.array([[{"shingle": v, "uses": c} for v, c in zip(values.tolist(), counts.tolist(), strict=True)]], KIND)
            return pa.RecordBatch.from_arrays([pa.array([-1 if f.name == "n" else None], f.type) for f in SEEN][:-1] + [often], schema=SEEN)

        for b in batches:
            got = sets(b.column(2).to_pylist())
            for s in got:
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield repeated()
                    held, size = [], 0
            columns = [b.column(0), b.column(1), [len(s) for s in got], [key_of(s) for s in got], [s[:LOWEST] for s in got], [sketch(s) if len(s) else None for s in got], [None] * len(got)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, SEEN, strict=True)], schema=SEEN)
        if size:
            yield repeated()
        held = []
        give_back()

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, key long, low array<bigint>, sketch binary, often array<struct<shingle:bigint,uses:bigint>>")


def chosen_by(spark: SparkSession, values: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test, for Python workers, that all of the numbers in `values` (one column of longs) pass and few others.

    FILTER_BITS bits in all, whatever the number of values: the driver gathers pieces of 4 KiB at most.
    """
    at = F.pmod(F.xxhash64(values.columns[0]), F.lit(FILTER_BITS))
    pieces = values.select(F.shiftright(at, 15).alias("piece"), F.pmod(at, F.lit(32768)).alias("bit"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r.piece * 4096 : (r.piece + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def passes(places: np.ndarray) -> np.ndarray:
        return shared.value[places >> 3] >> (places & 7) & 1 == 1

    return passes


def picked(table: DataFrame, column: str, passes: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of the table whose column passes the filter."""
    kind, names = table.schema, table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        for b in batches:
            ok = passes(b.column(len(names)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=names).filter(pa.array(ok, pa.bool_()))

    return table.withColumn("_at", F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))).mapInArrow(run, kind)


def verified(docs: DataFrame, heads: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """The linked ones of the pairs (u, v) of keys, a table that materialize wrote and that goes; the links are written.

    rows: how many heads there are.
    """
    spark = docs.sparkSession
    few = files(spark, rows)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("key"))

    def both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        a = table.select(F.col("key").alias("u"), F.col(column).alias("a"))
        b = table.select(F.col("key").alias("v"), F.col(column).alias("b"))
        return pairs.join(a, "u").join(b, "v")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        for b in batches:
            n, m = ([x["n"] for x in b.column(k).to_pylist()] for k in (2, 3))
            s, t = ([x["sketch"] for x in b.column(k).to_pylist()] for k in (2, 3))
            ok = [SHARE_OF * min(x) >= SHARE * max(x) and least_difference(*y) <= sum(x) - 2 * pair_overlap(*x) for x, y in zip(zip(n, m, strict=True), zip(s, t, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        for b in batches:
            got = sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in got], pa.binary())], names=["key", "set"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        for b in batches:
            a, c = ([np.frombuffer(x, np.int64) for x in b.column(k).to_pylist()] for k in (2, 3))
            ok = pa.array([linked(x, y) for x, y in zip(a, c, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(ok)

    some = picked(heads.select("key", F.struct("n", "sketch").alias("s")), "key", chosen_by(spark, ends(pairs)))
    left = materialize(both(pairs.select("u", "v"), some, "s").select("u", "v", "a", "b").mapInArrow(near, "u long, v long").repartition(few), "pairs")
    discard(pairs)
    named = heads.join(ends(left).distinct(), "key", "left_semi").select("key", "node", "th")
    named = materialize(named.repartition(few), "named")
    texts = picked(docs.select("doc_id", "th", "text"), "doc_id", chosen_by(spark, named.select("node")))
    texts = texts.join(named.withColumnRenamed("node", "doc_id"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("key", "text")
    s = materialize(texts.coalesce(files(spark, rows, WHOLE)).mapInArrow(whole, "key long, set binary"), "sets")
    out = materialize(both(left, s, "set").select("u", "v", "a", "b").mapInArrow(probed, "u long, v long").repartition(few), "links")
    discard(s, left, named)
    return out


def short_lists(docs: DataFrame, often: np.ndarray, buckets: int) -> DataFrame:
    """(shingle, key, place) of the short lists that hold more than one key; place: the shingle's place in the set's order.

    Postings travel as packed columns, a message for each MESSAGE of them and bucket of shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(often))  # at most FREQUENT numbers

    def messages(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(s) for _, s in held])
        shingle, key = np.concatenate([s for _, s in held]), np.repeat(np.array([k for k, _ in held], np.int64), sizes)
        place = (np.arange(len(shingle)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
        bucket = ((shingle.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        columns = [[x.tobytes() for x in np.split(c[order], cuts)] for c in (shingle, key, place)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][np.concatenate([[0], cuts])], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "shingle", "key", "place"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngram_join")
        frequent = shared.value
        held: dict[int, np.ndarray] = {}
        size = 0
        for b in batches:
            for s in sets(b.column(0).to_pylist()):
                if not len(s) or (key := key_of(s)) in held:
                    continue
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                held[key] = s[: len(s) - least_overlap(len(s)) + 1].copy()
                size += len(held[key])
                if size >= MESSAGE:
                    yield messages([*held.items()])
                    held, size = {}, 0
        if size:
            yield messages([*held.items()])
        held = {}
        give_back()

    def several(key: tuple, table: pa.Table) -> pa.Table:
        begin("ngram_join")
        give_back()  # of the group before
        shingle, owner, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("shingle", np.int64), ("key", np.int64), ("place", np.uint32)))
        order = np.lexsort((owner, shingle))
        shingle, owner, place = shingle[order], owner[order], place[order]
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        own = new | np.concatenate([[True], owner[1:] != owner[:-1]])
        shingle, owner, place, new = shingle[own], owner[own], place[own], new[own]
        sizes = np.diff(np.append(np.flatnonzero(new), len(shingle)))
        keep = np.repeat(sizes > 1, sizes)
        return pa.table([pa.array(shingle[keep]), pa.array(owner[keep]), pa.array(place[keep].astype(np.int64))], names=["shingle", "key", "place"])

    packed = docs.select("text").mapInArrow(prefixes, "bucket long, shingle binary, key binary, place binary")
    return packed.groupBy("bucket").applyInArrow(several, "shingle long, key long, place long")


def merged(lists: DataFrame, labels: DataFrame, entries: int) -> DataFrame:
    """Candidate pairs (u, v) of keys of different components that share enough of their short lists.

    labels: (key, n, component, weight), weight the keys of the component. Components are ranked by weight and number; of
    a pair the key in the higher one is the query, so the entries of a list's highest component need not travel, and no
    pair inside a component is met. Queries are dealt to buckets by key, with all their lists: a list travels once to each
    bucket that holds some of its queries, packed, PART entries at a time, and there all that a pair shares is counted in
    one place, for as many queries at once as have PAIRS entries.
    """
    rank = F.struct("weight", "component")
    now = lists.join(labels, "key").repartition("shingle")
    ends = now.groupBy("shingle").agg(F.max(rank).alias("top"), F.min(rank).alias("low"), F.count(F.lit(1)).alias("all")).where("low.component <> top.component")
    now = now.join(ends, "shingle")
    entry = F.struct("key", "component", "weight", F.col("n").alias("n"), "place")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("all") / PART)).alias("part")
    others = now.where(rank != F.col("top")).groupBy("shingle", part).agg(F.collect_list(entry).alias("others"))
    buckets = max(32, entries // ENTRIES)
    bucket = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(buckets)).alias("bucket")
    queries = now.where(rank != F.col("low")).groupBy("shingle", bucket).agg(F.collect_list(entry).alias("queries"))

    def flat(shingle: np.ndarray, column: pa.ChunkedArray) -> np.ndarray:
        c = column.combine_chunks()
        inner = c.flatten()
        sizes = np.diff(c.offsets.to_numpy())
        return np.stack([np.repeat(shingle, sizes), *[inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]], axis=1)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        begin("ngram_join")
        give_back()  # of the group before
        shingle, part = (table.column(c).to_numpy() for c in ("shingle", "part"))
        rest = flat(shingle, table.column("others"))
        rest = rest[np.argsort(rest[:, 0], kind="stable")]
        # A list of several parts comes with its queries as often.
        first = np.zeros(len(shingle), bool)
        first[np.unique(shingle, return_index=True)[1]] = True
        mine = flat(shingle[first], table.column("queries").filter(pa.array(first)))
        met = np.searchsorted(rest[:, 0], mine[:, 0], "right") - np.searchsorted(rest[:, 0], mine[:, 0], "left")
        turns = int(met.sum()) // PAIRS + 1
        turn = (mix(mine[:, 1].astype(np.uint64)) % np.uint64(turns)).astype(int)
        u, v = [], []
        for k in range(turns):
            a, b, *counts = tally(mine[turn == k], rest)
            ok = may_link(*counts) if len(a) else np.zeros(0, bool)
            u.append(a[ok])
            v.append(b[ok])
        return pa.table([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])

    rows = queries.join(others, "shingle").select("bucket", "shingle", "part", "queries", "others")
    return rows.groupBy("bucket").applyInArrow(run, "u long, v long")


def starred(heads: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(u, v): keys and, of the least ones of their LOWEST lists, those that share STAR of these and lie in other components.

    Least is by doc_id in the first turn (what was there first is what others copy), then by a hash.
    """
    low = heads.select("key", "node", "n", F.explode("low").alias("shingle"))
    rank = F.struct("node", "key") if not turn else F.struct(F.xxhash64("key", F.lit(turn)), "key")
    least = low.groupBy("shingle").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle", F.col("least.key").alias("v"))
    pairs = low.join(least, "shingle").where("key <> v").groupBy(F.col("key").alias("u"), "v").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
    pairs = pairs.where(F.col("shared") >= F.least(F.lit(STAR), F.col("n"))).select("u", "v")
    if not turn:
        return pairs
    now = labels.select("key", "component")
    both = pairs.join(now.toDF("u", "a"), "u").join(now.toDF("v", "b"), "v")
    return both.where("a <> b").select("u", "v")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """From (doc_id, th, text), th a hash of text: seen, a row for each document; heads, one for each set (key, its least
    doc_id as node, that row's th); edges (u, v) between keys, which join all linked sets; and the number of heads. Rows
    without a doc_id are in seen only."""
    spark = docs.sparkSession
    seen = materialize(first_pass(docs), "shingles")
    docs = docs.where("doc_id is not null and text is not null")
    rest = F.min(F.struct("doc_id", "th")).alias("least")
    heads = seen.where("key is not null and doc_id is not null").groupBy("key").agg(rest, F.first("n").alias("n"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
    heads = heads.select("key", F.col("least.doc_id").alias("node"), F.col("least.th").alias("th"), "n", "low", "sketch")
    heads = materialize(heads.coalesce(files(spark, seen.count(), SKETCHED)), "heads")
    rows, total = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = files(spark, rows)
    labels, edges = heads.select("key", "n", F.col("key").alias("component")), []
    for turn in range(ROUNDS):
        early = verified(docs, heads, materialize(starred(heads, labels, turn).repartition(few), "stars"), rows)
        edges.append(early)
        joined = components(reduce(DataFrame.unionByName, edges), rows=rows).withColumnRenamed("node", "key")
        labels = heads.select("key", "n").join(joined, "key", "left").select("key", "n", F.coalesce("component", "key").alias("component"))
    weights = materialize(joined.groupBy("component").agg(F.count(F.lit(1)).alias("weight")).coalesce(few), "weights")  # of two keys or more
    labels = labels.join(weights, "component", "left").select("key", "n", "component", F.coalesce("weight", F.lit(1)).alias("weight"))
    labels = materialize(labels.repartition(few), "labels")
    heavy = seen.where("n < 0").select(F.inline("often")).groupBy("shingle").agg(F.sum("uses").alias("uses")).orderBy(F.desc("uses"), "shingle").limit(FREQUENT)
    often = np.array([r[0] for r in heavy.collect()], np.int64)
    buckets = max(8, int(total * POSTING * (SHARE_OF - SHARE) / SHARE_OF / BUCKET_BYTES))
    lists = materialize(short_lists(docs, often, buckets), "lists")
    late = verified(docs, heads, materialize(merged(lists, labels, lists.count()), "candidates"), rows)
    discard(lists, labels, weights)
    return seen.where("n >= 0").select("doc_id", "th", "n", "key"), heads, reduce(DataFrame.unionByName, [*edges, late]), rows


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each document (doc_id, text); the component is its least doc_id."""
    seen, heads, edges, rows = links(hashed(docs))
    node = heads.select("key", "node")
    ends = edges.join(node.select(F.col("key").alias("u"), F.col("node").alias("a")), "u").join(node.select(F.col("key").alias("v"), F.col("node").alias("b")), "v")
    # Rows of one doc_id are one node: it is joined with the nodes of all its sets.
    own = seen.where("key is not null and doc_id is not null").select("doc_id", "key").distinct().join(node, "key").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    final = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own), rows=rows)
    out = seen.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def leaders(docs: DataFrame) -> DataFrame:
    """(doc_id, th): of each group of linked texts the row with the least doc_id, of texts without a word each one.

    th is xxhash64(text). Groups are of texts: rows that share a doc_id only are not of one group. Rows without a doc_id
    are left out.
    """
    seen, heads, edges, rows = links(hashed(docs))
    final = components(edges, rows=rows).withColumnRenamed("node", "key")
    groups = heads.select("key", "node", "th").join(final, "key", "left").select(F.coalesce("component", "key").alias("component"), F.struct("node", "th").alias("row"))
    best = groups.groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.node").alias("doc_id"), "row.th")
    return best.unionByName(seen.where("key is null and doc_id is not null").select("doc_id", "th").distinct())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return link(load(spark, sf_dir, "documents").select("doc_id", "text"))
