"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet where they share a seed of SEED words. Running Karp-Rabin then repeatedly marks the
longest non-overlapping matches of the item's words in the document's, so passages are found in any order, cut up or
moved; an item leaks where tiles cover at least COVERAGE of its words.

The benchmark is held in blocks of at most BLOCK_CHARS characters: one pass over the documents for each block, so what is
held by the driver and broadcast has a fixed bound, however large the benchmark.

Null and empty texts leak nothing. Items of fewer than SEED words, or null, are never matched. Repeated documents each
have their rows; an item_id given twice is tested for each of its texts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_append, discard, load, materialize, tune

WORD = re.compile(r"[^\W_]+")
#: Words of a seed, and so of the shortest tile; the share of an item's words that must lie in tiles.
SEED, COVERAGE = 5, 0.5
BLOCK_CHARS = 16_000_000
BASE = np.uint64(0x100000001B3)
ROLL, MODULUS = 1_000_003, (1 << 61) - 1
WALL = -1


def karp_rabin(a: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values."""
    if len(a) < n:
        return np.empty(0, np.uint64)
    x = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    h = np.zeros(len(a) - n + 1, np.uint64)
    for j in range(n):
        h = h * BASE + x[j : len(a) - n + 1 + j]
    return h


def tile(item: list[int], text: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of item by text: tiles (start in item, start in text, length), none overlapping in either.

    Running Karp-Rabin: at search length s, unmarked runs of s words that hash alike are extended; a match over 2s starts
    again at its length; else the matches of at least s are marked from the longest, and s is halved down to `least`.
    What is left of a match that a longer one has covered in part goes back into the queue. WALL in text matches nothing.
    """
    free_i, free_t = [True] * len(item), [x != WALL for x in text]
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(len(item), len(text)))

    def prefixes(seq: list[int]) -> list[int]:
        out = [0]
        for x in seq:
            out.append((out[-1] * ROLL + x + 2) % MODULUS)
        return out

    def runs(sums: list[int], free: list[bool], n: int) -> list[tuple[int, int]]:
        """Place and rolling hash of each run of n free words."""
        out, run, power = [], 0, pow(ROLL, n, MODULUS)
        for k, ok in enumerate(free):
            run = run + 1 if ok else 0
            if run >= n:
                out.append((k - n + 1, (sums[k + 1] - sums[k - n + 1] * power) % MODULUS))
        return out

    sums_i, sums_t = prefixes(item), prefixes(text)
    while True:
        table: dict[int, list[int]] = {}
        for a, h in runs(sums_i, free_i, s):
            table.setdefault(h, []).append(a)
        found, longest = [], 0
        for b, h in runs(sums_t, free_t, s):
            for a in table.get(h, ()):
                if item[a : a + s] != text[b : b + s]:
                    continue
                if a and b and free_i[a - 1] and free_t[b - 1] and item[a - 1] == text[b - 1]:
                    continue  # part of the match that begins one word before
                n = s
                while a + n < len(item) and b + n < len(text) and free_i[a + n] and free_t[b + n] and item[a + n] == text[b + n]:
                    n += 1
                found.append((-n, a, b))
                longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        heapq.heapify(found)
        while found:
            n, a, b = heapq.heappop(found)
            free = [x and y for x, y in zip(free_i[a : a - n], free_t[b : b - n], strict=True)]
            if all(free):
                free_i[a : a - n] = free_t[b : b - n] = [False] * -n
                tiles.append((a, b, -n))
                continue
            start = 0
            for k, ok in enumerate([*free, False]):
                if not ok:
                    if k - start >= s:
                        heapq.heappush(found, (start - k, a + start, b + start))
                    start = k + 1
        if s == least:
            return sorted(tiles)
        s = max(least, s // 2)


class Items:
    """A block of benchmark items, with the seeds that lead to them."""

    def __init__(self, rows: list[tuple[int, str]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item_id, text in rows:
            words = WORD.findall((text or "").lower())
            if len(words) >= SEED:
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        pairs = [(int(h), k) for k, (_, ids) in enumerate(self.items) for h in karp_rabin(np.array(ids), SEED)]
        self.by_seed: dict[int, list[int]] = {}
        for h, k in sorted(set(pairs)):
            self.by_seed.setdefault(h, []).append(k)
        self.seeds = np.array(sorted(self.by_seed), np.uint64)

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items that leak into it."""
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.seeds):
            return out
        get = self.vocabulary.get
        at = 0
        while at < len(texts):
            end, flat, starts = at, [], []
            while end < len(texts) and (end == at or len(flat) < 1 << 20):
                starts.append(len(flat))
                flat += [get(w, 0) for w in WORD.findall((texts[end] or "").lower())]
                flat.append(0)
                end += 1
            ids = np.array(flat, np.int64)
            h = karp_rabin(ids, SEED)
            if len(h):
                alien = np.cumsum(np.concatenate([[0], ids == 0]))
                whole = np.flatnonzero(alien[SEED:] == alien[:-SEED])  # no word outside the block's vocabulary
                hw = h[whole]
                k = np.minimum(np.searchsorted(self.seeds, hw), len(self.seeds) - 1)
                hits = whole[self.seeds[k] == hw]
                owners = np.searchsorted(starts, hits, "right") - 1
                for o in np.unique(owners):
                    out[at + o] = self._tiled(flat, hits[owners == o], h)
            at = end
        return out

    def _tiled(self, flat: list[int], places: np.ndarray, h: np.ndarray) -> list[dict]:
        by_item: dict[int, list[int]] = {}
        for p in places.tolist():
            for k in self.by_seed[int(h[p])]:
                by_item.setdefault(k, []).append(p)
        out = []
        for k, at in sorted(by_item.items()):
            item_id, ids = self.items[k]
            text: list[int] = []  # only the words under seeds can lie in a tile
            end = -1
            for p in at:
                if p > end:
                    text.append(WALL)
                    end = p
                text += flat[end : p + SEED]
                end = p + SEED
            if self.coverage * len(ids) > SEED * len(at):
                continue  # too few words under seeds
            tiles = tile(ids, text)
            covered = sum(n for _, _, n in tiles)
            if covered >= self.coverage * len(ids):
                out.append({"item_id": item_id, "coverage": covered / len(ids), "matched_words": covered, "item_words": len(ids), "n_tiles": len(tiles)})
        return out


LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched_words", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("n_tiles", T.LongType())])


def blocks(benchmark: DataFrame) -> tuple[int, Iterator[Items]]:
    """How many blocks of bounded size the benchmark has, split by a hash of the text; and each, gathered when it is asked for."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = rows.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0
    n = int(chars // BLOCK_CHARS) + 1
    n = 2 * n if n > 1 else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, (Items(sorted((tuple(r) for r in rows.where(part == k).collect()), key=lambda r: (r[0] is None, r))) for k in range(n))


def with_leaks(df: DataFrame, shared: Broadcast, text: str = "text", keep: list[str] | None = None, out: str = "leaks") -> DataFrame:
    return arrow_append(df, T.StructType([T.StructField(out, T.ArrayType(LEAK))]), lambda c: {out: shared.value.leaks(c[0].to_pylist())}, [text], keep)


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each document and item that leaks into it."""
    keep = keep or ["doc_id"]
    n, parts = blocks(benchmark)
    out: DataFrame | None = None
    for items in parts:
        shared = df.sparkSession.sparkContext.broadcast(items)
        found = with_leaks(df, shared, text, keep).where(F.size("leaks") > 0).select(*keep, F.inline("leaks"))
        if n > 1:  # one block at a time: its leaks are written, and it is released before the next is gathered
            found = materialize(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows into which no item leaks."""
    columns = [f"`{c}`" for c in df.columns]
    name = "_leaks"
    while name in df.columns:
        name += "_"
    n, parts = blocks(benchmark)
    for items in parts:
        shared, before = df.sparkSession.sparkContext.broadcast(items), df
        df = with_leaks(df, shared, text, out=name).where(F.size(name) == 0).select(*columns)
        if n > 1:
            df = materialize(df, "clean")
            shared.destroy()
            discard(before)
    return df


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, coverage, matched_words, item_words, n_tiles: a row for each leak; a clean document has none."""
    tune(spark)
    return leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
