"""Passage ranking inside a document (TextRank, LexRank) and refrains. Each document's graph is one Arrow group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAMPING, ROUNDS, CHANGE = 0.85, 50, 1e-6
TEXT_EDGE, LEX_EDGE, REFRAIN = 0.1, 0.2, 0.05


def confidence(variance: Column) -> Column:
    return F.when(variance < 0.005, "low").when(variance < 0.02, "medium").otherwise("high")


def similarity_matrix(units: list[list[str]]) -> np.ndarray:
    """Cosines of tf-idf vectors of units among themselves: count times ln(n / df)."""
    terms: dict[str, int] = {}
    for u in units:
        for t in u:
            terms.setdefault(t, len(terms))
    x = np.zeros((len(units), len(terms)))
    for i, u in enumerate(units):
        for t in u:
            x[i, terms[t]] += 1
    df = (x > 0).sum(0)
    x = x * np.log(len(units) / np.maximum(df, 1))
    norm = np.sqrt((x * x).sum(1))
    x = x / np.where(norm > 0, norm, 1)[:, None]
    return x @ x.T


def page_rank(edges: np.ndarray) -> np.ndarray:
    """Damped ranks over a weighted graph, which sum to 1. A node without edges passes nothing on; none: an empty result."""
    n = len(edges)
    if n < 2:
        return np.ones(n)
    out = edges.sum(1)
    flow = np.where(out[:, None] > 0, edges / np.where(out > 0, out, 1)[:, None], 0.0)
    r = np.full(n, 1.0 / n)
    for _ in range(ROUNDS):
        new = (1 - DAMPING) / n + DAMPING * (flow.T @ r)
        done = np.abs(new - r).sum() < CHANGE
        r = new
        if done:
            break
    return r / r.sum()


def ranked(similarity: np.ndarray, least: float, binary: bool = False) -> tuple[np.ndarray, float]:
    """Ranks over the edges of at least `least` (weighing 1 if binary), and their variance around 1 / n."""
    e = np.where(similarity >= least, 1.0 if binary else similarity, 0.0)
    np.fill_diagonal(e, 0.0)
    r = page_rank(e)
    return r, float(((r - 1 / max(1, len(r))) ** 2).mean()) if len(r) else 0.0


def passage_ranks(units: DataFrame) -> DataFrame:
    """(doc_id, pos, textrank, lexrank, variance) over (doc_id, pos, tokens). A document's paragraphs make one group."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("pos").to_pylist(), t.column("tokens").to_pylist(), strict=True))
        s = similarity_matrix([u for _, u in rows])
        a, v = ranked(s, TEXT_EDGE)
        b, _ = ranked(np.where(s >= LEX_EDGE, 1.0, 0.0), 0.5)
        n = len(rows)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int64()), pa.array([p for p, _ in rows], pa.int64()), pa.array(a), pa.array(b), pa.array([v] * n)], names=["doc_id", "pos", "textrank", "lexrank", "variance"])

    return units.select("doc_id", "pos", "tokens").groupBy("doc_id").applyInArrow(run, "doc_id long, pos long, textrank double, lexrank double, variance double")


def edit_distance(a: list[str], b: list[str]) -> float:
    """Levenshtein over tokens, by the longer one's length; 0 for two empty ones."""
    if not a and not b:
        return 0.0
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1] / max(len(a), len(b))


def common_prefix(units: list[list[str]]) -> list[str]:
    out = []
    for column in zip(*units):  # noqa: B905  the shortest one ends it
        if len(set(column)) > 1:
            break
        out.append(column[0])
    return out


def refrain_groups(units: list[list[str]], threshold: float = REFRAIN) -> list[list[int]]:
    """Groups of two or more units that are linked by distances of at most threshold, larger groups first.

    Equal units are one; the rest is compared where lengths allow the distance.
    """
    kinds: dict[tuple[str, ...], list[int]] = {}
    for i, u in enumerate(units):
        kinds.setdefault(tuple(u), []).append(i)
    keys = sorted(kinds, key=lambda k: (len(k), kinds[k][0]))
    up = list(range(len(keys)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, a in enumerate(keys):
        for j in range(i + 1, len(keys)):
            b = keys[j]
            if len(b) - len(a) > threshold * len(b):
                break
            if root(i) != root(j) and edit_distance(list(a), list(b)) <= threshold:
                up[root(j)] = root(i)
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        groups.setdefault(root(i), []).extend(kinds[k])
    return sorted((sorted(g) for g in groups.values() if len(g) > 1), key=lambda g: (-len(g), g[0]))


def refrains(units: DataFrame, threshold: float = REFRAIN) -> DataFrame:
    """(doc_id, group, size, phrase, positions) over (doc_id, pos, tokens)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("pos").to_pylist(), t.column("tokens").to_pylist(), strict=True))
        groups = refrain_groups([u for _, u in rows], threshold)
        return pa.table(
            [pa.array([key[0].as_py()] * len(groups), pa.int64()), pa.array(range(len(groups)), pa.int32()), pa.array([len(g) for g in groups], pa.int64()), pa.array([" ".join(common_prefix([rows[i][1] for i in g])) for g in groups], pa.string()), pa.array([",".join(str(rows[i][0]) for i in g) for g in groups], pa.string())],
            names=["doc_id", "group", "size", "phrase", "positions"],
        )

    return units.select("doc_id", "pos", "tokens").groupBy("doc_id").applyInArrow(run, "doc_id long, group int, size long, phrase string, positions string")
