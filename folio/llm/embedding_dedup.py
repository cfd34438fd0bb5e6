"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard of the vectors.

Equal vectors become one representative with a weight. Representatives are dealt to shards by hash, a graph is built for
each shard and written to a table, and every representative is searched for in every shard's graph. A search's beam is
widened while all that it holds lies above the threshold, and the shard's base beam is widened until an audit against
brute force passes: the mean over the audited queries with links of the part found is AUDIT, for those of small groups
also by themselves, self matches left out; where none of them has a link, NEAREST of their nearest neighbours are found.
If the widest beam fails too, the block is compared with the whole shard by brute force. Links are decided by the cosine
in double precision. Queries go through a shard in slices, of which only counts and a forest are kept.

A task returns for each query the weight of the links it found, and a spanning forest of them (not the pairs), so what
travels is linear in the vectors also inside large groups; the forests are joined into components.

Null or empty vectors, zero vectors and vectors with a null or non-finite component link with nothing. Vectors of
different lengths do not link. Null vec_id: no links, no component, not kept. Rows of one vec_id are one node, so they
share a component, also when their vectors differ; n_links is of the row's own vector, and counts each other vec_id that
holds a linked vector once for each such vector.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import components, discard, load, materialize, tune

THRESHOLD, AUDIT, NEAREST = 0.95, 0.99, 0.9
#: Links of a node above the ground layer (twice as many there), beam while building, first and last base beam of searches.
LINKS, BUILD_BEAM, BEAM, MOST_BEAM = 12, 40, 24, 768
#: A query of at most so many links is of a small group, which is audited apart; multiplications of a block of brute force.
SMALL, BRUTE = 24, 1 << 24
#: Shards at least, vectors of a shard and of a block of queries at most, audited queries of a block, bytes of a graph's part.
SHARDS, SHARD_ROWS, BLOCK_ROWS, AUDITED, PART_BYTES = 6, 200_000, 100_000, 128, 8_000_000
#: (query, node) pairs that a slice of queries can have at most, and its queries.
SLICE_PAIRS, SLICE = 1 << 24, 4096


def level_of(ids: np.ndarray) -> np.ndarray:
    """A layer for each id: geometric, from a hash of the id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(int), 12)


def repeated(cand: np.ndarray) -> np.ndarray:
    """Where a row names a node that it has named before."""
    order = np.argsort(cand, axis=1, kind="stable")
    own = np.take_along_axis(cand, order, 1)
    out = np.zeros(cand.shape, bool)
    np.put_along_axis(out, order[:, 1:], own[:, 1:] == own[:, :-1], 1)
    return out


class Hnsw:
    """A graph over unit vectors; all steps run on many nodes or queries at once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = np.ascontiguousarray(x, np.float32), ids
        self.levels = level_of(ids)
        self.near: list[np.ndarray] = []  # for each layer the nodes' neighbours, -1 where there is none
        self.entry = -1

    def build(self) -> Hnsw:
        n = len(self.x)
        order = np.argsort(-self.levels, kind="stable")  # high layers first: each layer's nodes are there when needed
        self.near = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.levels.max(initial=0)) + 1)]
        at, size = 0, 1
        while at < n:
            self._insert(order[at : at + size])
            at += size
            size = min(512, max(1, at))
        return self

    def _insert(self, new: np.ndarray) -> None:
        if self.entry < 0:
            self.entry = int(new[0])
            new = new[1:]
            if not len(new):
                return
        q = self.x[new]
        within = q @ q.T
        np.fill_diagonal(within, -2)
        top = len(self.near) - 1
        start = np.full(len(new), self.entry)
        for layer in range(top, -1, -1):
            here = self.levels[new] >= layer
            if not here.all():
                start[~here] = self._descend(q[~here], start[~here], layer)
            if here.any():
                mine = np.flatnonzero(here)
                ids, sims = self.search(q[mine], start[mine], BUILD_BEAM, layer)
                start[mine] = ids[:, 0]
                k = min(BUILD_BEAM // 2, len(mine))
                peers = np.argsort(-within[np.ix_(mine, mine)], axis=1, kind="stable")[:, :k]
                peer_sims = np.take_along_axis(within[np.ix_(mine, mine)], peers, 1)
                cand = np.concatenate([ids, np.where(peer_sims > -2, new[mine][peers], -1)], 1)
                cs = np.concatenate([sims, peer_sims], 1)
                width = self.near[layer].shape[1]
                chosen = self._diverse(cand, cs, LINKS)
                self.near[layer][new[mine], : chosen.shape[1]] = chosen
                self._back(new[mine], chosen, layer, width)

    def _diverse(self, cand: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
        """For each row up to k candidates: from the nearest on those nearer to the row than to any chosen one, then the nearest of the rest."""
        cand = np.where(repeated(cand), -1, cand)
        order = np.argsort(-np.where(cand >= 0, sims, -3), axis=1, kind="stable")[:, : max(2 * k, 32)]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(cand, 0)]
        mutual = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            closest = np.where(taken, mutual[:, j], -2).max(1)
            taken[:, j] = (cand[:, j] >= 0) & (sims[:, j] > closest) & (taken.sum(1) < k)
        rank = np.where(taken, 0, np.where(cand >= 0, 1, 2))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :k]
        return np.where(np.take_along_axis(rank, pick, 1) < 2, np.take_along_axis(cand, pick, 1), -1).astype(np.int32)

    def _back(self, nodes: np.ndarray, chosen: np.ndarray, layer: int, width: int) -> None:
        to, frm = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        ok = to >= 0
        to, frm = to[ok], frm[ok]
        sims = np.einsum("ij,ij->i", self.x[to], self.x[frm])
        order = np.lexsort((-sims, to))
        to, frm = to[order], frm[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        nth = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate([first, [len(to)]])))
        keep = nth < width
        to, frm, nth = to[keep], frm[keep], nth[keep]
        rows, inv = np.unique(to, return_inverse=True)
        more = np.full((len(rows), int(nth.max(initial=0)) + 1), -1, np.int32)
        more[inv, nth] = frm
        cand = np.concatenate([self.near[layer][rows], more], 1)
        cand = np.where((cand == rows[:, None]) | repeated(cand), -1, cand)
        cs = np.einsum("rd,rcd->rc", self.x[rows], self.x[np.maximum(cand, 0)])
        full = (cand >= 0).sum(1) > width
        packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)[:, :width]
        if full.any():
            packed[full] = self._diverse(cand[full], cs[full], width)
        self.near[layer][rows, : packed.shape[1]] = packed

    def _descend(self, q: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        """Greedy steps to the nearest node of a layer."""
        at = at.copy()
        best = np.einsum("ij,ij->i", q, self.x[at])
        rows = np.arange(len(q))
        while len(rows):
            nb = self.near[layer][at[rows]]
            sims = np.where(nb >= 0, np.einsum("rd,rcd->rc", q[rows], self.x[np.maximum(nb, 0)]), -2)
            j = sims.argmax(1)
            s = sims[np.arange(len(rows)), j]
            up = s > best[rows] + 1e-7
            rows, j, s, nb = rows[up], j[up], s[up], nb[up]
            at[rows], best[rows] = nb[np.arange(len(rows)), j], s
        return at

    def entries(self, q: np.ndarray) -> np.ndarray:
        at = np.full(len(q), self.entry)
        for layer in range(len(self.near) - 1, 0, -1):
            at = self._descend(q, at, layer)
        return at

    def search(self, q: np.ndarray, start: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The beam that each query ends with: node numbers and similarities, nearest first, -1 where it is not full."""
        step = max(1, min(2048, (1 << 25) // max(1, len(self.x))))
        parts = [self._search(q[a : a + step], start[a : a + step], beam, layer) for a in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, start: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        ids, sims, done = np.full((n, beam), -1, np.int32), np.full((n, beam), -3, np.float32), np.ones((n, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", q, self.x[start]), False
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), start] = True
        rows = np.arange(n)
        while len(rows):
            open_sims = np.where(done[rows], -4, sims[rows])
            j = open_sims.argmax(1)
            live = open_sims[np.arange(len(rows)), j] > -4
            rows, j = rows[live], j[live]
            if not len(rows):
                break
            done[rows, j] = True
            nb = self.near[layer][ids[rows, j]]
            fresh = (nb >= 0) & ~seen[rows[:, None], np.maximum(nb, 0)]
            seen[rows[:, None], np.where(fresh, nb, start[rows][:, None])] = True
            ns = np.where(fresh, np.einsum("rd,rcd->rc", q[rows], self.x[np.maximum(nb, 0)]), -3).astype(np.float32)
            ns = np.where(ns > sims[rows].min(1, keepdims=True), ns, -3)
            some = (ns > -3).any(1)
            if not some.any():
                continue
            r = rows[some]
            all_ids, all_sims = np.concatenate([ids[r], nb[some]], 1), np.concatenate([sims[r], ns[some]], 1)
            all_done = np.concatenate([done[r], ns[some] <= -3], 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[r], sims[r], done[r] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1), np.take_along_axis(all_done, keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -3, ids, -1), sims

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) numbers of what searches find at a similarity of least; a beam that lies wholly above is widened."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(len(q))
        start = self.entries(q)
        while len(rows):
            width = min(beam, len(self.x))
            ids, sims = self.search(q[rows], start, width)
            ok = (ids >= 0) & (sims >= least)
            more = ok.all(1) & (width < len(self.x))
            i, j = np.nonzero(ok & ~more[:, None])
            found.append((rows[i], ids[i, j]))
            rows, start = rows[more], ids[more, 0]
            beam *= 3
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, ids=self.ids, entry=np.array([self.entry]), **{f"near{k}": a for k, a in enumerate(self.near)})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Hnsw:
        z = np.load(io.BytesIO(raw))
        g = Hnsw(z["x"], z["ids"])
        g.entry, g.near = int(z["entry"][0]), [z[f"near{k}"] for k in range(sum(n.startswith("near") for n in z.files))]
        return g


def verified(shard: np.ndarray, q: np.ndarray, norms: np.ndarray, qn: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, node) whose cosine in double precision is a link's."""
    exact = np.empty(len(a), bool)
    for lo in range(0, len(a), 1 << 18):
        s = slice(lo, lo + (1 << 18))
        exact[s] = np.einsum("ij,ij->i", q[a[s]], shard[b[s]]) / (qn[a[s]] * norms[b[s]]) >= THRESHOLD
    return a[exact], b[exact]


def brute(shard: np.ndarray, q: np.ndarray, norms: np.ndarray, qn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links of q, from products of blocks of queries with the shard."""
    step = max(1, BRUTE // max(1, len(shard)))
    found = []
    for lo in range(0, len(q), step):
        s = slice(lo, lo + step)
        i, j = np.nonzero((q[s] @ shard.T) >= (THRESHOLD - 1e-9) * qn[s, None] * norms)
        found.append(verified(shard, q, norms, qn, i + lo, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def passes(truth: np.ndarray, hit: np.ndarray) -> bool:
    """truth, hit: the links, and those found, of each audited query. Each query counts alike, however many links it has."""
    n = truth.sum(1)
    part = (hit & truth).sum(1) / np.maximum(1, n)
    return all(not some.any() or part[some].mean() >= AUDIT for some in (n > 0, (n > 0) & (n <= SMALL)))


def base_beam(g: Hnsw, shard: np.ndarray, q: np.ndarray, norms: np.ndarray, qn: np.ndarray, beam: int, qid: np.ndarray | None) -> int:
    """The first beam from `beam` on with which the audit passes; 0 if none up to MOST_BEAM does."""
    some = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int))
    q, qn = q[some], qn[some]
    unit = (q / qn[:, None]).astype(np.float32)
    cosine = (q @ shard.T) / (qn[:, None] * norms)
    if qid is not None:
        cosine[qid[some, None] == g.ids] = -2
    truth = cosine >= THRESHOLD
    while beam <= MOST_BEAM:
        if truth.any():
            hit = np.zeros(truth.shape, bool)
            hit[verified(shard, q, norms, qn, *g.within(unit, THRESHOLD - 1e-4, beam))] = True
            if passes(truth, hit):
                return beam
        else:
            ids, _ = g.search(unit, g.entries(unit), min(beam, len(g.x)))
            if (ids == cosine.argmax(1)[:, None]).any(1).mean() >= NEAREST:
                return beam
        beam *= 2
    return 0


def linked(g: Hnsw, shard: np.ndarray, q: np.ndarray, beam: int = BEAM, qid: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) numbers of the links of q, verified in double precision, slice by slice. shard, q: the vectors as
    given; qid: q's nodes. The base beam is one with which an audit over a sample of the queries, spread evenly, passes.
    If there is none, brute force takes the search's place."""
    if not len(q):
        return
    norms, qn = np.linalg.norm(shard, axis=1), np.linalg.norm(q, axis=1)
    unit = (q / qn[:, None]).astype(np.float32)
    beam = base_beam(g, shard, q, norms, qn, beam, qid)
    step = min(SLICE, max(1, SLICE_PAIRS // len(shard)))
    for lo in range(0, len(q), step):
        s = slice(lo, lo + step)
        a, b = verified(shard, q[s], norms, qn[s], *g.within(unit[s], THRESHOLD - 1e-4, beam)) if beam else brute(shard, q[s], norms, qn[s])
        yield a + lo, b


def links(g: Hnsw, shard: np.ndarray, q: np.ndarray, beam: int = BEAM, qid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All that linked() yields."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *linked(g, shard, q, beam, qid)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Forest:
    """Edges that join two trees so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.u: list[int] = []
        self.v: list[int] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.u.append(x)
                self.v.append(y)


def prepare(df: DataFrame) -> DataFrame:
    """vec_id, key (a digest of a vector that can link, else null), dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = None if i is None or not v.is_valid or v.values.null_count or not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ok = x is not None and np.isfinite(x).all() and bool(x.any())
                keys.append(hashlib.md5(x.tobytes(), usedforsecurity=False).digest() if ok else None)
                dims.append(len(x) if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "embedding", "key", "dim"])

    return df.mapInArrow(run, "vec_id long, embedding array<double>, key binary, dim int")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.float64)


def build_shard(key: tuple, table: pa.Table) -> pa.Table:
    shard, dim = key
    x = matrix(table.column("embedding"))
    ids = table.column("node").to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    g = Hnsw(x / np.linalg.norm(x, axis=1)[:, None], ids).build()
    out = io.BytesIO()
    np.savez(out, graph=np.frombuffer(g.dump(), np.uint8), x=x, weight=table.column("weight").to_numpy()[order])
    raw = out.getvalue()
    parts = [raw[a : a + PART_BYTES] for a in range(0, len(raw), PART_BYTES)]
    n = len(parts)
    return pa.table([pa.array([shard.as_py()] * n, pa.int32()), pa.array([dim.as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=["shard", "dim", "part", "graph"])


def search_shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: a shard's graph; right: a block of queries. Rows (node, other, weight): other null: the weight linked to node."""
    nodes: list[int] = []
    others: list[int | None] = []
    weights: list[int] = []
    if left.num_rows and right.num_rows:
        parts = sorted(zip(left.column("part").to_pylist(), left.column("graph").to_pylist(), strict=True))
        z = np.load(io.BytesIO(b"".join(p for _, p in parts)))
        g, shard, weight = Hnsw.load(z["graph"].tobytes()), z["x"], z["weight"]
        q, qid = matrix(right.column("embedding")), right.column("node").to_numpy()
        total, trees = np.zeros(len(q), np.int64), Forest()
        for a, b in linked(g, shard, q, qid=qid):
            other = qid[a] != g.ids[b]
            a, b = a[other], b[other]
            total += np.bincount(a, weight[b], len(q)).astype(np.int64)
            trees.add(qid[a], g.ids[b])
        some = np.flatnonzero(total)
        nodes, others, weights = qid[some].tolist() + trees.u, [None] * len(some) + trees.v, total[some].tolist() + [0] * len(trees.u)
    return pa.table([pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(weights, pa.int64())], names=["node", "other", "weight"])


def dedupe(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each vector (vec_id, embedding)."""
    rows = materialize(prepare(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))), "vectors")
    known = rows.where("key is not null")
    weight = known.select("key", "vec_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    reps = known.groupBy("key").agg(F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"), F.first("dim").alias("dim")).join(weight, "key")
    # A vec_id with several vectors is the least one of several keys: a node is a key's hash, and the ids come in at the end.
    reps = materialize(reps.withColumn("node", F.xxhash64("key")), "reps")
    n = reps.count()
    shards, blocks = max(SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")
    graphs = reps.select("node", "weight", "embedding", "dim", own).groupBy("shard", "dim").applyInArrow(build_shard, "shard int, dim int, part int, graph binary")
    written = materialize(graphs, "graphs")
    graphs = written.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    queries = reps.select("node", "embedding", "dim", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(blocks)).cast("int").alias("block"), every)
    found = graphs.groupBy("shard", "dim", "block").cogroup(queries.groupBy("shard", "dim", "block")).applyInArrow(search_shard, "node long, other long, weight long")
    found = materialize(found, "found")
    discard(written)
    joined = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = found.where("other is null").groupBy("node").agg(F.sum("weight").alias("linked"))
    per = reps.select("key", "least", "weight", "node").join(counts, "node", "left").join(joined, "node", "left")
    per = per.select("key", "least", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    per = materialize(per, "classes")
    # Rows of one vec_id are one node: it is joined with the least ids of all its vectors, and these with those of their components.
    ids = known.select("vec_id", "key").distinct().join(per.select("key", "least"), "key").select(F.col("vec_id").alias("u"), F.col("least").alias("v"))
    least = per.groupBy("component").agg(F.min("least").alias("v"))
    ends = per.select("component", F.col("least").alias("u")).join(least, "component").select("u", "v")
    final = components(ids.unionByName(ends)).select(F.col("node").alias("vec_id"), F.col("component").alias("component_id"))
    out = rows.select("vec_id", "key").join(per.select("key", "n_links"), "key", "left").join(final, "vec_id", "left")
    discard(reps, found)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return dedupe(load(spark, sf_dir, "embeddings"))
