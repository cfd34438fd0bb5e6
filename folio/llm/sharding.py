"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its id and text, for ever; only the map from slots to shards changes. Bytes are summed per slot
(combined before the shuffle), and a map is edited by moving slots from heavy shards to light ones, as few as needed;
each edit is a new version, so any older layout can be read again. The map has SLOTS rows whatever the data's size.

Null id: the text alone tells the slot, so rows without id, or of one id, spread as their texts do. Null text: no bytes.
Rows equal in id and text share a slot. No rows: no rows.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folio.llm.common import load, scratch, tune

#: Virtual slots, fixed for the life of a data set; shards; the part of a shard's mean size that the spread may reach.
SLOTS, SHARDS, TOLERANCE = 8192, 8, 0.001

MAP = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType())])


def vslot(*key: str, slots: int = SLOTS) -> F.Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_bytes(df: DataFrame, slot: str = "vslot", size: str = "size") -> dict[int, int]:
    """Bytes of each slot; at most SLOTS rows reach the driver."""
    return {r[0]: int(r[1]) for r in df.groupBy(slot).agg(F.sum(size)).collect()}


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """Version 1, which knows no sizes: slots in turn."""
    return [s % shards for s in range(slots)]


def rebalance(layout: list[int], sizes: dict[int, int], shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """layout, edited until the heaviest and the lightest shard differ by at most tolerance of the mean, or no edit helps.

    An edit moves the slot, or swaps the two slots, that bring the heaviest and the lightest shard closest. Shards that the
    layout does not use yet are filled in the same way, so it also serves to add shards.
    """
    layout = list(layout)
    load_of = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for s, d in enumerate(layout):
        load_of[d] += sizes.get(s, 0)
        if sizes.get(s, 0):
            members[d].add(s)
    goal = tolerance * sum(load_of) / shards
    for _ in range(8 * len(layout)):
        hi, lo = max(range(shards), key=lambda d: (load_of[d], -d)), min(range(shards), key=lambda d: (load_of[d], d))
        gap = load_of[hi] - load_of[lo]
        if gap <= goal:
            break
        best = (gap, -1, -1)  # the gap that is left, the slot that goes, the slot that comes
        for s in sorted(members[hi]):
            best = min(best, (abs(gap - 2 * sizes[s]), s, -1))
        if best[0] > goal:
            theirs = sorted(members[lo], key=lambda s: (sizes[s], s))
            weights = [sizes[s] for s in theirs]
            for s in sorted(members[hi]):
                k = bisect_left(weights, sizes[s] - gap / 2)
                for j in (k - 1, k):
                    if 0 <= j < len(theirs):
                        best = min(best, (abs(gap - 2 * (sizes[s] - weights[j])), s, theirs[j]))
        left, gone, come = best
        if left >= gap:
            break
        for s, a, b in ((gone, hi, lo), (come, lo, hi)):
            if s >= 0:
                layout[s] = b
                members[a].discard(s)
                members[b].add(s)
                load_of[a] -= sizes[s]
                load_of[b] += sizes[s]
    return layout


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """The maps as a table: a row for each version and slot."""
    return spark.createDataFrame([(v + 1, s, d) for v, layout in enumerate(versions) for s, d in enumerate(layout)], MAP)


def newest(spark: SparkSession, path: str) -> int:
    """The newest version of the maps stored there; 0 if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0


def save_map(spark: SparkSession, versions: list[list[int]], path: str) -> None:
    """Stores the maps, a folder for each version; a version that is there is never written again."""
    map_table(spark, versions).where(F.col("version") > newest(spark, path)).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The stored map of a version, or the newest one: the shard of each slot."""
    rows = spark.read.parquet(path).where(F.col("version") == (version or newest(spark, path))).select("vslot", "shard").orderBy("vslot").collect()  # SLOTS rows
    return [r.shard for r in rows]


def place(df: DataFrame, layout: list[int], counts: dict[int, int], order: list[str], slot: str = "vslot") -> DataFrame:
    """Appends shard, and slot: the row's place in its shard, gapless from 0.

    A shard's slots follow one another, so a row's place is what the slots before its own hold plus its place in its own
    slot; the window is over one virtual slot, never over a shard.
    """
    before, at = [0] * len(layout), {}
    for s, d in enumerate(layout):
        before[s] = at.get(d, 0)
        at[d] = at.get(d, 0) + counts.get(s, 0)
    table = df.sparkSession.createDataFrame([(s, d, before[s]) for s, d in enumerate(layout)], "_slot int, shard int, _before long")
    w = Window.partitionBy(slot).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w))
    return ranked.join(F.broadcast(table), F.col(slot) == F.col("_slot")).withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_slot", "_before", "_rank")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version, by the law of near-equal bytes."""
    tune(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), vslot("doc_id", "text").alias("vslot"))
    per = {r[0]: (int(r[1]), int(r[2])) for r in docs.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()}  # at most SLOTS rows
    path = f"{scratch(spark)}/folio-slot-map-{uuid.uuid4().hex}"
    save_map(spark, [first_map()], path)
    first = read_map(spark, path)
    save_map(spark, [first, rebalance(first, {s: b for s, (b, _) in per.items()})], path)
    version = newest(spark, path)
    out = place(docs, read_map(spark, path, version), {s: n for s, (_, n) in per.items()}, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"))
