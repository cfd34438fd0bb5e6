"""Shared plumbing of the training-data operators: tables, scratch space, Arrow passes and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import ship

#: Rows in an Arrow batch of whole texts: bounds a Python worker's memory, long texts included.
TEXT_BATCH = 1000
#: Rows of ids that go into one file.
FILE_ROWS = 50_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """What every operator relies on: the package on the executors, and settings that do not depend on the data."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A query's shuffle files go when it ends: what later queries need has been written to tables.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a fresh local one only where the cluster names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_caches: dict[str, Callable[[], None]] = {}
_working = [""]


def begin(owner: str) -> None:
    """Called in a Python worker where an operator's code starts: caches of others are emptied, freed memory is given back.

    Workers are kept from stage to stage, so their memory is that of the largest operator, not of all.
    """
    if _working[0] == owner:
        return
    _working[0] = owner
    for other in [o for o in _caches if o != owner]:
        _caches.pop(other)()
    give_back()


def give_back() -> None:
    """Called in a Python worker: memory that is free goes back to the system, for whatever runs beside."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def take_cache(owner: str, clear: Callable[[], None]) -> None:
    """Called before an operator fills its cache in a Python worker; the next operator that begins there empties it."""
    begin(owner)
    _caches[owner] = clear


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage is cut, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/folio-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize has written and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_folio_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def files(spark: SparkSession, rows: int, each: int = FILE_ROWS) -> int:
    """In how many files a table of about so many rows is written, so that no cores idle and none is of a few rows.

    Without its native library Hadoop starts a process for each folder and file that a task writes (chmod). Until that
    process is another program it shares the executor's memory, and whoever adds up processes counts it twice.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def arrow_append(df: DataFrame, schema: T.StructType, fn: Callable[[list[pa.Array]], dict], inputs: list[str], keep: list[str] | None = None) -> DataFrame:
    """Appends to the columns `keep` (all, if None) those that fn makes of the columns `inputs`, batch by batch.

    fn gets the input arrays and returns {name: list or array}. A name that is kept as well is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = df.columns if keep is None else keep
    names = [f.name for f in schema.fields]
    fields = [df.schema[c] for c in keep if c not in names]
    out = T.StructType(fields + list(schema.fields))
    arrow = to_arrow_schema(out)
    kept = [f.name for f in fields]
    columns = list(dict.fromkeys(kept + inputs))
    owner = fn.__module__.rsplit(".", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        for b in batches:
            if not b.num_rows:
                continue
            got = fn([b.column(columns.index(c)) for c in inputs])
            cols = [b.column(columns.index(c)).cast(arrow.field(c).type) for c in kept]
            cols += [x if isinstance(x := got[n], pa.Array) else pa.array(x, arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, out)


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of edges (u, v): one row (node, component) for each node of an edge, component its least node.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step is a minimum per node, which is combined
    before the shuffle, and a join that adaptive execution can split. A round's edges are written to the shared folder;
    the driver sees a count and a checksum only. rows: about how many edges there are; the files are then few.
    """

    def written(df: DataFrame, rows: int | None) -> DataFrame:
        df = df.where("u <> v").distinct()
        return materialize(df if rows is None else df.coalesce(files(df.sparkSession, rows)), "edges")

    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), rows)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = sign(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        spent, e = e, written(star(star(e, True).where("u <> v").distinct(), False), None if rows is None else before[0])
        discard(spent)
        after = sign(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: the rounds were not enough")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
