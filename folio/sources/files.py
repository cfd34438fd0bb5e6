"""Files and folders through Spark's file systems, and sinks that replace a table whole and only when it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def matches(spark: SparkSession, glob: str) -> bool:
    fs, p = _at(spark, glob)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _at(spark, source)
    if not fs.rename(p, _at(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def digest(df: DataFrame) -> tuple:
    """What tells two tables apart whatever the order of rows: columns, count, and two sums over the rows' hashes."""
    h = F.xxhash64(*sorted(df.columns))
    other = F.hash(*sorted(df.columns))
    r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(other.cast("long") * other.cast("long") % 1000003)).first()
    return tuple(sorted((f.name, f.dataType.simpleString()) for f in df.schema)), *r


def swapped(df: DataFrame, path: str) -> None:
    """Writes a table beside the old one, then puts it in its place; the old one stays as a backup until that is done.

    A run that broke off between the two moves is mended first. df may read the old table.
    """
    spark, staging, backup = df.sparkSession, f"{path}.staging", f"{path}.backup"
    if exists(spark, backup) and not exists(spark, path):
        move(spark, backup, path)
    remove(spark, staging)
    df.write.parquet(staging)
    remove(spark, backup)
    if exists(spark, path):
        move(spark, path, backup)
    try:
        move(spark, staging, path)
    except Exception:
        if exists(spark, backup):
            move(spark, backup, path)
        raise
    remove(spark, backup)


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Replaces the table at a path where its rows or columns differ; says whether it did."""
    spark = df.sparkSession
    if exists(spark, path) and digest(spark.read.parquet(path)) == digest(df):
        return False
    swapped(df, path)
    return True


def changed(new: DataFrame, old: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of new whose key is new or whose body differs; bodies are compared by SHA-256, so only digests move."""
    hashed = old.select(F.col(key), F.sha2(F.col(body), 256).alias("_d"))
    n = new.withColumn("_d", F.sha2(F.col(body), 256))
    same = (n[key] == hashed[key]) & n["_d"].eqNullSafe(hashed["_d"])
    return n.join(hashed, same, "left_anti").drop("_d")
