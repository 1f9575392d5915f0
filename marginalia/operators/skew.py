"""Skew-aware building blocks.

One key may own a third of all rows, so nothing here sorts or collects a whole
key in a single task: keys are counted with map-side combining, hot keys are
split, running values are computed inside fixed-width buckets and then carried
across the much smaller bucket table.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_KEYS = 1000  # rows in a hot-key table; by pigeonhole any other key owns less than a thousandth of all rows
SALTS = 64
BUCKET_ROWS = 4096
TASK_ROWS = 8192  # chunks of text in a task that lists them under several sections


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local session; a cluster's
    executors could not read one, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage on shared storage, so lost executors never lose the rows.

    The rows are written as compressed Parquet and read back; the files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(stored: DataFrame) -> int:
    """Tasks of about ``TASK_ROWS`` rows each, however many there are: tasks sized by the bytes
    of their input spill where later steps widen or repeat the rows."""
    return max(1, math.ceil(stored.count() / TASK_ROWS))


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_KEYS) -> DataFrame:
    """The at most ``limit`` keys with the most rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.orderBy(F.desc("_n"), *keys).limit(limit).select(*keys, F.lit(True).alias("_hot"))


def hot_join(fact: DataFrame, dim: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Join a fact table with one dimension row per key, spreading hot keys.

    Rows of a hot key go to one of ``SALTS`` partitions by ``spread``; its
    single dimension row is copied to each of them. Other keys join as usual.
    """
    hot = F.broadcast(hot_keys(fact, keys))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = fact.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = dim.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key; the limit is applied before the shuffle as well."""
    return top_per_key(df, keys, order, 1).drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """First ``k`` rows of each key. ``row_number() <= k`` lets Spark keep only
    ``k`` rows per key and map task before shuffling (window group limit)."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def _bucketed(df: DataFrame, position: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(position) / width).cast("bigint"))


def carry_forward(
    df: DataFrame, keys: list[str], position: str, value: Column, name: str, default: str, width: int = BUCKET_ROWS
) -> DataFrame:
    """Last non-null ``value`` at or before each row, ``position`` unique per key."""
    rows = _bucketed(df.withColumn("_value", value), position, width)
    inside = W.partitionBy(*keys, "_bucket").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    closing = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(position))).alias("_closing"))
        .withColumn("_carried", F.last("_closing", ignorenulls=True).over(before))
        .select(*keys, "_bucket", "_carried")
    )
    return (
        rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
        .join(closing, [*keys, "_bucket"], "left")
        .withColumn(name, F.coalesce("_local", "_carried", F.lit(default)))
        .drop("_value", "_bucket", "_local", "_carried")
    )


def running_number(
    df: DataFrame, keys: list[str], position: str, order: list[Column], name: str, width: int = 256
) -> DataFrame:
    """Zero-based number of each row within its key.

    ``position`` is a coarse non-negative integer that increases with ``order``
    (a page); rows are numbered inside a bucket of pages and shifted by the
    number of rows in earlier buckets.
    """
    rows = _bucketed(df, position, width)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*keys, "_bucket", "_offset")
    )
    return (
        rows.withColumn("_local", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_bucket", "_local", "_offset")
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based rank over the whole table without a single-task window.

    The table is range-partitioned and sorted, stored once, and each partition
    is shifted by the rows before it; only one row per partition is broadcast.
    """
    mask = (1 << 33) - 1
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = reliable(placed)
    rows = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND(F.lit(mask)))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_part", "_offset")
    )
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_at", "_part", "_pos", "_offset")
    )
