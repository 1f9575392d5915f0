"""Helpers shared by the operators: stored tables, hashes, hot-key joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.skew import shared_folder

TOP_KEYS = 1000  # by pigeonhole every key outside the top 1000 owns less than a thousandth of the rows
SALTS = 32


def new_folder(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table once to shared storage and read it back: no lineage, survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def hash128(text: Column) -> Column:
    """128-bit content hash of a string as 16 bytes."""
    return F.unhex(F.md5(text))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_by_key(rows: DataFrame, keys: DataFrame, on: str, weight: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join many rows with one row per key, where a key may own a third of the rows.

    ``keys`` holds the number of rows per key in ``weight``. The heaviest
    ``TOP_KEYS`` keys (a table of proven size) are spread over ``SALTS`` parts by
    ``spread``; their one row is copied to each part. Both sides choose the heaviest
    keys for themselves, so ties are broken by the key: another choice would lose rows.
    """
    heavy = keys.orderBy(F.desc(weight), on).limit(TOP_KEYS).select(on, F.lit(True).alias("_heavy"))
    heavy = F.broadcast(heavy)
    part = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(heavy, on, "left").withColumn("_part", part).drop("_heavy")
    right = keys.join(heavy, on, "left").withColumn("_part", F.explode(parts)).drop("_heavy")
    return left.join(right, [on, "_part"], how).drop("_part")
