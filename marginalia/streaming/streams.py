"""Structured Streaming forms of the append-only logs.

Every ``foreachBatch`` sink merges its batch into hash buckets of a table and
commits by batch id, so a replayed batch changes nothing and no key is counted
twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.quality import is_boilerplate, is_caption
from ..functions.text import strip
from ..operators.chunking import chunk_text_rows
from ..operators.jobs import job_state, reconcile_stages
from ..operators.retrieval import with_hash_vector
from ..operators.skew import first_per_key, reliable


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A growing folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class BucketTable:
    """A keyed table in hash buckets that a stream of batches is merged into.

    A batch rewrites only the buckets it touches, into a folder of its own, and
    then writes the list of current buckets; that list is the commit. A batch whose
    list exists was merged before and is skipped. Readers follow the newest list.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = schema

    def _committed(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = [status.getPath() for status in system.listStatus(folder)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.getName()) for n in names if system.exists(done(n, "_SUCCESS")))

    def _places(self) -> dict[int, int]:
        """The batch that wrote each bucket last; as many entries as buckets."""
        done = self._committed()
        rows = self.spark.read.parquet(f"{self.path}/lists/{done[-1]}").collect() if done else []
        return {row["bucket"]: row["batch"] for row in rows}

    def _read(self, places: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/{batch}/_bucket={bucket}" for bucket, batch in sorted(places.items())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        return self._read(self._places())

    def merge(self, batch: DataFrame, batch_id: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``combine(stored, batch)`` gives the new rows of the buckets that the batch touches."""
        if batch_id in self._committed():
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = reliable(batch)
        touched = [row[0] for row in batch.select(bucket).distinct().collect()]  # at most as many as buckets
        places = self._places()
        merged = combine(self._read({b: v for b, v in places.items() if b in touched}), batch)
        rows = merged.withColumn("_bucket", bucket).repartition("_bucket")
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{batch_id}")
        places.update(dict.fromkeys(touched, batch_id))
        listed = self.spark.createDataFrame(sorted(places.items()), "bucket int, batch long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{batch_id}")


def daily_reviews(reviews: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """R-01: reviews and distinct cards per day; days close once the watermark passes them."""
    day = F.window("reviewed_at", "1 day")
    return (
        reviews.withWatermark("reviewed_at", delay)
        .groupBy(day, *keys)
        .agg(F.count(F.lit(1)).alias("reviews"), F.approx_count_distinct("card_id").alias("cards"))
        .select(F.to_date("window.start").alias("day"), *keys, "reviews", "cards")
    )


def daily_activity(spark: SparkSession, reviews: DataFrame, path: str, checkpoint: str, keys: list[str]) -> tuple[StreamingQuery, BucketTable]:
    """R-01: reviews and exact distinct cards per key and day, every day up to the last.

    The state is one row per key, day and card with its number of reviews: it adds up
    in any order, late rows included, and days are read at any time, no watermark needed.
    """
    names = [*keys, "day", "card_id"]
    source = reviews.select(*keys, F.to_date("reviewed_at").alias("day"), "card_id")
    schema = StructType([*source.schema.fields, StructField("reviews", LongType())])
    table = BucketTable(spark, path, names, schema)

    def combine(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return stored.unionByName(batch).groupBy(*names).agg(F.sum("reviews").alias("reviews"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch.groupBy(*names).agg(F.count(F.lit(1)).alias("reviews")), batch_id, combine)

    return _batches(source, checkpoint, sink), table


def activity_per_day(table: BucketTable, keys: list[str]) -> DataFrame:
    """R-01: the days of ``daily_activity``."""
    return table.read().groupBy(*keys, "day").agg(F.sum("reviews").alias("reviews"), F.count("card_id").alias("cards"))


def write_daily(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    writer = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def _batches(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ARRIVED = "paper_id {kind}, version long, ordinal int, text string, buckets array<int>, weights array<double>"


def chunk_arrivals(
    spark: SparkSession, documents: DataFrame, path: str, checkpoint: str, size: int, overlap: int, buckets: int = 64
) -> tuple[StreamingQuery, BucketTable]:
    """R-02: arriving texts to cleaned, embedded chunk rows, upserted by paper.

    documents(paper_id, text, version). The newest version of a paper replaces all its
    chunks, an older one that comes late changes nothing. Boilerplate, captions and
    blank chunks are dropped on the way.
    """
    kind = dict(documents.dtypes)["paper_id"]
    schema = spark.createDataFrame([], ARRIVED.format(kind=kind)).schema
    table = BucketTable(spark, path, ["paper_id"], schema, buckets)

    def combine(stored: DataFrame, batch: DataFrame) -> DataFrame:
        rows = stored.unionByName(batch)
        newest = rows.groupBy("paper_id").agg(F.max("version").alias("version"))
        return rows.join(newest, ["paper_id", "version"], "left_semi").dropDuplicates(["paper_id", "ordinal"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        newest = first_per_key(batch, ["paper_id"], [F.desc("version"), F.col("text")])
        table.merge(arrived_chunks(newest, size, overlap).select(*schema.names), batch_id, combine)

    return _batches(documents, checkpoint, sink), table


def arrived_chunks(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """R-02: the chunk rows of documents, one version per paper; a text without chunks leaves one row without text,
    so that it replaces what an earlier version left."""
    chunks = chunk_text_rows(documents, size, overlap).select("paper_id", F.col("ordinal").cast("int").alias("ordinal"), "text")
    kept = chunks.filter(~is_caption(F.col("text")) & ~is_boilerplate(F.col("text")) & (strip(F.col("text")) != ""))
    rows = documents.select("paper_id", F.col("version").cast("long").alias("version")).join(with_hash_vector(kept), "paper_id", "left")
    return rows.withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))


def current_chunks(table: BucketTable) -> DataFrame:
    """R-02: chunks of the newest version of every paper."""
    return table.read().filter(F.col("text").isNotNull()).drop("version")


STAGES = ["job_id", "stage"]


def stage_states(spark: SparkSession, events: DataFrame, path: str, checkpoint: str) -> tuple[StreamingQuery, BucketTable]:
    """R-03: newest event per job and stage, in whatever order events arrive.

    The newer of two events by (ts, event_id) is a join of a lattice: merging is
    associative, commutative and idempotent, so late and repeated events need no order.
    """
    table = BucketTable(spark, path, ["job_id"], events.schema)

    def newest(rows: DataFrame) -> DataFrame:
        return first_per_key(rows, STAGES, [F.desc("ts"), F.desc("event_id")])

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.merge(newest(batch), batch_id, lambda stored, fresh: newest(stored.unionByName(fresh)))

    return _batches(events, checkpoint, sink), table


def job_states(table: BucketTable) -> DataFrame:
    """R-03: M-04 over the merged stages: state, current stage and percent of every job."""
    return job_state(reconcile_stages(table.read()))
