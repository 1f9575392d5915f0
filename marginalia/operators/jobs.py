"""Ingestion job and stage analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .skew import first_per_key


def stage_index(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(K.STAGE_ORDER):
        out = F.when(stage == name, i).otherwise(out)
    return out


def latest_stage_status(events: DataFrame) -> DataFrame:
    """R-03 batch form: newest event per job and stage; late events lose to newer ones."""
    return first_per_key(events, ["job_id", "stage"], [F.desc("ts"), F.desc("event_id")])


def reconcile_stages(stages: DataFrame) -> DataFrame:
    """M-01: every job shows the seven stages in order; missing ones are pending.

    ``stages`` has one row per job and stage, so a job collects at most seven.
    """
    names = F.array(*[F.lit(s) for s in K.STAGE_ORDER])
    jobs = stages.groupBy("job_id", "paper_id").agg(F.collect_list(F.struct("stage", "status")).alias("_seen"))
    grid = jobs.select("job_id", "paper_id", "_seen", F.posexplode(names).alias("stage_index", "stage"))
    own = F.try_element_at(F.filter("_seen", lambda s: s["stage"] == F.col("stage")), F.lit(1))["status"]
    return grid.withColumn("status", F.coalesce(own, F.lit("pending"))).drop("_seen")


def stage_percent(stage: Column, status: Column) -> Column:
    """M-02: half-even rounding of the share of stages reached."""
    done = stage_index(stage) + F.when(status == "running", 0).otherwise(1)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(done / len(K.STAGE_ORDER) * 100).cast("int")))


def job_state(stages: DataFrame) -> DataFrame:
    """M-04/M-05: job state, current stage, percent and paper status.

    Only download, text and embedding errors fail a job; the others degrade it.
    A paper is ready once embedding is done, before its report.
    """
    fatal = F.col("stage").isin(K.FATAL_STAGES) & (F.col("status") == "error")
    soft = ~F.col("stage").isin(K.FATAL_STAGES) & (F.col("status") == "error")
    position = stage_index(F.col("stage"))
    started = F.col("status") != "pending"
    grouped = stages.groupBy("job_id", "paper_id").agg(
        F.bool_or(fatal).alias("failed"),
        F.bool_or(soft).alias("degraded"),
        F.bool_and(F.col("status").isin("done", "error")).alias("finished"),
        F.bool_or(started).alias("begun"),
        F.max_by("stage", F.when(started, position)).alias("current_stage"),
        F.max_by("status", F.when(started, position)).alias("current_status"),
        F.bool_or((F.col("stage") == "Embedding") & (F.col("status") == "done")).alias("embedded"),
    )
    state = (
        F.when(F.col("failed"), "error").when(F.col("finished"), "done").when(F.col("begun"), "running").otherwise("queued")
    )
    paper = F.when(F.col("failed"), "error").when(F.col("embedded"), "ready").when(F.col("begun"), "processing").otherwise("queued")
    return grouped.select(
        "job_id", "paper_id", state.alias("state"), "current_stage",
        F.coalesce(stage_percent(F.col("current_stage"), F.col("current_status")), F.lit(0)).alias("percent"),
        "degraded", paper.alias("paper_status"),
    )


def latest_job(jobs: DataFrame, ingestion_only: bool = False) -> DataFrame:
    """W-14: newest job per paper; ingestion jobs are those that have stages."""
    rows = jobs.filter(F.col("stage_count") > 0) if ingestion_only else jobs
    return first_per_key(rows, ["paper_id"], [F.desc("created_at"), F.desc("job_id")])


def reports_in_flight(latest: DataFrame, stages: DataFrame) -> DataFrame:
    """M-03: papers whose newest ingestion job has not finished its report."""
    report = stages.filter(F.col("stage") == "Generate report").select("job_id", F.col("status").alias("report_status"))
    rows = latest.filter(F.col("state").isin("queued", "running")).join(report, "job_id", "left")
    open_rows = rows.filter(~F.coalesce("report_status", F.lit("pending")).isin("done", "error"))
    where = F.when(F.col("report_status") == "running", "generating the report now").otherwise("still ingesting this paper")
    return open_rows.select("paper_id", "job_id", where.alias("phase"))


def has_in_flight(papers: DataFrame) -> DataFrame:
    """M-06: papers a client keeps polling for."""
    return papers.filter(F.col("status").isin("processing", "queued"))


def degraded_tally(stages: DataFrame) -> DataFrame:
    """M-08: degraded stages per job."""
    bad = (F.col("status") == "error") & ~F.col("stage").isin(K.FATAL_STAGES)
    return stages.groupBy("job_id").agg(F.sum(bad.cast("int")).alias("degraded_stages"), F.count(F.lit(1)).alias("stages"))
