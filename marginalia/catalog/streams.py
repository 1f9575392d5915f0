"""The log streams, drained once over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.skew import shared_folder
from ..sources import views as V
from ..sources.views import with_views
from ..streaming import streams as S
from . import sqltext as X
from .library import JOBS, LATEST, STATES
from .registry import Registry
from .text import WINDOWS

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _paths(spark) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def _stream(spark, sf, name):
    return S.read_log(spark, f"{sf}/{name}*.parquet", V.table(spark, sf, name).schema)


@register(
    "stream_daily_reviews",
    with_views("reviews") + """
  select reviewed_at::date as day, count(*) as reviews from reviews
  group by 1 having max(reviewed_at::date) + 1 <= (select max(ts) - interval 1 day from events)""",
)
def daily_reviews(spark, sf):
    out, state = _paths(spark)
    events = _stream(spark, sf, "events").selectExpr("cast(ts as timestamp) as reviewed_at", "user_id as card_id")
    S.write_daily(S.daily_reviews(events, []), out, state).awaitTermination()
    return spark.read.parquet(out).select("day", "reviews")


@register(
    "stream_paper_activity",
    with_views("reviews", "cards") + """
  select paper_id, reviewed_at::date as day, count(*) as reviews, count(distinct card_id) as cards from reviews join cards using (card_id) group by 1, 2""",
)
def paper_activity(spark, sf):
    out, state = _paths(spark)
    events = _stream(spark, sf, "events").selectExpr("cast(ts as timestamp) as reviewed_at", "user_id as card_id")
    of_paper = events.join(V.cards(spark, sf).select("card_id", "paper_id"), "card_id")
    query, table = S.daily_activity(spark, of_paper, out, state, ["paper_id"])
    query.awaitTermination()
    return S.activity_per_day(table, ["paper_id"])


ARRIVALS = (
    "(select paper_id, ordinal, case when n <= 200 then raw else text end as text from ("
    + WINDOWS.format(step=170, size=200).replace("select doc_id as paper_id,", "select doc_id as paper_id, len(ws) as n, raw,").replace(
        "select doc_id, regexp", "select doc_id, text as raw, regexp") + "))"
)


@register(
    "stream_chunk_arrivals",
    f"select paper_id, ordinal, text from {ARRIVALS} where not {X.is_caption('text')} and not {X.is_boilerplate('text')} and {X.strip('text')} <> ''",
)
def chunk_arrivals(spark, sf):
    out, state = _paths(spark)
    docs = _stream(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text", F.lit(1).alias("version"))
    query, table = S.chunk_arrivals(spark, docs, out, state, 200, 30)
    query.awaitTermination()
    return S.current_chunks(table).select("paper_id", "ordinal", "text")


def _stage_table(spark, sf):
    out, state = _paths(spark)
    events = _stream(spark, sf, "events").selectExpr(
        "event_id", "concat(user_id, '-', date_format(ts, 'yyyyMMdd')) as job_id", "user_id as paper_id", f"{V.STAGE_OF} as stage",
        "case when value < 5 then 'error' when value < 8 then 'running' else 'done' end as status", "ts",
    )
    query, table = S.stage_states(spark, events, out, state)
    query.awaitTermination()
    return table


@register("stream_latest_stages", with_views("stage_events") + "," + LATEST + " select job_id, stage, status, ts from latest")
def latest_stages(spark, sf):
    return _stage_table(spark, sf).read().select("job_id", "stage", "status", "ts")


@register("stream_job_states", JOBS + STATES + " select * from jobs")
def job_states(spark, sf):
    return S.job_states(_stage_table(spark, sf))
