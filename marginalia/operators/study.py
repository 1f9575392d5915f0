"""Review-log analytics: strength, session queue, progress, streaks, overview.

Inputs
    cards    card_id, paper_id, front, starred [, created_at]
    reviews  review_id, card_id, rating, reviewed_at
    papers   paper_id, title, label
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from .skew import global_rank, hot_join


def day_bounds(as_of: str, tz: str = "UTC") -> tuple[Column, Column]:
    """Naive-UTC start and end of the local day that contains ``as_of``."""
    local = F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), tz)
    start = F.date_trunc("day", local)
    return tuple(F.to_utc_timestamp(t, tz).cast("timestamp_ntz") for t in (start, start + F.expr("interval 1 day")))


def seen_on_day(as_of: str, tz: str = "UTC") -> Column:
    start, end = day_bounds(as_of, tz)
    at = F.col("reviewed_at").cast("timestamp_ntz")
    return (at >= start) & (at < end)


def card_strength(reviews: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """W-01: recalled reviews since the last one that was not recalled.

    Two aggregations instead of a per-card sort: the last break of every card,
    then a count of the reviews after it. Both combine before the shuffle and a
    hot card is spread over many tasks for the join between them.
    """
    recalled = F.coalesce(F.col("rating").isin(K.RECALLED_RATINGS), F.lit(False))
    moment = F.struct("reviewed_at", "review_id")
    log = reviews.select("card_id", "review_id", "reviewed_at", recalled.alias("recalled"))
    breaks = log.filter(~F.col("recalled")).groupBy("card_id").agg(F.max(moment).alias("last_break"))
    joined = hot_join(log, breaks, ["card_id"], F.col("review_id"))
    kept = F.col("last_break").isNull() | (moment > F.col("last_break"))
    return joined.groupBy("card_id").agg(
        F.sum(kept.cast("int")).alias("strength"),
        F.count(F.lit(1)).alias("reviews"),
        F.max("reviewed_at").alias("last_reviewed_at"),
        F.max(seen_on_day(as_of, tz)).alias("seen_today"),
    )


def with_strength(cards: DataFrame, strengths: DataFrame) -> DataFrame:
    """J-04: cards without history get strength 0."""
    zero = {"strength": 0, "reviews": 0, "seen_today": False}
    return cards.join(strengths, "card_id", "left").fillna(zero)


def queue_order() -> list[Column]:
    return [F.col("strength").asc(), F.col("last_reviewed_at").asc_nulls_first(), F.col("card_id").asc()]


def session_queue(cards: DataFrame, reviews: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """W-02: weakest first, then never or least recently seen, then id."""
    deck = with_strength(cards, card_strength(reviews, as_of))
    if limit is None:
        return global_rank(deck, queue_order(), "position")
    page = deck.orderBy(*queue_order()).limit(max(1, min(limit, 200)))
    return page.withColumn("position", F.row_number().over(W.orderBy(*queue_order())))


def with_paper(queue: DataFrame, papers: DataFrame) -> DataFrame:
    """J-03: missing papers show as empty strings."""
    named = papers.select("paper_id", F.col("title").alias("paper_title"), F.col("label").alias("paper_label"))
    return queue.join(named, "paper_id", "left").fillna("", ["paper_title", "paper_label"])


def shuffled_page(queue: DataFrame, seed: int, limit: int) -> DataFrame:
    """W-03: a page of the queue in an order fixed by the seed."""
    page = queue.orderBy(*queue_order()).limit(limit)
    return page.orderBy(F.xxhash64("card_id", F.lit(seed)), "card_id")


def requeue_position(current: Column, remaining: Column, rating: Column) -> Column:
    """W-05: place of a rated card in the running session, null when retired."""
    gap = F.when(rating == "again", K.REQUEUE_GAPS["again"]).when(rating == "almost", K.REQUEUE_GAPS["almost"])
    return current + F.least(gap, remaining) + 1 + gap * 0


def deck_progress(cards: DataFrame, reviews: DataFrame, as_of: str, tz: str = "UTC") -> DataFrame:
    """A-01/A-02/A-03: totals per paper and, with null paper, for the library.

    Reviews take the paper of their card. Each side is reduced to one row per
    card before they meet, so the join never carries raw log rows.
    """
    today = reviews.filter(seen_on_day(as_of, tz)).groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))
    deck = cards.select("card_id", "paper_id", F.col("starred").cast("int").alias("starred"))
    both = deck.join(today, "card_id", "left")
    return (
        both.rollup("paper_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count("n").alias("seen_today"),
            F.sum("starred").alias("starred_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("reviews_today"),
            F.grouping("paper_id").alias("is_library"),
        )
        .withColumn("due_count", F.greatest(F.lit(0), F.col("total") - F.col("seen_today")))
    )


def reviews_between(reviews: DataFrame, start: str, end: str) -> DataFrame:
    """A-04: number of reviews in [start, end)."""
    at = F.col("reviewed_at").cast("timestamp_ntz")
    inside = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
    return reviews.filter(inside).agg(F.count(F.lit(1)).alias("reviews"))


def last_seven_days(reviews: DataFrame, as_of: str) -> DataFrame:
    """A-05: zero-filled daily counts, oldest first."""
    today = F.to_date(F.lit(as_of))
    counts = (
        reviews.withColumn("day", F.to_date("reviewed_at"))
        .filter(F.col("day").between(F.date_sub(today, 6), today))
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )
    days = reviews.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, 6), today)).alias("day"))
    return days.join(counts, "day", "left").fillna(0, ["reviews"])


def streak(reviews: DataFrame, as_of: str) -> DataFrame:
    """W-04: consecutive review days ending on the day of ``as_of``.

    Only distinct calendar days reach the window, so it stays tiny.
    """
    today = F.to_date(F.lit(as_of))
    days = reviews.select(F.to_date("reviewed_at").alias("day")).filter(F.col("day") <= today).distinct()
    backwards = F.row_number().over(W.orderBy(F.desc("day")))
    return days.withColumn("back", backwards).agg(
        F.count(F.when(F.date_sub(today, F.col("back") - 1) == F.col("day"), 1)).alias("streak_days")
    )


def paper_stats(cards: DataFrame, quizzes: DataFrame, attempts: DataFrame, papers: DataFrame) -> DataFrame:
    """A-06: one row per paper that has a deck or a quiz, ordered by title."""
    deck = cards.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("cards_total"),
        F.sum(F.col("starred").cast("int")).alias("cards_starred"),
        F.max("created_at").alias("deck_generated_at"),
    )
    quiz = quizzes.groupBy("paper_id").agg(F.count(F.lit(1)).alias("quiz_count"))
    tried = attempts.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("quiz_attempt_count"),
        F.coalesce(F.max(F.when(F.col("mode") == "full", F.col("score"))), F.max("score")).alias("quiz_best_score"),
        F.max("finished_at").alias("quiz_last_attempted_at"),
    )
    known = papers.select("paper_id", F.col("title").alias("paper_title"), F.col("label").alias("paper_label"))
    counts = ["cards_total", "cards_starred", "quiz_count", "quiz_attempt_count"]
    return (
        deck.join(quiz, "paper_id", "full")
        .join(tried, "paper_id", "left")
        .join(known, "paper_id", "left")
        .fillna(0, counts)
        .fillna("", ["paper_title", "paper_label"])
        .withColumn("has_deck", F.col("cards_total") > 0)
        .orderBy(F.lower(F.coalesce(F.nullif("paper_title", F.lit("")), F.col("paper_id").cast("string"))), "paper_id")
    )


def overview(cards: DataFrame, quizzes: DataFrame, attempts: DataFrame) -> DataFrame:
    """A-07: library-wide counts as (metric, value) rows."""
    tried = attempts.select("quiz_id").distinct()
    metrics = [
        cards.agg(F.count_distinct("paper_id").alias("value")).withColumn("metric", F.lit("papers_with_decks")),
        quizzes.agg(F.count_distinct("paper_id").alias("value")).withColumn("metric", F.lit("papers_with_quizzes")),
        quizzes.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("quiz_count")),
        attempts.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("quiz_attempt_count")),
        quizzes.join(tried, "quiz_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("value"))
        .withColumn("metric", F.lit("quizzes_never_attempted")),
    ]
    out = metrics[0]
    for metric in metrics[1:]:
        out = out.unionByName(metric)
    return out


def queue_by_paper(queue: DataFrame) -> DataFrame:
    """A-12: cards waiting per paper, largest first."""
    counts = queue.groupBy("paper_id").agg(F.count(F.lit(1)).alias("cards"))
    return counts.orderBy(F.desc("cards"), "paper_id")


def newest_card(cards: DataFrame) -> DataFrame:
    """A-19."""
    return cards.groupBy("paper_id").agg(F.max("created_at").alias("deck_generated_at"))
