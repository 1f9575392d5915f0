"""Keyed merges, patches, cascades and appends over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_safe
from .skew import first_per_key


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """S-07/S-08/S-10/S-22: insert or overwrite rows by key.

    ``changes`` holds one row per key. With ``columns`` only those are
    overwritten and the others keep their stored value.
    """
    named = [c for c in base.columns if c not in keys]
    fresh = changes.withColumn("_new", F.lit(True))
    for missing in [c for c in named if c not in changes.columns]:
        fresh = fresh.withColumn(missing, F.lit(None).cast(base.schema[missing].dataType))
    new = fresh.select(*keys, "_new", *[F.col(c).alias(f"_n_{c}") for c in named])
    joined = base.withColumn("_old", F.lit(True)).join(new, keys, "full")
    take = [
        F.when(F.col("_new") & F.lit(columns is None or c in columns) | F.col("_old").isNull(), F.col(f"_n_{c}"))
        .otherwise(F.col(c))
        .alias(c)
        for c in named
    ]
    return joined.select(*keys, *take)


def _named_once(old: Column, new: Column, name: str) -> Column:
    """``old`` with each entry replaced by its namesake in ``new``, then the entries that only ``new`` has."""
    own = lambda s: F.try_element_at(F.filter(new, lambda n: n[name] == s[name]), F.lit(1))
    return F.concat(
        F.transform(old, lambda s: F.coalesce(own(s), s)), F.filter(new, lambda n: ~F.exists(old, lambda s: s[name] == n[name]))
    )


def upsert_job_snapshots(base: DataFrame, changes: DataFrame, stage_name: str = "stage") -> DataFrame:
    """S-22: job snapshots with their ``stages`` and ``log`` arrays merged, other columns as in ``upsert``.

    A stage of the change replaces the stored stage of its name or is appended; log
    entries are appended unless they are there. Both tables hold one row per ``job_id``,
    with one array of seven stages at most and one log, which are the row itself.
    """
    stored = base.select("job_id", F.col("stages").alias("_stages"), F.col("log").alias("_log"))
    both = changes.join(stored, "job_id", "left")
    for column in ("stages", "log"):
        empty = F.array().cast(base.schema[column].dataType)
        both = both.withColumn(column, F.coalesce(column, empty)).withColumn(f"_{column}", F.coalesce(f"_{column}", empty))
    merged = both.withColumn("stages", _named_once(F.col("_stages"), F.col("stages"), stage_name))
    return upsert(base, merged.withColumn("log", F.array_union("_log", "log")).drop("_stages", "_log"), ["job_id"])


def upsert_reports(base: DataFrame, changes: DataFrame) -> DataFrame:
    """S-10: one report per paper, and one per paper and chapter; the whole-paper report has no chapter."""
    own = F.coalesce(F.col("chapter").cast("bigint"), F.lit(-1).cast("bigint"))
    merged = upsert(base.withColumn("chapter", own), changes.withColumn("chapter", own), ["paper_id", "chapter"])
    return merged.withColumn("chapter", F.nullif("chapter", F.lit(-1).cast("bigint")))


def latest_version(rows: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key from a batch that may repeat keys."""
    return first_per_key(rows, keys, newest_first)


def reset_status(papers: DataFrame, touched: DataFrame) -> DataFrame:
    """S-07/S-25: touched papers go back to ``queued`` without an error."""
    marked = papers.join(touched.select("paper_id").distinct().withColumn("_hit", F.lit(True)), "paper_id", "left")
    return (
        marked.withColumn("status", F.when(F.col("_hit"), "queued").otherwise(F.col("status")))
        .withColumn("error_message", F.when(F.col("_hit").isNull(), F.col("error_message")))
        .drop("_hit")
    )


def without(children: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """S-11/S-12: children of removed parents are dropped."""
    return children.join(removed.select(*keys).distinct(), keys, "left_anti")


def rerun(papers: DataFrame, vectors: DataFrame, reports: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S-25: touched papers are queued again, their vectors and chapter reports go; whole-paper reports stay."""
    chapters = without(reports.filter(F.col("chapter").isNotNull()), touched, ["paper_id"])
    kept = reports.filter(F.col("chapter").isNull()).unionByName(chapters)
    return reset_status(papers, touched), without(vectors, touched, ["paper_id"]), kept


def cascade_delete(tables: dict[str, DataFrame], removed: DataFrame, parents: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """S-11: drop removed papers from every table.

    ``parents`` maps a table without ``paper_id`` to (parent table, key), for
    example answers to (attempts, attempt_id).
    """
    kept = {}
    for name, table in tables.items():
        if name in parents:
            parent, key = parents[name]
            gone = tables[parent].join(removed.select("paper_id").distinct(), "paper_id", "left_semi")
            kept[name] = without(table, gone, [key])
        else:
            kept[name] = without(table, removed, ["paper_id"])
    return kept


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """S-20/S-21: a null in the patch leaves the stored value alone."""
    new = changes.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = base.join(new, key, "left")
    for column in columns:
        out = out.withColumn(column, F.coalesce(f"_p_{column}", column))
    return out.drop(*[f"_p_{c}" for c in columns])


def set_status(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """S-21: status with its error rule: kept on error, cleared on ready, else untouched."""
    new = changes.select(
        "paper_id", F.col("status").alias("_status"), F.col("ingested").alias("_ingested"), F.col("error_message").alias("_error")
    )
    joined = papers.join(new, "paper_id", "left")
    error = (
        F.when(F.col("_status") == "error", F.col("_error"))
        .when(F.col("_status") == "ready", F.lit(None).cast("string"))
        .otherwise(F.col("error_message"))
    )
    return (
        joined.withColumn("error_message", error)
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("ingested", F.coalesce("_ingested", "ingested"))
        .drop("_status", "_ingested", "_error")
    )


CARD_CONTENT = ["front", "back", "hint", "source_section", "source_page", "chunk_id"]


def merge_deck(stored: DataFrame, generated: DataFrame, now: Column) -> DataFrame:
    """S-09: new keys are inserted, stored cards get fresh content, manual cards stay.

    ``generated`` carries ``seq``, its order inside the batch; the first card of
    a key wins. ``action`` tells created, updated, kept.
    """
    keys = ["paper_id", "content_key"]
    usable = generated.filter(blank_safe(F.col("content_key")) != "")
    first = first_per_key(usable, keys, [F.col("seq"), F.col("card_id")])
    new = first.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in ["card_id", "origin", *CARD_CONTENT]])
    joined = stored.withColumn("_old", F.lit(True)).join(new, keys, "full")
    action = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new") & (F.col("origin") != "manual"), "updated")
        .otherwise("kept")
    )
    acted = joined.withColumn("action", action)
    fresh = F.col("action") != "kept"
    created = F.col("action") == "created"
    content = [F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in CARD_CONTENT]
    return acted.select(
        *keys,
        F.when(created, F.col("_n_card_id")).otherwise(F.col("card_id")).alias("card_id"),
        F.when(created, F.col("_n_origin")).otherwise(F.col("origin")).alias("origin"),
        *content,
        F.coalesce("starred", F.lit(False)).alias("starred"),
        F.when(created, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"),
        "action",
    )


def deck_result(merged: DataFrame, generated: DataFrame) -> DataFrame:
    """A-20: created / updated / total / generated per paper."""
    counts = merged.groupBy("paper_id").agg(
        F.count_if(F.col("action") == "created").alias("created"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )
    made = generated.groupBy("paper_id").agg(F.count(F.lit(1)).alias("generated"))
    return counts.join(made, "paper_id", "left").fillna(0, ["generated"])


def starred_counts(cards: DataFrame) -> DataFrame:
    """S-20: starred cards per paper after a merge."""
    return cards.groupBy("paper_id").agg(F.sum(F.col("starred").cast("int")).alias("starred_count"))


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S-13/S-14/S-24: add rows to a log table."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def quiz_rows(quizzes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-24: a quiz header and its question rows with a flat citation."""
    questions = quizzes.select("quiz_id", "paper_id", F.posexplode("questions").alias("index", "q"))
    flat = questions.select(
        "quiz_id", "paper_id", "index", F.concat_ws("-", "quiz_id", "index").alias("question_id"), "q.prompt", "q.kind",
        "q.difficulty", F.col("q.citation.section").alias("citation_section"), F.col("q.citation.page").alias("citation_page"),
        F.col("q.citation.chunk_id").alias("citation_chunk_id"),
    )
    return quizzes.withColumn("question_count", F.size("questions")).drop("questions"), flat


def chat_turn(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """S-13: one user and one assistant row per exchange."""
    user = asked.select("session_id", "turn", F.lit("user").alias("role"), "text")
    reply = answered.select("session_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), "text")
    return user.unionByName(reply)
