"""Chapter derivation from outlines, headings or page buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.quality import NONCONTENT_LABEL
from ..functions.text import casefold, collapse, strip
from .skew import first_per_key, top_per_key


def clamp_page(page: Column, page_count: Column) -> Column:
    return F.greatest(F.lit(1), F.least(page, page_count))


def outline_candidates(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """W-10: usable outline entries, at most 300 per paper."""
    rows = outline.filter((F.col("page") >= 1) & F.col("level").between(1, 2)).withColumn("title", strip(F.col("title")))
    rows = rows.filter(F.length("title") >= 3).join(page_counts, "paper_id")
    rows = rows.withColumn("page_start", clamp_page(F.col("page"), F.col("page_count"))).withColumn("_t", casefold(F.col("title")))
    unique = first_per_key(rows, ["paper_id", "level", "_t", "page_start"], [F.col("position")])
    order = [F.col("page_start"), F.col("level"), F.col("position")]
    capped = top_per_key(unique, ["paper_id"], order, K.MAX_CHAPTERS, "entry")
    return capped.select("paper_id", "entry", "level", "title", "page_start", "page_count")


def heading_candidates(blocks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """W-11: first block of every section label, references and the like left out."""
    label = strip(F.col("section_label"))
    rows = blocks.withColumn("title", label).filter((label != "") & (label != "Document"))
    first = first_per_key(rows.withColumn("_t", casefold(label)), ["paper_id", "_t"], [F.col("ordinal")])
    kept = first.filter((F.length("title") >= 3) & ~F.col("title").rlike(NONCONTENT_LABEL)).join(page_counts, "paper_id")
    kept = kept.withColumn("page_start", clamp_page(F.col("page"), F.col("page_count"))).withColumn("level", F.lit(1))
    capped = top_per_key(kept, ["paper_id"], [F.col("page_start"), F.col("ordinal")], K.MAX_CHAPTERS, "entry")
    return capped.select("paper_id", "entry", "level", "title", "page_start", "page_count")


def bucket_candidates(page_counts: DataFrame) -> DataFrame:
    """W-12: ten-page buckets, or two halves when ten pages would make one."""
    size = F.when(F.col("page_count") <= K.CHAPTER_BUCKET_PAGES, F.greatest(F.lit(1), F.floor(F.col("page_count") / 2))).otherwise(
        K.CHAPTER_BUCKET_PAGES
    ).cast("int")
    rows = page_counts.filter(F.col("page_count") >= 2).withColumn("_size", size)
    starts = F.slice(F.sequence(F.lit(1), F.col("page_count"), F.col("_size")), 1, K.MAX_CHAPTERS)
    out = rows.select("paper_id", "page_count", "_size", F.posexplode(starts).alias("pos", "page_start"))
    end = F.least(F.col("page_start") + F.col("_size") - 1, F.col("page_count"))
    title = F.concat(F.lit("Pages "), F.col("page_start"), F.lit("-"), end)
    return out.select("paper_id", (F.col("pos") + 1).alias("entry"), F.lit(1).alias("level"), title.alias("title"), "page_start", "page_count")


def build_chapters(entries: DataFrame, source: str) -> DataFrame:
    """W-08/W-09: ranges from ordered entries; an entry ends before the next of its level or above.

    At most 300 entries exist per paper, so these windows stay small.
    """
    unique = first_per_key(entries, ["paper_id", "level", "page_start"], [F.col("entry")])
    after = W.partitionBy("paper_id").orderBy("entry").rowsBetween(1, W.unboundedFollowing)
    next_top = F.first(F.when(F.col("level") <= 1, F.col("page_start")), ignorenulls=True).over(after)
    next_any = F.first("page_start").over(after)
    end = F.when(F.col("level") == 1, next_top).otherwise(next_any) - 1
    ended = unique.withColumn("_end", F.coalesce(end, F.col("page_count")))
    numbered = ended.withColumn("index", F.row_number().over(W.partitionBy("paper_id").orderBy("entry")) - 1)
    return numbered.select(
        "paper_id",
        chapter_id(F.col("paper_id"), F.col("title"), F.col("page_start"), F.col("level")).alias("chapter_id"),
        "index", "title", "level", "page_start",
        F.greatest(F.col("page_start"), F.least("_end", "page_count")).alias("page_end"),
        F.lit(source).alias("source"),
    )


def chapter_id(paper_id: Column, title: Column, page_start: Column, level: Column) -> Column:
    raw = F.concat_ws("|", paper_id.cast("string"), level.cast("string"), page_start.cast("string"), collapse(casefold(title)))
    return F.concat(F.lit("ch-"), F.left(F.sha1(raw), F.lit(12)))


def choose_tier(outline: DataFrame, headings: DataFrame, buckets: DataFrame) -> DataFrame:
    """W-13: first tier that yields two chapters or more."""
    tiers = (
        outline.withColumn("tier", F.lit(1))
        .unionByName(headings.withColumn("tier", F.lit(2)))
        .unionByName(buckets.withColumn("tier", F.lit(3)))
    )
    usable = tiers.groupBy("paper_id", "tier").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    best = usable.groupBy("paper_id").agg(F.min("tier").alias("tier"))
    return tiers.join(best, ["paper_id", "tier"], "left_semi").drop("tier")


def chapter_listing(papers: DataFrame, chapters: DataFrame) -> DataFrame:
    """W-22: ordered chapter titles, source and whether any were detected."""
    entry = F.struct("index", "title", "source")
    listed = chapters.groupBy("paper_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    out = papers.join(listed, "paper_id", "left")
    return out.select(
        "paper_id", "page_count",
        F.coalesce(F.transform("entries", lambda e: e["title"]), F.array().cast("array<string>")).alias("titles"),
        F.try_element_at("entries", F.lit(1))["source"].alias("source"),
        F.col("entries").isNotNull().alias("detected"),
    )


def chunks_in_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """J-11: chunks whose page lies in a chapter of their paper; unknown pages are out.

    Chapters are spread over their pages first, which turns the interval test
    into an equality and keeps a chunk from meeting chapters it is not in.
    """
    pages = chapters.select("paper_id", "chapter_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return chunks.join(pages, ["paper_id", "page"])


def resolve_chapters(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """J-19: requested chapters by id."""
    return requests.join(chapters, ["paper_id", "chapter_id"])


def unknown_chapters(requests: DataFrame, chapters: DataFrame) -> DataFrame:
    """J-19: requests that name no chapter; titles are never matched."""
    return requests.join(chapters, ["paper_id", "chapter_id"], "left_anti")
