"""Page-layout joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, strip
from .skew import first_per_key

CAPTION_MARGIN = 80.0
MIN_SIDE = 40.0
OVERLAP_SHARE = 0.6
CAPTION = r"(?i)^(Fig(?:ure)?\.?\s*(\d+)|Table\s*(\d+))\s*[:.]?\s*(.*)$"


def caption_label(text: Column) -> Column:
    flat = collapse(text)
    figure, table = F.regexp_extract(flat, CAPTION, 2), F.regexp_extract(flat, CAPTION, 3)
    return F.when(figure != "", F.concat(F.lit("Fig "), figure)).when(table != "", F.concat(F.lit("Table "), table))


def nearest_caption(regions: DataFrame, captions: DataFrame) -> DataFrame:
    """J-09: closest caption above or below each region of the same page.

    regions(paper_id, page, region_id, x0..y1), captions(paper_id, page, caption_no, label, x0..y1).
    """
    c = captions.select("paper_id", "page", "caption_no", "label", *[F.col(v).alias(f"c_{v}") for v in ("x0", "y0", "x1", "y1")])
    pairs = regions.join(c, ["paper_id", "page"])
    gap = F.least(F.abs(F.col("c_y0") - F.col("y1")), F.abs(F.col("y0") - F.col("c_y1")))
    beside = F.least("c_x1", "x1") - F.greatest("c_x0", "x0")
    near = pairs.withColumn("gap", gap).filter((F.col("gap") <= CAPTION_MARGIN) & (beside >= -20))
    best = first_per_key(near, ["paper_id", "page", "region_id"], [F.col("gap"), F.col("caption_no")])
    found = best.select("paper_id", "page", "region_id", "label", "gap")
    return regions.join(found, ["paper_id", "page", "region_id"], "left")


def drop_overlapping(regions: DataFrame) -> DataFrame:
    """J-10: keep a region unless it covers 60 % of the smaller of it and one kept before.

    The choice is sequential on a page, so the fold runs per physical page.
    """
    sized = regions.filter((F.col("x1") - F.col("x0") >= MIN_SIDE) & (F.col("y1") - F.col("y0") >= MIN_SIDE))
    pages = sized.groupBy("paper_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("region_id", "x0", "y0", "x1", "y1"))).alias("rs")
    )

    def area(r: Column) -> Column:
        return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])

    def covers(a: Column, b: Column) -> Column:
        width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
        height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        return (width > 0) & (height > 0) & (width * height >= OVERLAP_SHARE * F.least(area(a), area(b)))

    kept = F.aggregate(
        "rs", F.slice("rs", 1, 0), lambda acc, r: F.when(F.exists(acc, lambda k: covers(r, k)), acc).otherwise(F.array_append(acc, r))
    )
    return pages.select("paper_id", "page", F.explode(kept).alias("r")).select("paper_id", "page", "r.*")


def dominant_size(spans: DataFrame, keys: list[str], default: float = 10.0) -> DataFrame:
    """A-17: font size that carries the most characters; the smaller size wins a tie."""
    sized = spans.withColumn("size", F.round("size", 1)).withColumn("chars", F.length(strip(F.col("text"))))
    # zero-length spans still name their document, so it can fall back to the default
    weights = sized.groupBy(*keys, "size").agg(F.sum(F.when(F.col("size") > 0, F.col("chars")).otherwise(0)).alias("weight"))
    best = weights.groupBy(*keys).agg(
        F.max_by("size", F.when(F.col("weight") > 0, F.struct(F.col("weight"), -F.col("size")))).alias("body_size")
    )
    return best.fillna(default, ["body_size"])


def ocr_regions(words: DataFrame, keys: list[str]) -> DataFrame:
    """A-18: readable words of a region joined in order, with their mean confidence."""
    usable = words.withColumn("word", strip(F.col("word"))).filter(
        (F.col("word") != "") & F.col("conf").isNotNull() & (F.col("conf") >= 0)
    )
    # two plain lists, filled row by row alike, are half as wide as one of structs
    listed = usable.groupBy(*keys).agg(
        F.collect_list("position").alias("_at"), F.collect_list("word").alias("_words"), (F.avg("conf") / 100).alias("ocr_confidence")
    )
    ordered = F.array_sort(F.arrays_zip("_at", "_words"))
    regions = listed.select(*keys, F.array_join(F.transform(ordered, lambda w: w["_words"]), " ").alias("text"), "ocr_confidence")
    return regions.filter(F.length("text") >= 5)
