"""Blocks to chunks: merging on a page, token windows, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_safe, chunk_id, let, token_count, words
from .skew import running_number


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """C-02: overlapping windows of whitespace tokens, as an array of pieces."""
    step = max(size - min(overlap, max(size - 1, 0)), 1)

    def cut(tokens: Column) -> Column:
        count = F.size(tokens)
        starts = F.sequence(F.lit(0), F.ceil((count - size) / step).cast("int"))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i * step + 1, F.lit(size)), " "))
        return F.when(count == 0, F.array(F.lit(""))).when(count <= size, F.array(text)).otherwise(pieces)

    return let(words(text), cut)


def merge_groups(blocks: DataFrame, size: int) -> DataFrame:
    """C-03: greedy groups of neighbouring text blocks on one page.

    A block joins the open group while modality and provenance agree and the
    group stays within ``size`` tokens; a block with an image stands alone. The
    fold runs over one physical page at a time, so no larger unit is collected.
    """
    atomic = (F.col("modality") != "text") | F.col("image_path").isNotNull()
    block = F.struct(
        "ordinal", "modality", "provenance", "text", "bbox", "image_path", "section_label", "ocr_confidence",
        "language", "figure_label", "caption", token_count(F.col("text")).alias("tokens"), atomic.alias("atomic"),
    )
    pages = blocks.groupBy("paper_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))

    def step(acc: Column, b: Column) -> Column:
        joins = (
            (acc["group"] >= 0)
            & ~b["atomic"]
            & ~acc["closed"]
            & (acc["kind"] == F.concat_ws("|", b["modality"], b["provenance"]))
            & (acc["tokens"] + b["tokens"] <= size)
        )
        return F.struct(
            F.when(joins, acc["group"]).otherwise(acc["group"] + 1).alias("group"),
            F.when(joins, acc["tokens"] + b["tokens"]).otherwise(b["tokens"]).alias("tokens"),
            F.concat_ws("|", b["modality"], b["provenance"]).alias("kind"),
            b["atomic"].alias("closed"),
            F.array_append(acc["groups"], F.when(joins, acc["group"]).otherwise(acc["group"] + 1)).alias("groups"),
        )

    start = F.struct(
        F.lit(-1).alias("group"), F.lit(0).alias("tokens"), F.lit("").alias("kind"), F.lit(False).alias("closed"),
        F.array().cast("array<int>").alias("groups"),
    )
    grouped = pages.withColumn("groups", F.aggregate("blocks", start, step)["groups"])
    zipped = F.explode(F.arrays_zip("blocks", "groups")).alias("z")
    return grouped.select("paper_id", "page", zipped).select("paper_id", "page", "z.groups", "z.blocks.*").withColumnRenamed(
        "groups", "group_no"
    )


def finalize_groups(grouped: DataFrame) -> DataFrame:
    """C-04: one row per group: joined text, union box, first values, mean confidence.

    A group holds at most ``size`` tokens, which bounds the collected text.
    """
    order = F.col("ordinal")

    def first(column: str) -> Column:
        return F.min_by(column, F.when(blank_safe(F.col(column)) != "", order)).alias(column)

    text = F.sort_array(F.collect_list(F.when(blank_safe(F.col("text")) != "", F.struct("ordinal", "text"))))
    box = F.struct(
        F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")
    )
    return grouped.groupBy("paper_id", "page", "group_no").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by("modality", order).alias("modality"),
        F.min_by("provenance", order).alias("provenance"),
        F.min_by("section_label", order).alias("section_label"),
        F.array_join(F.transform(text, lambda t: t["text"]), "\n\n").alias("text"),
        F.when(F.count("bbox") > 0, box).alias("bbox"),
        first("image_path"), first("figure_label"), first("caption"), first("language"),
        F.avg("ocr_confidence").alias("ocr_confidence"),
        F.count(F.lit(1)).alias("blocks"),
    )


def chunk_blocks(blocks: DataFrame, size: int, overlap: int) -> DataFrame:
    """C-03 to C-05: blocks of any number of papers to numbered chunks."""
    groups = finalize_groups(merge_groups(blocks, size))
    pieces = F.when(F.col("modality") == "image", F.array("text")).otherwise(token_windows(F.col("text"), size, overlap))
    split = groups.select(
        "paper_id", "page", "modality", "provenance", "section_label", "bbox", "image_path", "figure_label", "caption",
        "language", "ocr_confidence", "group_no", F.posexplode(pieces).alias("piece", "text"),
    )
    return number_chunks(split.withColumn("token_count", token_count(F.col("text"))))


def number_chunks(pieces: DataFrame) -> DataFrame:
    """C-05: consecutive ordinals per paper and the chunk id built from them."""
    numbered = running_number(pieces, ["paper_id"], "page", [F.col("page"), F.col("group_no"), F.col("piece")], "ordinal")
    return numbered.withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("ordinal"))).drop("group_no", "piece")


def chunk_text_rows(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """C-02 on whole texts: the window number is the position in the row, so no shuffle."""
    return texts.select("paper_id", F.posexplode(token_windows(F.col("text"), size, overlap)).alias("ordinal", "text"))


def all_streams(text: DataFrame, *others: DataFrame) -> DataFrame:
    """X-05: text, image, OCR and vision rows as one table."""
    out = text
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
