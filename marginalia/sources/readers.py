"""Readers and block extraction for feeds, uploads and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import blank_safe, collapse, paper_id_of, strip, strip_right
from ..operators.skew import carry_forward

FEED_SCHEMA = """
id string, title string, summary string, published string, updated string,
author array<struct<name: string>>, category array<struct<_term: string>>,
link array<struct<_rel: string, _href: string, _title: string, _type: string>>
"""


def atom_papers(spark: SparkSession, path: str) -> DataFrame:
    """S-01: metadata feed entries as paper rows."""
    feed = spark.read.schema(FEED_SCHEMA).option("rowTag", "entry").option("ignoreNamespace", "true").xml(path)
    return feed_rows(feed)


def feed_rows(feed: DataFrame) -> DataFrame:
    tail = F.regexp_extract(F.regexp_replace(strip(F.col("id")), "/+$", ""), "([^/]*)$", 1)
    bare = F.regexp_extract(tail, r"^(.+?)(v\d+)?$", 1)
    links = F.col("link")
    pdf = F.filter(links, lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf"))
    page = F.filter(links, lambda x: x["_rel"] == "alternate")
    last = F.lit(-1)
    return feed.select(
        paper_id_of(bare).alias("paper_id"),
        bare.alias("article_id"),
        F.concat(F.lit("arXiv:"), bare).alias("article_label"),
        F.nullif(F.regexp_extract(tail, r"^(.+?)(v\d+)?$", 2), F.lit("")).alias("version"),
        collapse(F.col("title")).alias("title"),
        collapse(F.col("summary")).alias("abstract"),
        F.filter(F.transform("author", lambda a: strip(a["name"])), lambda a: a != "").alias("authors"),
        F.filter(F.transform("category", lambda c: c["_term"]), lambda c: blank_safe(c) != "").alias("categories"),
        F.try_to_date(F.left("published", F.lit(10)), "yyyy-MM-dd").alias("published"),
        F.try_to_date(F.left("updated", F.lit(10)), "yyyy-MM-dd").alias("updated"),
        F.coalesce(
            F.try_element_at(pdf, last)["_href"], F.concat(F.lit("https://arxiv.org/pdf/"), bare)
        ).alias("pdf_url"),
        F.coalesce(F.try_element_at(page, last)["_href"], F.nullif(strip(F.col("id")), F.lit(""))).alias("abs_url"),
        F.lit("queued").alias("status"),
        F.lit(False).alias("ingested"),
    )


def binary_uploads(spark: SparkSession, path: str) -> DataFrame:
    """S-03/S-05 input: uploaded files with path, length and content."""
    return spark.read.format("binaryFile").load(path)


def upload_verdict(name: Column, mime: Column, length: Column) -> Column:
    """S-05: reject reason, null when the upload is accepted."""
    pdf = (F.lower(blank_safe(mime)) == "application/pdf") | F.lower(blank_safe(name)).endswith(".pdf")
    return (
        F.when(~pdf, "not_a_pdf").when(length > K.MAX_UPLOAD_BYTES, "too_large").when(length == 0, "empty")
    )


def upload_id(content: Column) -> Column:
    """S-03: same bytes, same id."""
    return F.concat(F.lit("upload-"), F.left(F.sha2(content, 256), F.lit(24)))


def derive_title(given: Column, meta_title: Column, text: Column, filename: Column) -> Column:
    """S-04: given, else metadata, else first non-blank line, else file stem."""
    lines = F.filter(F.split(blank_safe(text), "\n"), lambda ln: strip(ln) != "")
    base = F.regexp_extract(blank_safe(filename), "([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(.)\.[^.]*$", "$1")
    return F.coalesce(
        F.nullif(strip(given), F.lit("")),
        F.nullif(strip(meta_title), F.lit("")),
        F.when(F.size(lines) > 0, F.left(strip(F.try_element_at(lines, F.lit(1))), F.lit(300))),
        F.nullif(strip(stem), F.lit("")),
        F.lit("Untitled upload"),
    )


# page furniture, and the tags that open or close a block (fixed patterns, portable)
FURNITURE = (
    r"(?is)<!--.*?-->|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>"
    r"|<div class=\"ad\">.*?</div>"
)
BLOCK_OPEN = r"(?i)<(h[1-6]|p)(?:\s[^>]*)?>"
BLOCK_CLOSE = r"(?i)</(?:h[1-6]|p|article|main|body|html)>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_blocks(pages: DataFrame) -> DataFrame:
    """S-06: headings and paragraphs of each page, in order.

    ``ordinal`` is the position inside the page row, so blocks come out of one
    narrow pass without a shuffle.
    """
    marked = F.regexp_replace("html", FURNITURE, " ")
    marked = F.regexp_replace(marked, BLOCK_OPEN, "\u0001$1\u0002")
    marked = F.regexp_replace(marked, BLOCK_CLOSE, "\u0001x\u0002")

    def readable(piece: Column) -> Column:
        text = F.regexp_replace(F.regexp_extract(piece, "(?s)\u0002(.*)$", 1), "<[^>]+>", " ")
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
        tag = F.lower(F.regexp_extract(piece, "^([A-Za-z0-9]+)\u0002", 1))
        return F.struct(tag.alias("tag"), collapse(text).alias("text"))

    blocks = F.filter(
        F.transform(F.split(marked, "\u0001"), readable), lambda b: b["tag"].rlike("^(h[1-6]|p)$") & (b["text"] != "")
    )
    return pages.select("page_id", F.posexplode(blocks).alias("ordinal", "b")).select("page_id", "ordinal", "b.tag", "b.text")


def looks_like_heading(text: Column, larger: Column) -> Column:
    """W-07: at most 100 characters and larger than body text, numbered, or a known heading word."""
    t = strip(text)
    known = F.lower(strip_right(t, ":.")).isin(K.HEADING_KEYWORDS)
    return (t != "") & (F.length(t) <= 100) & (larger | t.rlike(K.NUMBERED_HEADING) | known)


def sectioned_blocks(blocks: DataFrame, keys: list[str], heading: Column) -> DataFrame:
    """W-06: body blocks labelled with the last heading above them."""
    label = F.when(heading, strip_right(F.col("text"), ":."))
    carried = carry_forward(
        blocks.withColumn("_heading", heading), keys, "ordinal", label, "section_label", "Document"
    )
    body = carried.filter(~F.col("_heading")).drop("_heading")
    return body.withColumn("token_count", F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")))
