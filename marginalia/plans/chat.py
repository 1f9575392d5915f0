"""Batch answers for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.citations import intent
from ..functions.text import clean_snippet, once
from ..operators import clean as N
from ..operators import retrieval as R
from ..operators.skew import first_per_key, reliable

TOP_K = 6
OVERFETCH = 4
NO_PASSAGES = (
    "I couldn't find grounded passages in this paper for that question yet. Try rephrasing, or check that the paper has finished ingesting."
)
NO_TEXT = "The retrieved passages did not contain readable text to answer this question."


def content_questions(questions: DataFrame) -> DataFrame:
    """Only content questions reach retrieval."""
    return questions.withColumn("_intent", once(intent(F.col("text")))).filter(F.col("_intent") == "content").drop("_intent")


def answer_context(questions: DataFrame, chunks: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """V-12: retrieve four times too many, clean without fallback, then diversify.

    questions(question_id, paper_id, text), chunks(paper_id, chunk_id, page, text).
    """
    return _context(questions, reliable(R.about_asked(chunks, questions)), top_k)


def _context(questions: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """:func:`answer_context` from the stored chunks of the papers asked about; windows clean the few hits of a question."""
    hits = R.sparse_nearest(R.with_hash_vector(questions), R.with_hash_vector(asked), top_k * OVERFETCH)
    found = hits.join(asked, ["paper_id", "chunk_id"]).select("question_id", "chunk_id", "page", "text", "rank")
    marked = N.mark_narrative(found, ["question_id"])
    marked = marked.withColumn("_any", F.max(F.col("clean").isNotNull()).over(W.partitionBy("question_id")))
    kept = marked.filter(F.col("clean").isNotNull() | ~F.col("_any"))
    rows = kept.withColumn("text", F.coalesce("clean", "text")).withColumn("low_prose", F.coalesce("low_prose", F.lit(False)))
    return N.diversify(rows, ["question_id"], top_k, ["low_prose", "rank"])


def draft_answers(questions: DataFrame, context: DataFrame) -> DataFrame:
    """V-12: numbered snippets of the context, one draft per question."""
    snippet = clean_snippet(F.col("text"), 320)
    shown = F.when(snippet != "", F.struct("position", F.concat(snippet, F.lit(" ["), F.col("position") + 1, F.lit("]")).alias("line")))
    lines = context.groupBy("question_id").agg(F.array_sort(F.collect_list(shown)).alias("ls"), F.count(F.lit(1)).alias("n"))
    joined = questions.select("question_id", "paper_id").join(lines, "question_id", "left")
    text = F.when(F.col("n").isNull(), NO_PASSAGES).when(F.size("ls") == 0, NO_TEXT).otherwise(
        F.array_join(F.transform("ls", lambda x: x["line"]), " ")
    )
    return joined.select("question_id", "paper_id", text.alias("draft"))


def used_pages(context: DataFrame, chunks: DataFrame) -> DataFrame:
    pages = first_per_key(chunks.select("chunk_id", "page"), ["chunk_id"], [F.col("page")])
    return context.join(pages, "chunk_id").select("question_id", "page").distinct()


def answers(questions: DataFrame, chunks: DataFrame, media: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """V-12, V-13, V-16: the draft of every question with the chunks it rests on and the figures that belong to it.

    ``media`` as in ``relevant_figures``. At most ``top_k`` chunk ids and three figures a question.
    """
    asked = reliable(R.about_asked(chunks, questions))
    context = reliable(_context(questions, asked, top_k))
    cited = context.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("cited"))
    shown = R.relevant_figures(questions, media, used_pages(context, asked))
    figures = shown.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "media_id"))).alias("figures"))
    rows = draft_answers(questions, context).join(cited, "question_id", "left").join(figures, "question_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "question_id", "paper_id", "draft",
        F.coalesce(R.grounding_ids(F.col("cited"), none), none).alias("chunk_ids"),
        F.coalesce(F.transform("figures", lambda f: f["media_id"]), none).alias("figures"),
    )
