"""Library listing, search, bibliography and record answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.citations import article_url, detect_styles, format_citation, intent, name_parts
from ..functions.text import blank_safe, let, strip
from .skew import top_per_key


def with_report_flag(papers: DataFrame, reports: DataFrame) -> DataFrame:
    """J-01 / S-18: whether a report exists for each paper."""
    known = reports.select("paper_id").distinct().withColumn("has_report", F.lit(True))
    return papers.join(known, "paper_id", "left").fillna(False, ["has_report"])


def listing(papers: DataFrame, reports: DataFrame) -> DataFrame:
    """S-18: every paper, newest update first."""
    return with_report_flag(papers, reports).orderBy(F.desc("updated_at"), "paper_id")


def text_search(papers: DataFrame, query: str) -> DataFrame:
    """Q-17: query inside the title, an author or the label."""
    wanted = F.lit(query.strip().lower())
    hit = (
        F.contains(F.lower("title"), wanted)
        | F.exists("authors", lambda a: F.contains(F.lower(a), wanted))
        | F.contains(F.lower("article_label"), wanted)
    )
    return papers if not query.strip() else papers.filter(hit)


DATE_WINDOWS = {"past_month": 30, "past_6_months": 182, "past_year": 365}


def metadata_search(
    papers: DataFrame, query: str = "", category: str | None = None, date_range: str = "any", today: str | None = None,
    sort: str = "relevance", limit: int = 25,
) -> DataFrame:
    """Q-18: term hits over all fields, category, date window, relevance or newest first."""
    terms = query.lower().split()
    fields = F.lower(F.concat_ws(" ", "title", "abstract", F.array_join("authors", " "), F.array_join("categories", " ")))
    hits = F.lit(0)
    for term in terms:
        hits = hits + F.contains(F.col("_fields"), F.lit(term)).cast("int")
    rows = papers.withColumn("_fields", F.explode(F.array(fields))).withColumn("relevance", hits)
    if terms:
        rows = rows.filter(F.col("relevance") > 0)
    if category:
        rows = rows.filter(F.array_contains("categories", category))
    if date_range in DATE_WINDOWS:
        end = F.to_date(F.lit(today))
        rows = rows.filter(F.col("published").between(F.date_sub(end, DATE_WINDOWS[date_range]), end))
    elif date_range == "2024_2025":
        rows = rows.filter(F.col("published").between(F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date")))
    newest = [F.desc_nulls_last("published"), F.col("paper_id")]
    order = [F.desc("relevance"), *newest] if sort == "relevance" else newest
    return rows.drop("_fields").orderBy(*order).limit(limit)


def merge_search_hits(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """J-02: hits flagged with library state; stored metadata wins."""
    known = stored.select("paper_id", F.col("title").alias("_title"), F.col("status").alias("_status"), F.col("ingested").alias("_ingested"))
    joined = hits.join(known, "paper_id", "left")
    return joined.select(
        "paper_id",
        F.coalesce("_title", "title").alias("title"),
        F.coalesce("_status", "status").alias("status"),
        F.col("_status").isNotNull().alias("in_library"),
        F.coalesce("_ingested", F.lit(False)).alias("ingested"),
    )


def citation_record(papers: DataFrame) -> DataFrame:
    """The record that styles are written from; a stored ``abs_url`` comes before the address made of the article id."""
    stored = F.col("abs_url") if "abs_url" in papers.columns else F.lit(None).cast("string")
    upload = F.col("article_id").startswith("upload:") | (F.col("article_label") == "Uploaded PDF")
    return papers.select(
        "paper_id",
        F.struct(
            F.col("title"),
            name_parts(F.col("authors")).alias("names"),
            F.year("published").alias("year"),
            F.col("article_id"),
            article_url(upload, stored, F.col("article_id")).alias("url"),
            upload.alias("upload"),
        ).alias("paper"),
    )


def bibliography(papers: DataFrame, styles: list[str] = K.CITATION_STYLES) -> DataFrame:
    """G-18: every paper in every style."""
    rows = citation_record(papers).select("paper_id", F.explode(F.array(F.col("paper"))).alias("paper"))
    listed = rows.select("paper_id", "paper", F.explode(F.array(*[F.lit(s) for s in styles])).alias("style"))
    return listed.select("paper_id", "style", format_citation(F.col("style"), F.col("paper")).alias("citation"))


def _mentions(low: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(low, F.lit(needle))
    return out


DATE_WORDS = ["year", "publish", "date", "when", "written", "released"]
AUTHOR_WORDS = ["author", "wrote", "who"]


def metadata_answer(question: Column, paper: dict[str, Column]) -> Column:
    """G-19: the recorded fields a question asks for, all of them when it names none."""

    def answer(low: Column) -> Column:
        everything = ~_mentions(low, AUTHOR_WORDS + DATE_WORDS + ["title", "arxiv", "categor", "subject"])
        authors = F.when(F.size(paper["authors"]) > 0, F.concat(F.lit("**Authors** — "), F.array_join(paper["authors"], ", "))).otherwise(
            "**Authors** — not recorded for this paper."
        )
        published = F.coalesce(
            F.concat(F.lit("**Published** — "), paper["published"].cast("string")), F.lit("**Published** — no publication date is recorded.")
        )
        link = F.concat(F.lit("https://arxiv.org/abs/"), paper["article_id"])
        source = F.when(
            paper["article_id"].startswith("upload:"), "**Source** — an uploaded PDF, so it has no arXiv identifier."
        ).otherwise(F.concat(F.lit("**arXiv** — "), paper["article_label"], F.lit(" ("), link, F.lit(")")))
        subjects = F.concat(F.lit("**Categories** — "), F.array_join(paper["categories"], ", "))
        parts = F.array(
            F.when(everything | _mentions(low, AUTHOR_WORDS), authors),
            F.when(everything | _mentions(low, DATE_WORDS), published),
            F.when(everything | _mentions(low, ["title"]), F.concat(F.lit("**Title** — "), paper["title"])),
            F.when(everything | _mentions(low, ["arxiv"]), source),
            F.when((everything | _mentions(low, ["categor", "subject"])) & (F.size(paper["categories"]) > 0), subjects),
        )
        return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")

    return let(F.lower(question), answer)


COUNTS_NOTE = (
    "Counts come from the ingested document itself, not from the text, so they reflect what was actually extracted."
)


def structure_answer(page_count: Column, figure_count: Column) -> Column:
    """G-19: page and figure counts, empty when neither is known."""
    parts = F.filter(
        F.array(
            F.when(page_count > 0, F.concat(F.lit("**Pages** — "), page_count.cast("string"))),
            F.when(figure_count.isNotNull(), F.concat(F.lit("**Figures and tables extracted** — "), figure_count.cast("string"))),
        ),
        lambda p: p.isNotNull(),
    )
    return F.when(F.size(parts) == 0, "").otherwise(F.array_join(F.concat(parts, F.array(F.lit(COUNTS_NOTE))), "\n\n"))


def record_answers(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """G-15 to G-19: questions answered from the paper record alone.

    Content questions drop out before the join; citation answers list the named
    styles, or every style when none is named.
    """
    asked = questions.withColumn("intent", F.explode(F.array(intent(F.col("text"))))).filter(F.col("intent") != "content")
    fields = {c: F.col(c) for c in ["authors", "published", "title", "article_id", "article_label", "categories"]}
    joined = asked.join(papers, "paper_id").join(citation_record(papers).withColumnRenamed("paper", "record"), "paper_id")
    wanted = F.when(F.size(detect_styles(F.col("text"))) > 0, detect_styles(F.col("text"))).otherwise(
        F.array(*[F.lit(s) for s in K.CITATION_STYLES])
    )
    labels = F.create_map(*[F.lit(v) for pair in K.CITATION_STYLE_LABELS.items() for v in pair])
    lines = F.transform(
        wanted, lambda s: F.concat(F.lit("**"), labels[s], F.lit("** — "), format_citation(s, F.col("record")))
    )
    lead = F.when(F.size(wanted) == 1, "Here is this paper cited in the style you asked for:").otherwise(
        "Here is this paper in each citation style:"
    )
    text = (
        F.when(F.col("intent") == "citation", F.concat(lead, F.lit("\n\n"), F.array_join(lines, "\n\n")))
        .when(F.col("intent") == "metadata", metadata_answer(F.col("text"), fields))
        .otherwise(structure_answer(F.col("page_count"), F.col("figure_count")))
    )
    return joined.select("question_id", "paper_id", "intent", text.alias("answer"))


def recent_history(messages: DataFrame, before: str = "turn", keep: int = 4) -> DataFrame:
    """W-21: the last four turns of each session as one note; empty texts are skipped."""
    last = top_per_key(messages, ["session_id"], [F.desc(before)], keep, "_back")
    line = F.struct(F.col(before).alias("t"), F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    spoken = F.when(blank_safe(F.col("text")) != "", line)
    listed = last.groupBy("session_id").agg(F.array_sort(F.collect_list(spoken)).alias("ls"))
    note = F.concat(F.lit("Conversation so far:\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n\n"))
    return listed.select("session_id", F.when(F.size("ls") > 0, note).otherwise("").alias("note"))


def paper_rows(raw: DataFrame) -> DataFrame:
    """S-23: stored strings to typed columns; bad dates become null, bad statuses the default."""
    return raw.select(
        "paper_id", strip(F.col("title")).alias("title"),
        F.coalesce(F.from_json("authors", "array<string>"), F.array().cast("array<string>")).alias("authors"),
        F.try_to_date(F.left("published", F.lit(10)), "yyyy-MM-dd").alias("published"),
        F.when(F.col("status").isin("queued", "processing", "ready", "error"), F.col("status")).otherwise("queued").alias("status"),
        F.coalesce("ingested", F.lit(False)).alias("ingested"),
    )


def _listed(json: Column, kind: str) -> Column:
    return F.coalesce(F.from_json(json, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _known(value: Column, names: list[str]) -> Column:
    return F.when(value.isin(names), value)


def job_rows(raw: DataFrame) -> DataFrame:
    """S-23: stored job rows to typed ones, stages and log as arrays of structs.

    A missing status is pending, a missing ``degraded`` false. A state, stage or
    status outside its fixed names becomes null and the row is marked not ``valid``, as
    is a percent outside 0 to 100; broken JSON gives empty arrays.
    """
    stages = F.transform(
        _listed(F.col("stages"), "struct<stage:string,status:string,detail:string,degraded:boolean>"),
        lambda s: F.struct(
            _known(s["stage"], K.STAGE_ORDER).alias("stage"), _known(F.coalesce(s["status"], F.lit("pending")), K.STAGE_STATUSES).alias("status"),
            s["detail"].alias("detail"), F.coalesce(s["degraded"], F.lit(False)).alias("degraded"),
        ),
    )
    log = F.transform(
        _listed(F.col("log"), "struct<t:string,m:string,stage:string>"),
        lambda e: F.struct(e["t"].alias("t"), e["m"].alias("m"), _known(e["stage"], K.STAGE_ORDER).alias("stage")),
    )
    rows = raw.withColumn("_stages", stages).withColumn("_log", log)
    named = F.forall("_stages", lambda s: s["stage"].isNotNull() & s["status"].isNotNull())
    valid = (
        F.col("state").isin(K.JOB_STATES) & F.col("percent").between(0, 100) & named
        & (F.col("current_stage").isNull() | F.col("current_stage").isin(K.STAGE_ORDER))
    )
    return rows.select(
        "job_id", "paper_id", _known(F.col("state"), K.JOB_STATES).alias("state"), _known(F.col("current_stage"), K.STAGE_ORDER).alias("current_stage"),
        F.col("percent").cast("int").alias("percent"), F.col("_stages").alias("stages"), F.col("_log").alias("log"), "error_message",
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def question_rows(raw: DataFrame) -> DataFrame:
    """S-23: stored question rows to typed ones, the answer key included.

    An unknown kind becomes multiple choice, an unknown difficulty recall; only
    objects count as options, their missing fields are empty texts. A question whose
    citation names no section, or one outside the fixed eleven, has no citation.
    """
    objects = F.filter(_listed(F.col("options"), "string"), lambda o: o.startswith("{"))
    field = lambda o, name: F.coalesce(F.get_json_object(o, f"$.{name}"), F.lit(""))
    cited = F.struct(
        F.col("citation_section").alias("section"), F.col("citation_page").cast("int").alias("page"), F.col("citation_chunk_id").alias("chunk_id"),
        F.coalesce("citation_snippet", F.lit("")).alias("snippet"),
    )
    return raw.select(
        "question_id", "quiz_id", "paper_id", F.col("index").cast("int").alias("index"), F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.coalesce(_known(F.col("kind"), K.QUESTION_KINDS), F.lit(K.QUESTION_KINDS[0])).alias("kind"),
        F.coalesce(_known(F.col("difficulty"), K.DIFFICULTIES), F.lit(K.DIFFICULTIES[0])).alias("difficulty"),
        F.transform(objects, lambda o: F.struct(field(o, "id").alias("id"), field(o, "text").alias("text"))).alias("options"),
        "correct_option_id", "correct_answer_text", _listed(F.col("accepted_answers"), "string").alias("accepted_answers"),
        F.coalesce("explanation", F.lit("")).alias("explanation"), F.when(F.col("citation_section").isin(K.SECTION_ORDER), cited).alias("citation"),
    )
