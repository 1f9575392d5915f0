"""Logical tables over the given parquet files.

Each view maps star-schema, log and document columns onto the study domain. The
meaning of a column is invented, its size and shape are not: every view reads
its whole base table. ``VIEWS_SQL`` states the same definitions for DuckDB, and
shared fragments (``DECORATE``, ``TITLE``, ...) are valid in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import first_per_key

AS_OF = "2024-01-30 23:59:59"


SCAN_PARTITIONS = "spark.marginalia.scanPartitions"
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Where ``SCAN_PARTITIONS`` is set, text tables are dealt out to that many partitions: a file with one
    row group is read by one task, whatever the rules that follow cost."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(parts), TEXT_TABLES[name]) if parts and name in TEXT_TABLES else rows


# --- study ---------------------------------------------------------------------

RATING = (
    "case event_type when 'error' then 'again' when 'click' then 'almost' "
    "when 'view' then 'got_it' when 'purchase' then 'good' else 'easy' end"
)


def papers(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("paper_id"), F.col("n_name").alias("title"), F.col("r_name").alias("label"))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as card_id",
        "c_nationkey as paper_id",
        "c_name as front",
        "c_acctbal < 0 as starred",
        "c_mktsegment as origin",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(c_custkey % 30 as int)) as created_at",
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id as review_id", "user_id as card_id", f"{RATING} as rating", "ts as reviewed_at"
    )


def quizzes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as quiz_id", "p_size % 25 as paper_id", "p_name as title"
    )


ATTEMPT_COLUMNS = [
    "o_orderkey as attempt_id",
    "o_custkey as quiz_id",
    "case when o_orderpriority = '1-URGENT' then 'retry_missed' else 'full' end as mode",
    "o_orderdate as finished_at",
]


def attempt_heads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*ATTEMPT_COLUMNS)


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as attempt_id",
        "l_linenumber as question_no",
        "l_returnflag <> 'R' as is_correct",
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )


NEWEST_SUBMISSION = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = first_per_key(
        submissions(spark, sf), ["attempt_id", "question_no"], [F.desc(c) for c in NEWEST_SUBMISSION]
    )
    return rows.select("attempt_id", "question_no", "is_correct")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts with their score; an attempt without answers scores 0."""
    from ..operators.quiz import score_attempts

    scored = score_attempts(answers(spark, sf))
    heads = attempt_heads(spark, sf).join(scored, "attempt_id", "left")
    # the paper of an attempt is the paper of its quiz
    filled = heads.fillna(0, ["correct", "total"]).fillna(0.0, ["score"])
    return filled.withColumn("missed", F.coalesce("missed", F.array().cast("array<int>")))


# --- documents -----------------------------------------------------------------

# Which decoration a line gets: a rule fires on every kind, plain prose on the rest.
DECORATE = r"""
case (paper_id * 7 + ordinal * 3) % 29
  when 0 then concat('Figure ', ordinal + 1, ': ', text)
  when 1 then concat('**Table ', ordinal + 1, '. ', text, '**')
  when 2 then concat('- ', ordinal + 1, ' -')
  when 3 then concat('https://host.example/', paper_id, '/', ordinal)
  when 4 then concat(text, ' The publisher grants permission to reproduce it.')
  when 5 then concat('lead', ordinal, '@uni.example.edu, Department of Computing, University of X. ', text)
  when 6 then concat('International Journal of Computer Science, Vol. ', ordinal + 1, ', No. 1, 2010 ', text)
  when 7 then concat('ISSN 1947-55', ordinal, ' ', text)
  when 8 then concat('(c) 2020 The Publisher. ', text)
  when 9 then concat('She received her Ph.D and is currently pursuing research. ', text)
  when 10 then concat('Dr. A. Name, Some University, City Abstract— ', text)
  when 11 then concat('{a, b}@mail.example.edu', chr(10), chr(10), text)
  when 12 then concat('Our model achieves ', ordinal + 20, '.4 points on the task and is better than the baseline. ', text)
  when 13 then concat('The pipeline is shown in Figure ', ordinal + 1, ' and measured in Table ', paper_id % 9 + 1, '. ', text)
  when 14 then concat('Span', ordinal, ' attention is defined as the share of the input that is in view. ', text)
  when 15 then concat('**Concept ', paper_id % 40, '** — the idea that is used for the task in the paper [', ordinal % 7 + 1, '].')
  when 16 then concat('First, the data is split in ', ordinal + 2, ' parts and the model is trained on them. ', text)
  when 17 then concat('We use Byte Pair Encoding (BPE) and a Support Vector Machine to read the text. ', text)
  when 18 then concat('However, the method does not work in dark conditions and remains an open question. ', text)
  when 19 then concat('The results on the dataset show that accuracy is improved by ', ordinal + 3, '% over the prior work. ', text)
  when 20 then concat('Proceedings of the Annual Meeting on the Study of Things, volume one, held in the city of X: ', text)
  else text
end
"""

SECTION_LABEL = r"""
case ordinal % 11 when 0 then 'Introduction' when 3 then 'Methods' when 6 then 'Results' when 9 then 'References' else 'Discussion' end
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line of every document; four lines make a page."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("paper_id"), "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")
    ).withColumn("page", (F.floor(F.col("ordinal") / 4) + 1).cast("int"))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with paper furniture mixed in, as retrieved chunks."""
    return (
        lines(spark, sf)
        .withColumn("text", F.expr(DECORATE))
        .withColumn("section_label", F.expr(SECTION_LABEL))
        .withColumn("modality", F.expr("case when ordinal % 13 = 5 then 'ocr' else 'text' end"))
        .withColumn("chunk_id", F.expr("concat(paper_id, '::c', lpad(cast(ordinal as string), 5, '0'))"))
        .select("paper_id", "chunk_id", "page", "ordinal", "modality", "section_label", "lang", "text")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id as chunk_id", "label as paper_id", "cast(vec_id % 12 + 1 as int) as page", "embedding"
    )


AUTHORS = r"""
case doc_id % 9
  when 0 then 'S. Sumathi'
  when 1 then 'Sumathi S.|Ada Lovelace'
  when 2 then 'Ms.S.Sumathi|J. R. Smith|Alan Turing'
  when 3 then 'Sumathi, S.|M. Uma Maheswari'
  when 4 then 'M. Uma Maheswari|Plato|Grace Hopper|Kurt Gödel'
  when 5 then 'Plato'
  when 6 then ''
  when 7 then 'A. One|B. Two|C. Three|D. Four|E. Five|F. Six|G. Seven|H. Eight|I. Nine|J. Ten|K. Eleven|L. Twelve|M. Thirteen|N. Fourteen|O. Fifteen|P. Sixteen|Q. Seventeen|R. Eighteen|S. Nineteen|T. Twenty|U. Last'
  else 'Prof. Maria Garcia|Dr Lee'
end
"""
ARTICLE_ID = "case when doc_id % 10 = 9 then concat('upload:', doc_id) else concat('24', lpad(cast(doc_id % 12 + 1 as {string}), 2, '0'), '.', lpad(cast(doc_id % 100000 as {string}), 5, '0')) end"
PUBLISHED = "case when doc_id % 8 = 7 then null else date '2023-01-01' + cast(doc_id % 900 as int) end"
PAPER_STATUS = "case doc_id % 4 when 0 then 'ready' when 1 then 'queued' when 2 then 'processing' else 'error' end"


def library(spark: SparkSession, sf: str) -> DataFrame:
    """Paper metadata, one row per document."""
    string = {"string": "string"}
    return (
        table(spark, sf, "documents")
        .selectExpr(
            "doc_id as paper_id",
            ARTICLE_ID.format(**string) + " as article_id",
            "case when doc_id % 16 = 15 then '' else trim(substring_index(substring_index(text, '.', 1), '\\n', 1)) end as title",
            AUTHORS + " as author_list",
            PUBLISHED + " as published",
            "array(source, lang) as categories",
            PAPER_STATUS + " as status",
            "cast(n_chars as int) as page_count",
            "text as abstract",
        )
        .withColumn("authors", F.filter(F.split("author_list", "\\|"), lambda a: a != ""))
        .withColumn("article_label", F.expr("case when article_id like 'upload:%' then 'Uploaded PDF' else concat('arXiv:', article_id) end"))
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr("conv_id as session_id", "turn", "role", "text")


# --- jobs ----------------------------------------------------------------------

STAGE_OF = (
    "case event_id % 7 when 0 then 'Download' when 1 then 'Extract text' when 2 then 'Extract images' when 3 then 'OCR' "
    "when 4 then 'Vision analysis' when 5 then 'Embedding' else 'Generate report' end"
)


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    """Stage log: one job per user and day."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "concat(user_id, '-', date_format(ts, 'yyyyMMdd')) as job_id",
        "user_id as paper_id",
        f"{STAGE_OF} as stage",
        "case when value < 5 then 'error' when value < 8 then 'running' else 'done' end as status",
        "ts",
    )


# --- the same views for DuckDB ---------------------------------------------------

VIEWS_SQL = {
    "papers": "select n_nationkey as paper_id, n_name as title, r_name as label from nation join region on n_regionkey = r_regionkey",
    "cards": "select c_custkey as card_id, c_nationkey as paper_id, c_name as front, c_acctbal < 0 as starred, c_mktsegment as origin,"
    " timestamp '2024-01-01 00:00:00' + to_days((c_custkey % 30)::int) as created_at from customer",
    "reviews": f"select event_id as review_id, user_id as card_id, {RATING} as rating, ts as reviewed_at from events",
    "quizzes": "select p_partkey as quiz_id, p_size % 25 as paper_id, p_name as title from part",
    "answers": "select l_orderkey as attempt_id, l_linenumber as question_no, l_returnflag <> 'R' as is_correct from lineitem"
    " qualify row_number() over (partition by l_orderkey, l_linenumber order by "
    + ", ".join(f"{c} desc" for c in NEWEST_SUBMISSION) + ") = 1",
    "scores": "select attempt_id, sum(is_correct::int)::bigint as correct, count(*) as total, sum(is_correct::int) / count(*) as score,"
    " list_sort(list(question_no) filter (where not is_correct)) as missed from answers group by attempt_id",
    "attempts": "select h.attempt_id, quiz_id, mode, finished_at, coalesce(correct, 0) as correct, coalesce(total, 0) as total,"
    " coalesce(score, 0.0) as score, coalesce(missed, []) as missed from (select " + ", ".join(ATTEMPT_COLUMNS)
    + " from orders) h left join scores using (attempt_id)",
    "lines": "select doc_id as paper_id, lang, (u.pos - 1)::int as ordinal, string_split(text, chr(10))[u.pos] as text,"
    " (floor((u.pos - 1) / 4)::int + 1)::int as page from documents, range(1, len(string_split(text, chr(10))) + 1) u(pos)",
    "passages": f"select paper_id, concat(paper_id, '::c', lpad(ordinal::varchar, 5, '0')) as chunk_id, page, ordinal,"
    f" case when ordinal % 13 = 5 then 'ocr' else 'text' end as modality, {SECTION_LABEL} as section_label, lang, {DECORATE} as text from lines",
    "vectors": "select vec_id as chunk_id, label as paper_id, (vec_id % 12 + 1)::int as page, embedding from embeddings",
    "library": f"select doc_id as paper_id, {ARTICLE_ID.format(string='varchar')} as article_id,"
    " case when doc_id % 16 = 15 then '' else trim(string_split(string_split(text, '.')[1], chr(10))[1]) end as title,"
    f" {AUTHORS} as author_list, list_filter(string_split({AUTHORS}, '|'), lambda a: a <> '') as authors, {PUBLISHED} as published,"
    f" [source, lang] as categories, {PAPER_STATUS} as status, n_chars::int as page_count, text as abstract,"
    f" case when doc_id % 10 = 9 then 'Uploaded PDF' else concat('arXiv:', {ARTICLE_ID.format(string='varchar')}) end as article_label from documents",
    "messages": "select conv_id as session_id, turn, role, text from conversations",
    "stage_events": f"select event_id, concat(user_id, '-', strftime(ts, '%Y%m%d')) as job_id, user_id as paper_id, {STAGE_OF} as stage,"
    " case when value < 5 then 'error' when value < 8 then 'running' else 'done' end as status, ts from events",
}

NEEDS = {"scores": ["answers"], "attempts": ["answers", "scores"], "passages": ["lines"]}


def with_views(*names: str) -> str:
    """A WITH prefix that defines the named views and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS_SQL[n]})" for n in ordered)
