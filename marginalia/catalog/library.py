"""Library upkeep: merges, jobs, chapters, layout, search, citations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.citations import detect_styles, intent, split_name
from ..operators import chapters as H
from ..operators import jobs as J
from ..operators import layout as L
from ..operators import library as B
from ..operators import merge as M
from ..operators.skew import shared_folder
from ..sources import readers as R
from ..sources import views as V
from ..sources.views import with_views
from . import sqltext as X
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

# --- merges ---------------------------------------------------------------------
# stored rows are customers; the change batch touches some and adds new keys


def _stored(spark, sf):
    return V.table(spark, sf, "customer").selectExpr(
        "c_custkey as paper_id", "c_name as title", "c_mktsegment as status", "if(c_custkey % 3 = 0, 'old error', null) as error_message",
        "c_acctbal as score", "false as ingested",
    )


STORED_SQL = "stored as (select c_custkey as paper_id, c_name as title, c_mktsegment as status, case when c_custkey % 3 = 0 then 'old error' end as error_message, c_acctbal as score, false as ingested from customer)"
CHANGES_SQL = "changes as (select s_suppkey * 40 as paper_id, s_name as title, s_acctbal as score from supplier)"


def _changes(spark, sf):
    return V.table(spark, sf, "supplier").selectExpr("s_suppkey * 40 as paper_id", "s_name as title", "s_acctbal as score")


@register(
    "merge_upsert_papers",
    f"with {STORED_SQL}, {CHANGES_SQL} select coalesce(s.paper_id, c.paper_id) as paper_id, case when c.paper_id is not null then c.title else s.title end as title,"
    " s.status, s.error_message, case when c.paper_id is not null then c.score else s.score end as score, s.ingested from stored s full join changes c using (paper_id)",
)
def upsert_papers(spark, sf):
    return M.upsert(_stored(spark, sf), _changes(spark, sf), ["paper_id"], ["title", "score"])


@register(
    "merge_upsert_vectors",
    """select chunk_id, max(case when fresh then n end) as fresh_sum, coalesce(max(case when fresh then n end), max(n)) as kept from (
      select vec_id as chunk_id, false as fresh, len(embedding)::int as n from embeddings union all select vec_id + 100, true, 32 from embeddings) group by 1""",
)
def upsert_vectors(spark, sf):
    base = V.table(spark, sf, "embeddings").selectExpr("vec_id as chunk_id", "size(embedding) as kept", "cast(null as int) as fresh_sum")
    new = V.table(spark, sf, "embeddings").selectExpr("vec_id + 100 as chunk_id", "32 as kept", "32 as fresh_sum")
    return M.upsert(base, new, ["chunk_id"])


@register(
    "merge_reset_status",
    f"with {STORED_SQL}, {CHANGES_SQL} select s.paper_id, case when c.paper_id is not null then 'queued' else status end as status,"
    " case when c.paper_id is null then error_message end as error_message from stored s left join changes c using (paper_id)",
)
def reset_status(spark, sf):
    return M.reset_status(_stored(spark, sf), _changes(spark, sf)).select("paper_id", "status", "error_message")


REPORTS_SQL = """reports as (select o_custkey as paper_id, case when o_orderkey % 4 > 0 then (o_orderkey % 4)::bigint end as chapter, max(o_totalprice) as body from orders where o_orderkey % 8 < 4 group by 1, 2),
  fresh as (select o_custkey as paper_id, case when o_orderkey % 4 > 0 then (o_orderkey % 4)::bigint end as chapter, min(o_totalprice) as body from orders where o_orderkey % 3 = 0 group by 1, 2)"""


def _reports(spark, sf, keep: str, pick):
    rows = V.table(spark, sf, "orders").filter(keep)
    chapter = F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 4).cast("bigint"))
    return rows.groupBy(F.col("o_custkey").alias("paper_id"), chapter.alias("chapter")).agg(pick("o_totalprice").alias("body"))


@register(
    "merge_upsert_reports",
    f"with {REPORTS_SQL} select coalesce(r.paper_id, f.paper_id) as paper_id, coalesce(r.chapter, f.chapter) as chapter, coalesce(f.body, r.body) as body"
    " from reports r full join fresh f on r.paper_id = f.paper_id and r.chapter is not distinct from f.chapter",
)
def upsert_reports(spark, sf):
    return M.upsert_reports(_reports(spark, sf, "o_orderkey % 8 < 4", F.max), _reports(spark, sf, "o_orderkey % 3 = 0", F.min))


@register(
    "merge_rerun",
    f"""with {STORED_SQL}, {CHANGES_SQL}, {REPORTS_SQL}
  select 'papers' as kept, count(*) as n, sum((c.paper_id is not null)::int)::bigint as queued from stored s left join (select distinct paper_id from changes) c using (paper_id)
  union all select 'vectors', count(*), 0 from embeddings where label not in (select paper_id from changes)
  union all select 'reports', count(*), 0 from reports where chapter is null or paper_id not in (select paper_id from changes)""",
)
def rerun(spark, sf):
    touched = _changes(spark, sf).select("paper_id").distinct()
    papers, vectors, reports = M.rerun(_stored(spark, sf), V.vectors(spark, sf), _reports(spark, sf, "o_orderkey % 8 < 4", F.max), touched)
    again = papers.join(touched.withColumn("hit", F.lit(True)), "paper_id", "left").select("status", "hit")
    queued = F.sum((F.coalesce("hit", F.lit(False)) & (F.col("status") == "queued")).cast("bigint"))
    out = again.agg(F.lit("papers").alias("kept"), F.count(F.lit(1)).alias("n"), queued.alias("queued"))
    for name, rows in (("vectors", vectors), ("reports", reports)):
        out = out.unionByName(rows.agg(F.lit(name).alias("kept"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("queued")))
    return out


@register(
    "merge_append_reviews",
    with_views("reviews", "cards") + """
  select card_id, count(*) as reviews, max(reviewed_at) as last_at from (
    select card_id, reviewed_at from reviews union all select card_id, timestamp '2024-02-01 00:00:00' from cards) all_rows group by 1""",
)
def append_reviews(spark, sf):
    path = f"{shared_folder(spark).rstrip('/')}/reviews-{uuid.uuid4().hex}"
    stored = V.reviews(spark, sf).select("card_id", "rating", "reviewed_at")
    M.append(stored, path)
    rated = V.cards(spark, sf).select("card_id", F.lit("good").alias("rating"), F.lit("2024-02-01 00:00:00").cast(stored.schema["reviewed_at"].dataType).alias("reviewed_at"))
    M.append(rated, path)
    log = spark.read.schema(stored.schema).parquet(path)
    return log.groupBy("card_id").agg(F.count(F.lit(1)).alias("reviews"), F.max("reviewed_at").alias("last_at"))


@register(
    "merge_set_status",
    f"""with {STORED_SQL}, ch as (select s_suppkey * 10 as paper_id, case s_suppkey % 3 when 0 then 'error' when 1 then 'ready' else 'processing' end as status,
      case when s_suppkey % 2 = 0 then true end as ingested, 'boom' as error_message from supplier)
    select s.paper_id, coalesce(c.status, s.status) as status, coalesce(c.ingested, s.ingested) as ingested,
      case when c.status = 'error' then c.error_message when c.status = 'ready' then null else s.error_message end as error_message
    from stored s left join ch c using (paper_id)""",
)
def set_status(spark, sf):
    changes = V.table(spark, sf, "supplier").selectExpr(
        "s_suppkey * 10 as paper_id", "case s_suppkey % 3 when 0 then 'error' when 1 then 'ready' else 'processing' end as status",
        "case when s_suppkey % 2 = 0 then true end as ingested", "'boom' as error_message",
    )
    return M.set_status(_stored(spark, sf), changes).select("paper_id", "status", "ingested", "error_message")


@register(
    "merge_patch_columns",
    f"""with {STORED_SQL}, ch as (select s_suppkey * 10 as paper_id, case when s_suppkey % 2 = 0 then s_acctbal end as score, case when s_suppkey % 3 = 0 then 'patched' end as title from supplier)
    select s.paper_id, coalesce(c.title, s.title) as title, coalesce(c.score, s.score) as score from stored s left join ch c using (paper_id)""",
)
def patch_columns(spark, sf):
    changes = V.table(spark, sf, "supplier").selectExpr(
        "s_suppkey * 10 as paper_id", "case when s_suppkey % 2 = 0 then s_acctbal end as score", "case when s_suppkey % 3 = 0 then 'patched' end as title"
    )
    return M.patch(_stored(spark, sf), changes, "paper_id", ["title", "score"]).select("paper_id", "title", "score")


@register(
    "merge_star_cards",
    with_views("cards") + """
  select paper_id, sum((starred or card_id in (select s_suppkey * 7 from supplier))::int)::bigint as starred_count from cards group by 1""",
)
def star_cards(spark, sf):
    stars = V.table(spark, sf, "supplier").selectExpr("s_suppkey * 7 as card_id", "true as starred")
    return M.starred_counts(M.patch(V.cards(spark, sf), stars, "card_id", ["starred"]))


def _deck(spark, sf):
    now = "timestamp '2024-02-01 00:00:00'"
    stored = V.cards(spark, sf).selectExpr(
        "card_id", "0 as paper_id", "concat('k', card_id) as content_key", "if(card_id % 4 = 0, 'manual', 'fact') as origin", "front", "'b' as back",
        "'h' as hint", "'Methods' as source_section", "1 as source_page", "'c' as chunk_id", "starred", "created_at", "created_at as updated_at",
    )
    generated = V.cards(spark, sf).selectExpr(
        "card_id + 600 as card_id", "0 as paper_id", "if(card_id % 10 = 9, '', concat('k', (card_id + 600) div 2)) as content_key", "concat(front, ' new') as front",
        "'key_concept' as origin", "'b2' as back", "'h2' as hint", "'Overview' as source_section", "2 as source_page", "'d' as chunk_id", "card_id as seq",
    )
    return M.merge_deck(stored, generated, F.expr(now)), generated


DECK_SQL = """
  stored as (select card_id, concat('k', card_id) as content_key, case when card_id % 4 = 0 then 'manual' else 'fact' end as origin, front from cards),
  generated as (select card_id + 600 as card_id, case when card_id % 10 = 9 then '' else concat('k', (card_id + 600) // 2) end as content_key, concat(front, ' new') as front, card_id as seq from cards),
  firsts as (select * from generated where content_key <> '' qualify row_number() over (partition by content_key order by seq) = 1),
  merged as (select coalesce(s.card_id, g.card_id) as card_id, content_key, case when s.card_id is null then 'key_concept' else s.origin end as origin,
     case when s.card_id is null or (g.card_id is not null and s.origin <> 'manual') then g.front else s.front end as front,
     case when s.card_id is null then 'created' when g.card_id is not null and s.origin <> 'manual' then 'updated' else 'kept' end as action
     from stored s full join firsts g using (content_key))"""


@register("merge_deck", with_views("cards") + "," + DECK_SQL + " select card_id, content_key, origin, front, action from merged")
def merge_deck(spark, sf):
    return _deck(spark, sf)[0].select("card_id", "content_key", "origin", "front", "action")


@register(
    "merge_deck_result",
    with_views("cards") + "," + DECK_SQL + """
  select 0 as paper_id, count(*) filter (where action = 'created') as created, count(*) filter (where action = 'updated') as updated, count(*) as total,
    (select count(*) from generated) as generated from merged""",
)
def deck_result(spark, sf):
    return M.deck_result(*_deck(spark, sf))


@register(
    "merge_cascade_delete",
    with_views("cards", "reviews", "quizzes", "answers") + """,
  gone as (select n_nationkey as paper_id from nation where n_regionkey = 1),
  heads as (select o_orderkey as attempt_id, (o_custkey % 25)::int as paper_id from orders)
  select 'cards' as name, count(*) as rows from cards where paper_id not in (select paper_id from gone) union all
  select 'quizzes', count(*) from quizzes where paper_id not in (select paper_id from gone) union all
  select 'attempts', count(*) from heads where paper_id not in (select paper_id from gone) union all
  select 'answers', count(*) from answers where attempt_id not in (select attempt_id from heads where paper_id in (select paper_id from gone)) union all
  select 'reviews', count(*) from reviews where card_id not in (select card_id from cards where paper_id in (select paper_id from gone))""",
)
def cascade_delete(spark, sf):
    gone = V.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("paper_id"))
    tables = {
        "cards": V.cards(spark, sf), "quizzes": V.quizzes(spark, sf),
        "attempts": V.table(spark, sf, "orders").selectExpr("o_orderkey as attempt_id", "cast(o_custkey % 25 as int) as paper_id"),
        "answers": V.answers(spark, sf), "reviews": V.reviews(spark, sf),
    }
    kept = M.cascade_delete(tables, gone, {"answers": ("attempts", "attempt_id"), "reviews": ("cards", "card_id")})
    out = None
    for name, table in kept.items():
        row = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.union(row)
    return out


@register(
    "merge_invalidate_chapter_reports",
    f"with {CHANGES_SQL} select c_custkey as paper_id, c_name as report from customer where c_custkey not in (select paper_id from changes)",
)
def invalidate(spark, sf):
    reports = V.table(spark, sf, "customer").selectExpr("c_custkey as paper_id", "c_name as report")
    return M.without(reports, _changes(spark, sf), ["paper_id"])


@register(
    "merge_chat_turns",
    """select conv_id as session_id, turn * 2 as turn, 'user' as role, text from conversations union all
       select conv_id, turn * 2 + 1, 'assistant', concat('Re: ', text) from conversations""",
)
def chat_turns(spark, sf):
    asked = V.table(spark, sf, "conversations").selectExpr("conv_id as session_id", "turn * 2 as turn", "text")
    return M.chat_turn(asked, asked.withColumn("text", F.concat(F.lit("Re: "), "text")))


@register(
    "merge_quiz_rows",
    """select p_partkey as quiz_id, concat(p_partkey, '-', i) as question_id, i::int as index, concat(p_name, ' ', i) as prompt, 'true_false' as kind, 'Methods' as citation_section,
      (p_size + i)::int as citation_page from part, range(0, 3) r(i)""",
)
def quiz_rows(spark, sf):
    quizzes = V.table(spark, sf, "part").selectExpr(
        "p_partkey as quiz_id", "p_size % 25 as paper_id",
        "transform(sequence(0, 2), i -> named_struct('prompt', concat(p_name, ' ', i), 'kind', 'true_false', 'difficulty', 'recall',"
        " 'citation', named_struct('section', 'Methods', 'page', p_size + i, 'chunk_id', 'c'))) as questions",
    )
    return M.quiz_rows(quizzes)[1].select("quiz_id", "question_id", "index", "prompt", "kind", "citation_section", "citation_page")


# --- library --------------------------------------------------------------------

REPORTED = "reported as (select distinct doc_id as paper_id from labels)"


@register(
    "library_listing",
    with_views("library") + "," + REPORTED + " select paper_id, title, status, paper_id in (select paper_id from reported) as has_report from library",
)
def library_listing(spark, sf):
    papers = V.library(spark, sf).withColumn("updated_at", F.col("published"))
    reports = V.table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"))
    return B.listing(papers, reports).select("paper_id", "title", "status", "has_report")


@register("library_report_papers", with_views("library") + "," + REPORTED + " select paper_id from library join reported using (paper_id)")
def report_papers(spark, sf):
    reports = V.table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"))
    return B.with_report_flag(V.library(spark, sf), reports).filter("has_report").select("paper_id")


@register(
    "library_text_search",
    with_views("library") + " select paper_id from library where contains(lower(title), 'tion') or len(list_filter(authors, lambda a: contains(lower(a), 'tion'))) > 0 or contains(lower(article_label), 'tion')",
)
def library_text_search(spark, sf):
    return B.text_search(V.library(spark, sf), " TION ").select("paper_id")


@register(
    "library_metadata_search",
    with_views("library") + """
  , fielded as (select *, lower(concat_ws(' ', title, abstract, array_to_string(authors, ' '), array_to_string(categories, ' '))) as f from library),
  hits as (select *, contains(f, 'the')::int + contains(f, 'sumathi')::int as relevance from fielded)
  select paper_id, relevance from hits where relevance > 0 and list_contains(categories, 'en') and published between date '2024-01-01' and date '2025-12-31'
  order by relevance desc, published desc, paper_id limit 25""",
)
def metadata_search(spark, sf):
    found = B.metadata_search(V.library(spark, sf), "the sumathi", category="en", date_range="2024_2025")
    return found.select("paper_id", "relevance")


@register(
    "library_newest",
    with_views("library") + " select paper_id, published from library where published between date '2023-06-15' - 182 and date '2023-06-15' order by published desc nulls last, paper_id limit 25",
)
def library_newest(spark, sf):
    return B.metadata_search(V.library(spark, sf), "", date_range="past_6_months", today="2023-06-15", sort="newest").select("paper_id", "published")


@register(
    "library_search_hits",
    """select page_id * 7 as paper_id, coalesce(d.title, url) as title, coalesce(d.status, 'queued') as status, d.doc_id is not null as in_library, coalesce(d.ingested, false) as ingested
     from pages left join (select doc_id, concat('stored ', doc_id) as title, 'ready' as status, n_chars > 1000 as ingested from documents) d on d.doc_id = page_id * 7""",
)
def search_hits(spark, sf):
    hits = V.table(spark, sf, "pages").selectExpr("page_id * 7 as paper_id", "url as title", "'queued' as status")  # some are not in the library
    stored = V.table(spark, sf, "documents").selectExpr(
        "doc_id as paper_id", "concat('stored ', doc_id) as title", "'ready' as status", "n_chars > 1000 as ingested"
    )
    return B.merge_search_hits(hits, stored)


@register(
    "library_typed_rows",
    """select doc_id as paper_id, trim(concat(' T', doc_id, ' ')) as title, case when doc_id % 3 = 0 then 'A,B' else '' end as authors,
      case when doc_id % 4 <> 3 then date '2023-01-01' + (doc_id % 27)::int end as published,
      case doc_id % 3 when 0 then 'ready' when 1 then 'queued' else 'error' end as status, doc_id % 2 = 0 as ingested from documents""",
)
def typed_rows(spark, sf):
    raw = V.table(spark, sf, "documents").selectExpr(
        "doc_id as paper_id", "concat(' T', doc_id, ' ') as title", "if(doc_id % 3 = 0, '[\"A\",\"B\"]', 'broken') as authors",
        "if(doc_id % 4 = 3, 'soon', concat('2023-01-', lpad(cast(doc_id % 27 + 1 as string), 2, '0'), 'T10:00:00')) as published",
        "case doc_id % 3 when 0 then 'ready' when 1 then 'made-up' else 'error' end as status", "if(doc_id % 2 = 0, true, null) as ingested",
    )
    return B.paper_rows(raw).withColumn("authors", F.array_join("authors", ","))


@register(
    "library_typed_jobs",
    """select doc_id as job_id, case doc_id % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'done' when 3 then 'error' end as state,
      case when doc_id % 7 > 0 then 'OCR' end as current_stage, (doc_id % 110)::int as percent,
      case when doc_id % 11 > 0 then concat('Download=', case when doc_id % 3 = 0 then 'pending' else 'done' end, '/', lang, '/', case when doc_id % 2 = 0 then 'true' else 'false' end,
        case when doc_id % 13 > 0 then ', Embedding=error/-/false' else ', -=error/-/false' end) else '' end as stages,
      concat('12:00:00 ', source, ' OCR') as log,
      doc_id % 5 < 4 and doc_id % 110 <= 100 and (doc_id % 13 > 0 or doc_id % 11 = 0) as valid from documents""",
)
def typed_jobs(spark, sf):
    raw = V.table(spark, sf, "documents").selectExpr(
        "doc_id as job_id", "doc_id as paper_id", "element_at(array('queued', 'running', 'done', 'error', 'lost'), int(doc_id % 5) + 1) as state",
        "if(doc_id % 7 > 0, 'OCR', null) as current_stage", "doc_id % 110 as percent",
        """if(doc_id % 11 > 0, concat('[{"stage":"Download"', if(doc_id % 3 = 0, '', ',"status":"done"'), ',"detail":"', lang, '"', if(doc_id % 2 = 0, ',"degraded":true', ''),
           '},{"stage":"', if(doc_id % 13 > 0, 'Embedding', 'Unheard of'), '","status":"error"}]'), 'broken') as stages""",
        """concat('[{"t":"12:00:00","m":"', source, '","stage":"OCR"}]') as log""", "cast(null as string) as error_message",
    )
    gap = lambda c: F.coalesce(c, F.lit("-"))
    stages = F.transform("stages", lambda s: F.concat(gap(s["stage"]), F.lit("="), s["status"], F.lit("/"), gap(s["detail"]), F.lit("/"), s["degraded"].cast("string")))
    return B.job_rows(raw).select(
        "job_id", "state", "current_stage", "percent", F.array_join(stages, ", ").alias("stages"),
        F.array_join(F.transform("log", lambda e: F.concat_ws(" ", e["t"], e["m"], e["stage"])), ", ").alias("log"),
        "valid",
    )


@register(
    "library_typed_questions",
    """select doc_id as question_id, case when doc_id % 3 = 0 then '' else left(text, 40) end as prompt,
      case doc_id % 4 when 1 then 'true_false' when 2 then 'short_answer' else 'multiple_choice' end as kind,
      case doc_id % 5 when 1 then 'understand' when 2 then 'apply' else 'recall' end as difficulty,
      case when doc_id % 6 = 0 then '' else concat('a=', lang, ', b=') end as options, case when doc_id % 2 = 0 then concat(lang, '|', source) else '' end as accepted,
      case when doc_id % 3 = 1 then concat('Methods p', doc_id % 9, ' ', case when doc_id % 7 > 0 then source else '' end) end as citation from documents""",
)
def typed_questions(spark, sf):
    raw = V.table(spark, sf, "documents").selectExpr(
        "doc_id as question_id", "doc_id as quiz_id", "doc_id as paper_id", "doc_id % 10 as index", "if(doc_id % 3 = 0, null, left(text, 40)) as prompt",
        "element_at(array('multiple_choice', 'true_false', 'short_answer', 'essay'), int(doc_id % 4) + 1) as kind",
        "element_at(array('recall', 'understand', 'apply', null, 'hard'), int(doc_id % 5) + 1) as difficulty",
        """if(doc_id % 6 = 0, null, concat('[{"id":"a","text":"', lang, '"},"stray",7,{"id":"b"}]')) as options""",
        "'a' as correct_option_id", "cast(null as string) as correct_answer_text",
        """if(doc_id % 2 = 0, concat('["', lang, '","', source, '"]'), '{') as accepted_answers""", "cast(null as string) as explanation",
        "case doc_id % 3 when 1 then 'Methods' when 2 then 'Errata' end as citation_section", "doc_id % 9 as citation_page",
        "cast(doc_id as string) as citation_chunk_id", "if(doc_id % 7 > 0, source, null) as citation_snippet",
    )
    cited = F.concat(F.col("citation.section"), F.lit(" p"), F.col("citation.page").cast("string"), F.lit(" "), F.col("citation.snippet"))
    return B.question_rows(raw).select(
        "question_id", "prompt", "kind", "difficulty", F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["text"])), ", ").alias("options"),
        F.array_join("accepted_answers", "|").alias("accepted"), cited.alias("citation"),
    )


FEED = """select doc_id, named_struct('id', concat('http://host.example/abs/24', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '.', lpad(cast(doc_id % 100000 as string), 5, '0'), 'v', doc_id % 3 + 1),
 'title', concat('  A  study ', doc_id, '\\n of things '), 'summary', text, 'published', if(doc_id % 5 = 0, 'bad', '2024-01-05T00:00:00Z'), 'updated', '2024-02-06',
 'author', array(named_struct('name', ' Ada '), named_struct('name', ''), named_struct('name', lang)),
 'category', array(named_struct('_term', 'cs.CL'), named_struct('_term', source)),
 'link', if(doc_id % 2 = 0, array(named_struct('_rel', 'alternate', '_href', 'http://a', '_title', cast(null as string), '_type', 'text/html'),
    named_struct('_rel', 'related', '_href', 'http://p', '_title', 'pdf', '_type', cast(null as string))),
    cast(array() as array<struct<_rel:string,_href:string,_title:string,_type:string>>))) as e"""


@register(
    "library_feed_rows",
    f"""with n as (select doc_id, text, lang, source, concat('24', lpad((doc_id % 12 + 1)::varchar, 2, '0'), '.', lpad((doc_id % 100000)::varchar, 5, '0')) as bare from documents)
    select replace(bare, '.', '-') as paper_id, bare as article_id, concat('v', doc_id % 3 + 1) as version, concat('A study ', doc_id, ' of things') as title, {X.collapse('text')} as abstract,
      concat('Ada|', lang) as authors, concat('cs.CL|', source) as categories, case when doc_id % 5 <> 0 then date '2024-01-05' end as published, date '2024-02-06' as updated,
      case when doc_id % 2 = 0 then 'http://p' else concat('https://arxiv.org/pdf/', bare) end as pdf_url,
      case when doc_id % 2 = 0 then 'http://a' else concat('http://host.example/abs/', bare, 'v', doc_id % 3 + 1) end as abs_url from n""",
)
def feed_rows(spark, sf):
    entries = V.table(spark, sf, "documents").selectExpr("doc_id", "text", "lang", "source")
    struct = FEED[FEED.index("named_struct") : FEED.rindex(" as e")]
    rows = R.feed_rows(entries.select(F.expr(struct).alias("e")).select("e.*"))
    return rows.select(
        "paper_id", "article_id", "version", "title", "abstract", F.array_join("authors", "|").alias("authors"),
        F.array_join("categories", "|").alias("categories"), "published", "updated", "pdf_url", "abs_url",
    )


# --- citations --------------------------------------------------------------------

NAMES_SQL = f"""
written as (select paper_id, unnest(authors) as author, unnest(range(0, len(authors)))::int as position from library),
cleaned as (select *, list_filter(string_split(trim(regexp_replace(author, '\\.([^ ])', '. \\1', 'g')), ' '), lambda t: t <> '') as raw from written),
tokens as (select *, case when list_contains({X.lst(K.HONORIFICS)}, lower(rtrim(raw[1], '.'))) then raw[2:] else raw end as t from cleaned),
placed as (select *, list_filter(range(1, len(t) + 1), lambda i: not regexp_matches(t[i], '^[A-Za-z]\\.?$')) as longs from tokens),
parted as (select paper_id, position, author,
   case when contains(author, ',') then trim(string_split(author, ',')[1]) when len(t) = 1 then t[1] when len(longs) = 1 then t[longs[1]] else t[len(t)] end as family,
   case when contains(author, ',') then list_filter(string_split(trim(string_split(author, ',')[2]), ' '), lambda x: x <> '') when len(t) = 1 then []
     when len(longs) = 1 then list_concat(t[1:longs[1] - 1], t[longs[1] + 1:]) else t[1:len(t) - 1] end as gs from placed),
names as (select paper_id, position, author, family, array_to_string(list_transform(gs, lambda g: case when regexp_matches(g, '^[A-Za-z]$') then g || '.' else g end), ' ') as given,
   array_to_string(list_transform(gs, lambda g: upper(left(g, 1)) || '.'), ' ') as initials from parted)"""


@register("cite_author_names", with_views("library") + "," + NAMES_SQL + " select paper_id, position, author, given, family from names")
def author_names(spark, sf):
    rows = V.library(spark, sf).select("paper_id", F.posexplode("authors").alias("position", "author"))
    return rows.withColumn("n", split_name(F.col("author"))).select("paper_id", "position", "author", "n.given", "n.family")


def _listed(item: str, last: str, pair: str) -> str:
    xs = f"list({item} order by position)"
    return f"case count(*) when 1 then {xs}[1] when 2 then {xs}[1] || {X.q(pair)} || {xs}[2] else array_to_string({xs}[1:count(*)::int - 1], ', ') || {X.q(last)} || {xs}[count(*)::int] end"


FAMILY_INITIALS = "(case when initials <> '' then family || ', ' || initials else family end)"
FAMILY_GIVEN = "(case when given <> '' then family || ', ' || given else family end)"
GIVEN_FAMILY = "trim(given || ' ' || family)"
CITATIONS_SQL = NAMES_SQL + f""",
credits as (select paper_id,
   case when count(*) > 20 then array_to_string(list({FAMILY_INITIALS} order by position)[1:19], ', ') || ', ... ' || last({FAMILY_INITIALS} order by position) else {_listed(FAMILY_INITIALS, ', & ', ', & ')} end as apa,
   case count(*) when 1 then first({FAMILY_GIVEN} order by position) when 2 then first({FAMILY_GIVEN} order by position) || ', and ' || last({GIVEN_FAMILY} order by position)
     else first({FAMILY_GIVEN} order by position) || ', et al.' end as mla,
   {_listed(f"(case when position = 0 then {FAMILY_GIVEN} else {GIVEN_FAMILY} end)", ', and ', ' and ')} as chicago,
   {_listed("trim(initials || ' ' || family)", ', and ', ' and ')} as ieee,
   array_to_string(list({FAMILY_GIVEN} order by position), ' and ') as bib, first(family order by position) as lead from names group by 1),
base as (select l.paper_id, article_id, article_id like 'upload:%' as upload, case when title = '' then '[title unavailable]' else title end as t, title,
   coalesce(year(published)::varchar, 'n.d.') as y, year(published) as yr, 'https://arxiv.org/abs/' || article_id as url,
   coalesce(apa, '') as apa, rtrim(coalesce(mla, ''), '.') as mla, rtrim(coalesce(chicago, ''), '.') as chicago, coalesce(ieee, '') as ieee, coalesce(bib, '') as bib, lead,
   case when title = '' then '[title unavailable].' else title || '.' end as tp, case when title = '' then '[title unavailable].' else '"' || title || '."' end as tq,
   case when title = '' then '[title unavailable],' else '"' || title || ',"' end as tc from library l left join credits using (paper_id)),
more as (select *, case when y like '%.' then y else y || '.' end as ys,
   coalesce(nullif(regexp_replace(lower(coalesce(lead, '')), '[^a-z]', '', 'g'), ''), 'unknown') as fam,
   coalesce(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: not list_contains({X.lst(K.TITLE_STOPWORDS)}, w))[1], '') as word from base)"""

RENDERED = {
    "apa": "case when apa <> '' then apa || ' (' || y || '). ' || tp else tp || ' (' || y || ').' end || case when upload then '' else ' arXiv. ' || url end",
    "mla": "case when mla <> '' then mla || '. ' || tq else tq end || case when upload then case when yr is null then '' else ' ' || y || '.' end else ' ' || case when yr is null then 'arXiv' else 'arXiv, ' || y end || ', ' || url || '.' end",
    "chicago": "case when chicago <> '' then chicago || '. ' || ys || ' ' || tq else tq || ' ' || ys end || case when upload then '' else ' arXiv. ' || url end",
    "ieee": "case when ieee <> '' then ieee || ', ' || tc else tc end || case when upload then ' ' || ys else ' arXiv preprint arXiv:' || article_id || ', ' || ys end",
    "bibtex": "'@misc{' || case when yr is not null then fam || yr || word else fam || '_' || case when word = '' then 'untitled' else word end end || ',' || chr(10) ||"
    " array_to_string(list_filter([case when bib <> '' then '  author = {' || bib || '}' end, '  title = {' || t || '}', case when yr is not null then '  year = {' || y || '}' end,"
    " case when upload then '  note = {Uploaded PDF; no arXiv identifier}' else '  eprint = {' || article_id || '}' end, case when not upload then '  archivePrefix = {arXiv}' end,"
    " case when not upload then '  url = {' || url || '}' end], lambda f: f is not null), ',' || chr(10)) || chr(10) || '}'",
}


@register(
    "cite_bibliography",
    with_views("library") + "," + CITATIONS_SQL + " " + " union all ".join(f"select paper_id, '{s}' as style, {e} as citation from more" for s, e in RENDERED.items()),
)
def bibliography(spark, sf):
    return B.bibliography(V.library(spark, sf))


# questions: a fixed cue per turn in front of the turn's own text
CUES = [
    "how do I cite this", "who wrote this?", "how many figures are in this paper", "what is the MLA dataset used for", "which papers does this cite?",
    "bibtex", "what IEEE standard does it follow", "cite this in bibtex and APA format", "what is the title", "What are the limitations of this work?",
    "what year was it, and which categories?", "how long is this",
]
CUE_INTENT = ["citation", "metadata", "structure", "content", "content", "citation", "content", "citation", "metadata", "content", "metadata", "structure"]
CUE_STYLES = ["", "", "", "mla", "", "bibtex", "ieee", "apa,bibtex", "", "", "", ""]


def _cued(spark, sf):
    cues = F.array(*[F.lit(c) for c in CUES])
    return V.table(spark, sf, "events").select(
        F.col("event_id").alias("question_id"), F.col("user_id").alias("paper_id"),
        F.element_at(cues, (F.col("event_id") % len(CUES) + 1).cast("int")).alias("text"),
    )


CUED = f"cued as (select event_id as question_id, user_id as paper_id, {X.lst(CUES)}[event_id % {len(CUES)} + 1] as text, {X.lst(CUE_INTENT)}[event_id % {len(CUES)} + 1] as intent, {X.lst(CUE_STYLES)}[event_id % {len(CUES)} + 1] as styles from events)"


@register("chat_intent", f"with {CUED} select question_id, intent, styles from cued")
def chat_intent(spark, sf):
    return _cued(spark, sf).select("question_id", intent(F.col("text")).alias("intent"), F.array_join(detect_styles(F.col("text")), ",").alias("styles"))


def _recorded(spark, sf):
    return V.library(spark, sf).withColumn("figure_count", F.expr("case when paper_id % 3 <> 0 then cast(paper_id % 7 as int) end")).drop("abstract", "author_list")


@register(
    "chat_record_answers",
    with_views("library") + "," + CUED + "," + CITATIONS_SQL + f""",
  wide as (select m.*, l.authors, l.article_label, l.published, l.categories, l.page_count, case when m.paper_id % 3 <> 0 then (m.paper_id % 7)::int end as figure_count from more m join library l using (paper_id)),
  lined as (select paper_id, unnest([{', '.join(f"{{'s': '{s}', 'line': '**{K.CITATION_STYLE_LABELS[s]}** — ' || trim({e})}}" for s, e in RENDERED.items())}]) as l from wide),
  wanted as (select question_id, string_agg(l.line, chr(10) || chr(10) order by list_position({X.lst(K.CITATION_STYLES)}, l.s)) as body, count(*) as n
     from cued join lined using (paper_id) where intent = 'citation' and (styles = '' or list_contains(string_split(styles, ','), l.s)) group by 1)
  select question_id, c.paper_id, intent, case intent
    when 'citation' then case when n = 1 then 'Here is this paper cited in the style you asked for:' else 'Here is this paper in each citation style:' end || chr(10) || chr(10) || body
    when 'metadata' then case when contains(text, 'wrote') then case when len(authors) > 0 then '**Authors** — ' || array_to_string(authors, ', ') else '**Authors** — not recorded for this paper.' end
       when contains(text, 'title') then '**Title** — ' || title
       else coalesce('**Published** — ' || published, '**Published** — no publication date is recorded.') || chr(10) || chr(10) || '**Categories** — ' || array_to_string(categories, ', ') end
    else case when page_count > 0 then '**Pages** — ' || page_count || chr(10) || chr(10) else '' end || case when figure_count is not null then '**Figures and tables extracted** — ' || figure_count || chr(10) || chr(10) else '' end || {X.q(B.COUNTS_NOTE)} end as answer
  from cued c join wide using (paper_id) left join wanted using (question_id) where intent <> 'content'""",
)
def record_answers(spark, sf):
    return B.record_answers(_cued(spark, sf), _recorded(spark, sf))


@register(
    "chat_recent_history",
    """with last as (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4)
    select conv_id as session_id, coalesce('Conversation so far:' || chr(10) || string_agg(role || ': ' || text, chr(10) order by turn) filter (where text <> '') || chr(10) || chr(10), '') as note from last group by 1""",
)
def recent_history(spark, sf):
    return B.recent_history(V.messages(spark, sf))


# --- jobs --------------------------------------------------------------------------

LATEST = "latest as (select * from stage_events qualify row_number() over (partition by job_id, stage order by ts desc, event_id desc) = 1)"
STAGES = f"stages(i, stage) as (values {', '.join(f'({i}, {X.q(s)})' for i, s in enumerate(K.STAGE_ORDER))})"
GRID = f"grid as (select j.job_id, j.paper_id, s.i, s.stage, coalesce(l.status, 'pending') as status from (select distinct job_id, paper_id from latest) j cross join stages s left join latest l using (job_id, stage))"
JOBS = with_views("stage_events") + "," + LATEST + "," + STAGES + "," + GRID


def _stages(spark, sf):
    latest = J.latest_stage_status(V.stage_events(spark, sf))
    return J.reconcile_stages(latest.select("job_id", "paper_id", "stage", "status"))


@register("jobs_latest_stage_status", with_views("stage_events") + "," + LATEST + " select job_id, stage, status, ts from latest")
def latest_stage_status(spark, sf):
    return J.latest_stage_status(V.stage_events(spark, sf)).select("job_id", "stage", "status", "ts")


@register("jobs_reconciled_stages", JOBS + " select job_id, i::int as stage_index, stage, status from grid")
def reconciled(spark, sf):
    return _stages(spark, sf).select("job_id", "stage_index", "stage", "status")


@register(
    "jobs_stage_percent",
    with_views("stage_events") + "," + STAGES + " select event_id, greatest(0, least(100, round_even((i + case when status = 'running' then 0 else 1 end) / 7 * 100, 0)))::int as percent from stage_events join stages using (stage)",
)
def stage_percent(spark, sf):
    return V.stage_events(spark, sf).select("event_id", J.stage_percent(F.col("stage"), F.col("status")).alias("percent"))


STATES = f""",
  states as (select job_id, paper_id,
    bool_or(status = 'error' and stage in ('Download', 'Extract text', 'Embedding')) as failed,
    bool_or(status = 'error' and stage not in ('Download', 'Extract text', 'Embedding')) as degraded,
    bool_and(status in ('done', 'error')) as finished, bool_or(status <> 'pending') as begun,
    arg_max(stage, i) filter (where status <> 'pending') as current_stage, arg_max(status, i) filter (where status <> 'pending') as current_status,
    max(i) filter (where status <> 'pending') as ci, bool_or(stage = 'Embedding' and status = 'done') as embedded from grid group by 1, 2),
  jobs as (select job_id, paper_id, case when failed then 'error' when finished then 'done' when begun then 'running' else 'queued' end as state, current_stage,
    coalesce(round_even((ci + case when current_status = 'running' then 0 else 1 end) / 7 * 100, 0), 0)::int as percent, degraded,
    case when failed then 'error' when embedded then 'ready' when begun then 'processing' else 'queued' end as paper_status from states)"""


@register("jobs_state", JOBS + STATES + " select * from jobs")
def job_states(spark, sf):
    return J.job_state(_stages(spark, sf))


def _job_heads(spark, sf):
    events = V.stage_events(spark, sf)
    heads = events.groupBy("job_id", "paper_id").agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("stage_count"))
    # a job with a single event stands for one without stages
    return heads.withColumn("stage_count", F.col("stage_count") - 1)


HEADS = "heads as (select job_id, paper_id, min(ts) as created_at, count(*) - 1 as stage_count from stage_events group by 1, 2)"
NEWEST = "newest as (select * from heads where stage_count > 0 qualify row_number() over (partition by paper_id order by created_at desc, job_id desc) = 1)"


@register(
    "jobs_latest_per_paper",
    with_views("stage_events") + "," + HEADS + " select paper_id, job_id, created_at from heads qualify row_number() over (partition by paper_id order by created_at desc, job_id desc) = 1",
)
def latest_per_paper(spark, sf):
    return J.latest_job(_job_heads(spark, sf)).select("paper_id", "job_id", "created_at")


@register("jobs_latest_ingestion", with_views("stage_events") + "," + HEADS + "," + NEWEST + " select paper_id, job_id, stage_count from newest")
def latest_ingestion(spark, sf):
    return J.latest_job(_job_heads(spark, sf), ingestion_only=True).select("paper_id", "job_id", "stage_count")


@register(
    "jobs_reports_in_flight",
    JOBS + STATES + "," + HEADS + "," + NEWEST + """
  select n.paper_id, n.job_id, case when g.status = 'running' then 'generating the report now' else 'still ingesting this paper' end as phase
  from newest n join jobs j using (job_id) left join grid g on g.job_id = n.job_id and g.stage = 'Generate report'
  where j.state in ('queued', 'running') and coalesce(g.status, 'pending') not in ('done', 'error')""",
)
def in_flight(spark, sf):
    stages = _stages(spark, sf)
    newest = J.latest_job(_job_heads(spark, sf), ingestion_only=True).select("paper_id", "job_id")
    return J.reports_in_flight(newest.join(J.job_state(stages).select("job_id", "state"), "job_id"), stages)


@register("jobs_papers_polling", with_views("library") + " select paper_id from library where status in ('processing', 'queued')")
def papers_polling(spark, sf):
    return J.has_in_flight(V.library(spark, sf)).select("paper_id")


@register(
    "jobs_degraded_tally",
    JOBS + " select job_id, sum((status = 'error' and stage not in ('Download', 'Extract text', 'Embedding'))::int)::bigint as degraded_stages, count(*) as stages from grid group by 1",
)
def degraded_tally(spark, sf):
    return J.degraded_tally(_stages(spark, sf))


# the stored snapshot knows the mornings, the new one the whole log and the stages of the afternoons


@register("jobs_upsert_snapshot", with_views("stage_events") + """,
  halves as (select *, hour(ts) >= 12 as late from stage_events),
  last as (select * from halves qualify row_number() over (partition by job_id, late, stage order by ts desc, event_id desc) = 1),
  stages as (select job_id, stage, arg_max(status, late) as status, bool_or(not late) as known from last group by 1, 2),
  listed as (select job_id, string_agg(stage || '=' || status, ', ' order by not known, stage) as stages from stages group by 1),
  logs as (select job_id, count(*)::int as n, string_agg(event_id::varchar, ',' order by late, ts, event_id) as log from halves group by 1)
  select job_id, n, stages, log from listed join logs using (job_id)""")
def upsert_snapshot(spark, sf):
    events = V.stage_events(spark, sf).withColumn("late", F.hour("ts") >= 12)

    def snapshot(rows, logged):
        last = J.latest_stage_status(rows).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("stage", "status"))).alias("stages"))
        log = logged.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("log"))
        return log.join(last, "job_id", "left").select("job_id", "n", "stages", "log")

    merged = M.upsert_job_snapshots(snapshot(events.filter("not late"), events.filter("not late")), snapshot(events.filter("late"), events))
    return merged.select(
        "job_id", "n", F.array_join(F.transform("stages", lambda s: F.concat(s["stage"], F.lit("="), s["status"])), ", ").alias("stages"),
        F.array_join(F.transform("log", lambda e: e["event_id"].cast("string")), ",").alias("log"),
    )


# --- chapters -----------------------------------------------------------------------
# an outline entry per line that opens a page, its level from the line number

COUNTS = "counts as (select paper_id, max(page)::int as page_count from lines group by 1)"
OUTLINE = "outline as (select paper_id, ordinal as position, case when ordinal % 12 = 0 then 1 when ordinal % 4 = 0 then 2 else 3 end as level, left(text, 24) as title, page from lines)"
ENTRIES = f"""
usable as (select o.*, {X.strip('title')} as t, greatest(1, least(page, page_count)) as page_start, page_count from outline o join counts using (paper_id)
   where page >= 1 and level between 1 and 2 and len({X.strip('title')}) >= 3),
uniq as (select * from usable qualify row_number() over (partition by paper_id, level, replace(lower(t), 'ß', 'ss'), page_start order by position) = 1),
entries as (select *, row_number() over (partition by paper_id order by page_start, level, position)::int as entry from uniq qualify entry <= 300)"""


def _page_counts(spark, sf):
    return V.lines(spark, sf).groupBy("paper_id").agg(F.max("page").alias("page_count"))


def _outline(spark, sf):
    level = F.expr("case when ordinal % 12 = 0 then 1 when ordinal % 4 = 0 then 2 else 3 end")
    return V.lines(spark, sf).select("paper_id", F.col("ordinal").alias("position"), level.alias("level"), F.left("text", F.lit(24)).alias("title"), "page")


@register("chapters_outline_entries", with_views("lines") + "," + COUNTS + "," + OUTLINE + "," + ENTRIES + " select paper_id, entry, level, t as title, page_start, page_count from entries")
def outline_entries(spark, sf):
    return H.outline_candidates(_outline(spark, sf), _page_counts(spark, sf))


def _chapters_sql(source: str, entries: str, out: str) -> str:
    return f"""
{out}_u as (select * from {entries} qualify row_number() over (partition by paper_id, level, page_start order by entry) = 1),
{out} as (select paper_id, (row_number() over (partition by paper_id order by entry) - 1)::int as index, t as title, level, page_start,
  greatest(page_start, least(page_count, coalesce((select n.page_start - 1 from {out}_u n where n.paper_id = e.paper_id and n.entry > e.entry and n.level <= e.level order by n.entry limit 1), page_count))) as page_end,
  concat('ch-', left(sha1(concat_ws('|', paper_id, level, page_start, {X.collapse("replace(lower(t), 'ß', 'ss')")})), 12)) as chapter_id, '{source}' as source from {out}_u e)"""


@register(
    "chapters_from_outline",
    with_views("lines") + "," + COUNTS + "," + OUTLINE + "," + ENTRIES + "," + _chapters_sql("outline", "entries", "ch") + " select * from ch",
)
def from_outline(spark, sf):
    return H.build_chapters(H.outline_candidates(_outline(spark, sf), _page_counts(spark, sf)), "outline")


HEAD_ENTRIES = f"""
firsts as (select paper_id, ordinal, section_label as t, page, 1 as level from passages where section_label not in ('', 'Document')
  qualify row_number() over (partition by paper_id, lower(section_label) order by ordinal) = 1),
head_entries as (select f.*, greatest(1, least(page, page_count)) as page_start, page_count, row_number() over (partition by paper_id order by page, ordinal)::int as entry
  from firsts f join counts using (paper_id) where len(t) >= 3 and not {X.has('t', X.NONCONTENT)})"""
BUCKETS = """
bucketed as (select paper_id, page_count, case when page_count <= 10 then greatest(1, page_count // 2) else 10 end::int as size from counts where page_count >= 2),
bucket_entries as (select paper_id, (i + 1)::int as entry, 1 as level, page_count, (i * size + 1)::int as page_start,
  concat('Pages ', i * size + 1, '-', least(i * size + size, page_count)) as t from bucketed, range(0, 300) r(i) where i * size + 1 <= page_count)"""


@register("chapters_from_headings", with_views("passages") + "," + COUNTS + "," + HEAD_ENTRIES + "," + _chapters_sql("headings", "head_entries", "ch") + " select * from ch")
def from_headings(spark, sf):
    return H.build_chapters(H.heading_candidates(V.passages(spark, sf), _page_counts(spark, sf)), "headings")


@register("chapters_from_pages", with_views("lines") + "," + COUNTS + "," + BUCKETS + "," + _chapters_sql("headings", "bucket_entries", "ch") + " select * from ch")
def from_pages(spark, sf):
    return H.build_chapters(H.bucket_candidates(_page_counts(spark, sf)), "headings")


ALL_TIERS = (
    with_views("passages") + "," + COUNTS + "," + OUTLINE.replace("case when ordinal % 12", "case when paper_id % 3 > 0 then 3 when ordinal % 12") + "," + ENTRIES + "," + HEAD_ENTRIES + "," + BUCKETS + ","
    + _chapters_sql("outline", "entries", "c1") + "," + _chapters_sql("headings", "head_entries", "c2") + "," + _chapters_sql("headings", "bucket_entries", "c3") + """,
  tiers as (select *, 1 as tier from c1 union all select *, 2 from c2 union all select *, 3 from c3),
  best as (select paper_id, min(tier) as tier from (select paper_id, tier from tiers group by 1, 2 having count(*) >= 2) group by 1),
  chapters as (select tiers.* exclude (tier) from tiers join best using (paper_id, tier))"""
)


def _chapters(spark, sf):
    counts = _page_counts(spark, sf)
    # the outlines of two papers in three are too deep to use
    outline = _outline(spark, sf).withColumn("level", F.when(F.col("paper_id") % 3 > 0, 3).otherwise(F.col("level")))
    return H.choose_tier(
        H.build_chapters(H.outline_candidates(outline, counts), "outline"),
        H.build_chapters(H.heading_candidates(V.passages(spark, sf), counts), "headings"),
        H.build_chapters(H.bucket_candidates(counts), "headings"),
    )


@register("chapters_chosen_tier", ALL_TIERS + " select * from chapters")
def chosen_tier(spark, sf):
    return _chapters(spark, sf)


@register(
    "chapters_listing",
    ALL_TIERS + """ select c.paper_id, page_count, coalesce(string_agg(title, '|' order by index), '') as titles, any_value(source) as source, count(title) > 0 as detected
  from counts c left join chapters using (paper_id) group by 1, 2""",
)
def chapter_listing(spark, sf):
    out = H.chapter_listing(_page_counts(spark, sf), _chapters(spark, sf))
    return out.withColumn("titles", F.array_join("titles", "|"))


@register("chapters_chunks_in_range", ALL_TIERS + " select chunk_id, chapter_id from passages p join chapters c on p.paper_id = c.paper_id and p.page between page_start and page_end")
def chunks_in_range(spark, sf):
    return H.chunks_in_chapters(V.passages(spark, sf), _chapters(spark, sf)).select("chunk_id", "chapter_id")


REQUESTS = "requests as (select paper_id, case when paper_id % 2 = 0 then chapter_id else concat('ch-', index) end as chapter_id from chapters)"


def _requests(spark, sf):
    wanted = F.when(F.col("paper_id") % 2 == 0, F.col("chapter_id")).otherwise(F.concat(F.lit("ch-"), "index"))
    return _chapters(spark, sf).select("paper_id", wanted.alias("chapter_id"))


@register("chapters_resolved", ALL_TIERS + "," + REQUESTS + " select r.chapter_id, title, page_start, page_end from requests r join chapters using (paper_id, chapter_id)")
def resolved(spark, sf):
    return H.resolve_chapters(_requests(spark, sf), _chapters(spark, sf)).select("chapter_id", "title", "page_start", "page_end")


@register("chapters_unknown", ALL_TIERS + "," + REQUESTS + " select paper_id, chapter_id from requests where (paper_id, chapter_id) not in (select paper_id, chapter_id from chapters)")
def unknown(spark, sf):
    return H.unknown_chapters(_requests(spark, sf), _chapters(spark, sf))


# --- layout --------------------------------------------------------------------------
# one region per line item of an order (a page), one caption per line number

REGION = "l_orderkey as paper_id, cast(l_suppkey % 3 as int) as page, l_linenumber * 100000 + l_partkey as region_id, cast(l_quantity * 4 as double) as x0, cast(l_discount * 5000 as double) as y0, cast(l_quantity * 4 + 60 + l_tax * 1000 as double) as x1, cast(l_discount * 5000 + 50 + l_linenumber * 5 as double) as y1"
CAPTIONS = "o_orderkey as paper_id, cast(o_custkey % 3 as int) as page, 1 as caption_no, concat('Fig ', o_custkey % 9 + 1) as label, cast(o_custkey % 200 as double) as x0, cast(o_orderkey % 500 as double) as y0, cast(o_custkey % 200 + 100 as double) as x1, cast(o_orderkey % 500 + 12 as double) as y1"


@register(
    "layout_nearest_caption",
    f"""with regions as (select {REGION} from lineitem), captions as (select {CAPTIONS} from orders),
  pairs as (select r.*, c.label, c.caption_no, least(abs(c.y0 - r.y1), abs(r.y0 - c.y1)) as gap, least(c.x1, r.x1) - greatest(c.x0, r.x0) as beside from regions r join captions c using (paper_id, page)),
  best as (select * from pairs where gap <= 80 and beside >= -20 qualify row_number() over (partition by paper_id, page, region_id order by gap, caption_no) = 1)
  select r.paper_id, r.page, r.region_id, b.label, round(b.gap, 6) as gap from regions r left join best b using (paper_id, page, region_id)""",
)
def nearest_caption(spark, sf):
    regions = V.table(spark, sf, "lineitem").selectExpr(*[e.strip() for e in _split(REGION)])
    captions = V.table(spark, sf, "orders").selectExpr(*[e.strip() for e in _split(CAPTIONS)])
    out = L.nearest_caption(regions, captions)
    return out.select("paper_id", "page", "region_id", "label", F.round("gap", 6).alias("gap"))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, char in enumerate(columns):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


@register("layout_kept_regions")
def kept_regions(spark, sf):
    regions = V.table(spark, sf, "lineitem").selectExpr(*[e.strip() for e in _split(REGION)])
    return L.drop_overlapping(regions).select("paper_id", "page", "region_id")


@register(
    "layout_caption_labels",
    with_views("passages") + f""" select chunk_id, case when regexp_extract({X.collapse('text')}, {X.q(L.CAPTION)}, 2) <> '' then concat('Fig ', regexp_extract({X.collapse('text')}, {X.q(L.CAPTION)}, 2))
     when regexp_extract({X.collapse('text')}, {X.q(L.CAPTION)}, 3) <> '' then concat('Table ', regexp_extract({X.collapse('text')}, {X.q(L.CAPTION)}, 3)) end as label from passages""",
)
def caption_labels(spark, sf):
    return V.passages(spark, sf).select("chunk_id", L.caption_label(F.col("text")).alias("label"))


@register(
    "layout_dominant_size",
    with_views("lines") + """
  , weights as (select paper_id, (len(text) % 7 + 8)::double as size, sum(len(trim(text)))::bigint as weight from lines group by 1, 2)
  select paper_id, coalesce(max_by(size, (weight * 1000 - size)) filter (where weight > 0), 10.0) as body_size from weights group by 1""",
)
def dominant_size(spark, sf):
    spans = V.lines(spark, sf).withColumn("size", (F.length("text") % 7 + 8).cast("double"))
    return L.dominant_size(spans, ["paper_id"])


@register(
    "layout_ocr_regions",
    with_views("lines") + f"""
  , w as (select paper_id, ordinal, unnest(string_split(text, ' ')) as word, unnest(range(0, len(string_split(text, ' '))))::int as position from lines),
  scored as (select *, case when (position + ordinal) % 9 = 8 then -1 when (position + ordinal) % 11 = 10 then null else (position * 7 + ordinal) % 100 end as conf from w),
  regions as (select paper_id, ordinal, string_agg(word, ' ' order by position) as text, round(avg(conf) / 100, 9) as ocr_confidence from scored where word <> '' and conf >= 0 group by 1, 2)
  select * from regions where len(text) >= 5""",
)
def ocr_regions(spark, sf):
    words = V.lines(spark, sf).select("paper_id", "ordinal", F.posexplode(F.split("text", " ")).alias("position", "word"))
    conf = F.expr("case when (position + ordinal) % 9 = 8 then -1 when (position + ordinal) % 11 = 10 then null else (position * 7 + ordinal) % 100 end")
    out = L.ocr_regions(words.withColumn("conf", conf), ["paper_id", "ordinal"])
    return out.withColumn("ocr_confidence", F.round("ocr_confidence", 9))
