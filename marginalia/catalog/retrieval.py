"""Embedding and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import retrieval as R
from ..sources import views as V
from ..sources.views import with_views
from . import sqltext as X
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

VECTOR_SQL = """
counted as (select {id}, bucket, count(*) as n from (
   select {id}, (concat('0x', right(md5(w), 3))::int % 1024)::int as bucket from (select {id}, unnest(regexp_extract_all(lower(text), '\\S+')) as w from {source}))
   group by all),
components as (select {id}, bucket, n / sqrt(sum(n * n) over (partition by {id})) as weight from counted)"""


def _embedded(spark, sf):
    return R.with_hash_vector(V.passages(spark, sf))


@register(
    "embed_hashed_words",
    with_views("passages") + "," + VECTOR_SQL.format(id="chunk_id", source="passages")
    + " select chunk_id, bucket, round(weight, 9) as weight from components",
)
def hashed_words(spark, sf):
    rows = R.vector_rows(_embedded(spark, sf))
    return rows.withColumn("weight", F.round("weight", 9))


@register(
    "embed_inputs",
    f"""with raw as (select vec_id, case vec_id % 4 when 0 then '' when 1 then concat(' note ', vec_id, ' ') end as text, case when vec_id % 3 = 0 then concat('caption ', vec_id) end as caption,
      case when vec_id % 5 = 0 then 64 when vec_id % 5 = 1 then 32 end as dims from embeddings),
    kept as (select vec_id, nullif({X.strip("coalesce(nullif(text, ''), caption, '')")}, '') as document, dims = 64 as has_image from raw)
    select vec_id, document, coalesce(has_image, false) as has_image from kept where document is not null or has_image""",
)
def embed_inputs(spark, sf):
    rows = V.table(spark, sf, "embeddings").selectExpr(
        "vec_id", "case vec_id % 4 when 0 then '' when 1 then concat(' note ', vec_id, ' ') end as text",
        "case when vec_id % 3 = 0 then concat('caption ', vec_id) end as caption",
        "case when vec_id % 5 = 0 then embedding when vec_id % 5 = 1 then slice(embedding, 1, 32) end as image_vector",
    )
    out = R.embeddable(rows, 64)
    return out.select("vec_id", "document", F.col("image_vector").isNotNull().alias("has_image"))


# one question per paper: the mean of its vectors
CENTROIDS = """
dims as (select paper_id, u.i, embedding[u.i] as v from vectors, range(1, 65) u(i)),
questions as (select paper_id, list(m order by i) as q from (select paper_id, i, round(avg(v::double), 6) as m from dims group by 1, 2) group by 1)"""


def _centroids(spark, sf):
    parts = V.vectors(spark, sf).select("paper_id", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("paper_id", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m"))
    # the list has one entry per vector dimension
    listed = means.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
    return listed.select(F.col("paper_id").alias("question_id"), F.transform("l", lambda x: x["m"]).alias("embedding"))


def _asked(questions, paper=None, low=None, high=None):
    none = F.lit(None).cast("int")
    return questions.select(
        "question_id", "embedding", (none if paper is None else F.col(paper)).alias("paper_id"),
        (none if low is None else low).alias("page_lo"), (none if high is None else high).alias("page_hi"),
    )


COSINE = "round(list_cosine_similarity(v.embedding::double[], q.q), 9)"


@register(
    "retrieve_dense_top_k",
    with_views("vectors") + "," + CENTROIDS + f"""
  select q.paper_id as question_id, v.chunk_id, {COSINE} as score,
    row_number() over (partition by q.paper_id order by {COSINE} desc, v.chunk_id)::int as rank
  from questions q cross join vectors v qualify rank <= 6""",
)
def dense_top_k(spark, sf):
    return R.nearest(_asked(_centroids(spark, sf)), V.vectors(spark, sf), 6).select("question_id", "chunk_id", "score", "rank")


@register(
    "retrieve_per_paper",
    with_views("vectors") + "," + CENTROIDS + f"""
  select q.paper_id as question_id, v.paper_id, v.chunk_id, {COSINE} as score,
    row_number() over (partition by q.paper_id, v.paper_id order by {COSINE} desc, v.chunk_id)::int as rank
  from questions q cross join vectors v qualify rank <= 3""",
)
def per_paper(spark, sf):
    return R.nearest(_asked(_centroids(spark, sf)), V.vectors(spark, sf), 3, per_paper=True)


@register(
    "retrieve_own_paper",
    with_views("vectors") + "," + CENTROIDS + f"""
  select q.paper_id as question_id, v.chunk_id, greatest(0, {COSINE}) as score,
    row_number() over (partition by q.paper_id order by {COSINE} desc, v.chunk_id)::int as rank
  from questions q join vectors v using (paper_id) qualify rank <= 6""",
)
def own_paper(spark, sf):
    asked = _asked(_centroids(spark, sf).withColumn("own", F.col("question_id")), paper="own")
    out = R.nearest(asked, V.vectors(spark, sf), 6)
    return out.select("question_id", "chunk_id", R.distance_score(F.col("score")).alias("score"), "rank")


@register(
    "retrieve_page_scoped",
    with_views("vectors") + "," + CENTROIDS + f"""
  select q.paper_id as question_id, v.chunk_id, v.page, {COSINE} as score,
    row_number() over (partition by q.paper_id order by {COSINE} desc, v.chunk_id)::int as rank
  from questions q join vectors v using (paper_id) where v.page between 3 and 6 qualify rank <= 6""",
)
def page_scoped(spark, sf):
    asked = _asked(_centroids(spark, sf).withColumn("own", F.col("question_id")), "own", F.lit(6), F.lit(3))
    vectors = V.vectors(spark, sf)
    return R.nearest(asked, vectors, 6).drop("paper_id").join(vectors.select("chunk_id", "page"), "chunk_id")


def _fixed(queries: list[str]) -> str:
    rows = [f"({n}, {b}, {w!r})" for n, q in enumerate(queries) for b, w in sorted(R.fixed_query_vector(q).items())]
    return f"fixed(query_no, bucket, q) as (values {', '.join(rows)})"


SECTION_TEXTS = list(K.SECTION_QUERIES.values())


def _sweep_sql(queries: list[str], k: int) -> str:
    return "," + VECTOR_SQL.format(id="chunk_id", source="passages") + "," + _fixed(queries) + f""",
  dots as (select chunk_id, query_no, sum(weight * q) as score from components join fixed using (bucket) group by 1, 2),
  scored as (select p.paper_id, p.chunk_id, n.i::int as query_no, round(coalesce(score, 0), 9) as score from passages p cross join range(0, {len(queries)}) n(i)
     left join dots d on d.chunk_id = p.chunk_id and d.query_no = n.i),
  hits as (select *, row_number() over (partition by paper_id, query_no order by score desc, chunk_id)::int as rank from scored qualify rank <= {k})"""


@register(
    "retrieve_section_queries",
    with_views("passages") + _sweep_sql(SECTION_TEXTS, 10) + " select paper_id, query_no, chunk_id, score, rank from hits",
)
def section_queries(spark, sf):
    return R.sweep(_embedded(spark, sf), SECTION_TEXTS, 10).select("paper_id", "query_no", "chunk_id", "score", "rank")


@register(
    "retrieve_flat_outline",
    with_views("passages") + _sweep_sql(SECTION_TEXTS, 10)
    + " select paper_id, chunk_id, min(query_no)::int as section_no from hits group by 1, 2",
)
def flat_outline(spark, sf):
    hits = R.sweep(_embedded(spark, sf), SECTION_TEXTS, 10)
    return R.first_seen(hits, ["paper_id"], [F.col("query_no"), F.col("rank")]).select(
        "paper_id", "chunk_id", F.col("query_no").alias("section_no")
    )


def _questions(spark, sf):
    """User turns asked of the paper with the same number."""
    turns = V.table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("conv_id").alias("paper_id"), F.col("turn").alias("turn"), "text"
    )


QUESTIONS = "asked as (select concat(conv_id, '-', turn) as question_id, conv_id as paper_id, turn, text from conversations where role = 'user')"


@register(
    "retrieve_sparse_top_k",
    with_views("passages") + "," + QUESTIONS + "," + VECTOR_SQL.format(id="chunk_id", source="passages") + ","
    + VECTOR_SQL.format(id="question_id", source="asked").replace("counted", "q_counted").replace("components as", "q_components as") + """,
  dots as (select a.question_id, p.chunk_id, round(coalesce(sum(q.weight * c.weight), 0), 9) as score
     from asked a join passages p on p.paper_id = a.paper_id left join components c on c.chunk_id = p.chunk_id left join q_components q on q.question_id = a.question_id and q.bucket = c.bucket group by 1, 2)
  select *, row_number() over (partition by question_id order by score desc, chunk_id)::int as rank from dots qualify rank <= 6""",
)
def sparse_top_k(spark, sf):
    asked = _questions(spark, sf)
    chunks = R.with_hash_vector(R.about_asked(V.passages(spark, sf), asked))
    return R.sparse_nearest(R.with_hash_vector(asked), chunks, 6).select("question_id", "chunk_id", "score", "rank")


@register(
    "retrieve_round_robin",
    with_views("passages") + """,
  spans as (select paper_id, min(page) as low, greatest(1, (max(page) - min(page) + 1) // 6) as width from passages group by 1),
  placed as (select p.*, least((page - low) // width, 5)::int as bucket from passages p join spans using (paper_id))
  select chunk_id, bucket, row_number() over (partition by paper_id, bucket order by page, chunk_id) - 1 as turn from placed""",
)
def round_robin(spark, sf):
    return R.round_robin_by_page(V.passages(spark, sf)).select("chunk_id", "bucket", "turn")


def _keyword_sql(keywords: list[str]) -> str:
    return " + ".join(f"len(string_split(low, {X.q(w)})) - 1" for w in keywords)


SECTION_SCORES = ", ".join(f"{{'section': {X.q(n)}, 'score': {_keyword_sql(k)}}}" for n, k in K.SECTION_KEYWORDS.items())


@register(
    "retrieve_keyword_fallback",
    with_views("passages") + f""",
  lowered as (select *, lower(text) as low from passages),
  scored as (select paper_id, chunk_id, ordinal, s.section, s.score::int as score from (select *, unnest([{SECTION_SCORES}]) as s from lowered)),
  best as (select *, row_number() over (partition by paper_id, section order by score desc, ordinal, chunk_id) as place,
     max(score) over (partition by paper_id, section) as top from scored qualify place <= 18)
  select chunk_id, section, score from best where score > 0 or top = 0""",
)
def keyword_fallback(spark, sf):
    chunks = V.passages(spark, sf).withColumn("rank", F.col("ordinal"))
    return R.fallback_bucket(chunks).select("chunk_id", "section", "score")


@register(
    "retrieve_relevant_figures",
    with_views("passages") + """,
  media as (select paper_id, chunk_id as media_id, ordinal as position, page, case when ordinal % 2 = 0 then concat('Figure ', ordinal + 1) else concat('Table ', ordinal + 1) end as label, text as caption from passages),
  asked as (select concat(conv_id, '-', turn) as question_id, conv_id as paper_id, concat(text, ' See figure ', conv_id % 9 + 1, '.') as text, turn % 3 + 1 as used_page from conversations where role = 'user'),
  words as (select *, list_transform(regexp_extract_all(lower(text), '(?:^|[^\\pL\\pN_])(?:fig(?:ure)?s?|tables?)\\.?\\s*(\\d{1,2})', 1), lambda n: n::int) as numbers,
     list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 3)) as qw from asked),
  pairs as (select question_id, media_id, label, position,
     case when list_contains(numbers, try_cast(regexp_extract(label, '(\\d{1,3})\\s*$', 1) as int)) then 10 else 0 end + case when page = used_page then 3 else 0 end
     + least(3, len(list_intersect(qw, list_distinct(list_filter(regexp_extract_all(lower(caption), '[a-z0-9]+'), lambda w: len(w) > 3))))) as score
     from words join media using (paper_id))
  select question_id, media_id, label, score::int as score, row_number() over (partition by question_id order by score desc, position)::int as rank
  from pairs where score > 0 qualify rank <= 3""",
)
def relevant_figures(spark, sf):
    media = V.passages(spark, sf).selectExpr(
        "paper_id", "chunk_id as media_id", "ordinal as position", "page",
        "case when ordinal % 2 = 0 then concat('Figure ', ordinal + 1) else concat('Table ', ordinal + 1) end as label", "text as caption",
    )
    asked = _questions(spark, sf).withColumn("text", F.expr("concat(text, ' See figure ', paper_id % 9 + 1, '.')"))
    used = asked.select("question_id", F.expr("turn % 3 + 1").alias("page"))
    return R.relevant_figures(asked, media, used)


@register(
    "retrieve_grounding_ids",
    "select event_id, case when event_id % 3 = 0 then 'r1,r2' else concat('c', event_id % 5, case when event_id % 5 <> event_id % 7 then concat(',c', event_id % 7) else '' end) end as ids from events",
)
def grounding(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(
        "event_id",
        "case when event_id % 3 = 0 then array() else array(named_struct('chunk_id', concat('c', event_id % 5)), named_struct('chunk_id', ''), named_struct('chunk_id', concat('c', event_id % 7))) end as cited",
    )
    ids = R.grounding_ids(F.col("cited"), F.array(F.lit("r1"), F.lit("r2")))
    return rows.select("event_id", F.array_join(ids, ",").alias("ids"))


@register(
    "retrieve_one_dimension",
    "select vec_id, 64 as dim from embeddings where vec_id % 3 <> 0",
)
def one_dimension(spark, sf):
    mixed = V.table(spark, sf, "embeddings").selectExpr(
        "vec_id", "case when vec_id % 3 = 0 then slice(embedding, 1, 32) else embedding end as embedding"
    )
    return R.read_dimension(mixed.withColumn("dim", F.size("embedding")), 64).select("vec_id", "dim")
