"""Study queries and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quiz as Z
from ..operators import study as S
from ..sources import views as V
from ..sources.views import AS_OF, with_views
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


STRENGTH = f"""
strengths as (
  select card_id,
    coalesce(min(case when not ok then rn end) - 1, count(*)) as strength, count(*) as reviews,
    max(reviewed_at) as last_reviewed_at,
    bool_or(reviewed_at >= timestamp '2024-01-30' and reviewed_at < timestamp '2024-01-31') as seen_today
  from (select *, rating in ('almost','got_it','hard','good','easy') as ok,
          row_number() over (partition by card_id order by reviewed_at desc, review_id desc) as rn from reviews)
  group by card_id)"""

QUEUE = f"""
queue as (
  select c.card_id, c.paper_id, coalesce(strength, 0) as strength, last_reviewed_at,
    row_number() over (order by coalesce(strength, 0), last_reviewed_at nulls first, c.card_id) as position
  from cards c left join strengths s using (card_id))"""


@register("study_card_strength", with_views("reviews") + "," + STRENGTH + " select * from strengths")
def card_strength(spark, sf):
    return S.card_strength(V.reviews(spark, sf), AS_OF)


@register(
    "study_session_queue",
    with_views("reviews", "cards", "papers") + "," + STRENGTH + "," + QUEUE
    + " select position, card_id, strength, last_reviewed_at, coalesce(title, '') as paper_title, coalesce(label, '') as paper_label"
    " from queue left join papers using (paper_id)",
)
def session_queue(spark, sf):
    queue = S.session_queue(V.cards(spark, sf), V.reviews(spark, sf), AS_OF)
    return S.with_paper(queue, V.papers(spark, sf)).select(
        "position", "card_id", "strength", "last_reviewed_at", "paper_title", "paper_label"
    )


@register(
    "study_due_page",
    with_views("reviews", "cards") + "," + STRENGTH + "," + QUEUE
    + " select card_id, strength, position::int as position from queue where position <= 50",
)
def due_page(spark, sf):
    page = S.session_queue(V.cards(spark, sf), V.reviews(spark, sf), AS_OF, limit=50)
    return page.select("card_id", "strength", "position")


@register("study_shuffled_page")
def shuffled_page(spark, sf):
    deck = S.with_strength(V.cards(spark, sf), S.card_strength(V.reviews(spark, sf), AS_OF))
    return S.shuffled_page(deck, seed=7, limit=50).select("card_id", "strength")


@register(
    "study_unreviewed_strength_zero",
    with_views("reviews", "cards") + "," + STRENGTH
    + " select card_id, coalesce(strength, 0) as strength, coalesce(reviews, 0) as reviews, coalesce(seen_today, false) as seen_today"
    " from cards left join strengths using (card_id)",
)
def unreviewed(spark, sf):
    deck = S.with_strength(V.cards(spark, sf), S.card_strength(V.reviews(spark, sf), AS_OF))
    return deck.select("card_id", "strength", "reviews", "seen_today")


@register(
    "study_requeue_position",
    with_views("reviews")
    + " select review_id, case rating when 'again' then 0 + least(6, review_id % 20) + 1 when 'almost' then 0 + least(12, review_id % 20) + 1 end::bigint"
    " as new_index from reviews",
)
def requeue(spark, sf):
    at = S.requeue_position(F.lit(0), F.col("review_id") % 20, F.col("rating"))
    return V.reviews(spark, sf).select("review_id", at.cast("bigint").alias("new_index"))


@register(
    "study_deck_progress",
    with_views("reviews", "cards") + f""",
  today as (select card_id, count(*) as n from reviews where reviewed_at >= timestamp '2024-01-30' and reviewed_at < timestamp '2024-01-31' group by 1)
  select paper_id, count(*) as total, count(n) as seen_today, sum(starred::int)::bigint as starred_count,
    coalesce(sum(n), 0)::bigint as reviews_today, greatest(0, count(*) - count(n)) as due_count, grouping(paper_id)::int as is_library
  from cards left join today using (card_id) group by rollup (paper_id)""",
)
def deck_progress(spark, sf):
    out = S.deck_progress(V.cards(spark, sf), V.reviews(spark, sf), AS_OF)
    return out.withColumn("is_library", F.col("is_library").cast("int"))


@register(
    "study_reviews_between",
    with_views("reviews") + " select count(*) as reviews from reviews where reviewed_at >= timestamp '2024-01-10' and reviewed_at < timestamp '2024-01-20'",
)
def reviews_between(spark, sf):
    return S.reviews_between(V.reviews(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@register(
    "study_seen_today",
    with_views("reviews") + " select count(distinct card_id) as seen from reviews where reviewed_at >= timestamp '2024-01-30' and reviewed_at < timestamp '2024-01-31'",
)
def seen_today(spark, sf):
    return V.reviews(spark, sf).filter(S.seen_on_day(AS_OF)).agg(F.count_distinct("card_id").alias("seen"))


@register(
    "study_last_seven_days",
    with_views("reviews") + """,
  days as (select (date '2024-01-24' + i::int)::date as day from range(0, 7) r(i))
  select day, count(review_id) as reviews from days left join reviews on reviewed_at::date = day group by day""",
)
def last_seven_days(spark, sf):
    return S.last_seven_days(V.reviews(spark, sf), AS_OF)


@register(
    "study_streak",
    with_views("reviews") + """,
  days as (select distinct reviewed_at::date as day from reviews where reviewed_at::date <= date '2024-01-30'),
  numbered as (select day, row_number() over (order by day desc) as rn from days)
  select count(*) filter (where day = date '2024-01-30' - (rn - 1)::int) as streak_days from numbered""",
)
def streak(spark, sf):
    return S.streak(V.reviews(spark, sf), AS_OF)


@register(
    "study_paper_stats",
    with_views("cards", "quizzes", "attempts", "papers") + """,
  att as (select q.paper_id, a.* from attempts a join quizzes q using (quiz_id)),
  deck as (select paper_id, count(*) as cards_total, sum(starred::int)::bigint as cards_starred, max(created_at) as deck_generated_at from cards group by 1),
  quiz as (select paper_id, count(*) as quiz_count from quizzes group by 1),
  tried as (select paper_id, count(*) as quiz_attempt_count, coalesce(max(score) filter (where mode = 'full'), max(score)) as best,
      max(finished_at) as quiz_last_attempted_at from att group by 1),
  ids as (select paper_id from deck union select paper_id from quiz)
  select i.paper_id, coalesce(title, '') as paper_title, coalesce(label, '') as paper_label, coalesce(cards_total, 0) as cards_total,
    coalesce(cards_starred, 0) as cards_starred, deck_generated_at, coalesce(quiz_count, 0) as quiz_count,
    coalesce(quiz_attempt_count, 0) as quiz_attempt_count, round(best, 9) as quiz_best_score, quiz_last_attempted_at,
    coalesce(cards_total, 0) > 0 as has_deck
  from ids i left join deck using (paper_id) left join quiz using (paper_id) left join tried using (paper_id) left join papers using (paper_id)""",
)
def paper_stats(spark, sf):
    quizzes = V.quizzes(spark, sf)
    attempts = V.attempts(spark, sf).join(quizzes.select("quiz_id", "paper_id"), "quiz_id")
    out = S.paper_stats(V.cards(spark, sf), quizzes, attempts, V.papers(spark, sf))
    return out.withColumn("quiz_best_score", F.round("quiz_best_score", 9))


@register(
    "study_overview",
    with_views("cards", "quizzes", "attempts") + """
  select 'papers_with_decks' as metric, count(distinct paper_id) as value from cards union all
  select 'papers_with_quizzes', count(distinct paper_id) from quizzes union all
  select 'quiz_count', count(*) from quizzes union all
  select 'quiz_attempt_count', count(*) from attempts union all
  select 'quizzes_never_attempted', count(*) from quizzes where quiz_id not in (select quiz_id from attempts)""",
)
def overview(spark, sf):
    return S.overview(V.cards(spark, sf), V.quizzes(spark, sf), V.attempt_heads(spark, sf)).select("metric", "value")


@register(
    "study_papers_with_material",
    with_views("cards", "quizzes") + " select paper_id from cards union select paper_id from quizzes",
)
def with_material(spark, sf):
    return V.cards(spark, sf).select("paper_id").union(V.quizzes(spark, sf).select("paper_id")).distinct()


@register(
    "study_queue_by_paper",
    with_views("cards") + " select paper_id, count(*) as cards from cards group by paper_id",
)
def queue_by_paper(spark, sf):
    return S.queue_by_paper(V.cards(spark, sf))


@register(
    "study_newest_card",
    with_views("cards") + " select paper_id, max(created_at) as deck_generated_at from cards group by paper_id",
)
def newest_card(spark, sf):
    return S.newest_card(V.cards(spark, sf))


@register(
    "study_starred_cards",
    with_views("cards") + " select card_id, paper_id, front from cards where starred",
)
def starred(spark, sf):
    return V.cards(spark, sf).filter("starred").select("card_id", "paper_id", "front")


# --- quizzes -------------------------------------------------------------------


@register(
    "quiz_list",
    with_views("quizzes", "attempts") + """
  select q.quiz_id, q.paper_id, q.title, count(a.attempt_id) as attempt_count,
    round(coalesce(max(score) filter (where mode = 'full'), max(score)), 9) as best_score, max(finished_at) as last_attempted_at
  from quizzes q left join attempts a using (quiz_id) group by all""",
)
def quiz_list(spark, sf):
    out = Z.quiz_list(V.quizzes(spark, sf), V.attempts(spark, sf))
    return out.withColumn("best_score", F.round("best_score", 9))


@register(
    "quiz_attempt_history",
    with_views("attempts") + """
  select attempt_id, quiz_id, mode, correct, total, round(score, 9) as score, len(missed)::int as missed_count, finished_at,
    round(coalesce(max(score) filter (mode = 'full') over (partition by quiz_id), max(score) over (partition by quiz_id)), 9) as quiz_best_score from attempts""",
)
def attempt_history(spark, sf):
    out = Z.attempt_history(V.attempts(spark, sf))
    return out.select(
        "attempt_id", "quiz_id", "mode", "correct", "total", F.round("score", 9).alias("score"), "missed_count",
        "finished_at", F.round("quiz_best_score", 9).alias("quiz_best_score"),
    )


@register(
    "quiz_attempt_scores",
    with_views("scores") + " select attempt_id, correct, total, round(score, 9) as score, array_to_string(coalesce(missed, []), ',') as missed from scores",
)
def attempt_scores(spark, sf):
    out = Z.score_attempts(V.answers(spark, sf))
    return out.select("attempt_id", "correct", "total", F.round("score", 9).alias("score"), F.array_join("missed", ",").alias("missed"))


@register("quiz_last_submission_wins", with_views("answers") + " select * from answers")
def last_submission(spark, sf):
    return V.answers(spark, sf)


# questions of attempt n are numbers 1..7; the answer sheet holds some of them
SHEET = "sheet as (select o_orderkey as attempt_id, unnest(range(1, 6))::int as question_no from orders)"


def _sheet(spark, sf):
    numbers = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("question_no")
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt_id"), numbers)


@register(
    "quiz_unanswered_are_wrong",
    with_views("answers") + "," + SHEET
    + " select attempt_id, question_no, coalesce(is_correct, false) as is_correct from sheet left join answers using (attempt_id, question_no)",
)
def unanswered(spark, sf):
    rows = Z.match_submissions(_sheet(spark, sf), V.answers(spark, sf), ["attempt_id", "question_no"])
    return rows.fillna(False, ["is_correct"])


@register(
    "quiz_submissions_out_of_scope",
    with_views("answers") + "," + SHEET
    + " select attempt_id, question_no from answers where (attempt_id, question_no) not in (select attempt_id, question_no from sheet)",
)
def out_of_scope(spark, sf):
    keys = ["attempt_id", "question_no"]
    return Z.unknown_submissions(V.answers(spark, sf), _sheet(spark, sf), keys).select(*keys)


@register(
    "quiz_retry_scope",
    with_views("scores") + "," + SHEET
    + " select attempt_id, question_no from (select attempt_id, unnest(missed) as question_no from scores) join sheet using (attempt_id, question_no)",
)
def retry_scope(spark, sf):
    return Z.retry_scope(Z.score_attempts(V.answers(spark, sf)), _sheet(spark, sf))


@register(
    "quiz_rebuild_attempt",
    with_views("answers") + """
  select attempt_id, (question_no - 1)::int as position, question_no::int as question_no, is_correct
  from (select o_orderkey as attempt_id, unnest(range(1, 8)) as question_no from orders) left join answers using (attempt_id, question_no)""",
)
def rebuild_attempt(spark, sf):
    ids = F.sequence(F.lit(1), F.lit(7)).alias("question_ids")
    heads = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt_id"), ids)
    return Z.attempt_detail(heads, V.answers(spark, sf))


TIER = "case question_no % 3 when 0 then 'recall' when 1 then 'understand' else 'apply' end"
KIND = "case question_no % 2 when 0 then 'multiple_choice' else 'true_false' end"


@register(
    "quiz_score_by_difficulty",
    with_views("answers") + f""",
  tagged as (select attempt_id, is_correct, {TIER} as difficulty from answers),
  grid as (select distinct attempt_id, unnest(['recall', 'understand', 'apply']) as difficulty from answers)
  select attempt_id, difficulty, coalesce(sum(is_correct::int), 0)::bigint as correct, count(is_correct) as total
  from grid left join tagged using (attempt_id, difficulty) group by 1, 2""",
)
def score_by_difficulty(spark, sf):
    graded = V.answers(spark, sf).withColumn("difficulty", F.expr(TIER))
    return Z.by_difficulty(graded, ["attempt_id"])


@register(
    "quiz_question_mix",
    with_views("answers") + f"""
  select attempt_id as quiz_id, count(*) filter (where {TIER} = 'recall') as recall, count(*) filter (where {TIER} = 'understand') as understand,
    count(*) filter (where {TIER} = 'apply') as apply, count(*) filter (where {KIND} = 'multiple_choice') as multiple_choice,
    count(*) filter (where {KIND} = 'true_false') as true_false
  from answers group by 1""",
)
def question_mix(spark, sf):
    questions = V.answers(spark, sf).selectExpr("attempt_id as quiz_id", f"{TIER} as difficulty", f"{KIND} as kind")
    mixed = Z.mixes(questions)

    def count(column, key):
        return F.coalesce(F.try_element_at(column, F.lit(key)), F.lit(0)).cast("bigint").alias(key)

    return mixed.select(
        "quiz_id", *[count("difficulty_mix", k) for k in ("recall", "understand", "apply")],
        *[count("kind_mix", k) for k in ("multiple_choice", "true_false")],
    )


@register(
    "quiz_public_questions",
    with_views("answers") + f"""
  select attempt_id as quiz_id, question_no, {KIND} as kind, {TIER} as difficulty, '' as snippet, (attempt_id % 9)::int as page from answers""",
)
def public_questions(spark, sf):
    rows = V.answers(spark, sf).selectExpr(
        "concat(attempt_id, '-', question_no) as question_id", "attempt_id as quiz_id", "question_no", "'p' as prompt",
        f"{KIND} as kind", f"{TIER} as difficulty", "array('a') as options", "is_correct",
        "named_struct('page', cast(attempt_id % 9 as int), 'snippet', 'secret') as citation",
    )
    shown = Z.public_questions(rows)
    return shown.select("quiz_id", "question_no", "kind", "difficulty", "citation.snippet", "citation.page")


@register(
    "quiz_started_at_clamp",
    """select o_orderkey as attempt_id, least(case o_orderkey % 3 when 0 then o_orderdate - interval 1 hour when 1 then o_orderdate
      else o_orderdate end, o_orderdate) as started_at from orders""",
)
def started_at(spark, sf):
    raw = F.expr(
        "case o_orderkey % 3 when 0 then date_format(o_orderdate - interval 1 hour, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        " when 1 then 'not a time' else date_format(o_orderdate + interval 1 hour, 'yyyy-MM-dd HH:mm:ss') end"
    )
    at = Z.started_at(raw, F.col("o_orderdate").cast("timestamp"))
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt_id"), at.cast("timestamp_ntz").alias("started_at"))
