"""Flashcard and quiz dataset queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import mining as M
from ..functions import text as T
from ..operators import mining as O
from ..plans import deck as D
from ..plans import quiz as Z
from ..plans import report as RP
from ..sources import views as V
from ..sources.views import with_views
from . import sqltext as X
from .registry import Registry
from .reports import SECTIONS, _sections

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _ranked(spark, sf):
    return V.passages(spark, sf).withColumn("rank", F.col("ordinal"))


SENTS = f"""
usable as (select *, ordinal as rank from passages where {X.strip('text')} <> '' and not {X.is_boilerplate('text')}),
sents as (select paper_id, rank, chunk_id, page, unnest({X.sentences('text')}) as sentence, unnest(range(0, len({X.sentences('text')}))) as sent_no from usable)"""


def _stems(family: str, seed: str, wide: bool, **params: str) -> str:
    short, extra = K.CARD_STEMS[family]
    return X.stable_choice(seed, [X.render(t, **params) for t in (short + extra if wide else short)])


def _first_cap(source: str, key: str) -> str:
    return (
        f"u as (select * from {source} qualify row_number() over (partition by paper_id, {key} order by rank, sent_no) = 1),"
        f" cards as (select *, row_number() over (partition by paper_id order by rank, sent_no)::int as seq from u)"
    )


@register(
    "cards_definitions",
    with_views("passages") + "," + SENTS + f""",
  c as (select *, {X.collapse('sentence')} as clean from sents),
  d as (select *, {X.definition_term('clean')} as term, {X.collapse(X.definition_part('clean', 2))} as body from c where {X.usable_sentence('clean')} and {X.definition_part('clean', 1)} is not null),
  k as (select *, replace(lower(term), 'ß', 'ss') as key from d where term <> '' and len(string_split_regex({X.strip('term')}, '\\s+')) <= 8 and not list_contains({X.lst(K.WEAK_SUBJECTS)}, lower(term)) and len(body) >= 20),
  {_first_cap('k', 'key')}
  select paper_id, seq, chunk_id, term, body as back, {_stems('term', 'term', False, term='term')} as front from cards""",
)
def definitions(spark, sf):
    return O.definition_cards(_ranked(spark, sf), ["paper_id"]).select("paper_id", "seq", "chunk_id", "term", "back", "front")


@register(
    "cards_cloze",
    with_views("passages") + "," + SENTS + f""",
  c as (select *, {X.strip_markers('sentence')} as clean from sents),
  f as (select *, {X.blanked('clean')} as blanked from c where len(clean) between 45 and 300 and {X.usable_sentence('clean')}),
  k as (select *, {X.normalize_front('blanked')} as key from f where blanked is not null),
  {_first_cap('k', 'key')}
  select paper_id, seq, chunk_id, blanked, clean as back, {_stems('number', 'blanked', True, blanked='blanked')} as wide_front from cards""",
)
def cloze(spark, sf):
    return O.cloze_cards(_ranked(spark, sf), ["paper_id"]).select("paper_id", "seq", "chunk_id", "blanked", "back", "wide_front")


BOLD = r"\*\*([^*]{2,60})\*\*"
LABEL_END = X.LEFT + r"(?:fig(?:ure)?|table|chart|plate|scheme|eq(?:uation)?|appendix)\s*$"


def _recall_front(x: str, label: str) -> str:
    subject = X.rstrip(X.strip(f"regexp_extract({x}, {X.q(BOLD)}, 1)"), ".:;,")
    plain = f"replace({x}, '**', '')"
    lead = X.rstrip(f"array_to_string({X.words(plain)}[1:5], ' ')", ".:;,")
    body = f"""case when sb <> '' and len({X.words('sb')}) <= 6 and not {X.has('sb', '(?i)' + LABEL_END)} then {_stems('bold', 'sb', False, subject='sb')}
      when bl is not null then {_stems('number', 'bl', False, blanked='bl')}
      when len({X.words(plain)}) > 6 and ld <> '' then {_stems('lead', 'ld', False, label=X.q(label), lead='ld')} else {X.q(K.HEADLINE_FRONT)} end"""
    return X.let("sb", subject, X.let("bl", X.blanked(plain), X.let("ld", lead, body)))


@register(
    "cards_recall",
    with_views("passages") + "," + SENTS + f""",
  c as (select *, {X.strip_markers('sentence')} as clean from sents),
  f as (select * from c where len(clean) between 60 and 280 and {X.usable_sentence('clean')} and {X.blanked('clean')} is null and {X.definition_part('clean', 1)} is null),
  k as (select *, {X.normalize_front('clean')} as key from f),
  {_first_cap('k', 'key')}
  select paper_id, seq, chunk_id, clean as back, {_recall_front('clean', 'passage')} as front from cards""",
)
def recall(spark, sf):
    return O.recall_cards(_ranked(spark, sf), ["paper_id"]).select("paper_id", "seq", "chunk_id", "back", "front")


# sections of one line each, with three citations per section
def _bodies(spark, sf):
    return _sections(spark, sf).select(F.col("report_id").alias("paper_id"), "name", "body")


def _cited(spark, sf):
    markers = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("marker")
    rows = _sections(spark, sf).select(F.col("report_id").alias("paper_id"), "name", "chunk_id", "page", "body", markers)
    return rows.select(
        "paper_id", "name", F.col("marker").alias("position"), "marker", F.concat("body", F.lit(" "), F.col("marker")).alias("snippet"),
        (F.col("page") + F.col("marker")).alias("page"), F.concat("chunk_id", F.lit("-"), "marker").alias("chunk_id"),
    )


BODIES = SECTIONS + ", bodies as (select report_id as paper_id, name, body, chunk_id, page from sections)"
ENTRY = X.collapse(X.sub("p", r"^\s*(?:[-*+•]\s+|\d+[.)]\s+)", "", ""))
ENTRIES = f"list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda p: {X.strip('p')}), lambda p: p <> ''), lambda p: {ENTRY}), lambda b: b <> '')"
PAIR = r"(?s)^\s*(?:[-*+•]\s+|\d+[.)]\s+)?\*\*([^*\n]{2,80})\*\*\s*(?:[—–:-]\s*)?(.+)$"


def _blocks_of(names: list[str]) -> str:
    return f"blocks as (select paper_id, name, chunk_id, page, unnest({ENTRIES}) as block, unnest(range(0, len({ENTRIES})))::int as block_no from bodies where list_contains({X.lst(names)}, name))"


MARK = "try_cast(regexp_extract(block, '\\[(\\d{1,3})\\]', 1) as int)"


@register(
    "cards_section_terms",
    with_views("passages") + "," + BODIES + "," + _blocks_of(["Key Concepts"]) + f""",
  t as (select *, {X.strip_markers(f"regexp_extract(block, {X.q(PAIR)}, 1)")} as term, {X.strip_markers(f"regexp_extract(block, {X.q(PAIR)}, 2)")} as back, {MARK} as mk from blocks where {X.has('block', PAIR)}),
  k as (select *, case when mk between 1 and 3 then page + mk end as p, case when mk between 1 and 3 then concat(chunk_id, '-', mk) end as ch from t where back <> '' and term <> '' and not {X.has('term', '(?i)' + LABEL_END)})
  select paper_id, block_no, term, back, p as page, ch as chunk_id, concat('See **Key Concepts**', case when p is not null then concat(', page ', p, '.') else '.' end) as hint,
    {_stems('term', 'term', False, term='term')} as front from k""",
)
def section_terms(spark, sf):
    return D.term_cards(_bodies(spark, sf), _cited(spark, sf)).drop("name", "wide_front")


@register(
    "cards_section_takeaways",
    with_views("passages") + "," + BODIES + "," + _blocks_of(["Key Takeaways"]) + f""",
  t as (select *, {X.strip_markers('block')} as back from blocks)
  select paper_id, block_no, back, {_recall_front('back', 'takeaway')} as front from t where len(back) >= 20""",
)
def section_takeaways(spark, sf):
    return D.takeaway_cards(_bodies(spark, sf), _cited(spark, sf)).select("paper_id", "block_no", "back", "front")


@register("cards_section_facts")
def section_facts(spark, sf):
    return D.section_fact_cards(_bodies(spark, sf), _cited(spark, sf), 20)


ABSTRACT_SENTS = X.sentences("regexp_replace(text, '\\s+', ' ', 'g')")


@register(
    "cards_abstract",
    f"""with s as (select doc_id as paper_id, unnest({ABSTRACT_SENTS}) as back, unnest(range(0, len({ABSTRACT_SENTS}))) as sent_no from documents),
  k as (select *, row_number() over (partition by paper_id order by sent_no)::int as seq from s where len(back) >= 60 qualify seq <= 10)
  select paper_id, seq, back, 'From the paper''s abstract.' as hint, {_recall_front('back', 'statement')} as front from k""",
)
def abstract(spark, sf):
    papers = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    return D.abstract_cards(papers).drop("wide_front")


# --- deck assembly: candidates are the passages themselves, in three buckets ---------

CANDIDATES = """
cand as (select paper_id, (ordinal % 3)::int as bucket, ordinal as place, 'fact' as origin, concat('Recall: ', section_label, ' ', ordinal % 5) as front, concat('Widely: ', section_label, ' ', ordinal % 7) as wide_front, text as back from passages),
known as (select doc_id as paper_id, left(sha1(concat(doc_id, '|fact|', 'recall introduction ', u.i)), 16) as content_key from documents, range(0, 3) u(i))"""
KEY_SQL = f"left(sha1(concat(paper_id, '|fact|', {X.normalize_front('front')})), 16)"


def _candidates(spark, sf):
    return V.passages(spark, sf).select(
        "paper_id", F.expr("cast(ordinal % 3 as int)").alias("bucket"), F.col("ordinal").alias("place"), F.lit("fact").alias("origin"),
        F.expr("concat('Recall: ', section_label, ' ', ordinal % 5)").alias("front"), F.expr("concat('Widely: ', section_label, ' ', ordinal % 7)").alias("wide_front"),
        F.col("text").alias("back"), F.lit("h").alias("hint"), F.col("section_label").alias("section"), "page", "chunk_id",
    )


def _known(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    front = F.concat(F.lit("recall introduction "), F.col("i"))
    return rows.select("paper_id", M.content_key(F.col("paper_id"), F.lit("fact"), front).alias("content_key"))


WIDENED = f"""
w as (select c.* exclude (front, wide_front), case when {KEY_SQL} in (select content_key from known k where k.paper_id = c.paper_id) then front else wide_front end as front from cand c),
flagged as (select *, {KEY_SQL} as content_key, {KEY_SQL} in (select content_key from known k where k.paper_id = w.paper_id) as seen_before from w)"""


@register(
    "deck_widened_fronts",
    with_views("passages") + "," + CANDIDATES + "," + WIDENED + " select paper_id, place, front, content_key, seen_before from flagged",
)
def widened(spark, sf):
    known = _known(spark, sf)
    out = D.known_last(D.widen_new(_candidates(spark, sf), known), known)
    return out.select("paper_id", "place", "front", "content_key", "seen_before")


@register(
    "deck_interleaved",
    with_views("passages") + "," + CANDIDATES + "," + WIDENED + """,
  turned as (select *, row_number() over (partition by paper_id, bucket order by seen_before, place) as turn from flagged),
  picked as (select *, row_number() over (partition by paper_id order by turn, bucket)::int as position from turned qualify position <= 20)
  select paper_id, position, place from picked""",
)
def interleaved(spark, sf):
    known = _known(spark, sf)
    ready = D.known_last(D.widen_new(_candidates(spark, sf), known), known)
    return D.interleave(ready, 20).select("paper_id", "position", "place")


@register(
    "deck_useful_cards",
    with_views("passages") + "," + CANDIDATES + f""",
  p as (select *, {X.normalize_front('front')} as f, {X.normalize_front('back')} as b from cand),
  u as (select * from p where len(back) >= 20 and f <> '' and b <> '' and not contains(f, b) and {X.is_usable('front')} and {X.is_usable('back')} qualify row_number() over (partition by paper_id, f order by place) = 1)
  select paper_id, place from u""",
)
def useful(spark, sf):
    return D.useful_first(_candidates(spark, sf).withColumn("position", F.col("place"))).select("paper_id", "place")


def _full_deck(spark, sf):
    papers = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    pool = RP.rotated_pool(V.passages(spark, sf))
    candidates = D.with_abstract_fallback(D.pool_candidates(pool, 20), papers)
    return D.build_deck(candidates, _known(spark, sf), 20)


@register("deck_build")
def deck_build(spark, sf):
    return _full_deck(spark, sf)


@register("deck_build_from_report")
def deck_from_report(spark, sf):
    candidates = D.report_candidates(_bodies(spark, sf), _cited(spark, sf), 20)
    return D.build_deck(candidates, _known(spark, sf), 20)


@register("deck_build_whole")
def whole_deck(spark, sf):
    papers = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    bodies = _bodies(spark, sf).withColumn("paper_id", F.floor(F.col("paper_id") / 100000).cast("bigint"))
    pool = RP.rotated_pool(V.passages(spark, sf))
    return D.build_whole_deck(_paper_sections(bodies), _paper_citations(spark, sf), pool, papers, _known(spark, sf), 20)


# --- quizzes ----------------------------------------------------------------------


def _sources(spark, sf):
    empty = _bodies(spark, sf).withColumn("paper_id", F.floor(F.col("paper_id") / 100000).cast("bigint"))
    return Z.collect_sources(_paper_sections(empty), _paper_citations(spark, sf), _ranked(spark, sf))


def _paper_sections(bodies):
    """One section per name of a paper: the bodies of its lines, in order."""
    lines = bodies.groupBy("paper_id", "name").agg(F.array_sort(F.collect_list("body")).alias("lines"))
    return lines.select("paper_id", "name", F.array_join("lines", "\n").alias("body"))


def _paper_citations(spark, sf):
    """All citations of a section, numbered anew by page and chunk."""
    cited = _cited(spark, sf).withColumn("paper_id", F.floor(F.col("paper_id") / 100000).cast("bigint"))
    number = F.row_number().over(W.partitionBy("paper_id", "name").orderBy("page", "chunk_id"))
    return cited.withColumn("marker", number).withColumn("position", number)


@register(
    "quiz_pool_sources",
    with_views("passages") + f""",
  s as (select paper_id, ordinal as rank, chunk_id, page, unnest(regexp_split_to_array(t, chr(1))) as raw, unnest(range(0, len(regexp_split_to_array(t, chr(1))))) as sn from
     (select *, regexp_replace({X.collapse(X.sub(X.strip('text'), chr(92) + '[(' + chr(92) + 'd{1,3})' + chr(92) + ']'))}, '([.!?])\\s+', '\\1' || chr(1), 'g') as t from passages where {X.strip('text')} <> '')),
  b as (select *, {X.strip(X.sub('raw', r'^\s*(?:[-*+]\s+|\d+[.)]\s+)', '', ''))} as body from s),
  u as (select *, not regexp_matches(body, '(?i)^(first|second|third|fourth|fifth|initially|then|next|finally|subsequently|afterwards?|after\\s+that|lastly)(?:[,:]\\s+|\\s+)') as later from b
     where len(body) between 45 and 320 and not {X.is_boilerplate('body')} and {X.prose_score('body')} >= 0.2),
  c as (select *, row_number() over (partition by paper_id, chunk_id order by later, sn) as bn from u qualify bn <= 3)
  select paper_id, row_number() over (partition by paper_id order by rank, bn)::int as a, chunk_id, case when {X.has('body', M.QUIZ_DEFINITION)} and len({X.strip(f"regexp_extract(body, {X.q(M.QUIZ_DEFINITION)}, 2)")}) >= 30
    then {X.strip(f"regexp_extract(body, {X.q(M.QUIZ_DEFINITION)}, 2)")} else body end as body from c qualify a <= 30""",
)
def pool_sources(spark, sf):
    return Z.pool_sources(_ranked(spark, sf)).select("paper_id", "a", "chunk_id", F.col("body"))


@register("quiz_sources")
def sources(spark, sf):
    return _sources(spark, sf)


# claims: one source per passage, numbered by line
CLAIMS = "claims as (select paper_id, ordinal + 1 as no, concat('s', ordinal + 1) as source_id, section_label as section, text as body, (row_number() over (partition by paper_id order by ordinal) - 1)::int as position from passages)"


def _claims(spark, sf):
    return V.passages(spark, sf).select(
        "paper_id", (F.col("ordinal") + 1).alias("no"), F.expr("concat('s', ordinal + 1)").alias("source_id"), F.col("section_label").alias("section"),
        F.col("text").alias("body"), F.lit(None).cast("string").alias("term"), "chunk_id",
    )


NUM = r"(^|[^\pL\pN_.])(\d+(?:\.\d+)?)(%?)($|[^\pL\pN_])"


def _one_number() -> str:
    """Numbers bounded as the rule asks; a following digit or letter, or a leading point, disqualifies."""
    spaced = "regexp_replace(body, '([^\\pL\\pN_.])', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({spaced}, {X.q(NUM)}, 2))"


@register(
    "quiz_numeric_blanks",
    with_views("passages") + "," + CLAIMS + f""",
  n as (select *, regexp_extract(body, {X.q(r'^((?s).*?)' + NUM)}, 1) || regexp_extract(body, {X.q(r'^((?s).*?)' + NUM)}, 2) as before, regexp_extract(body, {X.q(NUM)}, 2) as v, regexp_extract(body, {X.q(NUM)}, 3) as sf from claims where {_one_number()} = 1),
  k as (select *, {X.rstrip(X.strip('body'), ' .')} as sentence from n where not {X.has('before', X.LABELS)})
  select paper_id, source_id, v || sf as answer, {X.strip("[" + ", ".join(X.render(t, blanked="substr(sentence, 1, len(before)) || '____' || substr(sentence, len(before) + len(v || sf) + 1)") for t in K.QUIZ_STEMS['numeric_blank']) + "][position % 4 + 1]")} as prompt from k""",
)
def numeric_blanks(spark, sf):
    drafts = Z.numeric_questions(_claims(spark, sf)).filter("kind = 'short_answer'")
    return drafts.select("paper_id", "source_id", F.col("correct_answer_text").alias("answer"), "prompt")


@register("quiz_numeric_questions")
def numeric_questions(spark, sf):
    return Z.numeric_questions(_claims(spark, sf)).select("paper_id", "source_id", "kind", "prompt", "correct_option_id", "explanation")


@register(
    "quiz_distractors",
    with_views("passages") + "," + CLAIMS + f""",
  placed as (select paper_id, no, source_id, {X.folded_set('body')} as ws, count(*) over (partition by paper_id) as n,
    row_number() over (partition by paper_id order by sha1(concat_ws('|', paper_id, source_id)), no) as place from claims),
  fitting as (select a.paper_id, a.source_id, b.no as other, (b.place - a.place + a.n) % a.n as step from placed a join placed b on a.paper_id = b.paper_id and a.no <> b.no
    where case when len(a.ws) = 0 then 0.0 else len(list_intersect(a.ws, b.ws)) / len(a.ws) end < {K.NEAR_DUPLICATE_OVERLAP}
      and case when len(b.ws) = 0 then 0.0 else len(list_intersect(a.ws, b.ws)) / len(b.ws) end < {K.NEAR_DUPLICATE_OVERLAP}),
  three as (select * from fitting qualify row_number() over (partition by paper_id, source_id order by step) <= 3),
  listed as (select paper_id, source_id, string_agg(concat('Term ', other), '|' order by step) as distractors from three group by 1, 2)
  select paper_id, source_id, coalesce(distractors, '') as distractors from claims left join listed using (paper_id, source_id)""",
)
def distractors(spark, sf):
    rows = _claims(spark, sf).withColumn("term", F.concat(F.lit("Term "), "no"))
    out = Z.with_distractors(rows)
    return out.select("paper_id", "source_id", F.array_join(F.transform("others", lambda d: d["term"]), "|").alias("distractors"))


@register("quiz_definition_questions")
def definition_questions(spark, sf):
    rows = _claims(spark, sf).withColumn("term", F.concat(F.lit("Term "), "no"))
    out = Z.definition_questions(Z.with_distractors(rows))
    return out.select("paper_id", "source_id", "kind", "difficulty", "prompt", "correct_option_id", "correct_answer_text", "explanation")


@register("quiz_ordering_questions")
def ordering_questions(spark, sf):
    # the lines of a page are steps of one chunk
    steps = _claims(spark, sf).withColumn("chunk_id", F.concat(F.lit("p"), F.floor((F.col("no") - 1) / 4))).withColumn(
        "body", F.concat(F.lit("Then, "), "body")
    )
    one_section = steps.withColumn("section", F.lit("Methods"))
    return Z.ordering_questions(one_section).select("paper_id", "source_id", "kind", "prompt", "correct_option_id", "explanation")


@register("quiz_locator_questions")
def locator_questions(spark, sf):
    return Z.locator_questions(_claims(spark, sf)).select("paper_id", "source_id", "prompt", "correct_option_id", "explanation")


DRAFTS = """
drafts as (select event_id, case when event_id % 13 = 0 then 'sX' else 's1' end as source_id, case event_id % 3 when 0 then 'short_answer' when 1 then 'true_false' else 'multiple_choice' end as kind,
  case when event_id % 17 = 3 then 'hard' else 'recall' end as difficulty, case when event_id % 11 = 5 then 'Short?' else concat('Which event is number ', event_id, ' of the log', case when event_id % 7 = 2 then ', the purchase event' else '' end, '?') end as prompt,
  event_type, event_id % 5 as o from events)"""


@register(
    "quiz_draft_validation",
    "with " + DRAFTS + f"""
  select event_id, case when source_id = 'sX' then 'unknown_source' when len(prompt) < 12 then 'too_short' when difficulty = 'hard' then 'unknown_kind'
    when kind = 'short_answer' then case when contains({X.punctuation_free('prompt')}, event_type) then 'answer_in_prompt' end
    when kind = 'true_false' then case when o = 0 then 'not_true_false' when o = 1 then 'no_right_option' end
    else case when o = 0 then 'banned_option' when o = 1 then 'repeated_option' when o = 2 then 'not_four_options' when contains({X.punctuation_free('prompt')}, 'the purchase event') then 'answer_in_prompt' end end as reject from drafts""",
)
def draft_validation(spark, sf):
    pair = "array(named_struct('id', 'true', 'text', 'True'), named_struct('id', 'false', 'text', 'False'))"
    four = "array(named_struct('id', 'a', 'text', 'The purchase event'), named_struct('id', 'b', 'text', {b}), named_struct('id', 'c', 'text', 'C option'), named_struct('id', {d}, 'text', 'D option'))"
    rows = V.table(spark, sf, "events").selectExpr(
        "event_id", "0 as paper_id", "if(event_id % 13 = 0, 'sX', 's1') as source_id",
        "case event_id % 3 when 0 then 'short_answer' when 1 then 'true_false' else 'multiple_choice' end as kind", "if(event_id % 17 = 3, 'hard', 'recall') as difficulty",
        "if(event_id % 11 = 5, 'Short?', concat('Which event is number ', event_id, ' of the log', if(event_id % 7 = 2, ', the purchase event', ''), '?')) as prompt",
        f"case event_id % 3 when 1 then if(event_id % 5 = 0, reverse({pair}), {pair}) when 2 then case event_id % 5 when 0 then {four.format(b=chr(39) + 'None of the above' + chr(39), d=chr(39) + 'd' + chr(39))}"
        f" when 1 then {four.format(b=chr(39) + 'C option' + chr(39), d=chr(39) + 'd' + chr(39))} when 2 then {four.format(b=chr(39) + 'B' + chr(39), d=chr(39) + 'e' + chr(39))}"
        f" else {four.format(b=chr(39) + 'B' + chr(39), d=chr(39) + 'd' + chr(39))} end else array() end as options",
        "case event_id % 3 when 1 then if(event_id % 5 = 1, 'maybe', 'true') when 2 then 'a' end as correct_option_id", "event_type as correct_answer_text",
        "'Because the log says so, plainly.' as explanation",
    )
    sources = rows.select("paper_id", F.lit("s1").alias("source_id")).distinct()
    return Z.validate_drafts(rows, sources).select("event_id", "reject")


@register("quiz_build")
def quiz_build(spark, sf):
    asked = V.messages(spark, sf).select(F.col("session_id").alias("paper_id"), F.col("text").alias("prompt"))
    return Z.build_quizzes(_sources(spark, sf), asked).select(
        "paper_id", "index", "kind", "difficulty", "prompt", "correct_option_id", "correct_answer_text", "section", "chunk_id"
    )


@register(
    "quiz_stem_rotation",
    f"select l_orderkey, l_linenumber, l_partkey, {X.lst(K.CARD_STEMS['number'][0])}[l_linenumber % 3 + 1] as stem from lineitem",
)
def stem_rotation(spark, sf):
    stem = Z._rotate(K.CARD_STEMS["number"][0], F.col("l_linenumber"), blanked=F.lit("{blanked}"))
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", stem.alias("stem"))


@register(
    "text_keyword_hits",
    "select doc_id, (len(string_split(lower(text), 'the')) - 1 + len(string_split(lower(text), 'of the')) - 1)::int as hits from documents",
)
def keyword_hits(spark, sf):
    docs = V.table(spark, sf, "documents").withColumn("low", T.once(F.lower("text")))
    return docs.select("doc_id", T.keyword_score(F.col("low"), ["the", "of the"]).alias("hits"))
