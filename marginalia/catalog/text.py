"""Text quality, chunking and grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import grading as G
from ..functions import mining as M
from ..functions import quality as Q
from ..functions import text as T
from ..operators import chunking as C
from ..operators import clean as N
from ..operators import quiz as Z
from ..sources import readers as R
from ..sources import views as V
from ..sources.views import with_views
from . import sqltext as X
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _per_passage(name: str, columns, sql: dict) -> None:
    """A row-wise rule over every passage, as one narrow pass; ``columns`` makes its Columns once a session runs."""
    shown = ", ".join(f"{expression} as {alias}" for alias, expression in sql.items())

    @register(name, with_views("passages") + f" select chunk_id, {shown} from passages")
    def run(spark, sf):
        return V.passages(spark, sf).select("chunk_id", *[c.alias(a) for a, c in columns().items()])


_per_passage("text_caption", lambda: {"caption": Q.is_caption(F.col("text"))}, {"caption": X.is_caption("text")})
_per_passage("text_caption_sentence", lambda: {"caption": Q.is_caption_sentence(F.col("text"))}, {"caption": X.is_caption_sentence("text")})
_per_passage("text_boilerplate_rule", lambda: {"rule": Q.boilerplate_rule(F.col("text"))}, {"rule": X.boilerplate_rule("text")})
_per_passage("text_title_block_cut", lambda: {"body": Q.strip_title_block(F.col("text"))}, {"body": X.strip_title_block("text")})
_per_passage("text_contact_block_cut", lambda: {"body": Q.strip_contact_block(F.col("text"))}, {"body": X.strip_contact_block("text")})
_per_passage("text_prose_score", lambda: {"score": F.round(Q.prose_score(F.col("text")), 9)}, {"score": f"round({X.prose_score('text')}, 9)"})
_per_passage("text_usable_sentence", lambda: {"usable": Q.usable_sentence(F.col("text"))}, {"usable": X.usable_sentence("text")})
_per_passage("text_reads_like_sentence", lambda: {"sentence": Q.looks_like_sentence(F.col("text"))}, {"sentence": X.looks_like_sentence("text")})
_per_passage(
    "text_noncontent",
    lambda: {"off": Q.is_noncontent(F.col("section_label"), F.col("text"))},
    {"off": f"({X.has('section_label', X.NONCONTENT)} or {X.has('text', K.MODEL_TOKEN)})"},
)
_per_passage("text_dedupe_key", lambda: {"key": Q.dedupe_key(F.col("text"))}, {"key": X.dedupe_key("text")})
_per_passage(
    "text_snippet",
    lambda: {"snippet": T.clean_snippet(F.col("text"), 120), "card": T.truncate_card(F.col("text"), 80)},
    {"snippet": X.shorten("text", 120, 0.4), "card": X.shorten("text", 80, 0.5)},
)
_per_passage("text_token_count", lambda: {"tokens": T.token_count(F.col("text"))}, {"tokens": f"len({X.words('text')})::int"})
_per_passage(
    "text_markers",
    lambda: {"bare": T.strip_markers(F.col("text")), "first_marker": T.first_marker(F.col("text"))},
    {"bare": X.strip_markers("text"), "first_marker": f"try_cast(regexp_extract(text, {X.q(r'\[(\d{1,3})\]')}, 1) as int)"},
)
_per_passage("text_normalized_front", lambda: {"front": M.normalize_front(F.col("text"))}, {"front": X.normalize_front("text")})
_per_passage(
    "text_content_key",
    lambda: {"content_key": M.content_key(F.col("paper_id"), F.lit("fact"), F.col("text"))},
    {"content_key": f"left(sha1(concat(paper_id, '|fact|', {X.normalize_front('text')})), 16)"},
)
_per_passage(
    "text_textual_chunks",
    lambda: {"textual": Q.is_textual(F.when(F.col("ordinal") % 5 == 0, "image").otherwise(F.col("modality")), F.col("text"))},
    {"textual": f"(case when ordinal % 5 = 0 then 'image' else modality end <> 'image' and {X.strip('text')} <> '')"},
)
_per_passage(
    "text_figure_fallback",
    lambda: {"shown": Q.figure_text(F.when(F.col("ordinal") % 2 == 0, F.col("text")), F.when(F.col("ordinal") % 3 == 0, F.lit("Fig 1")), F.when(F.col("page") % 2 == 0, F.col("lang")))},
    {"shown": f"coalesce(nullif({X.strip('case when ordinal % 2 = 0 then text else ' + X.q('') + ' end')}, ''),"
     " concat(case when ordinal % 3 = 0 then 'Fig 1' else 'This figure' end, case when page % 2 = 0 then concat(': ', lang)"
     " else ' — vision analysis unavailable; showing the extracted crop only.' end))"},
)
_per_passage(
    "text_ordinal_number",
    lambda: {"pointer": Q.is_ordinal_number(F.col("text"), F.regexp_instr(F.col("text"), F.lit(r"\d")) - 1)},
    {"pointer": X.has("case when regexp_matches(text, '\\d') then regexp_extract(text, '^([^\\d]*)', 1) else '' end", X.LABELS)},
)
_per_passage(
    "text_blanked_number",
    lambda: {"blanked": M.blanked_sentence(F.col("text")), "value": M.blanked_value(F.col("text"))},
    {"blanked": X.blanked("text"), "value": X.let("n", X.first_number("text"), f"case when n is not null then {X.strip('n.value')} end")},
)
_per_passage(
    "text_definition_parts",
    lambda: {"term": M.definition_term(F.col("text")), "body": M.definition_body(F.col("text"))},
    {"term": f"coalesce({X.definition_term('text')}, '')", "body": f"coalesce({X.collapse(X.definition_part('text', 2))}, '')"},
)
_per_passage(
    "text_section_guess",
    lambda: {"section": M.section_guess(F.col("text"))},
    {
        "section": X.let(
            "w", "regexp_extract_all(lower(text), '[a-z]+')",
            X.let(
                "sc",
                "[" + ", ".join(f"len(list_intersect(list_distinct(w), {X.lst(h)}))" for _, h in K.POOL_SECTION_HINTS) + "]",
                f"case when list_max(sc) = 0 then 'Overview' else {X.lst([s for s, _ in K.POOL_SECTION_HINTS])}[list_position(sc, list_max(sc))] end",
            ),
        )
    },
)
_per_passage(
    "text_card_stem",
    lambda: {"front": M.stem("term", F.col("section_label"), term=F.col("section_label")), "lead": M.stem("lead", F.col("text"), True, label=F.lit("passage"), lead=T.clean_snippet(F.col("text"), 40))},
    {
        "front": X.stable_choice("section_label", [X.render(t, term="section_label") for t in K.CARD_STEMS["term"][0]]),
        "lead": X.stable_choice("text", [X.render(t, label="'passage'", lead=X.shorten("text", 40, 0.4)) for t in sum(K.CARD_STEMS["lead"], [])]),
    },
)
_per_passage(
    "text_predicate_form",
    lambda: {"pred": M.lower_first(M.as_predicate(M.trim_period(F.concat(F.lit("It is "), F.col("text")))))},
    {"pred": X.let("p", X.rstrip(X.strip("'It is ' || text"), " ."), X.let("b", X.strip("substr(p, 7)"), X.let(
        "c", "case when len(b) < 12 then p else b end",
        f"case when c = '' or regexp_matches(substr(c, 2, 1), '^\\p{{Lu}}$') then c else lower(substr(c, 1, 1)) || substr(c, 2) end")))},
)
_per_passage(
    "text_number_mutation",
    lambda: {"mutated": M.mutate_number(F.when(F.col("ordinal") % 3 == 0, F.concat(F.col("ordinal").cast("string"), F.lit(".5"))).otherwise((F.col("ordinal") * 97).cast("string")), F.lit("%"))},
    {"mutated": "concat(case when ordinal % 3 = 0 then case when ordinal * 2 + 1 > 0 then (ordinal * 2 + 1)::varchar end"
     " when ordinal * 97 between 1900 and 2100 then (ordinal * 97 + 7)::varchar when ordinal = 0 then '1' else (ordinal * 194)::varchar end, '%')"},
)
_per_passage(
    "text_term_mask",
    lambda: {"masked": M.mask_term(F.col("text"), F.lit("Byte Pair Encoding (BPE)")), "variants": F.array_join(M.term_variants(F.lit("Byte Pair Encoding (BPE)")), "|")},
    {
        "masked": X.let("m", "text", X.collapse("regexp_replace(regexp_replace(m, '(?i)Byte Pair Encoding \\(BPE\\)', '___', 'g'), '(?i)Byte Pair Encodings?', '___', 'g')").replace("m, '(?i)Byte Pair Encoding \\(BPE", "m, '(?i)Byte Pair Encoding \\(BPE")),
        "variants": "'Byte Pair Encoding (BPE)|Byte Pair Encoding|BPE'",
    },
)


@register(
    "text_repair_markers",
    with_views("passages") + f""" select chunk_id, {X.strip("regexp_replace(regexp_replace(case when ordinal % 7 + 1 <= 5 then text || ' [' || (ordinal % 7 + 1) || '] and [' || (ordinal % 7 + 1) || '].' else text || ' [n] ' || (ordinal % 7 + 1) || ' and **(' || (ordinal % 7 + 1) || ')**.' end, '(?i)" + chr(92) + "s*" + chr(92) + "[" + chr(92) + "s*n" + chr(92) + "s*" + chr(92) + "]" + chr(92) + "s*', ' ', 'g'), 'qqq', '')")} as repaired from passages""",
)
def repair_markers(spark, sf):
    n = (F.col("ordinal") % 7 + 1).cast("string")
    raw = F.concat(F.col("text"), F.lit(" [n] "), n, F.lit(" and **("), n, F.lit(")**."))
    return V.passages(spark, sf).select("chunk_id", T.repair_markers(raw, F.lit(5)).alias("repaired"))


@register(
    "text_strip_preamble",
    with_views("passages") + f" select chunk_id, {X.strip('text')} as body from passages",
)
def strip_preamble(spark, sf):
    raw = (
        F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("Sure, here is the rewritten text:\n\n"), F.col("text")))
        .when(F.col("ordinal") % 3 == 1, F.concat(F.lit("```markdown\n"), F.col("text"), F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    return V.passages(spark, sf).select("chunk_id", T.strip_preamble(raw).alias("body"))


@register(
    "text_sentences",
    f"select doc_id as paper_id, unnest({X.sentences('text')}) as sentence, unnest(range(0, len({X.sentences('text')})))::int as position from documents",
)
def sentences(spark, sf):
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("paper_id"), F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence")
    )


WINDOWS = (
    "select doc_id as paper_id, i::int as ordinal, array_to_string(ws[(i * {step} + 1):(i * {step} + {size})], ' ') as text from"
    " (select doc_id, regexp_extract_all(text, '\\S+') as ws from documents) t,"
    " range(0, greatest(ceil((len(ws) - {size}) / {step})::int, 0) + 1) r(i)"
)


@register(
    "chunk_token_windows",
    "select paper_id, ordinal, case when n <= 200 then raw else text end as text from (" + WINDOWS.format(step=170, size=200).replace(
        "select doc_id as paper_id,", "select doc_id as paper_id, len(ws) as n, raw,").replace("select doc_id, regexp", "select doc_id, text as raw, regexp") + ")",
)
def token_windows(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return C.chunk_text_rows(docs, 200, 30)


def _blocks(spark, sf):
    """Passages with the nullable columns of OCR, vision and image rows."""
    media = F.col("ordinal") % 13 == 5
    return V.passages(spark, sf).select(
        "paper_id", "page", "ordinal", "modality", "section_label", "text",
        F.when(F.col("modality") == "ocr", "ocr").otherwise("text").alias("provenance"),
        F.struct(
            F.col("page").cast("double").alias("x0"), (F.col("ordinal") % 7).cast("double").alias("y0"),
            (F.col("page") + 100).cast("double").alias("x1"), (F.col("ordinal") % 7 + 20).cast("double").alias("y1"),
        ).alias("bbox"),
        F.when(media, F.concat(F.lit("p"), F.col("page"), F.lit(".png"))).alias("image_path"),
        F.when(media, F.lit("Fig 1")).alias("figure_label"),
        F.lit(None).cast("string").alias("caption"),
        F.when(media, F.col("lang")).alias("language"),
        F.when(media, F.col("ordinal") / 100).alias("ocr_confidence"),
    )


@register("chunk_corpus")
def chunk_corpus(spark, sf):
    out = C.chunk_blocks(_blocks(spark, sf), size=120, overlap=20)
    return out.select("paper_id", "chunk_id", "ordinal", "page", "modality", "text", "token_count")


# size 1 keeps every block in its own group, so grouping has a closed form
@register(
    "chunk_group_finalize",
    with_views("passages") + """
  select paper_id, page, count(*) as blocks, string_agg(nullif(text, ''), chr(10) || chr(10) order by ordinal) as text,
    min(page)::double as x0, min(ordinal % 7)::double as y0, max(page + 100)::double as x1, max(ordinal % 7 + 20)::double as y1,
    round(avg(case when ordinal % 13 = 5 then ordinal / 100 end), 9) as ocr_confidence,
    arg_min(case when ordinal % 13 = 5 then lang end, case when ordinal % 13 = 5 then ordinal end) as language
  from passages group by paper_id, page""",
)
def group_finalize(spark, sf):
    out = C.finalize_groups(_blocks(spark, sf).withColumn("group_no", F.lit(0)))
    return out.select(
        "paper_id", "page", "blocks", F.nullif("text", F.lit("")).alias("text"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1",
        F.round("ocr_confidence", 9).alias("ocr_confidence"), "language",
    )


@register(
    "chunk_numbering",
    with_views("passages") + """
  select paper_id, page, text, (row_number() over (partition by paper_id order by page, ordinal) - 1) as ordinal,
    concat(paper_id, '::c', lpad((row_number() over (partition by paper_id order by page, ordinal) - 1)::varchar, 5, '0')) as chunk_id
  from passages where text <> ''""",
)
def chunk_numbering(spark, sf):
    pieces = V.passages(spark, sf).filter(F.col("text") != "").select(
        "paper_id", "page", "text", F.col("ordinal").alias("group_no"), F.lit(0).alias("piece")
    )
    return C.number_chunks(pieces).select("paper_id", "page", "text", "ordinal", "chunk_id")


@register("chunk_greedy_groups")
def greedy_groups(spark, sf):
    return C.merge_groups(_blocks(spark, sf), 60).select("paper_id", "page", "ordinal", "group_no", "tokens")


@register(
    "chunk_stream_union",
    with_views("passages") + " select chunk_id, text, null::varchar as image_path from passages union all"
    " select concat('v', vec_id), null, concat('p', vec_id, '.png') from embeddings",
)
def stream_union(spark, sf):
    images = V.table(spark, sf, "embeddings").selectExpr("concat('v', vec_id) as chunk_id", "concat('p', vec_id, '.png') as image_path")
    return C.all_streams(V.passages(spark, sf).select("chunk_id", "text"), images)


@register(
    "chunk_body_entries",
    "select doc_id as paper_id, unnest(e) as entry, unnest(range(0, len(e)))::int as position from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: "
    + X.collapse(X.sub("l", r"^\s*(?:[-*+•]\s+|\d+[.)]\s+)", "", "")) + "), lambda l: l <> '') as e from documents)",
)
def body_entries(spark, sf):
    # every line becomes a bullet, so an all-bullet paragraph yields one entry per line
    body = F.concat(F.lit("- "), F.regexp_replace("text", "\n", "\n- "), F.lit("\n- end of list"))
    entries = F.filter(T.body_blocks(body), lambda e: (e != "end of list") & (e != "-"))
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("paper_id"), F.posexplode(entries).alias("position", "entry")
    )


# --- cleaning ------------------------------------------------------------------

RANKED = "ranked as (select *, ordinal as rank from passages)"


def _ranked(spark, sf):
    return V.passages(spark, sf).withColumn("rank", F.col("ordinal"))


HEADERS = f"""
opened as (select *, {X.header_prefix('text')} as opening, {X.collapse('text')} as flat from ranked),
openings as (
  select paper_id, opening, min(lower(substr(flat, 1, 401))) as low, max(lower(substr(flat, 1, 401))) as high, arg_min(len(flat), ordinal) as first_size
  from opened where len(opening) >= 20 group by 1, 2 having count(distinct page) >= 3),
measured as (
  select *, coalesce(list_position(list_transform(range(1, least(len(low), len(high)) + 1), lambda i: low[i] = high[i]), false) - 1, least(len(low), len(high))) as n from openings),
headed as (
  select paper_id, opening, case when n > 400 or (n < first_size and low[n] <> ' ')
      then regexp_replace(left(low, least(n, 400)), ' [^ ]*$', '') else left(low, least(n, 400)) end as header from measured),
stripped as (
  select o.* exclude (text), case when header is null then text else {X.strip("substr(flat, len(header) + 1)", r" \t\r\n,.;:\-—")} end as text,
    header is not null as hit
  from opened o left join (select * from headed where len(header) >= 20) using (paper_id, opening)),
unheaded as (select * from stripped where not hit or len(text) >= 5)"""


@register(
    "clean_running_headers",
    with_views("passages") + "," + RANKED + "," + HEADERS + " select chunk_id, text from unheaded",
)
def running_headers(spark, sf):
    return N.strip_running_headers(_ranked(spark, sf), ["paper_id"]).select("chunk_id", "text")


def _dedupe_sql(source: str) -> str:
    key = f"coalesce(nullif({X.dedupe_key('text')}, ''), '#' || chunk_id)"
    return f"select * from {source} qualify row_number() over (partition by paper_id, {key} order by rank, chunk_id) = 1"


@register(
    "clean_near_duplicates",
    with_views("passages") + "," + RANKED + f", d as ({_dedupe_sql('ranked')}) select chunk_id from d",
)
def near_duplicates(spark, sf):
    return N.dedupe_similar(_ranked(spark, sf), ["paper_id"]).select("chunk_id")


@register(
    "clean_low_prose_last",
    with_views("passages") + f" select chunk_id, {X.prose_score('text')} < 0.15 as low_prose from passages",
)
def low_prose(spark, sf):
    return N.demote_low_prose(_ranked(spark, sf)).select("chunk_id", "low_prose")


NARRATIVE = f"""
fronted as (select * exclude (text), {X.strip_title_block('text')} as text from unheaded),
kept as (select * from fronted where not {X.is_caption('text')} and not {X.is_boilerplate('text')}),
unique_rows as ({_dedupe_sql('kept')}),
cleaned as (select paper_id, chunk_id, rank, text, {X.prose_score('text')} < 0.15 as low_prose from unique_rows)"""


@register(
    "clean_narrative",
    with_views("passages") + "," + RANKED + "," + HEADERS + "," + NARRATIVE + f""",
  emptied as (select * from ranked where paper_id not in (select paper_id from cleaned)),
  fallback as ({_dedupe_sql('emptied')})
  select chunk_id, rank, text, low_prose from cleaned union all select chunk_id, rank, text, false from fallback""",
)
def narrative(spark, sf):
    return N.narrative_chunks(_ranked(spark, sf), ["paper_id"]).select("chunk_id", "rank", "text", "low_prose")


@register(
    "clean_noncontent",
    with_views("passages") + f""",
  marked as (select *, ({X.has('section_label', X.NONCONTENT)} or {X.has('text', K.MODEL_TOKEN)}) as off from passages)
  select chunk_id from marked where not off or paper_id not in (select paper_id from marked where not off)""",
)
def noncontent(spark, sf):
    return N.drop_noncontent(_ranked(spark, sf), ["paper_id"]).select("chunk_id")


SIMILAR = "len(list_intersect(p, b.w)) > 0 and len(list_intersect(p, b.w)) / len(list_distinct(p || b.w)) > 0.6"


@register(
    "clean_diversified",
    with_views("passages").replace("with", "with recursive", 1) + "," + RANKED + f""",
  bags as (select paper_id, chunk_id, text, {X.content_words('text')} as w, row_number() over (partition by paper_id order by rank, chunk_id) as place from ranked),
  scan(paper_id, place, picked, places) as (
    select distinct paper_id, 0::bigint, []::varchar[][], []::bigint[] from bags
    union all
    select s.paper_id, b.place,
      case when len(list_filter(s.picked, lambda p: {SIMILAR})) = 0 then list_append(s.picked, b.w) else s.picked end,
      case when len(list_filter(s.picked, lambda p: {SIMILAR})) = 0 then list_append(s.places, b.place) else s.places end
    from scan s join bags b on b.paper_id = s.paper_id and b.place = s.place + 1 where len(s.places) < 6),
  ended as (select paper_id, places from scan qualify row_number() over (partition by paper_id order by place desc) = 1)
  select paper_id, (row_number() over (partition by paper_id order by not list_contains(places, place), place) - 1)::int as position, chunk_id, text
  from bags join ended using (paper_id) qualify position < 6""",
)
def diversified(spark, sf):
    return N.diversify(_ranked(spark, sf), ["paper_id"], limit=6, order=["rank", "chunk_id"])


@register(
    "clean_jaccard_neighbours",
    with_views("passages") + f""",
  bags as (select paper_id, ordinal, chunk_id, {X.content_words('text')} as w from passages)
  select a.chunk_id, round(case when len(a.w) = 0 or len(b.w) = 0 then 0.0 else len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) end, 9) as jaccard
  from bags a join bags b on a.paper_id = b.paper_id and b.ordinal = a.ordinal + 1""",
)
def jaccard_neighbours(spark, sf):
    bags = V.passages(spark, sf).select("paper_id", "ordinal", "chunk_id", Q.content_words(F.col("text")).alias("w"))
    following = bags.select("paper_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("w").alias("w2"))
    return bags.join(following, ["paper_id", "ordinal"]).select("chunk_id", F.round(Q.jaccard(F.col("w"), F.col("w2")), 9).alias("jaccard"))


# --- page blocks ----------------------------------------------------------------

BLOCKS = f"""
marked as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, {X.q(R.FURNITURE)}, ' ', 'g'), {X.q(R.BLOCK_OPEN)}, chr(1) || '\\1' || chr(2), 'g'),
  {X.q(R.BLOCK_CLOSE)}, chr(1) || 'x' || chr(2), 'g') as m from pages),
pieces as (select page_id, u.i, string_split(m, chr(1))[u.i] as piece from marked, range(1, len(string_split(m, chr(1))) + 1) u(i)),
cut as (select page_id, i, lower(regexp_extract(piece, '^([A-Za-z0-9]+)' || chr(2), 1)) as tag,
  regexp_replace(regexp_extract(piece, '(?s)' || chr(2) || '(.*)$', 1), '<[^>]+>', ' ', 'g') as t from pieces),
plain as (select page_id, i, tag, {X.collapse("replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '" + chr(34) + "'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')")} as text from cut),
blocks as (select page_id, (row_number() over (partition by page_id order by i) - 1)::int as ordinal, tag, text from plain
  where regexp_matches(tag, '^(h[1-6]|p)$') and text <> '')"""


@register("pages_html_blocks", "with " + BLOCKS + " select * from blocks")
def html_blocks(spark, sf):
    return R.html_blocks(V.table(spark, sf, "pages"))


HEADING = f"(len({X.strip('text')}) <= 100 and {X.strip('text')} <> '' and (tag like 'h%' or {X.has(X.strip('text'), K.NUMBERED_HEADING)} or list_contains({X.lst(K.HEADING_KEYWORDS)}, lower({X.rstrip(X.strip('text'), ':.')}))))"


@register(
    "pages_section_labels",
    "with " + BLOCKS + f""",
  labelled as (select *, {HEADING} as heading from blocks),
  carried as (select *, coalesce(last_value(case when heading then {X.rstrip('text', ':.')} end ignore nulls)
     over (partition by page_id order by ordinal rows between unbounded preceding and current row), 'Document') as section_label from labelled)
  select page_id, ordinal, section_label, text, greatest(1, len(text) // 4)::int as token_count from carried where not heading""",
)
def section_labels(spark, sf):
    blocks = R.html_blocks(V.table(spark, sf, "pages"))
    heading = R.looks_like_heading(F.col("text"), F.col("tag").startswith("h"))
    out = R.sectioned_blocks(blocks, ["page_id"], heading)
    return out.select("page_id", "ordinal", "section_label", "text", "token_count")


# --- grading ------------------------------------------------------------------

_turns = "with turns as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as reply from conversations)"


def _turn_pairs(spark, sf):
    turns = V.table(spark, sf, "conversations")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(replies, ["conv_id", "turn"], "left")


@register(
    "grade_normalized_text",
    f"select conv_id, turn, {X.normalize_text('text')} as normal, {X.punctuation_free('text')} as bare, array_to_string({X.content_tokens('text')}, ' ') as tokens from conversations",
)
def normalized_text(spark, sf):
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", G.normalize_text(F.col("text")).alias("normal"), G.punctuation_free(F.col("text")).alias("bare"),
        F.array_join(G.content_tokens(F.col("text")), " ").alias("tokens"),
    )


@register(
    "grade_token_overlap",
    _turns + f" select conv_id, turn, round({X.token_overlap('text', 'coalesce(reply, ' + X.q('') + ')')}, 9) as overlap from turns",
)
def token_overlap(spark, sf):
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(G.token_overlap(F.col("text"), F.col("reply")), 9).alias("overlap"))


EVENT_ANSWER = "case event_id % 6 when 0 then 'n/a' when 1 then 'I don''t know!' when 2 then '  IDK ' when 3 then event_type when 4 then '?' else concat('the ', event_type, ' rate') end"


@register(
    "grade_non_answer",
    f"select event_id, list_contains({X.lst(K.NON_ANSWER_KEYS)}, {X.punctuation_free('a')}) as skipped from (select event_id, {EVENT_ANSWER} as a from events)",
)
def non_answer(spark, sf):
    answer = EVENT_ANSWER.replace("'I don''t know!'", '"I don\'t know!"')
    rows = V.table(spark, sf, "events").select("event_id", F.expr(answer).alias("a"))
    return rows.select("event_id", G.is_non_answer(F.col("a")).alias("skipped"))


@register(
    "grade_choice",
    "select l_orderkey, l_linenumber, l_partkey, (l_linestatus <> 'O' and lower(trim(l_returnflag)) = lower(l_linestatus)) as is_correct from"
    " (select l_orderkey, l_linenumber, l_partkey, l_linestatus, case when l_linestatus = 'F' and l_quantity < 25 then ' f ' else l_returnflag end as l_returnflag from lineitem)",
)
def choice(spark, sf):
    picked = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 25), " f ").otherwise(F.col("l_returnflag"))
    correct = F.when(F.col("l_linestatus") != "O", F.col("l_linestatus"))
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.grade_choice(picked, correct).alias("is_correct"))


@register(
    "grade_short_answers",
    f"""with asked as (select event_id, {EVENT_ANSWER} as a, concat('The ', event_type, ' rate') as acc1, event_type as acc2 from events),
  keyed as (select *, {X.punctuation_free('a')} as k, {X.punctuation_free('acc1')} as k1, {X.punctuation_free('acc2')} as k2,
     {X.token_overlap('acc1', 'a')} as o1, {X.token_overlap('acc2', 'a')} as o2 from asked)
  select event_id,
    case when list_contains({X.lst(K.NON_ANSWER_KEYS)}, k) then false when k = k1 or k = k2 then true else greatest(o1, o2) >= 0.6 end as is_correct,
    case when list_contains({X.lst(K.NON_ANSWER_KEYS)}, k) then null when k = k1 then acc1 when k = k2 then acc2 when greatest(o1, o2) = 0 then null
      when o1 >= o2 then acc1 else acc2 end as matched_answer,
    round(case when list_contains({X.lst(K.NON_ANSWER_KEYS)}, k) then 0 when k = k1 or k = k2 then 1 else greatest(o1, o2) end, 9) as overlap
  from keyed""",
)
def short_answers(spark, sf):
    answer = EVENT_ANSWER.replace("'I don''t know!'", '"I don\'t know!"')
    rows = V.table(spark, sf, "events").select(
        "event_id", F.expr(answer).alias("a"), F.array(F.concat(F.lit("The "), "event_type", F.lit(" rate")), "event_type").alias("accepted")
    )
    verdict = G.grade_short_answer(F.col("a"), F.col("accepted"))
    return rows.select("event_id", verdict.alias("v")).select(
        "event_id", "v.is_correct", "v.matched_answer", F.round("v.overlap", 9).alias("overlap")
    )


@register(
    "grade_answer_sheet",
    f"""with asked as (select event_id, {EVENT_ANSWER} as a, event_type, event_id % 2 = 0 as written from events),
  keyed as (select *, {X.punctuation_free('a')} as k, {X.token_overlap('event_type', 'a')} as o from asked)
  select event_id, case when written then not list_contains({X.lst(K.NON_ANSWER_KEYS)}, k) and (k = event_type or o >= 0.6) else event_id % 3 = 1 end as is_correct,
    case when written then event_type else 'Option B' end as expected,
    case when written then 'Because. Expected answer: **' || event_type || '**.' else 'Because.' end as feedback
  from keyed""",
)
def answer_sheet(spark, sf):
    answer = EVENT_ANSWER.replace("'I don''t know!'", '"I don\'t know!"')
    rows = V.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, "short_answer").otherwise("multiple_choice").alias("kind"),
        F.expr(answer).alias("answer_text"),
        F.expr("case event_id % 3 when 0 then 'a' when 1 then ' B' end").alias("selected_option_id"),
        F.lit("b").alias("correct_option_id"),
        F.col("event_type").alias("correct_answer_text"),
        F.array("event_type").alias("accepted_answers"),
        F.expr("array(named_struct('id', 'a', 'text', 'Option A'), named_struct('id', 'b', 'text', 'Option B'))").alias("options"),
        F.lit("Because.").alias("explanation"),
    )
    return Z.grade_answers(rows).select("event_id", "is_correct", "expected", "feedback")


@register(
    "grade_origin_default",
    with_views("cards") + " select card_id, case when lower(origin) in ('glossary', 'fact', 'household') and lower(origin) <> 'household' then lower(origin) else 'fact' end as origin from cards",
)
def origin_default(spark, sf):
    return V.cards(spark, sf).select("card_id", T.enum_or(F.lower("origin"), K.CARD_ORIGINS, "fact").alias("origin"))


@register(
    "ids_article",
    """with raw as (select page_id, case page_id % 4 when 0 then concat('arXiv:', 2400 + page_id % 12, '.', lpad((page_id % 100000)::varchar, 5, '0'), 'v2')
     when 1 then concat('cs.CL/', lpad((page_id % 10000000)::varchar, 7, '0')) when 2 then concat(' ', 2400 + page_id % 12, '.', lpad((page_id % 10000)::varchar, 4, '0'))
     else concat('nonsense ', page_id) end as raw from pages)
  select page_id, case page_id % 4 when 0 then concat(2400 + page_id % 12, '-', lpad((page_id % 100000)::varchar, 5, '0'))
     when 1 then concat('cs-cl-', lpad((page_id % 10000000)::varchar, 7, '0')) when 2 then concat(2400 + page_id % 12, '-', lpad((page_id % 10000)::varchar, 4, '0')) end as paper_id from raw""",
)
def article_ids(spark, sf):
    raw = F.expr(
        "case page_id % 4 when 0 then concat('arXiv:', 2400 + page_id % 12, '.', lpad(cast(page_id % 100000 as string), 5, '0'), 'v2')"
        " when 1 then concat('cs.CL/', lpad(cast(page_id % 10000000 as string), 7, '0'))"
        " when 2 then concat(' ', 2400 + page_id % 12, '.', lpad(cast(page_id % 10000 as string), 4, '0')) else concat('nonsense ', page_id) end"
    )
    return V.table(spark, sf, "pages").select("page_id", T.paper_id_of(raw).alias("paper_id"))


@register(
    "ids_upload",
    "select distinct concat('upload-', left(sha256(text), 24)) as paper_id from documents",
)
def upload_ids(spark, sf):
    return V.table(spark, sf, "documents").select(R.upload_id(F.col("text").cast("binary")).alias("paper_id")).distinct()


@register(
    "upload_titles",
    f"""select doc_id, case when doc_id % 5 = 0 then 'Given' when doc_id % 5 = 1 then 'From metadata'
      when doc_id % 5 = 2 and {X.strip('text')} <> '' then left({X.strip("list_filter(string_split(text, chr(10)), lambda l: " + X.strip('l') + " <> '')[1]")}, 300)
      when doc_id % 5 = 4 then 'Untitled upload' else concat('file', doc_id) end as title from documents""",
)
def upload_titles(spark, sf):
    rest = F.col("doc_id") % 5
    return V.table(spark, sf, "documents").select(
        "doc_id",
        R.derive_title(
            F.when(rest == 0, " Given "), F.when(rest == 1, "From metadata"), F.when(rest == 2, F.col("text")),
            F.when(rest != 4, F.concat(F.lit("dir/file"), "doc_id", F.lit(".pdf"))),
        ).alias("title"),
    )


@register(
    "upload_verdicts",
    """select doc_id, case when doc_id % 4 = 3 then 'not_a_pdf' when doc_id % 4 = 2 and n_chars > 400 then 'too_large' when doc_id % 4 = 1 and n_chars < 200 then 'empty' end as reason from documents""",
)
def upload_verdicts(spark, sf):
    rest = F.col("doc_id") % 4
    name = F.when(rest == 3, "a.txt").when(rest == 0, "A.PDF").otherwise("blob")
    mime = F.when((rest == 1) | (rest == 2), "application/pdf")
    size = F.when((rest == 2) & (F.col("n_chars") > 400), F.lit(1 << 40)).when((rest == 1) & (F.col("n_chars") < 200), F.lit(0)).otherwise(F.col("n_chars"))
    return V.table(spark, sf, "documents").select("doc_id", R.upload_verdict(name, mime, size).alias("reason"))
