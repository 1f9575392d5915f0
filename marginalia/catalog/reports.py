"""Report queries: media, links, citations, statistics, drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import mining as T
from ..operators import report as P
from ..plans import chat as CH
from ..plans import report as RP
from ..sources import views as V
from ..sources.views import with_views
from . import sqltext as X
from .library import ALL_TIERS, _chapters
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

# --- views: a page of a document is a report, each of its lines a section --------

NAMES_SQL = X.lst(K.SECTION_ORDER)
SECTIONS = (
    f"sections as (select paper_id * 100000 + page as report_id, {NAMES_SQL}[ordinal % 11 + 1] as name, (ordinal % 11 + 1)::int as section_no, text as body,"
    " case when ordinal % 2 = 0 then section_label || ' is seen in Table ' || (ordinal + 1) || ' and 3.' end as deep_dive,"
    " case when ordinal % 5 = 0 then 'CUSTOM' end as badge, chunk_id, paper_id, page, ordinal, modality from passages)"
)
MEDIA = (
    "media as (select paper_id * 100000 + page as report_id, chunk_id as media_id, case when ordinal % 2 = 0 then 'figure' else 'table' end as kind,"
    " case ordinal % 4 when 0 then concat('Figure ', ordinal + 1) when 1 then concat('Table ', ordinal + 1) when 2 then concat('Figure (p', page, ')') else 'Table 3' end as label,"
    " ordinal as position, text as caption, page, chunk_id from passages)"
)


def _sections(spark, sf):
    names = F.array(*[F.lit(s) for s in K.SECTION_ORDER])
    return V.passages(spark, sf).select(
        F.expr("paper_id * 100000 + page").alias("report_id"),
        F.element_at(names, (F.col("ordinal") % 11 + 1).cast("int")).alias("name"),
        F.expr("cast(ordinal % 11 + 1 as int)").alias("section_no"),
        F.col("text").alias("body"),
        F.expr("case when ordinal % 2 = 0 then section_label || ' is seen in Table ' || (ordinal + 1) || ' and 3.' end").alias("deep_dive"),
        F.expr("case when ordinal % 5 = 0 then 'CUSTOM' end").alias("badge"),
        "chunk_id", "paper_id", "page", "ordinal", "modality",
    )


def _media(spark, sf):
    return V.passages(spark, sf).selectExpr(
        "paper_id * 100000 + page as report_id", "chunk_id as media_id", "case when ordinal % 2 = 0 then 'figure' else 'table' end as kind",
        "case ordinal % 4 when 0 then concat('Figure ', ordinal + 1) when 1 then concat('Table ', ordinal + 1) when 2 then concat('Figure (p', page, ')') else 'Table 3' end as label",
        "ordinal as position", "text as caption", "page", "chunk_id",
    )


VISUAL = (
    "visual as (select paper_id, page, ordinal, chunk_id, text, case (paper_id + ordinal) % 5 when 0 then 'image' when 1 then 'vision' when 2 then 'ocr' when 3 then 'image' else 'text' end as modality,"
    " case when ordinal % 3 = 0 then null else concat('p', page, '-', (ordinal + paper_id) % 2, '.png') end as image_path,"
    " case when ordinal % 4 = 1 then concat('Table ', ordinal) when ordinal % 4 = 2 then concat('Fig ', ordinal) end as figure_label,"
    " case when ordinal % 5 = 2 then concat('Caption ', ordinal) end as caption from passages)"
)


def _visual(spark, sf):
    body = VISUAL[VISUAL.index("select ") + 7 : VISUAL.index(" from passages")]
    from .library import _split

    return V.passages(spark, sf).selectExpr(*[c.strip() for c in _split(body)])


def _attach(prefix: str, source: str, modality: str, columns: str) -> str:
    picked = ", ".join(f"coalesce(b.{c}, l.{c}) as {prefix}_{c}" for c in ("chunk_id", *columns.split()))
    return f"""
{prefix}_path as (select * from visual where modality = '{modality}' and image_path is not null qualify row_number() over (partition by paper_id, image_path order by ordinal desc, chunk_id desc) = 1),
{prefix}_loose as (select *, row_number() over (partition by paper_id, page order by ordinal, chunk_id) as turn from visual where modality = '{modality}' and image_path is null),
{prefix}_turn as (select i.*, b.chunk_id as hit, case when b.chunk_id is null then row_number() over (partition by i.paper_id, i.page, b.chunk_id is null order by i.ordinal, i.chunk_id) end as turn
   from {source} i left join {prefix}_path b using (paper_id, image_path)),
{prefix}_done as (select i.* exclude (hit, turn), {picked} from {prefix}_turn i left join {prefix}_path b using (paper_id, image_path)
   left join {prefix}_loose l on l.paper_id = i.paper_id and l.page = i.page and l.turn = i.turn)"""


@register(
    "media_assembly",
    with_views("passages") + "," + VISUAL + ", images as (select paper_id, page, ordinal, chunk_id, image_path, figure_label, caption from visual where modality = 'image'),"
    + _attach("v", "images", "vision", "text caption figure_label") + "," + _attach("o", "v_done", "ocr", "text") + f""",
  base as (select *, coalesce(figure_label, v_figure_label, concat('Figure (p', page, ')')) as l from o_done),
  main as (select paper_id, 0 as tier, page, ordinal, l as label, coalesce(caption, nullif({X.strip("coalesce(v_text, '')")}, ''), v_caption,
     case when o_chunk_id is not null then {X.shorten("coalesce(o_text, '')", 220, 0.4)} end, '') as caption,
     case when v_chunk_id is null and o_chunk_id is not null then 'ocr' else 'vision' end as provenance, image_path, coalesce(v_chunk_id, o_chunk_id, chunk_id) as chunk_id from base),
  rest as (select paper_id, case modality when 'vision' then 1 else 2 end as tier, page, ordinal,
     case when modality = 'ocr' then concat('Table (p', page, ')') else coalesce(figure_label, concat('Figure (p', page, ')')) end as label,
     case when modality = 'vision' and caption is not null then caption else {X.shorten('text', 220, 0.4)} end as caption, modality as provenance, image_path, chunk_id from visual
     where (modality = 'vision' and chunk_id not in (select v_chunk_id from base where v_chunk_id is not null)) or (modality = 'ocr' and chunk_id not in (select o_chunk_id from base where o_chunk_id is not null)))
  select chunk_id, tier, ordinal, label, case when contains(lower(label), 'table') then 'table' else 'figure' end as kind, caption, provenance, image_path as filename from (from main union all from rest)""",
)
def media_assembly(spark, sf):
    return P.build_media(_visual(spark, sf)).select("chunk_id", "tier", "ordinal", "label", "kind", "caption", "provenance", "filename")


MENTION_SQL = X.LEFT + r"((?:Fig(?:ure)?s?\.?|Tables?\.?)\s*\.?\s*\d+(?:\s*(?:,|and|&|-|–|—|to)\s*\d+)*)"


@register(
    "media_figure_links",
    with_views("passages") + "," + SECTIONS + "," + MEDIA + f""",
  numbered as (select *, list_filter(list_transform(regexp_extract_all(label, '[A-Za-z]?\\d+'), lambda n: case when regexp_matches(n, '^[A-Za-z]') then n[3:] else n end), lambda n: n <> '')[-1]::int as number from media),
  idx as (select * from numbered where number is not null qualify row_number() over (partition by report_id, kind, number order by position) = 1),
  hits as (select report_id, name, regexp_extract_all(concat_ws(chr(10), nullif(body, ''), nullif(deep_dive, '')), {X.q('(?i)' + MENTION_SQL)}, 1) as hs from sections where name <> 'Figures'),
  flat as (select report_id, name, flatten(list_transform(hs, lambda h: list_transform(regexp_extract_all(h, '\\d+'),
     lambda n: {{'kind': case when lower(h) like 'table%' then 'table' else 'figure' end, 'number': n::int}}))) as ms from hits),
  named as (select report_id, name, unnest(ms) as m, unnest(range(0, len(ms))) as pos from flat),
  found as (select n.report_id, n.name, media_id, min(pos) as pos from named n join idx on idx.report_id = n.report_id and idx.kind = m.kind and idx.number = m.number
     where (n.report_id, n.name, media_id) not in (select report_id, name, chunk_id from sections where badge is not null) group by 1, 2, 3)
  select report_id, name, media_id, row_number() over (partition by report_id, name order by pos)::int as rank from found qualify rank <= 3""",
)
def figure_links(spark, sf):
    sections = _sections(spark, sf)
    attached = sections.filter("badge is not null").select("report_id", "name", F.col("chunk_id").alias("media_id"))
    return P.link_figures(sections, _media(spark, sf), attached)


CITED_TEXT = "case when ordinal % 3 = 0 then text else concat(text, ' See [', ordinal % 6 + 1, '] and [', ordinal % 2, '].') end"


@register(
    "cite_positional",
    with_views("passages") + f""",
  texts as (select paper_id * 100000 + page as report_id, ordinal as k, {CITED_TEXT} as text from passages),
  chunks as (select paper_id * 100000 + page as report_id, row_number() over (partition by paper_id, page order by ordinal)::int as position, chunk_id, paper_id, page,
    case when ordinal % 4 > 0 then section_label end as section_label, case when ordinal % 4 > 0 then concat('p. ', page, ' top') end as page_label,
    case when ordinal % 3 > 0 then concat_ws(',', ordinal % 50, 7, ordinal % 50 + 90, 40) end as bbox, text from passages),
  sizes as (select report_id, max(position) as n from chunks group by 1),
  marked as (select t.report_id, k, n, list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x::int)) as ms from texts t join sizes using (report_id)),
  spread as (select report_id, k, n, unnest(case when len(ms) > 0 then ms else range(1, least(n, 5) + 1)::int[] end) as marker from marked)
  select s.report_id, k, marker, chunk_id, page, coalesce(section_label, concat('Page ', page)) as source,
    coalesce(page_label, concat('page ', page)) as page_label, bbox, concat(paper_id, '/pages/p', page, '.png') as page_image_path,
    coalesce(nullif({X.shorten('text', 280, 0.4)}, ''), '(no text available for this source)') as snippet
  from spread s join chunks c on c.report_id = s.report_id and c.position = (marker - 1) % n + 1 where marker >= 1""",
)
def cite_positional(spark, sf):
    from pyspark.sql import Window as W

    rows = V.passages(spark, sf).withColumn("report_id", F.expr("paper_id * 100000 + page"))
    texts = rows.select("report_id", F.col("ordinal").alias("k"), F.expr(CITED_TEXT).alias("text"))
    position = F.row_number().over(W.partitionBy("paper_id", "page").orderBy("ordinal"))
    chunks = rows.select(
        "report_id", position.alias("position"), "chunk_id", "paper_id", "page", "text", F.expr("if(ordinal % 4 > 0, section_label, null)").alias("section_label"),
        F.expr("if(ordinal % 4 > 0, concat('p. ', page, ' top'), null)").alias("page_label"),
        F.expr("if(ordinal % 3 > 0, array(ordinal % 50, 7, ordinal % 50 + 90, 40), null)").cast("array<double>").alias("bbox"),
    )
    # every text of a page cites that page's chunks
    per_text = texts.select("report_id", "k").join(chunks, "report_id")
    out = P.cite(texts, per_text, ["report_id", "k"])
    return out.withColumn("bbox", F.array_join(F.col("bbox").cast("array<int>"), ","))


@register(
    "cite_best_match",
    with_views("passages") + f""",
  l as (select paper_id, page, ordinal as line_no, concat(text, case when ordinal % 5 = 0 then concat(' [', ordinal % 4 + 1, ']') else '' end) as text from passages),
  c as (select paper_id, page, row_number() over (partition by paper_id, page order by ordinal)::int as position, text as snippet, chunk_id from passages),
  w as (select *, try_cast(regexp_extract(text, '\\[(\\d{{1,3}})\\]', 1) as int) as mk, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as ws from l),
  s as (select w.paper_id, w.page, line_no, position, chunk_id, case when mk = position then 2.0 when len(ws) = 0 then 0.0
     else len(list_intersect(ws, list_distinct(regexp_extract_all(lower(snippet), '[a-z]+')))) / len(ws) end as score from w join c using (paper_id, page))
  select paper_id, line_no, chunk_id, round(score, 9) as score from s where score >= 0.4 qualify row_number() over (partition by paper_id, page, line_no order by score desc, position) = 1""",
)
def best_match(spark, sf):
    from pyspark.sql import Window as W

    rows = V.passages(spark, sf)
    lines = rows.select(
        "paper_id", F.col("page").alias("name"), F.col("ordinal").alias("line_no"),
        F.expr("concat(text, case when ordinal % 5 = 0 then concat(' [', ordinal % 4 + 1, ']') else '' end)").alias("text"),
    )
    position = F.row_number().over(W.partitionBy("paper_id", "page").orderBy("ordinal"))
    cited = rows.select(
        "paper_id", F.col("page").alias("name"), position.alias("position"), position.alias("marker"), F.col("text").alias("snippet"), "page", "chunk_id"
    )
    out = P.match_citations(lines, cited, ["paper_id", "name"])
    return out.select("paper_id", "line_no", "chunk_id", F.round("score", 9).alias("score"))


LOOKUP = f"""
figs as (select report_id, 1 as section_no, 0 as k, position, case when position % 3 = 0 then chunk_id else 'x' || chunk_id end as chunk_id, kind, label, page from media),
refs as (select report_id, section_no, 1 as k, ordinal as position, chunk_id, 'page' as kind, concat('page ', page) as label, page from sections),
both_kinds as (from figs union all from refs)"""


@register(
    "media_lookup",
    with_views("passages") + "," + SECTIONS + "," + MEDIA + "," + LOOKUP + """
  select chunk_id, report_id, kind, label, page from both_kinds where chunk_id in (select chunk_id from passages)
  qualify row_number() over (partition by chunk_id order by coalesce(string_split(chunk_id, '::')[1] <> report_id::varchar, true)::int, report_id, section_no, k, position) = 1""",
)
def media_lookup(spark, sf):
    media = _media(spark, sf).select(
        "report_id", F.lit(1).alias("section_no"), "position", F.expr("case when position % 3 = 0 then chunk_id else 'x' || chunk_id end").alias("chunk_id"),
        "kind", "label", "caption", "page", F.lit(None).cast("string").alias("image_path"),
    )
    cited = _sections(spark, sf).select(
        "report_id", "section_no", F.col("ordinal").alias("position"), "chunk_id", F.concat(F.lit("page "), "page").alias("page_label"), "page",
        F.lit("p.png").alias("page_image_path"),
    )
    wanted = V.passages(spark, sf).select("chunk_id")
    return P.find_media(wanted, media, cited).select("chunk_id", "report_id", "kind", "label", "page")


@register(
    "cite_resolve",
    with_views("passages") + " select concat('cit-', chunk_id) as citation_id, chunk_id, page from passages where concat('cit-', chunk_id) in (select concat('cit-', doc_id, '::c00002') from documents)",
)
def cite_resolve(spark, sf):
    wanted = V.table(spark, sf, "documents").select(F.expr("concat('cit-', doc_id, '::c00002')").alias("citation_id"))
    cited = V.passages(spark, sf).select(F.expr("concat('cit-', chunk_id)").alias("citation_id"), "chunk_id", "page")
    return P.resolve_citations(wanted, cited)


# --- statistics -------------------------------------------------------------------


@register(
    "report_stats",
    with_views("passages") + "," + SECTIONS + "," + MEDIA + """,
  s as (select report_id, sum(len(regexp_extract_all(body, '\\S+')) + len(regexp_extract_all(coalesce(deep_dive, ''), '\\S+'))) as words, bool_or(name = 'Figures') as has_figures from sections group by 1),
  m as (select report_id, count(*) as media, count(*) filter (where position % 11 = 6) as figures_media from media where kind = 'figure' group by 1),
  c as (select report_id, count(*) as n from sections where body like '%[%' group by 1),
  p as (select distinct report_id, page as page_count, case when paper_id % 2 = 0 then (paper_id % 9)::int end as figure_count from sections)
  select report_id, page_count as pages, case when has_figures then coalesce(figures_media, 0) when coalesce(media, 0) > 0 then media else coalesce(figure_count, 0) end as figures,
    coalesce(n, 0) as citations_extracted, ceil(words / 200)::bigint as reading_time_min from s left join m using (report_id) left join c using (report_id) left join p using (report_id)""",
)
def report_stats(spark, sf):
    sections = _sections(spark, sf)
    media = _media(spark, sf).filter("kind = 'figure'").withColumn("name", F.expr("case when position % 11 = 6 then 'Figures' else 'Methods' end"))
    papers = sections.selectExpr("report_id", "page as page_count", "case when paper_id % 2 = 0 then cast(paper_id % 9 as int) end as figure_count").distinct()
    return P.report_stats(sections, media, sections.filter(F.contains("body", F.lit("["))), papers)


@register(
    "report_section_confidence",
    with_views("passages") + """,
  b as (select paper_id, section_label as section, 0.55 + 0.05 * least(count(*), 6) + 0.1 * count(*) filter (where modality = 'text') / count(*) - 0.05 * count(*) filter (where modality = 'ocr') / count(*) as base,
    avg(case when modality = 'ocr' then (ordinal % 100) / 100 end) as ocr from passages group by 1, 2)
  select s.paper_id, s.section, case when base is null then 0.2 else round(greatest(0.1, least(case when ocr is null then base else 0.6 * base + 0.4 * ocr end, 0.97)), 2)::double end as confidence
  from (select doc_id as paper_id, unnest(['Introduction', 'Methods', 'Results', 'Discussion', 'References']) as section from documents) s left join b using (paper_id, section)""",
)
def confidence(spark, sf):
    names = F.array(*[F.lit(n) for n in ("Introduction", "Methods", "Results", "Discussion", "References")])
    sections = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(names).alias("section"))
    rows = V.passages(spark, sf).withColumnRenamed("section_label", "section").withColumn(
        "ocr_confidence", F.expr("case when modality = 'ocr' then (ordinal % 100) / 100 end")
    )
    return P.section_confidence(sections, rows, ["paper_id", "section"])


@register(
    "report_degraded_tally",
    with_views("passages") + """
  select paper_id as report_id, sum((modality = 'ocr')::int)::bigint as degraded_sections, count(*) as sections from passages group by 1""",
)
def degraded_tally(spark, sf):
    rows = V.passages(spark, sf).select(F.col("paper_id").alias("report_id"), (F.col("modality") == "ocr").alias("degraded"))
    return P.degraded_tally(rows)


@register(
    "report_provenance",
    with_views("passages") + """,
  seen as (select paper_id, modality as provenance, min(ordinal) as pos from passages group by 1, 2)
  select paper_id, string_agg(provenance, ',' order by pos, provenance) as provenance from seen group by 1""",
)
def provenance(spark, sf):
    rows = V.passages(spark, sf).withColumn("provenance", F.col("modality"))
    return P.provenance_lists(rows, ["paper_id"], "ordinal").withColumn("provenance", F.array_join("provenance", ","))


@register(
    "report_normalized_sections",
    with_views("passages") + "," + SECTIONS + f""",
  grid as (select report_id, i::int as position, {NAMES_SQL}[i + 1] as name from (select distinct report_id from sections), range(0, 11) r(i))
  select g.report_id, g.position, g.name, coalesce(body, '') as body, coalesce(badge, {X.lst([b or '' for b in K.SECTION_BADGES.values()])}[g.position + 1]) as badge,
    {X.lst(list(K.SECTION_QUESTIONS.values()))}[g.position + 1] as question, list_contains({X.lst(K.DEFAULT_OPEN_SECTIONS)}, g.name) as default_open
  from grid g left join sections s using (report_id, name)""",
)
def normalized(spark, sf):
    out = P.normalize_sections(_sections(spark, sf).select("report_id", "name", "body", "badge"))
    return out.select("report_id", "position", "name", "body", F.coalesce("badge", F.lit("")).alias("badge"), "question", "default_open")


@register(
    "report_load_stored_sections",
    """select doc_id as report_id, 0 as stored_at, 'Overview' as name, text as body from documents where lang <> 'fr' union all
       select doc_id, 2, 'Methods', null from documents where lang <> 'fr'""",
)
def stored_sections(spark, sf):
    stored = F.when(F.col("lang") == "fr", F.lit("{not json")).otherwise(
        F.to_json(
            F.array(
                F.struct(F.lit("Overview").alias("name"), F.col("text").alias("body_markdown")),
                F.struct(F.lit("Glossary").alias("name"), F.lit("old").alias("body_markdown")),
                F.struct(F.lit("Methods").alias("name"), F.lit(None).cast("string").alias("body_markdown")),
            )
        )
    )
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), stored.alias("sections"))
    return P.load_sections(rows).select("report_id", "stored_at", "name", F.col("body_markdown").alias("body"))


@register(
    "report_chunk_round_trip",
    with_views("passages") + """ select chunk_id, page, case when ordinal % 3 <> 0 then page::double end as x0, case when ordinal % 4 <> 0 then section_label end as label
  from passages where ordinal % 17 <> 4""",
)
def round_trip(spark, sf):
    rows = V.passages(spark, sf).select(
        "chunk_id", "paper_id", "ordinal", "page", "text", F.expr("case when ordinal % 17 = 4 then 'audio' else modality end").alias("modality"),
        F.expr("named_struct('x0', cast(page as double), 'y0', 1d, 'x1', 2d, 'y1', if(ordinal % 3 = 0, null, 3d))").alias("bbox"),
        F.expr("named_struct('section_label', section_label, 'page_label', if(ordinal % 4 = 0, null, 'p'), 'page', page)").alias("source_ref"),
    )
    out = P.rebuild_chunk(P.flatten_chunk(rows))
    return out.select("chunk_id", "page", "bbox.x0", F.col("source_ref.section_label").alias("label"))


@register(
    "report_markdown",
    with_views("passages") + "," + SECTIONS + f""",
  blocks as (select report_id, section_no, concat('## ', name, case when badge is not null then concat(' — ', badge) else '' end, chr(10),
      case when {X.strip('body')} <> '' or body <> '' then concat(chr(10), {X.strip('body')}, chr(10)) else '' end,
      case when deep_dive is not null then concat(chr(10), '### Deep dive', chr(10), deep_dive, chr(10)) else '' end,
      case when deep_dive is not null then concat(chr(10), '![Cap ', ordinal, '](p.png)', chr(10), '*Fig ', ordinal, ': Cap ', ordinal, '*', chr(10)) else '' end,
      case when deep_dive is null then concat(chr(10), '**Citations:**', chr(10), '[1] S (page ', page, '): "', ordinal, '"', chr(10)) else '' end) as b from sections)
  select report_id, concat({X.strip("concat('# Report ', report_id, chr(10), '*A, B*', chr(10), 'L · x', chr(10), chr(10), '**3 pages** · **4 figures** · **5 citations** · **6 min read**', chr(10), chr(10), string_agg(b, chr(10) order by section_no))")}, chr(10)) as markdown
  from blocks group by report_id""",
)
def markdown(spark, sf):
    sections = _sections(spark, sf)
    headers = sections.select("report_id").distinct().selectExpr(
        "report_id", "concat('Report ', report_id) as title", "array('A', 'B') as authors", "'L' as label", "array('x') as categories",
        "cast(null as date) as published", "3 as pages", "4 as figures", "5 as citations_extracted", "6 as reading_time_min",
    )
    media = sections.filter("deep_dive is not null").selectExpr(
        "report_id", "name", "0 as position", "concat('Cap ', ordinal) as caption", "concat('Fig ', ordinal) as label", "'p.png' as image_path"
    )
    cited = sections.filter("deep_dive is null").selectExpr(
        "report_id", "name", "1 as marker", "'S' as source", "concat('page ', page) as page_label", "cast(ordinal as string) as snippet"
    )
    return P.report_markdown(headers, sections, media, cited)


@register(
    "report_audit",
    with_views("passages") + "," + SECTIONS + f""",
  asked as (select *, case when ordinal % 6 <> 1 then {X.lst(list(K.SECTION_QUESTIONS.values()))}[section_no] end as question,
     case when ordinal % 9 = 2 then concat(body, chr(10), body) when ordinal % 9 = 5 then concat(body, ' HARD LENGTH LIMIT') else body end as b2 from sections),
  lined as (select *, list_filter(list_transform(string_split(b2, chr(10)), lambda l: {X.strip('l')}), lambda l: l <> '') as ls from asked),
  defects as (
    select report_id, name, 'captions_only' as defect from lined where name <> 'Figures' and len(ls) > 0 and len(list_filter(ls, lambda l: not regexp_matches(l, '(?i)^\\s*(fig(ure)?|table)\\s*\\.?\\s*\\d+\\s*[:.\\-—)]'))) = 0 union all
    select report_id, name, 'repeated_line' from lined where len(list_distinct(list_transform(ls, lambda l: lower(l)))) < len(ls) union all
    select report_id, name, 'leaked_scaffolding' from lined where {' or '.join(f"contains(lower(concat_ws(' ', b2, coalesce(deep_dive, ''))), {X.q(f)})" for f in K.SCAFFOLD_FRAGMENTS)} union all
    select report_id, name, 'missing_question' from lined where question is null union all
    select report_id, name, 'missing_glance_field' from lined where name = 'At a Glance' and not (b2 like '%**Problem**%'))
  select * from defects""",
)
def audit(spark, sf):
    rows = _sections(spark, sf)
    questions = F.array(*[F.lit(q) for q in K.SECTION_QUESTIONS.values()])
    body = F.expr("case when ordinal % 9 = 2 then concat(body, '\\n', body) when ordinal % 9 = 5 then concat(body, ' HARD LENGTH LIMIT') else body end")
    rows = rows.withColumn("question", F.when(F.col("ordinal") % 6 != 1, F.element_at(questions, F.col("section_no")))).withColumn("body", body)
    return P.audit_sections(rows)


@register(
    "report_honest_sections",
    ALL_TIERS + f""",
  grid as (select c.paper_id, c.chapter_id, page_start, page_end, {NAMES_SQL}[i + 1] as name from chapters c, range(0, 11) r(i)),
  filled as (select distinct chapter_id, {NAMES_SQL}[ordinal % 11 + 1] as name from passages p join chapters c on p.paper_id = c.paper_id and p.page between c.page_start and c.page_end)
  select g.chapter_id, g.name, case when f.name is null then concat('There isn''t enough material on pages ', page_start, '-', page_end, ' to write **', g.name,
    '** for this chapter. Nothing outside the chapter''s pages was used, so this section is intentionally empty rather than filled with content from elsewhere in the paper.') else 'text' end as body,
    case when f.name is null then 0.0 end::double as confidence
  from grid g left join filled f using (chapter_id, name)""",
)
def honest_sections(spark, sf):
    from ..operators.chapters import chunks_in_chapters

    chapters = _chapters(spark, sf)
    names = F.array(*[F.lit(s) for s in K.SECTION_ORDER])
    grid = chapters.select("chapter_id", "page_start", "page_end", F.explode(names).alias("name"))
    named = V.passages(spark, sf).withColumn("name", F.element_at(names, (F.col("ordinal") % 11 + 1).cast("int")))
    filled = chunks_in_chapters(named, chapters).select("chapter_id", "name", F.lit("text").alias("body")).distinct()
    rows = grid.join(filled, ["chapter_id", "name"], "left").withColumn("media_count", F.lit(0)).withColumn("confidence", F.lit(None).cast("double"))
    return P.honest_sections(rows).select("chapter_id", "name", "body", "confidence")


@register(
    "report_degraded_sections",
    with_views("passages") + f""",
  grid as (select doc_id as paper_id, {NAMES_SQL}[i + 1] as name from documents, range(0, 11) r(i)),
  r as (select paper_id, {NAMES_SQL}[ordinal % 11 + 1] as name, text, row_number() over (partition by paper_id, ordinal % 11 order by ordinal) as n from passages qualify n <= 4)
  select g.paper_id, g.name, coalesce(string_agg(concat(left({X.strip('text')}, 200), ' [', n, ']'), ' ' order by n) filter (where {X.strip('text')} <> ''), concat('No grounded content is available yet for **', g.name, '**.')) as body,
    0.2::double as confidence, true as degraded
  from grid g left join r using (paper_id, name) group by 1, 2""",
)
def degraded(spark, sf):
    names = F.array(*[F.lit(s) for s in K.SECTION_ORDER])
    grid = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(names).alias("name"))
    chunks = V.passages(spark, sf).select("paper_id", F.element_at(names, (F.col("ordinal") % 11 + 1).cast("int")).alias("name"), F.col("ordinal").alias("rank"), "text")
    return P.degraded_sections(grid, chunks, ["paper_id", "name"])


# --- drafts ---------------------------------------------------------------------


@register("report_outline")
def outline(spark, sf):
    return RP.plan_outline(V.passages(spark, sf)).select("paper_id", "section", "chunk_id", "place.low_prose", "place.rank", "text")


@register("report_source_pool")
def source_pool(spark, sf):
    return RP.source_pool(V.passages(spark, sf)).select("paper_id", "rank", "chunk_id", "page", "text")


def _inputs(spark, sf):
    return RP.section_inputs(RP.plan_outline(V.passages(spark, sf)))


@register("report_section_drafts")
def section_drafts(spark, sf):
    papers = V.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("abstract"))
    return RP.section_drafts(_inputs(spark, sf), papers)


@register("report_section_citations")
def section_citations(spark, sf):
    inputs = _inputs(spark, sf)
    return RP.section_citations(RP.section_drafts(inputs, None), inputs).select("report_id", "section", "marker", "chunk_id", "page", "snippet")


@register("report_section_scores")
def section_scores(spark, sf):
    return RP.section_scores(_inputs(spark, sf))


@register("report_study_questions")
def study_questions(spark, sf):
    titles = V.library(spark, sf).select("paper_id", "title")
    return RP.study_questions(RP.plan_outline(V.passages(spark, sf)), titles)


@register("report_chapter_drafts")
def chapter_drafts(spark, sf):
    from ..operators.chapters import chunks_in_chapters

    scoped = RP.as_chapters(chunks_in_chapters(V.passages(spark, sf), _chapters(spark, sf)))
    return RP.section_drafts(RP.section_inputs(RP.plan_outline(scoped)), None)


RANKED = "firsts as (select *, ordinal + 1 as rank from passages)"


def _ranked(spark, sf):
    return V.passages(spark, sf).withColumn("rank", F.col("ordinal") + 1)


SENTENCES = f"""
sents as (select paper_id, rank, chunk_id, page, unnest({X.sentences('text')}) as raw, unnest(range(0, len({X.sentences('text')}))) as sent_no from firsts),
cands as (select * from (select *, {X.shorten('raw', 240, 0.4)} as sentence from sents) where len(sentence) >= 40 and not {X.is_caption('sentence')} and not {X.is_boilerplate('sentence')})"""


@register("report_sentence_candidates", with_views("passages") + "," + RANKED + "," + SENTENCES + " select paper_id, rank, sent_no::int as sent_no, sentence from cands")
def sentence_candidates(spark, sf):
    return T.sentence_candidates(_ranked(spark, sf), ["paper_id"]).select("paper_id", "rank", "sent_no", "sentence")


def _score_sql(x: str, keywords: list[str], weight: int = 2) -> str:
    return "(" + " + ".join(f"(len(string_split({x}, {X.q(w)})) - 1)" + (f" * {weight}" if " " in w else "") for w in keywords) + ")"


@register(
    "report_sentence_scores",
    with_views("passages") + "," + RANKED + "," + SENTENCES + f""",
  low as (select *, lower(sentence) as l from cands)
  select paper_id, rank, sent_no::int as sent_no, {_score_sql('l', K.GLANCE_KEYWORDS['Approach'])}::int as approach,
    case when {_score_sql('l', K.GLANCE_KEYWORDS['Headline result'])} > 0 and regexp_matches(sentence, '\\d') then {_score_sql('l', K.GLANCE_KEYWORDS['Headline result'])} + 3 else {_score_sql('l', K.GLANCE_KEYWORDS['Headline result'])} end::int as headline from low""",
)
def sentence_scores(spark, sf):
    rows = T.sentence_candidates(_ranked(spark, sf), ["paper_id"])
    return rows.select(
        "paper_id", "rank", "sent_no", T.sentence_score(F.col("low"), K.GLANCE_KEYWORDS["Approach"]).alias("approach"),
        T.sentence_score(F.col("low"), K.GLANCE_KEYWORDS["Headline result"], True).alias("headline"),
    )


@register("report_at_a_glance")
def at_a_glance(spark, sf):
    inputs = _ranked(spark, sf).withColumn("marker", F.col("rank"))
    return RP.glance_draft(RP.glance_candidates(inputs, None))


@register(
    "report_takeaways",
    with_views("passages") + "," + RANKED + "," + SENTENCES + f""",
  k as (select *, not regexp_matches(sentence, '\\d') as plain from cands),
  u as (select * from k qualify row_number() over (partition by paper_id, left(lower(sentence), 80) order by plain, rank, sent_no) = 1)
  select paper_id, row_number() over (partition by paper_id order by plain, rank, sent_no)::int as n,
    concat('**', coalesce(nullif({X.strip("array_to_string(regexp_extract_all(sentence, '" + chr(92) + "S+')[1:6], ' ')", " ,;:." + chr(92) + "-—")}, ''), left(sentence, 40)), '** — ', sentence, ' [', rank, ']') as line
  from u qualify n <= 6""",
)
def takeaways(spark, sf):
    return RP.takeaway_lines(_ranked(spark, sf).withColumn("marker", F.col("rank")), 6)


@register(
    "report_limitations",
    with_views("passages") + "," + RANKED + "," + SENTENCES + f""",
  st as (select *, row_number() over (partition by paper_id order by rank, sent_no) as n from (select * from cands where {_score_sql('lower(sentence)', K.LIMITATION_MARKERS)} > 0
     qualify row_number() over (partition by paper_id, left(lower(sentence), 80) order by rank, sent_no) = 1) qualify n <= 6),
  sc as (select *, row_number() over (partition by paper_id order by rank, sent_no) as n from cands where {_score_sql('lower(sentence)', K.SCOPE_MARKERS)} > 0 and paper_id not in (select paper_id from st) qualify n <= 5)
  select paper_id, n::int as n, concat(sentence, ' [', rank, ']') as line from st union all select paper_id, n::int, concat(sentence, ' [', rank, ']') from sc
  union all select distinct paper_id, 0, {X.q(K.NO_LIMITATIONS_LEAD)} from sc
  union all select distinct paper_id, 0, {X.q(K.NO_LIMITATIONS_ONLY)} from firsts where paper_id not in (select paper_id from st) and paper_id not in (select paper_id from sc)""",
)
def limitations(spark, sf):
    return RP.limitation_lines(_ranked(spark, sf).withColumn("marker", F.col("rank")), 6)


@register("report_concepts")
def concepts(spark, sf):
    return RP.concept_lines(_ranked(spark, sf).withColumn("marker", F.col("rank")), 8)


def _usable_term(x: str) -> str:
    return f"(not list_contains({X.lst(K.STOP_TERMS)}, upper({x})) and len({x}) between 2 and 48 and regexp_matches({x}, '\\pL') and not regexp_matches({x}, '^\\d+$'))"


EDGE = " \\-—:;,."
# RE2 boundaries are ASCII: accented letters become "_", a word character no term contains
ASCII = "regexp_replace(regexp_replace(s, '[—…“”’•×]', ' ', 'g'), '[^\\x00-\\x7f]', '_', 'g')"
EXP_RE = r"((?:[A-Za-z][\pL\pN_\-]*\s+){1,5}[A-Za-z][\pL\pN_\-]*)\s*\(\s*([A-Z][A-Za-z0-9\-]{1,9})s?\s*\)"


@register(
    "mine_vocabulary",
    with_views("passages") + f""",
  s0 as (select paper_id, ordinal as rank, unnest({X.sentences('text')}) as s, unnest(range(0, len({X.sentences('text')}))) as sn from passages),
  s1 as (select * from s0 where not {X.is_boilerplate('s')} and {X.prose_score('s')} >= 0.15),
  e0 as (select *, regexp_extract_all(s, {X.q(X.LEFT + EXP_RE)}, 1) as ls, regexp_extract_all(s, {X.q(X.LEFT + EXP_RE)}, 2) as ss, regexp_extract_all({ASCII}, {X.q(chr(92) + 'b([A-Z][A-Za-z0-9' + chr(92) + '-]*[A-Z0-9])' + chr(92) + 'b')}, 1) as acs,
     regexp_extract_all({ASCII}, {X.q(chr(92) + 'b([A-Z][a-z]{2,}(?:[ ' + chr(92) + '-][A-Z][a-z]{2,}){1,3})' + chr(92) + 'b')}, 1) as phs from s1),
  offers as (
    select paper_id, rank, sn, s, 0 as kind, unnest(range(0, len(ss))) as place, unnest(ss) as raw, unnest(ls) as long, 6 as score, false as bare from e0 union all
    select paper_id, rank, sn, s, 1, unnest(range(0, len(acs))), unnest(acs), null, 2, true from e0 union all
    select paper_id, rank, sn, s, 2, unnest(range(0, len(phs))), unnest(phs), null, 1, false from e0),
  o as (select *, {X.strip('raw', EDGE)} as term, case when long is not null then {X.strip(X.sub(X.strip('long', EDGE), '(?i)^(?:the|a|an|our|this|these|its)' + chr(92) + 's+', '', ''))} end as expansion, (rank, sn, kind, place) as pos from offers),
  ex as (select paper_id, lower(term) as key, arg_min(expansion, pos) as expansion from o where expansion is not null and {_usable_term('term')} and {_usable_term('expansion')} group by 1, 2),
  ok as (select *, {X.shorten('s', 260, 0.4)} as clean from o where {_usable_term('term')} and {X.looks_like_sentence('s')}),
  g as (select paper_id, lower(term) as key, sum(score)::bigint as score, arg_min(term, pos) as term, arg_min(clean, pos) as first_clean, max(len(clean)) filter (where len(clean) >= 40) as longest,
     bool_and(bare) as only_bare, count(distinct rank) as chunks from ok group by 1, 2),
  best as (select g.*, case when longest > len(first_clean) then (select arg_min(clean, pos) from ok where ok.paper_id = g.paper_id and lower(ok.term) = g.key and len(clean) = longest) else first_clean end as sentence from g),
  j as (select b.*, expansion from best b left join ex using (paper_id, key) where (not only_bare or expansion is not null or chunks >= 2)
     and (b.paper_id, b.key) not in (select paper_id, lower(expansion) from ex))
  select paper_id, case when expansion is not null then concat(term, ' (', expansion, ')') else term end as display, score, sentence,
    row_number() over (partition by paper_id order by score desc, len(term), lower(term))::int as place from j qualify place <= 24""",
)
def vocabulary(spark, sf):
    chunks = V.passages(spark, sf).withColumn("rank", F.col("ordinal"))
    return T.mine_terms(chunks, ["paper_id"], 24).select("paper_id", "display", "score", "sentence", "place")


# --- chat -------------------------------------------------------------------------


def _asked(spark, sf):
    turns = V.table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("conv_id").alias("paper_id"), "text")


@register("chat_answer_context")
def answer_context(spark, sf):
    return CH.answer_context(CH.content_questions(_asked(spark, sf)), V.passages(spark, sf))


@register("chat_draft_answers")
def draft_answers(spark, sf):
    asked = CH.content_questions(_asked(spark, sf))
    return CH.draft_answers(asked, CH.answer_context(asked, V.passages(spark, sf)))


@register("chat_answers")
def answers(spark, sf):
    passages = V.passages(spark, sf)
    media = passages.selectExpr(
        "paper_id", "chunk_id as media_id", "ordinal as position", "page",
        "case when ordinal % 2 = 0 then concat('Figure ', ordinal + 1) else concat('Table ', ordinal + 1) end as label", "text as caption",
    )
    return CH.answers(CH.content_questions(_asked(spark, sf)), passages, media)
