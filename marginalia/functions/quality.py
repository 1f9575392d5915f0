"""Text-quality predicates and scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import blank_safe, collapse, let, strip

TOKEN = r"[A-Za-z0-9][A-Za-z0-9'’\-]*"
EMAIL = r"(?iU)[\w.\-{}, ]+@[\w.\-]+\.[a-z]{2,}"
INSTITUTION = (
    r"(?iU)\b(university|universität|institute|laborator(y|ies)|department|college|academy"
    r"|research\s+cent(er|re)|inc\.|ltd\.|gmbh)\b"
)
ID_STAMP = r"(?iU)\b(issn|isbn|doi)\s*[:#]?\s*[\d\w.\-/]+|arxiv\s*[:#]?\s*\d{4}\.\d{4,5}"
ABSTRACT_FRONT = r"(?isU)^(.{0,600}?)\babstract\b\s*[—–\-:.]?\s+(?=\S)"
TITLE_SIGNAL = r"(?iU)\b(dr|prof|mr|ms|mrs)\.|university|college|institute|department|@[\w.\-]+\.\w+|\b\d{5,}\b"
NONCONTENT_LABEL = (
    r"(?iU)\b(reference|bibliograph|acknowledg|appendix|author\s+contribution|funding|conflict|supplementary|visuali[sz]ation)"
)
URLISH = r"(?iU)https?://|www\.\w|\.(?:com|org|net|edu|gov|io|jpg|jpeg|png|gif|pdf)\b"
AUX_VERB = (
    r"(?iU)\b(?:is|are|was|were|be|been|being|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must)\b"
)


def is_caption(c: Column) -> Column:
    """Q-01."""
    text = strip(c)
    return (F.length(text) < K.SHORT_CHUNK_CHARS) & text.rlike(K.CAPTION)


def is_caption_sentence(c: Column) -> Column:
    """Q-02."""
    return F.regexp_replace(strip(c), K.CAPTION_LEAD, "").rlike(K.CAPTION)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank_safe(c)), F.lit(TOKEN), F.lit(0))


def prose_score(c: Column) -> Column:
    """Q-08: share of function words; texts under ten tokens score 1."""

    def score(found: Column) -> Column:
        stop = F.size(F.filter(found, lambda t: t.isin(K.PROSE_STOPWORDS)))
        return F.when(F.size(found) < 10, F.lit(1.0)).otherwise(stop / F.size(found))

    return let(tokens(c), score)


def content_words(c: Column) -> Column:
    kept = F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(K.PROSE_STOPWORDS))
    return F.array_distinct(kept)


def jaccard(left: Column, right: Column) -> Column:
    """X-04: intersection over union of two distinct-element arrays."""
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))
    )


def has_email(text: Column) -> Column:
    # the address pattern scans whole word runs; the cheap test keeps it off ordinary prose
    return F.contains(text, F.lit("@")) & text.rlike(EMAIL)


def boilerplate_rule(c: Column) -> Column:
    """Q-04: name of the first furniture rule that fires, null for content.

    The stripped text is bound once: inlined, it would be copied into every rule
    and the generated method would pass its size limit.
    """
    return let(strip(c), _first_rule)


def _first_rule(text: Column) -> Column:
    size = F.length(text)
    short = size < K.SHORT_CHUNK_CHARS
    lives = F.regexp_count(text, F.lit(K.BIOGRAPHY))
    residue = strip(F.regexp_replace(text, K.JOURNAL_HEADER, " "), " \t\n,.;:-—")
    return (
        F.when(size == 0, F.lit(None).cast("string"))
        .when(text.rlike(K.BARE_PAGE_NUMBER) & text.rlike("\\d"), "page_number")
        .when(text.rlike(K.BARE_URL), "url")
        .when(text.rlike(K.AUTHOR_PROFILE), "author_profile")
        .when((lives >= 2) | ((lives == 1) & short), "biography")
        .when(text.rlike(K.LICENCE), "licence")
        .when((size < 2 * K.SHORT_CHUNK_CHARS) & has_email(text) & text.rlike(INSTITUTION), "affiliation")
        .when(text.rlike(K.JOURNAL_HEADER) & (F.length(residue) < K.MIN_RESIDUE_CHARS), "journal_header")
        .when(short & text.rlike(ID_STAMP), "id_stamp")
        .when(short & text.rlike(K.COPYRIGHT), "copyright")
    )


def is_boilerplate(c: Column) -> Column:
    return boilerplate_rule(c).isNotNull()


def is_contact_block(block: Column) -> Column:
    text = strip(block)
    without = strip(F.regexp_replace(text, EMAIL, " "), " ,;{}()\n\t")
    return (
        (F.length(text) > 0)
        & (F.length(text) <= 200)
        & has_email(text)
        & ((F.length(without) < 60) | without.rlike(INSTITUTION))
    )


def strip_contact_block(c: Column) -> Column:
    """Q-06: drop leading paragraphs that are only addresses."""

    def drop_leading(blocks: Column) -> Column:
        first = F.array_position(F.transform(blocks, is_contact_block), F.lit(False)).cast("int")
        rest = F.when(first == 0, F.lit("")).otherwise(
            strip(F.array_join(F.slice(blocks, F.greatest(first, F.lit(1)), F.size(blocks)), "\n\n"))
        )
        return F.when((first == 1) | (rest == ""), c).otherwise(rest)

    # no address, no contact block: the split is only paid where it can matter
    return F.when(F.contains(blank_safe(c), F.lit("@")), let(F.split(blank_safe(c), "\n\n"), drop_leading)).otherwise(c)


def strip_title_block(c: Column) -> Column:
    """Q-05: cut affiliation front matter before "Abstract", else Q-06."""
    front = F.regexp_extract(blank_safe(c), ABSTRACT_FRONT, 1)
    rest = strip(F.regexp_replace(blank_safe(c), ABSTRACT_FRONT, ""))
    fires = F.contains(F.lower(blank_safe(c)), F.lit("abstract")) & c.rlike(ABSTRACT_FRONT) & front.rlike(TITLE_SIGNAL)
    return F.when(fires, F.coalesce(F.nullif(rest, F.lit("")), c)).otherwise(strip_contact_block(c))


def dedupe_key(c: Column) -> Column:
    """Q-10: letters and digits of the first 120 characters."""
    return F.regexp_replace(F.lower(F.left(blank_safe(c), F.lit(K.DEDUPE_KEY_CHARS))), "[^a-z0-9]+", "")


def header_prefix(c: Column) -> Column:
    """Q-07: normalised opening used to detect a running header."""
    head = collapse(F.left(blank_safe(c), F.lit(K.PREFIX_CHARS + 20)))
    return F.lower(F.left(head, F.lit(K.PREFIX_CHARS)))


def is_noncontent(label: Column, text: Column) -> Column:
    """Q-13."""
    return blank_safe(label).rlike(NONCONTENT_LABEL) | blank_safe(text).rlike(K.MODEL_TOKEN)


def is_usable(c: Column) -> Column:
    text = blank_safe(c)
    return (text != "") & ~text.rlike(K.SCAFFOLD_OPENING) & ~text.rlike(URLISH) & ~is_caption_sentence(text)


def usable_sentence(c: Column) -> Column:
    """Q-14. Bound once: inlined, the stripped text would be copied into dozens of patterns."""
    return let(
        strip(c),
        lambda text: (F.length(text) >= 30)
        & is_usable(text)
        & ~is_boilerplate(text)
        & (prose_score(text) >= K.MIN_PROSE_SCORE),
    )


def looks_like_sentence(c: Column) -> Column:
    """Q-15."""
    text = blank_safe(c)
    return text.rlike("[a-z]{3,}") & (text.rlike(AUX_VERB) | text.rlike(r"(?U)\b[a-z]{3,}(?:s|ed|ing)\b"))


def is_textual(modality: Column, text: Column) -> Column:
    """Q-16."""
    return (modality != "image") & (strip(text) != "")


ORDINAL_LABEL = (
    r"(?i)(?:fig(?:ure)?|table|chart|plate|scheme|section|sec|equation|eq|appendix|chapter|algorithm|alg|step|phase|stage"
    r"|layer|line|row|column|col|footnote|ref|reference|page|p|pp|no|nr|item|part|version|v)\s*\.?\s*$"
)


def is_ordinal_number(text: Column, start: Column) -> Column:
    """Q-03: the number at zero-based ``start`` is a pointer, not a quantity."""
    return F.substring(text, F.lit(1), start).rlike(ORDINAL_LABEL)


def figure_text(text: Column, label: Column, caption: Column) -> Column:
    """Q-19: model text, else "label: caption", else a fixed note."""
    name = F.coalesce(F.nullif(blank_safe(label), F.lit("")), F.lit("This figure"))
    fallback = F.when(blank_safe(caption) != "", F.concat(name, F.lit(": "), caption)).otherwise(
        F.concat(name, F.lit(" — vision analysis unavailable; showing the extracted crop only."))
    )
    return F.coalesce(F.nullif(strip(text), F.lit("")), fallback)
