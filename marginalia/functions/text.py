"""Basic text Columns shared by every operator (no Python runs per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "\\s+"
WHITESPACE = " \t\n\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(value: Column) -> Column:
    """Evaluate ``value`` one time per row.

    Filters above a plain projection are pushed below it with the expression
    copied into every use; a one-element generator is a boundary they respect.
    """
    return F.explode(F.array(value))


def strip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(blank_safe(c), F.lit(chars))


def strip_right(c: Column, chars: str) -> Column:
    return F.rtrim(blank_safe(c), F.lit(chars))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank_safe(c), BLANK, " "))


def token_count(c: Column) -> Column:
    """C-01: number of whitespace-separated words."""
    return F.regexp_count(blank_safe(c), F.lit("\\S+"))


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), BLANK), lambda w: w != "")


def sentences(c: Column) -> Column:
    """C-06: split after ., ! or ? followed by whitespace; blanks removed."""
    parts = F.split(blank_safe(c), "(?<=[.!?])\\s+")
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def last_index(text: Column, needle: str) -> Column:
    """Zero-based position of the last ``needle`` in ``text``, -1 if absent."""
    found = F.locate(needle[::-1], F.reverse(text))
    return F.when(found > 0, F.length(text) - found - len(needle) + 1).otherwise(-1)


def shorten(c: Column, limit: int, floor: float) -> Column:
    """C-07: cut at a sentence end past ``floor`` of the limit, else at a word."""

    def cut(head: Column) -> Column:
        spaced = last_index(head, " ")
        word_cut = F.when(spaced > 0, F.expr("null").cast("string")).otherwise(head)
        word_cut = F.coalesce(word_cut, F.substring(head, F.lit(1), spaced))
        out = F.concat(strip_right(word_cut, ",;:- "), F.lit("…"))
        for mark in ("? ", "! ", ". "):
            at = last_index(head, mark)
            out = F.when(at > limit * floor, F.trim(F.substring(head, F.lit(1), at + 1))).otherwise(out)
        return out

    return let(
        collapse(c),
        lambda text: F.when(F.length(text) <= limit, text).otherwise(let(F.left(text, F.lit(limit)), cut)),
    )


def clean_snippet(c: Column, limit: int = 280) -> Column:
    return shorten(c, limit, 0.4)


def truncate_card(c: Column, limit: int) -> Column:
    return shorten(c, limit, 0.5)


def strip_markers(c: Column) -> Column:
    """G-14: drop ``[3]`` and ``[3, 7]`` groups, tidy the spaces left behind."""
    bare = F.regexp_replace(blank_safe(c), r"\[\s*\d{1,3}(?:\s*[,;]\s*\d{1,3})*\s*\]", "")
    return F.trim(F.replace(F.replace(collapse(bare), F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(",")))


def strip_simple_markers(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(blank_safe(c), r"\[(\d{1,3})\]", ""), BLANK, " "))


def first_marker(c: Column) -> Column:
    return F.expr("try_cast(null as int)") if c is None else F.regexp_extract(blank_safe(c), r"\[(\d{1,3})\]", 1).try_cast("int")


def all_markers(c: Column) -> Column:
    """Distinct ``[n]`` numbers in ascending order."""
    found = F.regexp_extract_all(blank_safe(c), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.try_cast("int"))))


def repair_markers(c: Column, max_marker: Column) -> Column:
    """G-12: ``[n] 3`` and ``**(3)**`` become ``[3]`` when in range."""

    def repair(text: Column, pattern: str) -> Column:
        hits = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        numbered = F.transform(
            hits, lambda h: F.struct(h.alias("raw"), F.regexp_extract(h, r"(\d{1,3})", 1).cast("int").alias("n"))
        )
        in_range = F.filter(numbered, lambda s: (s["n"] >= 1) & (s["n"] <= max_marker))
        return F.aggregate(
            in_range, text, lambda acc, s: F.replace(acc, s["raw"], F.concat(F.lit("["), s["n"].cast("string"), F.lit("]")))
        )

    leaked = repair(blank_safe(c), r"(?iU)\[\s*n\s*\]\s*\d{1,3}\b")
    styled = repair(leaked, r"\*{1,2}\(\s*\d{1,3}\s*\)\*{1,2}")
    return strip(F.regexp_replace(styled, r"(?i)\s*\[\s*n\s*\]\s*", " "))


def strip_preamble(c: Column) -> Column:
    """G-13: unwrap one code fence, then drop a leading "Here is ...:" line."""
    fence = r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*$"
    opener = r"(?i)^\s*(?:sure[,.!:]?\s*)?(?:here(?:'s| is| are)?|below is|the following(?: is)?)\b[^\n]*:\s*\n+"
    body = strip(c)
    body = F.when(body.rlike(fence), strip(F.regexp_extract(body, fence, 1))).otherwise(body)
    return let(body, lambda b: F.coalesce(F.nullif(strip(F.regexp_replace(b, opener, "")), F.lit("")), b))


def slug(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "-")


MODERN_OR_LEGACY_ID = r"(?i)^(?:arxiv:)?\s*((?:\d{4}\.\d{4,5}(?:v\d+)?)|(?:[a-z\-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?))$"


def normalize_article_id(c: Column) -> Column:
    """S-02: bare article id, null when the input is not one."""
    return F.nullif(F.regexp_extract(strip(c), MODERN_OR_LEGACY_ID, 1), F.lit(""))


def paper_id_of(c: Column) -> Column:
    known = normalize_article_id(c)
    return F.when(known.isNotNull(), slug(F.regexp_replace(known, "v\\d+$", "")))


def chunk_id(paper_id: Column, ordinal: Column) -> Column:
    """``<paper>::c00042``; ordinals past five digits keep all of theirs."""
    digits = ordinal.cast("string")
    padded = F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0"))
    return F.concat(paper_id.cast("string"), F.lit("::c"), padded)


def keyword_score(text: Column, keywords: list[str], phrase_weight: int = 1) -> Column:
    """Occurrences of each keyword in ``text`` (already lower case), summed; null without a text.

    Replacing searches a text far more slowly than the test whether it holds a word, and most texts hold few of them.
    """
    total = F.lit(0)
    for word in keywords:
        removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))
        hits = (removed / len(word.encode())).cast("int") * (phrase_weight if " " in word else 1)
        total = total + F.when(~F.contains(text, F.lit(word)), F.lit(0)).otherwise(hits)
    return total


def bullet_free(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*(?:[-*+•]\s+|\d+[.)]\s+)", "")


def body_blocks(body: Column) -> Column:
    """C-08: blank-line paragraphs; an all-bullet paragraph yields its lines."""
    bullet = r"^\s*(?:[-*+•]\s+|\d+[.)]\s+)"

    def expand(para: Column) -> Column:
        lines = F.filter(F.split(para, "\n"), lambda ln: strip(ln) != "")
        listed = (F.size(lines) > 1) & F.forall(lines, lambda ln: ln.rlike(bullet))
        return F.when(listed, F.transform(lines, lambda ln: collapse(bullet_free(ln)))).otherwise(
            F.array(collapse(bullet_free(para)))
        )

    paras = F.filter(F.transform(F.split(blank_safe(body), r"\n\s*\n"), lambda p: strip(p)), lambda p: p != "")
    return F.filter(F.flatten(F.transform(paras, expand)), lambda b: b != "")


def enum_or(c: Column, allowed: list[str], default: str) -> Column:
    """G-20: keep a known value, otherwise the default."""
    return F.when(c.isin(allowed), c).otherwise(F.lit(default))


def digest_mod(hex_digest: Column, n: int, digits: int = 40) -> Column:
    """A hex digest modulo ``n``: eight digits at a time, so nothing overflows."""
    total, step = F.lit(0).cast("bigint"), 16**8 % n
    for start in range(1, digits + 1, 8):
        piece = F.conv(F.substring(hex_digest, start, 8), 16, 10).cast("bigint")
        total = (total * step + piece) % n
    return total


def stable_choice(seed: Column, options: list[Column]) -> Column:
    """G-21: sha1(casefold(seed)) mod n picks one of the options."""
    pick = digest_mod(F.sha1(casefold(blank_safe(seed))), len(options))
    return F.element_at(F.array(*options), (pick + 1).cast("int"))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def render(template: str, **params: Column) -> Column:
    """Fill ``{name}`` holes of a fixed template with Columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(params[rest[start + 1 : end]])
        rest = rest[end + 1 :]
    return F.concat(*parts)
