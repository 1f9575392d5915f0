"""Columns that turn sentences into card and question material."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .quality import is_usable
from .text import blank_safe, casefold, collapse, let, render, stable_choice, strip, strip_right, truncate_card, words

NUMBER = r"\$?\d+(?:[.,]\d+)?(?:\s?(?:%|×|x\b|k\b|M\b|B\b))?"
_LABELS = (
    r"fig(?:ure)?|table|chart|plate|scheme|section|sec|equation|eq|appendix|chapter|algorithm|alg|step|phase|stage"
    r"|layer|line|row|column|col|footnote|ref|reference|page|p|pp|no|nr|item|part|version|v"
)
# A number is passed over inside [brackets], after a letter or "_", after a
# letter-hyphen pair, and after a pointer word such as "Figure"; the possessive
# loop walks past those and stops at the first number worth blanking.
_PASSED_OVER = (
    r"\[[^\]\n]{0,80}\]"
    r"|(?<=[\p{L}_])" + NUMBER + r"|(?<=[\p{L}\p{N}][-–])" + NUMBER
    + r"|(?<=(?i:" + _LABELS + r")\s{0,9}\.?\s{0,9})" + NUMBER
    + r"|[^\d$\[]++|\[|\$(?!\d)"
)
FIRST_NUMBER = r"(?sU)^((?:" + _PASSED_OVER + r")*+)(" + NUMBER + r")(.*)$"


def blanked_sentence(c: Column) -> Column:
    """G-23: the sentence with its first real quantity replaced by ____."""
    hit = c.rlike(FIRST_NUMBER)
    return F.when(
        hit,
        strip(F.concat(F.regexp_extract(c, FIRST_NUMBER, 1), F.lit("____"), F.regexp_extract(c, FIRST_NUMBER, 3))),
    )


def blanked_value(c: Column) -> Column:
    return F.when(c.rlike(FIRST_NUMBER), strip(F.regexp_extract(c, FIRST_NUMBER, 2)))


def normalize_front(c: Column) -> Column:
    """G-22: punctuation-free, case-folded card front."""
    bare = F.replace(collapse(c), F.lit("*"), F.lit(""))
    return casefold(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", " "), "\\s+", " ")))


def content_key(paper_id: Column, origin: Column, front: Column) -> Column:
    raw = F.concat_ws("|", paper_id.cast("string"), origin, normalize_front(front))
    return F.left(F.sha1(raw), F.lit(16))


_TERM = r"[A-Z]\w[\w\-\s]{1,60}?"
DEFINITION_FORMS = [
    (r"(?U)^(" + _TERM + r")\s+(?:is|are)\s+defined\s+as\s+(.+)$", 1, 2),
    (r"(?U)^(" + _TERM + r")\s+refers\s+to\s+(.+)$", 1, 2),
    (r"(?U)^(" + _TERM + r")\s+denotes\s+(.+)$", 1, 2),
    (r"(?iU)^We\s+(?:define|call|refer to)\s+(.{2,60}?)\s+as\s+(.+)$", 1, 2),
    (r"(?iU)^(" + _TERM + r"),?\s+(?:also\s+known\s+as|i\.e\.,?)\s+(.+)$", 1, 2),
]


def is_definition(c: Column) -> Column:
    out = F.lit(False)
    for pattern, _, _ in DEFINITION_FORMS:
        out = out | c.rlike(pattern)
    return out


def definition_part(c: Column, part: int) -> Column:
    out = F.when(F.lit(False), c)
    for pattern, term, body in DEFINITION_FORMS:
        out = out.when(c.rlike(pattern), F.regexp_extract(c, pattern, term if part == 1 else body))
    return out


def definition_term(c: Column) -> Column:
    trimmed = strip(collapse(definition_part(c, 1)), " ,.;:-")
    return F.regexp_replace(trimmed, r"(?i)^(?:the|a|an)\s+", "")


def definition_body(c: Column) -> Column:
    return collapse(definition_part(c, 2))


BOLD_PAIR = r"(?s)^\s*(?:[-*+•]\s+|\d+[.)]\s+)?\*\*([^*\n]{2,80})\*\*\s*(?:[—–:-]\s*)?(.+)$"
TRAILING_LABEL = r"(?iU)\b(?:fig(?:ure)?|table|chart|plate|scheme|eq(?:uation)?|appendix)\s*$"


def is_real_subject(term: Column) -> Column:
    return (strip(term) != "") & ~strip(term).rlike(TRAILING_LABEL)


def stem(family: str, seed: Column, widened: bool = False, **params: Column) -> Column:
    """G-21: one phrasing per seed, from the short or the widened set."""
    short, extra = K.CARD_STEMS[family]
    return stable_choice(seed, [render(t, **params) for t in (short + extra if widened else short)])


def recall_subject(claim: Column) -> Column:
    subject = strip_right(strip(F.regexp_extract(claim, r"\*\*([^*]{2,60})\*\*", 1)), ".:;,")
    ok = (subject != "") & (F.size(words(subject)) <= 6) & is_real_subject(subject)
    return F.when(ok, subject)


def recall_lead(plain: Column) -> Column:
    listed = words(plain)
    lead = strip_right(F.array_join(F.slice(listed, 1, 5), " "), ".:;,")
    return F.when((F.size(listed) > 6) & (lead != ""), lead)


def recall_front(claim: Column, label: str, widened: bool = False) -> Column:
    """Front of a recall card: bold subject, else cloze, else opening words."""

    def phrase(parts: Column) -> Column:
        return (
            F.when(parts["subject"].isNotNull(), stem("bold", parts["subject"], widened, subject=parts["subject"]))
            .when(parts["blanked"].isNotNull(), stem("number", parts["blanked"], widened, blanked=parts["blanked"]))
            .when(
                parts["lead"].isNotNull(),
                stem("lead", parts["lead"], widened, label=F.lit(label), lead=parts["lead"]),
            )
            .otherwise(F.lit(K.HEADLINE_FRONT))
        )

    plain = F.replace(claim, F.lit("**"), F.lit(""))
    return let(
        F.struct(
            recall_subject(claim).alias("subject"),
            blanked_sentence(plain).alias("blanked"),
            recall_lead(plain).alias("lead"),
        ),
        phrase,
    )


def front_text(c: Column) -> Column:
    return truncate_card(c, K.MAX_FRONT_CHARS)


def back_text(c: Column) -> Column:
    return truncate_card(c, K.MAX_BACK_CHARS)


# --- quiz sentences ----------------------------------------------------------

QUIZ_DEFINITION = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)?\*\*([^*\n]{2,60}?)\*\*\s*(?:[—–\-:]|--)\s*(\S.*)$"
QUIZ_NUMBER = r"(?U)(?<![\w.])(\d+(?:\.\d+)?)(%?)(?![\w])"
STEP_MARKER = (
    r"(?iU)^(first|second|third|fourth|fifth|initially|then|next|finally|subsequently|afterwards?|after\s+that|lastly)\b[,:]?\s+"
)


def section_guess(text: Column) -> Column:
    """T-10: section whose hint words overlap the sentence most; first wins ties."""

    def best(found: Column) -> Column:
        scores = F.array(
            *[
                F.struct(
                    F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in hints]))).alias("score"),
                    F.lit(-rank).alias("rank"),
                    F.lit(section).alias("section"),
                )
                for rank, (section, hints) in enumerate(K.POOL_SECTION_HINTS)
            ]
        )
        top = F.array_max(scores)
        return F.when(top["score"] > 0, top["section"]).otherwise("Overview")

    found = F.array_distinct(F.regexp_extract_all(F.lower(blank_safe(text)), F.lit("[a-z]+"), F.lit(0)))
    return let(found, best)


def trim_period(c: Column) -> Column:
    return strip_right(strip(c), " .")


def lower_first(c: Column) -> Column:
    text = strip(c)
    shout = F.substring(text, 2, 1).rlike(r"^\p{Lu}$")
    return F.when((text == "") | shout, text).otherwise(
        F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))
    )


_PREAMBLE = (
    r"(?:(?:in|on|at|for|with|within|under|by|from|as|when|where|during|through|via|after|before|given|based\s+on)\b[^,]{0,70},\s*)?"
)
COPULA = (
    r"(?iU)^\s*" + _PREAMBLE
    + r"(?:this|it|these|those|that|___)\s+(?:is|are|was|were|refers?\s+to|denotes?|means?)\s+(?:defined\s+as\s+)?"
)


def as_predicate(c: Column) -> Column:
    """G-26: "It is a stack of …" becomes "a stack of …"."""
    trimmed = strip(F.regexp_replace(strip(c), COPULA, ""))
    return F.when(F.length(trimmed) < 12, strip(c)).otherwise(trimmed)


def mutate_number(value: Column, suffix: Column) -> Column:
    """G-24: a wrong but plausible number (year + 7, anything else doubled)."""
    whole = value.cast("decimal(38,0)")
    doubled = F.when(whole.between(1900, 2100), whole + 7).when(whole == 0, F.lit(1)).otherwise(whole * 2)
    # values with a point: doubled, at most two decimals, six significant digits, no trailing zeros
    real = value.cast("double")
    twice = F.when(real == 0, F.lit(1.5)).otherwise(F.round(real * 2, 2))
    short = F.regexp_replace(F.format_string("%.6g", twice), r"(\.\d*?)0+(e.*)?$", "$1$2")
    short = F.regexp_replace(short, r"\.(e.*)?$", "$1")
    return F.concat(F.when(F.contains(value, F.lit(".")), short).otherwise(doubled.cast("string")), suffix)


def term_variants(term: Column) -> Column:
    """G-25: "Byte Pair Encoding (BPE)" also answers to either part."""
    text = strip(term)
    form = r"^([^()]+?)\s*\(([^()]+)\)\s*$"
    parts = F.when(
        text.rlike(form), F.array(text, strip(F.regexp_extract(text, form, 1)), strip(F.regexp_extract(text, form, 2)))
    ).otherwise(F.array(text))
    return F.filter(F.array_distinct(parts), lambda v: F.length(v) >= 2)


def mask_term(text: Column, term: Column) -> Column:
    """G-25: every form of the term replaced by ___, longest form first."""
    ordered = F.array_sort(
        term_variants(term), lambda a, b: (F.length(b) - F.length(a)).cast("int")
    )
    masked = F.aggregate(
        ordered,
        blank_safe(text),
        lambda acc, v: F.regexp_replace(
            acc, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), v, F.lit(r"\E(?:'s|s)?(?!\w)")), F.lit("___")
        ),
    )
    return collapse(masked)


def section_claim(c: Column) -> Column:
    """Sentence without a list marker."""
    return strip(F.regexp_replace(c, r"^\s*(?:[-*+]\s+|\d+[.)]\s+)", ""))


def is_card_useful(front: Column, back: Column) -> Column:
    """W-17: long enough, not scaffolding, and the back is not already in the front."""
    f, b = normalize_front(front), normalize_front(back)
    return (
        (F.length(back) >= K.MIN_BACK_CHARS)
        & (f != "")
        & (b != "")
        & ~F.contains(f, b)
        & is_usable(front)
        & is_usable(back)
    )
