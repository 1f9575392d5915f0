"""Bibliography formatting and chat intent as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import blank_safe, let, strip, strip_right, words

INITIAL = r"^[A-Za-z]\.?$"

# ordered intent rules (fixed patterns)
CITES_OTHERS = (
    r"(?iU)\b(which|what|how many|whose)\b[^?]{0,40}\b(cite|cites|cited|references?)\b|\bworks?\s+cited\s+by\b"
    r"|\bwho\s+(do|does)\s+(they|it|the\s+authors?)\s+cite\b"
)
CITE_THIS = (
    r"(?iU)\bcite\s+(this|it|the\s+(paper|pdf|article|work))\b|\bcitation\s+(for|of)\s+(this|the|it)\b"
    r"|\b(how\s+(do|would|should)\s+i\s+cite)\b|\breference\s+(list\s+)?entry\b|\bbibliograph(y|ic)\s+(entry|record|citation)\b"
    r"|\bcitation\s+styles?\b|\b(all|every|each)\s+(the\s+)?(citation|reference)s?\b"
)
STYLE_NAME = r"(?iU)\b(apa|mla|chicago|harvard|ieee|bibtex|bib\s?tex)\b"
CITE_CUE = r"(?iU)\b(cite|citation|citations|cited|reference|references|bibliograph\w*|format|style|quote)\b"
STRUCTURE = (
    r"(?iU)\bhow\s+(many|long)\b[^?]{0,30}\b(page|pages|figure|figures|table|tables|chapter|chapters|section|sections|word|words)\b"
    r"|\b(page|figure|table|chapter)\s+count\b|\bhow\s+long\s+is\s+(this|it|the\s+(paper|pdf|document))\b"
    r"|\bwhat\s+(chapters|sections)\s+(are|does)\b"
)
METADATA = (
    r"(?iU)\bwho\s+(wrote|are\s+the\s+authors?|is\s+the\s+author)\b|\b(author|authors)\s+(of\s+(this|the)\b|names?\b)"
    r"|\bwhen\s+was\s+(it|this|the\s+paper)\s+(published|written|released)\b|\b(publication|published)\s+(date|year)\b"
    r"|\bwhat\s+year\b|\bwhat\s+is\s+(the\s+)?(title|arxiv\s*(id|number))\b|\barxiv\s*(id|number|link|url)\b"
    r"|\bwhat\s+(is|are)\s+(the\s+)?(categor|subject)"
)
STYLE_PATTERNS = {
    "apa": r"(?iU)\bapa\b",
    "mla": r"(?iU)\bmla\b",
    "chicago": r"(?iU)\bchicago\b",
    "ieee": r"(?iU)\bieee\b",
    "bibtex": r"(?iU)\bbib\s*tex\b|\blatex\b",
}


def intent(question: Column) -> Column:
    """G-15: first matching rule decides what kind of answer is wanted."""
    text = strip(question)
    return (
        F.when(text == "", "content")
        .when(text.rlike(CITES_OTHERS), "content")
        .when(text.rlike(CITE_THIS), "citation")
        .when(text.rlike(STYLE_NAME) & (text.rlike(CITE_CUE) | (F.size(words(text)) <= 3)), "citation")
        .when(text.rlike(STRUCTURE), "structure")
        .when(text.rlike(METADATA), "metadata")
        .otherwise("content")
    )


def detect_styles(question: Column) -> Column:
    """G-16: every citation style named in the question."""
    named = [F.when(blank_safe(question).rlike(p), F.lit(s)) for s, p in STYLE_PATTERNS.items()]
    return F.filter(F.array(*named), lambda s: s.isNotNull())


# --- names -----------------------------------------------------------------------


def _given(tokens: Column) -> Column:
    dotted = F.transform(tokens, lambda t: F.when(t.rlike(INITIAL) & ~t.endswith("."), F.concat(t, F.lit("."))).otherwise(t))
    return F.array_join(dotted, " ")


def _spaced(name: Column) -> Column:
    return words(F.regexp_replace(name, r"\.(?=\S)", ". "))


def split_name(name: Column) -> Column:
    """G-17: struct(given, family) from any of the usual spellings."""

    def pair(given: Column, family: Column) -> Column:
        return F.struct(given.alias("given"), family.alias("family"))

    def by_tokens(raw: Column) -> Column:
        titled = F.lower(strip_right(F.try_element_at(raw, F.lit(1)), ".")).isin(K.HONORIFICS)
        return let(F.when(titled, F.slice(raw, F.lit(2), F.size(raw))).otherwise(raw), plain)

    def plain(tokens: Column) -> Column:
        long_words = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: ~F.try_element_at(tokens, i).rlike(INITIAL))
        # a single full word is the family name wherever it stands, else the last word
        place = F.when(F.size(long_words) == 1, F.try_element_at(long_words, F.lit(1))).otherwise(F.size(tokens))

        def around(at: Column) -> Column:
            rest = F.concat(F.slice(tokens, F.lit(1), at - 1), F.slice(tokens, at + 1, F.size(tokens)))
            return pair(_given(rest), F.element_at(tokens, at))

        return (
            F.when(F.size(tokens) == 0, pair(F.lit(""), F.lit("")))
            .when(F.size(tokens) == 1, pair(F.lit(""), F.element_at(tokens, 1)))
            .otherwise(let(place, around))
        )

    def by_comma(text: Column) -> Column:
        family = strip(F.regexp_extract(text, "^([^,]*),", 1))
        return pair(_given(_spaced(F.regexp_extract(text, "(?s)^[^,]*,(.*)$", 1))), family)

    return let(
        strip(name),
        lambda text: F.when(text == "", pair(F.lit(""), F.lit("")))
        .when(F.contains(text, F.lit(",")), by_comma(text))
        .otherwise(let(_spaced(text), by_tokens)),
    )


def initials(given: Column) -> Column:
    return F.array_join(F.transform(words(given), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))), " ")


def name_parts(authors: Column) -> Column:
    """Array of struct(given, family, initials)."""

    def parts(author: Column) -> Column:
        return let(
            split_name(author),
            lambda n: F.struct(n["given"].alias("given"), n["family"].alias("family"), initials(n["given"]).alias("initials")),
        )

    return F.transform(F.coalesce(authors, F.array().cast("array<string>")), parts)


def _family_first(n: Column, given: str) -> Column:
    return F.when(n[given] != "", F.concat(n["family"], F.lit(", "), n[given])).otherwise(n["family"])


def _given_first(n: Column, given: str) -> Column:
    return strip(F.concat(n[given], F.lit(" "), n["family"]))


def _listed(items: Column, last: str, pair: str) -> Column:
    """One, two or many names; ``last`` joins the final one of many."""
    size = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0))), ", ")
    final = F.try_element_at(items, F.lit(-1))
    return (
        F.when(size == 0, "")
        .when(size == 1, final)
        .when(size == 2, F.concat(head, F.lit(pair), final))
        .otherwise(F.concat(head, F.lit(last), final))
    )


def apa_authors(names: Column) -> Column:
    def join(items: Column) -> Column:
        many = F.concat(F.array_join(F.slice(items, 1, 19), ", "), F.lit(", ... "), F.try_element_at(items, F.lit(-1)))
        return F.when(F.size(items) > 20, many).otherwise(_listed(items, ", & ", ", & "))

    return let(F.transform(names, lambda n: _family_first(n, "initials")), join)


def mla_authors(names: Column) -> Column:
    first = _family_first(F.try_element_at(names, F.lit(1)), "given")
    second = _given_first(F.try_element_at(names, F.lit(2)), "given")
    return (
        F.when(F.size(names) == 0, "")
        .when(F.size(names) == 1, first)
        .when(F.size(names) == 2, F.concat(first, F.lit(", and "), second))
        .otherwise(F.concat(first, F.lit(", et al.")))
    )


def chicago_authors(names: Column) -> Column:
    items = F.transform(names, lambda n, i: F.when(i == 0, _family_first(n, "given")).otherwise(_given_first(n, "given")))
    return let(items, lambda x: _listed(x, ", and ", " and "))


def ieee_authors(names: Column) -> Column:
    return let(F.transform(names, lambda n: _given_first(n, "initials")), lambda x: _listed(x, ", and ", " and "))


def bibtex_authors(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: _family_first(n, "given")), " and ")


def cite_key(names: Column, year: Column, title: Column) -> Column:
    family = F.regexp_replace(F.lower(F.try_element_at(names, F.lit(1))["family"]), "[^a-z]", "")
    family = F.coalesce(F.nullif(family, F.lit("")), F.lit("unknown"))
    title_words = F.filter(
        F.regexp_extract_all(F.lower(blank_safe(title)), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(K.TITLE_STOPWORDS)
    )
    word = F.coalesce(F.try_element_at(title_words, F.lit(1)), F.lit(""))
    fallback = F.concat(family, F.lit("_"), F.coalesce(F.nullif(word, F.lit("")), F.lit("untitled")))
    return F.when(year.isNotNull(), F.concat(family, year.cast("string"), word)).otherwise(fallback)


def full_stop(text: Column) -> Column:
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def format_citation(style: Column, paper: Column) -> Column:
    """G-18: one citation string. ``paper`` has title, names, year, article_id, url, upload."""
    title = strip(paper["title"])
    missing = title == ""

    def titled(end: str, quoted: bool = True) -> Column:
        mark = '"' if quoted else ""
        shown = F.concat(F.lit(mark), title, F.lit(end + mark))
        return F.when(missing, F.lit(K.TITLE_MISSING + end)).otherwise(shown)

    names, upload, url = paper["names"], paper["upload"], paper["url"]
    year = F.coalesce(paper["year"].cast("string"), F.lit("n.d."))
    undated = paper["year"].isNull()

    def archived(lead: Column) -> Column:
        return F.when(upload | url.isNull(), lead).otherwise(F.concat(lead, F.lit(" arXiv. "), url))

    def apa() -> Column:
        plain = titled(".", quoted=False)
        return let(
            apa_authors(names),
            lambda a: archived(
                F.when(a != "", F.concat(a, F.lit(" ("), year, F.lit("). "), plain)).otherwise(F.concat(plain, F.lit(" ("), year, F.lit(").")))
            ),
        )

    def mla() -> Column:
        def finish(a: Column) -> Column:
            lead = F.when(a != "", F.concat(a, F.lit(". "), titled("."))).otherwise(titled("."))
            tail = F.when(undated, F.lit("arXiv")).otherwise(F.concat(F.lit("arXiv, "), year))
            tail = F.when(url.isNotNull(), F.concat(tail, F.lit(", "), url)).otherwise(tail)
            own = F.when(undated, lead).otherwise(F.concat(lead, F.lit(" "), year, F.lit(".")))
            return F.when(upload, own).otherwise(F.concat(lead, F.lit(" "), tail, F.lit(".")))

        return let(strip_right(mla_authors(names), "."), finish)

    def chicago() -> Column:
        return let(
            strip_right(chicago_authors(names), "."),
            lambda a: archived(
                F.when(a != "", F.concat(a, F.lit(". "), full_stop(year), F.lit(" "), titled("."))).otherwise(
                    F.concat(titled("."), F.lit(" "), full_stop(year))
                )
            ),
        )

    def ieee() -> Column:
        def finish(a: Column) -> Column:
            lead = F.when(a != "", F.concat(a, F.lit(", "), titled(","))).otherwise(titled(","))
            number = blank_safe(paper["article_id"])
            preprint = F.concat(lead, F.lit(" arXiv preprint arXiv:"), number, F.lit(", "), full_stop(year))
            return F.when(upload | (number == ""), F.concat(lead, F.lit(" "), full_stop(year))).otherwise(preprint)

        return let(ieee_authors(names), finish)

    def bibtex() -> Column:
        def field(name: str, value: Column) -> Column:
            return F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))

        authors = bibtex_authors(names)
        fields = F.array(
            F.when(authors != "", field("author", authors)),
            field("title", F.when(missing, F.lit(K.TITLE_MISSING)).otherwise(title)),
            F.when(~undated, field("year", year)),
            F.when(upload, field("note", F.lit("Uploaded PDF; no arXiv identifier"))),
            F.when(~upload & (blank_safe(paper["article_id"]) != ""), field("eprint", paper["article_id"])),
            F.when(~upload, field("archivePrefix", F.lit("arXiv"))),
            F.when(~upload & url.isNotNull(), field("url", url)),
        )
        body = F.array_join(F.filter(fields, lambda f: f.isNotNull()), ",\n")
        return F.concat(F.lit("@misc{"), cite_key(names, paper["year"], paper["title"]), F.lit(",\n"), body, F.lit("\n}"))

    return strip(
        F.when(style == "apa", apa())
        .when(style == "mla", mla())
        .when(style == "chicago", chicago())
        .when(style == "ieee", ieee())
        .when(style == "bibtex", bibtex())
    )


def article_url(upload: Column, abs_url: Column, article_id: Column) -> Column:
    fallback = F.when(blank_safe(article_id) != "", F.concat(F.lit("https://arxiv.org/abs/"), article_id))
    return F.when(~upload, F.coalesce(F.nullif(abs_url, F.lit("")), fallback))
