"""DuckDB spellings of the text rules, used only in the checking statements.

RE2 has neither look-around nor Unicode word boundaries, so boundaries are
written as explicit character classes.
"""

from __future__ import annotations

from ..functions import constants as K

LEFT, RIGHT, WORD = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])", r"[\pL\pN_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, {q(flags)})" if flags else f"regexp_replace({x}, {q(pattern)}, {q(by)})"


def strip(x: str, chars: str = r"\s") -> str:
    return sub(x, f"^[{chars}]+|[{chars}]+$")


def rstrip(x: str, chars: str) -> str:
    return sub(x, f"[{chars}]+$")


def collapse(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '\\S+')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def shorten(x: str, limit: int, floor: float) -> str:
    def at(mark: str) -> str:
        found = f"instr(reverse(h), {q(mark[::-1])})"
        return f"(case when {found} > 0 then len(h) - {found} - {len(mark) - 1} else -1 end)"

    cases = " ".join(f"when {at(m)} > {limit * floor} then trim(substr(h, 1, {at(m)} + 1))" for m in (". ", "! ", "? "))
    by_word = rstrip(f"(case when {at(' ')} > 0 then substr(h, 1, {at(' ')}) else h end)", ",;:\\- ")
    cut = let("h", f"substr(t, 1, {limit})", f"case {cases} else {by_word} || '…' end")
    return let("t", collapse(x), f"case when len(t) <= {limit} then t else {cut} end")


def is_caption(x: str) -> str:
    return let("t", strip(x), f"(len(t) < 300 and {has('t', K.CAPTION)})")


def is_caption_sentence(x: str) -> str:
    return has(sub(strip(x), K.CAPTION_LEAD, "", ""), K.CAPTION)


TOKEN = r"[A-Za-z0-9][A-Za-z0-9'’\-]*"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(TOKEN)})"


def prose_score(x: str) -> str:
    stop = f"len(list_filter(k, lambda w: list_contains({lst(K.PROSE_STOPWORDS)}, w)))"
    return let("k", tokens(x), f"case when len(k) < 10 then 1.0 else {stop} / len(k) end")


def content_words(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda w: len(w) > 2 and not list_contains({lst(K.PROSE_STOPWORDS)}, w)))"


EMAIL = r"(?i)[\pL\pN_.\-{}, ]+@[\pL\pN_.\-]+\.[a-z]{2,}"
INSTITUTION = (
    f"(?i){LEFT}(?:university|universität|institute|laborator(?:y|ies)|department|college|academy|research\\s+cent(?:er|re)"
    f"|inc\\.|ltd\\.|gmbh){RIGHT}"
)
ID_STAMP = rf"(?i){LEFT}(?:issn|isbn|doi)\s*[:#]?\s*[\pL\pN_.\-/]+|arxiv\s*[:#]?\s*\d{{4}}\.\d{{4,5}}"
TITLE_SIGNAL = rf"(?i){LEFT}(?:dr|prof|mr|ms|mrs)\.|university|college|institute|department|@[\pL\pN_.\-]+\.[\pL\pN_]+|{LEFT}\d{{5,}}{RIGHT}"
NONCONTENT = f"(?i){LEFT}(reference|bibliograph|acknowledg|appendix|author\\s+contribution|funding|conflict|supplementary|visuali[sz]ation)"
URLISH = rf"(?i)https?://|www\.{WORD}|\.(?:com|org|net|edu|gov|io|jpg|jpeg|png|gif|pdf){RIGHT}"
AUX = f"(?i){LEFT}(?:is|are|was|were|be|been|being|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must){RIGHT}"


def boilerplate_rule(x: str) -> str:
    residue = strip(sub("t", K.JOURNAL_HEADER, " "), " \\t\\n,.;:\\-—")
    lives = count("t", K.BIOGRAPHY)
    body = f"""case when t = '' then null
      when {has('t', K.BARE_PAGE_NUMBER)} and {has('t', chr(92) + 'd')} then 'page_number'
      when {has('t', K.BARE_URL)} then 'url'
      when {has('t', K.AUTHOR_PROFILE)} then 'author_profile'
      when {lives} >= 2 or ({lives} = 1 and len(t) < 300) then 'biography'
      when {has('t', K.LICENCE)} then 'licence'
      when len(t) < 600 and {has('t', EMAIL)} and {has('t', INSTITUTION)} then 'affiliation'
      when {has('t', K.JOURNAL_HEADER)} and len({residue}) < 80 then 'journal_header'
      when len(t) < 300 and {has('t', ID_STAMP)} then 'id_stamp'
      when len(t) < 300 and {has('t', K.COPYRIGHT)} then 'copyright' end"""
    return let("t", strip(x), body)


def is_boilerplate(x: str) -> str:
    return f"({boilerplate_rule(x)} is not null)"


def strip_contact_block(x: str) -> str:
    without = strip(sub("b", EMAIL, " "), " ,;{}()\\n\\t")
    contact = let("b", strip("p"), f"(b <> '' and len(b) <= 200 and {has('b', EMAIL)} and (len({without}) < 60 or {has(without, INSTITUTION)}))")
    first = f"list_position(list_transform(ps, lambda p: {contact}), false)"
    rest = strip(f"array_to_string(ps[coalesce({first}, len(ps) + 1):], chr(10) || chr(10))")
    return let("ps", f"string_split({x}, chr(10) || chr(10))", f"coalesce(nullif(case when {first} = 1 then {x} else {rest} end, ''), {x})")


ABSTRACT = rf"(?is)^(.{{0,600}}?{LEFT})abstract(?:\s*[—–\-:.]\s+|\s+)(\S.*)$"


def strip_title_block(x: str) -> str:
    front, rest = f"regexp_extract({x}, {q(ABSTRACT)}, 1)", f"regexp_extract({x}, {q(ABSTRACT)}, 2)"
    return f"case when {has(x, ABSTRACT)} and {has(front, TITLE_SIGNAL)} then coalesce(nullif({strip(rest)}, ''), {x}) else {strip_contact_block(x)} end"


def dedupe_key(x: str) -> str:
    return sub(f"lower(substr({x}, 1, 120))", "[^a-z0-9]+")


def header_prefix(x: str) -> str:
    return f"lower(substr({collapse(f'substr({x}, 1, 110)')}, 1, 90))"


SCAFFOLD = K.SCAFFOLD_OPENING


def is_usable(x: str) -> str:
    return f"({x} <> '' and not {has(x, SCAFFOLD)} and not {has(x, URLISH)} and not {is_caption_sentence(x)})"


def usable_sentence(x: str) -> str:
    return let("u", strip(x), f"(len(u) >= 30 and {is_usable('u')} and not {is_boilerplate('u')} and {prose_score('u')} >= 0.15)")


def looks_like_sentence(x: str) -> str:
    return f"({has(x, '[a-z]{3,}')} and ({has(x, AUX)} or {has(x, LEFT + '[a-z]{3,}(?:s|ed|ing)' + RIGHT)}))"


# --- grading --------------------------------------------------------------------


def normalize_text(x: str) -> str:
    from ..functions.grading import FOLD_FROM, FOLD_TO

    folded = f"replace(translate({x}, {q(FOLD_FROM)}, {q(FOLD_TO)}), '…', '...')"
    cased = f"replace(lower({collapse(folded)}), 'ß', 'ss')"
    return strip(sub(cased, r"^[^\pL\pN_]+|[^\pL\pN_]+$"))


def punctuation_free(x: str) -> str:
    return f"trim({sub(normalize_text(x), '[^a-z0-9]+', ' ')})"


def content_tokens(x: str) -> str:
    from ..functions.grading import TOKEN as GRADE_TOKEN

    stop = lst(K.GRADING_STOPWORDS)
    parts = f"list_filter(regexp_split_to_array(w, '[''\\-]'), lambda p: len(p) >= 3 and not list_contains({stop}, p))"
    return f"flatten(list_transform(regexp_extract_all({normalize_text(x)}, {q(GRADE_TOKEN)}), lambda w: case when regexp_matches(w, '^\\d') then [w] else {parts} end))"


def folded_set(x: str) -> str:
    fold = "case when len(t) > 3 and t[-1] = 's' and t[-2:] <> 'ss' then t[1:-2] else t end"
    return f"list_distinct(list_transform({content_tokens(x)}, lambda t: {fold}))"


def token_overlap(expected: str, given: str) -> str:
    body = f"case when len(e) = 0 then 0.0 else len(list_intersect(e, {folded_set(given)})) / len(e) end"
    return let("e", folded_set(expected), body)


def strip_markers(x: str) -> str:
    bare = sub(x, r"\[\s*\d{1,3}(?:\s*[,;]\s*\d{1,3})*\s*\]")
    return f"trim(replace(replace({collapse(bare)}, ' .', '.'), ' ,', ','))"


# --- numbers worth blanking --------------------------------------------------------

NUMBER = r"\$?\d+(?:[.,]\d+)?(?:\s?(?:%|×|x\b|k\b|M\b|B\b))?"
LABELS = (
    r"(?i)(?:fig(?:ure)?|table|chart|plate|scheme|section|sec|equation|eq|appendix|chapter|algorithm|alg|step|phase|stage"
    r"|layer|line|row|column|col|footnote|ref|reference|page|p|pp|no|nr|item|part|version|v)\s*\.?\s*$"
)


def first_number(x: str) -> str:
    """struct(before, value, after) of the first quantity, null without one."""
    pieces = f"regexp_extract_all({x}, {q(r'(?s)' + chr(92) + r'[[^' + chr(92) + r']\n]{0,80}' + chr(92) + ']|' + NUMBER + r'|[^\d$\[]+|.')})"
    before = "array_to_string(ps[1:i - 1], '')"
    fits = (
        f"regexp_full_match(ps[i], {q(NUMBER)}) and not {has(before, LABELS)}"
        f" and not {has(before, '[' + chr(92) + 'pL_]$')} and not {has(before, '[' + chr(92) + 'pL' + chr(92) + 'pN][-–]$')}"
    )
    at = f"list_filter(range(1, len(ps) + 1), lambda i: {fits})[1]"
    found = let("pos", at, "case when pos is not null then {'before': array_to_string(ps[1:pos - 1], ''), 'value': ps[pos], 'after': array_to_string(ps[pos + 1:], '')} end")
    return let("ps", pieces, found)


def blanked(x: str) -> str:
    return let("n", first_number(x), f"case when n is not null then {strip(chr(110) + '.before || ' + q('____') + ' || n.after')} end")


def normalize_front(x: str) -> str:
    bare = f"replace({collapse(x)}, '*', '')"
    spaced = sub(sub(bare, r"[^\pL\pN_\s]", " "), r"\s+", " ")
    return f"replace(lower(trim({spaced})), 'ß', 'ss')"


DEFINITIONS = [
    r"^([A-Z][\pL\pN_][\pL\pN_\-\s]{1,60}?)\s+(?:is|are)\s+defined\s+as\s+(.+)$",
    r"^([A-Z][\pL\pN_][\pL\pN_\-\s]{1,60}?)\s+refers\s+to\s+(.+)$",
    r"^([A-Z][\pL\pN_][\pL\pN_\-\s]{1,60}?)\s+denotes\s+(.+)$",
    r"(?i)^We\s+(?:define|call|refer to)\s+(.{2,60}?)\s+as\s+(.+)$",
    r"(?i)^([A-Z][\pL\pN_][\pL\pN_\-\s]{1,60}?),?\s+(?:also\s+known\s+as|i\.e\.,?)\s+(.+)$",
]


def definition_part(x: str, part: int) -> str:
    cases = " ".join(f"when {has(x, p)} then regexp_extract({x}, {q(p)}, {part})" for p in DEFINITIONS)
    return f"case {cases} end"


def definition_term(x: str) -> str:
    return sub(strip(collapse(definition_part(x, 1)), " ,.;:\\-"), r"(?i)^(?:the|a|an)\s+", "", "")


def digest_mod(x: str, n: int) -> str:
    """sha1(x) mod n, folded digit by digit."""
    digit = "(instr('0123456789abcdef', d) - 1)"
    return f"list_reduce(list_transform(regexp_extract_all(sha1({x}), '.'), lambda d: {digit}::bigint), lambda a, d: (a * 16 + d) % {n}, 0::bigint)"


def stable_choice(seed: str, options: list[str]) -> str:
    return f"[{', '.join(options)}][{digest_mod(f'replace(lower({seed}), {q(chr(223))}, {q(chr(115) * 2)})', len(options))} + 1]"


def render(template: str, **params: str) -> str:
    out, rest = [], template
    while rest:
        start = rest.find("{")
        if start < 0:
            out.append(q(rest))
            break
        end = rest.index("}", start)
        out += [q(rest[:start])] if start else []
        out.append(params[rest[start + 1 : end]])
        rest = rest[end + 1 :]
    return "concat(" + ", ".join(out) + ")"
