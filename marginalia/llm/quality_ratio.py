"""Quality rules by a log-likelihood ratio (operator 11), DataFrame functions only.

Word n-grams (orders 1 to ``ORDER``) of whole texts are hashed into ``BUCKETS``
cells. Two multinomials are counted over the cells: the raw corpus (every
document) and the trusted target (every document whose id is in ``trusted``). A
text's score is the sum of its cells' log ratios divided by its n-grams; it is
kept when that mean reaches a fixed threshold and the base rules hold. Ratios are
rounded to millionths, so scores are integer sums: the verdict does not depend on
the order of summation and repeats exactly on any cluster. A small corpus cannot fill
all cells, and ratios of nearly empty cells would only measure which texts the
target holds; cells are therefore folded (a power of two, so by their remainder)
until each has ``FILL`` n-grams on average.

The counts meet in at most ``BUCKETS`` rows; the ratios return to the scan as one array
in a scalar subquery, whose size that parameter bounds. No text is shuffled while
the trusted ids number at most ``BROADCAST_IDS``; beyond it they are joined by id.

Defined cases: a null text counts as empty and, like any text without words, has
n-gram count 0 and fails the base rules; a very long text is scored whole; a null
id is never trusted; trusted ids that repeat count once; equal rows are judged
alike, each on its own; an empty table gives an empty result; without trusted
documents all ratios favour rare cells alike and only differ by their counts;
further columns are ignored, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1 << 16  # a power of two
FILL = 128
ORDER = 2
THRESHOLD = -100_000  # millionths of a nat per n-gram
DOUBLINGS = 3  # a repeated passage has 2 ** 3 words
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
BROADCAST_IDS = 1_000_000  # a hash table of at most some 50 MB
SYMBOLS = "[#*$%&|<>]"
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D."""
    return F.array_remove(F.split(text, BLANKS), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often a lambda inside refers to it."""
    return F.transform(F.array(value), use)[0]


def hashes_of(words: Column) -> Column:
    """A 32-bit hash of every word."""
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))


def combined(hashes: Column, offset: int, others: Column | None = None) -> Column:
    """Each hash combined with the one of ``others`` (the same list) ``offset`` places on; shorter by ``offset``."""
    others = hashes if others is None else others
    count = F.greatest(F.size(others) - offset, F.lit(0))
    return F.zip_with(
        F.slice(hashes, F.lit(1), count), F.slice(others, F.lit(offset + 1), count), lambda a, b: (a * 40503 + b * 7919 + 1).bitwiseAND(F.lit((1 << 32) - 1))
    )


def repeated_words(words: Column, hashes: Column, doublings: int = DOUBLINGS) -> Column:
    """Number of words inside a window of 2 ** ``doublings`` words that occurs twice or more in the text.

    Hashes of windows tell whether any window may repeat; only then are the windows
    themselves sorted, so that equal ones are neighbours and compared as text.
    """
    width = 1 << doublings
    starts = F.sequence(F.lit(1), F.size(words) - width + 1)

    def covered(windows: Column) -> Column:
        twice = F.filter(windows, lambda x, j: (x["w"] == F.get(windows, j - 1)["w"]) | (x["w"] == F.get(windows, j + 1)["w"]))
        first = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            first,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def doubled(offset: int):
        return lambda h: combined(h, offset)

    def text_at(w: Column, i: Column) -> Column:
        return F.struct(F.array_join(F.slice(w, i, width), " ").alias("w"), i.alias("i"))

    # a column named twice or in a lambda might be merged into it and computed again, so each is bound first
    hashed = hashes
    for k in range(doublings):
        hashed = bound(hashed, doubled(1 << k))
    windows = bound(words, lambda w: F.transform(starts, lambda i: text_at(w, i)))
    repeats = bound(hashed, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) >= width, F.when(repeats, bound(F.sort_array(windows), covered)).otherwise(none)).otherwise(none)


def base_columns(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, its words and their hashes."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    columns = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words, hashes),
    }
    return {name: column.cast("long") for name, column in columns.items()}


def grams_of(hashes: Column, order: int = ORDER) -> Column:
    """Hashes of all n-grams of order 1 to ``order``; a cell is the remainder by the number of cells."""

    def listed(h: Column) -> Column:
        grown, all_orders = h, [h]
        for k in range(1, order):
            grown = combined(grown, k, h)
            all_orders.append(grown)
        return F.concat(*all_orders)

    return bound(hashes, listed)


def counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """cell, raw, target: n-grams of all documents and of the trusted ones; at most ``buckets`` rows."""
    ids = trusted.select(trusted[id_col].alias("_id")).filter(F.col("_id").isNotNull()).distinct().withColumn("_target", F.lit(1))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(ids) if few else ids, "_id", "left")
    listed = grams_of(hashes_of(words_of(_plain(F.col("_text")))), order)
    grams = rows.select(F.coalesce("_target", F.lit(0)).alias("_target"), F.explode(listed).alias("_gram"))
    cell = F.col("_gram").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("cell")
    return grams.groupBy(cell).agg(F.count(F.lit(1)).alias("raw"), F.sum("_target").alias("target"))


def _plain(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def folded_size(grams: int, buckets: int = BUCKETS, fill: int = FILL) -> int:
    """The largest power of two up to ``buckets`` that leaves ``fill`` n-grams per cell, at least one cell."""
    return min(buckets, 1 << max(0, (grams // fill).bit_length() - 1))


def weights(counted: DataFrame, size: int, raw_all: int, target_all: int) -> DataFrame:
    """One row with one array: the log ratio target to raw of every folded cell in millionths, add-one smoothed."""
    folded = counted.groupBy((F.col("cell") % size).alias("cell")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    every = counted.sparkSession.range(size).select(F.col("id").cast("int").alias("cell")).join(folded, "cell", "left")
    share = lambda name, total: (F.coalesce(name, F.lit(0)) + 1) / F.lit(total + size)
    ratio = F.round(F.log(share("target", target_all) / share("raw", raw_all)) * 1e6).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("cell", ratio.alias("ratio"))))
    return every.agg(F.transform(listed, lambda x: x["ratio"]).alias("weights"))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    buckets: int = BUCKETS,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """One row per document: ``id_col``, the base columns, base_failed, n_grams, llr_micro (the sum), kept.

    ``trusted`` holds the ids of the target's documents in a column named ``id_col``.
    """
    counted = stored(counts(docs, trusted, id_col, text_col, order, buckets), "quality-counts")
    raw, target = (n or 0 for n in counted.agg(F.sum("raw"), F.sum("target")).first())
    size = folded_size(raw, buckets)
    ratios = stored(weights(counted, size, raw, target), "quality-weights").scalar()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), ratios.alias("_weights"))

    def score(weights: Column, grams: Column) -> Column:
        return F.aggregate(grams, F.lit(0).cast("long"), lambda acc, g: acc + F.get(weights, g.bitwiseAND(F.lit(size - 1)).cast("int")))

    def measured(text: Column, words: Column, hashes: Column) -> Column:
        columns = base_columns(text, words, hashes)
        llr = bound(F.col("_weights"), lambda w: bound(grams_of(hashes, order), lambda g: F.struct(F.size(g).cast("long").alias("n"), score(w, g).alias("sum"))))
        return F.struct(*[c.alias(n) for n, c in columns.items()], llr.alias("llr"))

    # one expression for all measures of a text: its lists of words and n-grams are bound inside and never become columns
    all_measures = bound(_plain(F.col("_text")), lambda t: bound(words_of(t), lambda w: bound(hashes_of(w), lambda h: measured(t, w, h))))
    scored = rows.select("_id", all_measures.alias("_m")).select("_id", "_m.*")
    scored = scored.select("*", F.col("llr.n").alias("n_grams"), F.col("llr.sum").alias("llr_micro"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed)
    verdict = ~F.col("base_failed") & (F.col("llr_micro") >= threshold * F.col("n_grams"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(F.col("_id").alias(id_col), *names, verdict.alias("kept"), "n_grams", "llr_micro")
