"""Toxicity (operator 4): two class-conditional Kneser-Ney models over characters.

The models predict a character from the three before it. Both classes share the
backoff: the discounted mass, taken from pooled counts, goes to continuation
counts (how many different characters precede a shorter expression) of both
classes together, so a rare expression is as likely under either model. A
context in which a class was never seen uses the pooled distribution.

A text's score compares the two log-likelihoods. Log-ratios of at most ``floor``
count as equal, and the sum is divided by a power of the length; a logistic curve
fitted on labelled rows that gave no counts turns it into 0 to 1.

Every labelled row that is not held out takes part: three quarters, by a hash of the
id, give the counts, the others the curve. Counting, smoothing and the steps of the
curve are Spark aggregations; only the strong expressions, whose number follows the
alphabet and not the rows, are sent to every task. Every text is scored whole.

Defined cases: null and empty texts have a comparison of 0; labels that are null
are ignored, a document labelled twice counts as toxic if any label says so;
without labels of both classes every score is the share of toxic labels (0
without any); repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingles import mix

ORDER = 4
DISCOUNT = 0.75
FLOOR = 3.0
POWER = 0.5  # of the length by which a comparison is divided
TEXTS = 512


def _codes(text: str | None) -> np.ndarray:
    """Code points of a text in lower case with single spaces, one space at both ends."""
    return np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n code points."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    factors = mix(np.arange(211, 211 + n, dtype=np.uint64)) | np.uint64(1)
    wide = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        total = wide[:count] * factors[0]
        for j in range(1, n):
            total += wide[j : j + count] * factors[j]
    return mix(total)


def _count(order: int):
    """Arrow batches of (text, toxic) to rows of expressions with their counts, added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found, label = [], []
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    codes = _codes(text)
                    whole = _grams(codes, order)
                    shorter, inner = _grams(codes, order - 1), _grams(codes, order - 2)
                    n = len(whole)
                    found.append(np.stack([whole, shorter[:n], shorter[1 : n + 1], inner[1 : n + 1]]))
                    label.append(np.full(n, toxic, np.int64))
                rows, toxic = np.concatenate(found, axis=1), np.concatenate(label)
                _, first, group = np.unique(rows[0], return_index=True, return_inverse=True)
                columns = [rows[i, first].view(np.int64) for i in range(4)]
                counts = [np.bincount(group, toxic == c, len(first)).astype(np.int64) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*columns, *counts)], ["gram", "context", "suffix", "inner", "n0", "n1"]
                )

    return run


def ratios(rows: DataFrame, order: int, discount: float, floor: float) -> DataFrame:
    """(gram, ratio): log-likelihood ratio, toxic to ordinary, of every expression whose ratio exceeds ``floor``.

    ``rows`` are (text, toxic). A gram is a context of ``order - 1`` characters and the next one.
    """
    schema = "gram long, context long, suffix long, inner long, n0 long, n1 long"
    counted = rows.mapInArrow(_count(order), schema).groupBy("gram").agg(
        *[F.min(c).alias(c) for c in ("context", "suffix", "inner")], F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    counted = stored(counted, "expressions")
    cut = lambda n: F.greatest(n - discount, F.lit(0.0))
    pooled = F.col("n0") + F.col("n1")
    of_context = counted.groupBy("context").agg(
        F.sum(pooled).alias("seen"), F.sum(cut(pooled)).alias("kept"), F.sum(cut(F.col("n0"))).alias("kept0"), F.sum(cut(F.col("n1"))).alias("kept1")
    )
    of_suffix = counted.groupBy("suffix").agg(F.count(F.lit(1)).alias("before"))
    of_inner = counted.groupBy("inner").agg(F.count(F.lit(1)).alias("pairs"))
    joined = counted.join(of_context, "context").join(of_suffix, "suffix").join(of_inner, "inner")
    shared = F.col("before") / F.col("pairs")
    held = F.col("kept") / F.col("seen")
    common = cut(pooled) / F.col("kept")

    def likelihood(n: str, kept: str) -> Column:
        own = F.when(F.col(kept) > 0, cut(F.col(n)) / F.col(kept)).otherwise(F.coalesce(common, F.lit(0.0)))
        return held * own + (1 - held) * shared

    ratio = F.log(likelihood("n1", "kept1") / likelihood("n0", "kept0"))
    return joined.select("gram", ratio.alias("ratio")).filter(F.col("ratio") > floor)


class Comparison:
    """Length-normalised comparison of the two models for a text."""

    BITS = 22

    def __init__(self, grams: np.ndarray, values: np.ndarray, order: int, power: float) -> None:
        at = np.argsort(grams)
        self.grams, self.values, self.order, self.power = grams[at], values[at], order, power
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(grams >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __call__(self, text: str | None) -> float:
        grams = _grams(_codes(text), self.order)
        if not len(grams) or not len(self.grams):
            return 0.0
        grams_in = grams[self.maybe[(grams >> np.uint64(64 - self.BITS)).astype(np.int64)]]
        at = np.minimum(np.searchsorted(self.grams, grams_in), len(self.grams) - 1)
        return float(self.values[at][self.grams[at] == grams_in].sum() / len(grams) ** self.power)


def fit_curve(rows: DataFrame, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over (value, toxic), by Newton steps with a small ridge.

    A step is one aggregation over all rows, of which five sums come back.
    """
    x, y = F.col("value"), F.col("toxic")
    w = np.zeros(2)
    for _ in range(50):
        line = F.lit(float(w[0])) * x + F.lit(float(w[1]))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))
        q = p * (1 - p)
        xx, x1, one, gx, g1 = rows.agg(*[F.sum(c) for c in (x * x * q, x * q, q, x * (y - p), y - p)]).first()
        step = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + ridge * np.eye(2), np.array([gx, g1]) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return round(float(w[0]), 9), round(float(w[1]), 9)  # sums of floats depend on their order


def _compare(sent, order: int, power: float):
    """A pandas UDF from text to its comparison."""

    @F.pandas_udf("double")
    def compare(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, values = sent.value
        model = Comparison(grams, values, order, power)
        for texts in batches:
            yield pd.Series([model(t) for t in texts], dtype="float64")

    return compare


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, fold) of every row with a label that is not held out; rows of fold 0 give no counts."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out).groupBy(id_col).agg(F.max("toxic").cast("long").alias("toxic"))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(4)))
    known = stored(known.select(F.col(id_col).alias("_known"), "toxic", "fold"), "labels")
    texts = docs.filter(~held_out).select(docs[id_col].alias("_known"), docs[text_col].cast("string").alias("text"))
    # labels grow with the rows, so they are not broadcast at any size: the texts that may be learnt from cross one shuffle
    return texts.join(known.hint("merge"), "_known").select("text", "toxic", "fold")


def score(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    order: int = ORDER, discount: float = DISCOUNT, floor: float = FLOOR, power: float = POWER,
) -> DataFrame:
    """``docs`` with the column ``_score``, 0 to 1.

    ``labels`` has ``id_col`` and ``toxic`` (0 or 1). Rows for which ``held_out``
    (a boolean Column over ``docs`` and over ``labels``, built on ``id_col``) holds are never learnt from.
    """
    spark = docs.sparkSession
    rows = stored(labelled(docs, labels, held_out, id_col, text_col), "labelled-texts")
    table = ratios(rows.filter("fold <> 0").select("text", "toxic"), order, discount, floor).toPandas()
    sent = spark.sparkContext.broadcast((table["gram"].to_numpy(np.int64).view(np.uint64), table["ratio"].to_numpy(np.float64)))
    compare = _compare(sent, order, power)
    spoken = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    check = stored(rows.filter("fold = 0").select(compare(F.coalesce("text", F.lit(""))).alias("value"), "toxic"), "compared")
    share, seen = check.agg(F.avg("toxic"), F.count_distinct("toxic")).first()
    if seen == 2 and len(table):
        slope, shift = fit_curve(check)
        return docs.withColumn("_score", 1 / (1 + F.exp(-(F.lit(slope) * compare(spoken) + shift))))
    return docs.withColumn("_score", F.lit(float(share or 0.0)))
