"""Filter interaction audit with wide packed counters (operator 12).

Every document has a mask of the filters it fails. For each of the 120 orders of
five filters and each step, a mask says whether the document is removed there:
600 outcomes. A mask is mapped to one big integer with a field of ``FIELD_BITS``
bits for each outcome (and one for the document itself), so adding integers adds
all 601 counters at once. A part's integers are summed in the map tasks (all
documents, good ones, toxic ones), merged in two rounds whose groups are bounded,
and unpacked once. A field holds 2 ** 48 - 1, more documents than any table has,
so no carry ever reaches the next field.

Texts leave the scan as a 256-bit digest and four bits; equality of texts (filter
E) is equality of SHA-256. The smallest id per digest combines before the shuffle,
and digests that own many rows are spread over salts in the join.

Defined cases: null text and part count as empty; a null id fails E never and is
smaller than no other; rows that repeat id and text fail E alike; several labels
of one id count as one that is good or toxic if any of them is; labels without a
document are ignored; very long texts are read whole; an empty table gives no
rows; further columns are ignored, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, stored
from .quality_ratio import words_of

FILTERS = "ABCDE"
FIELD_BITS = 48
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
LANE = 1024  # packed sums that meet in one group of the first merge
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column, words: Column) -> Column:
    """The bits of filters A to D of a text and its words."""
    tests = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    bits = F.lit(0)
    for i, test in enumerate(tests):
        bits = bits + F.when(test, 1 << i).otherwise(0)
    return bits


def outcomes(mask: int) -> int:
    """The packed counters of one document: field 0 counts it, field 1 + 5 * order + step - 1 counts its removal there."""
    packed = 1
    for number, order in enumerate(ORDERS):
        for step, letter in enumerate(order):
            if mask >> FILTERS.index(letter) & 1:
                packed |= 1 << FIELD_BITS * (1 + len(FILTERS) * number + step)
                break
    return packed


def unpack(packed: int) -> np.ndarray:
    """All counters of a packed sum, the document count first."""
    width = FIELD_BITS // 8
    raw = np.frombuffer(packed.to_bytes(width * (STEPS + 1), "little"), np.uint8).reshape(-1, width)
    return raw.astype(np.int64) @ (np.int64(1) << np.arange(0, FIELD_BITS, 8, dtype=np.int64))


def _bytes(packed: int) -> bytes:
    return packed.to_bytes((packed.bit_length() + 7) // 8, "little")


SUMS = ["every", "good", "toxic"]


def _sum_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part of a task: the sums of its documents' integers."""
    from pyspark import TaskContext

    integers = [outcomes(mask) for mask in range(1 << len(FILTERS))]
    sums: dict[str, list[int]] = {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic")]
        for part, mask, good, toxic in zip(*columns):
            own = sums.setdefault(part, [0, 0, 0])
            own[0] += integers[mask]
            if good:
                own[1] += integers[mask]
            if toxic:
                own[2] += integers[mask]
        if len(sums) > LANE:  # many parts: hand on what is there
            yield _packed_rows(sums, TaskContext.get().partitionId() // LANE)
            sums = {}
    yield _packed_rows(sums, TaskContext.get().partitionId() // LANE)


def _packed_rows(sums: dict[str, list[int]], lane: int) -> pa.RecordBatch:
    packed = [pa.array([_bytes(s[i]) for s in sums.values()], pa.binary()) for i in range(3)]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([lane] * len(sums), pa.int32()), *packed], ["part", "lane", *SUMS]
    )


def _add(table: pa.Table) -> pa.Table:
    """The integers of one group added up."""
    first = table.slice(0, 1)
    sums = [sum(int.from_bytes(x.as_py(), "little") for x in table.column(c)) for c in SUMS]
    return pa.table([first.column("part"), first.column("lane"), *[pa.array([_bytes(s)], pa.binary()) for s in sums]], ["part", "lane", *SUMS])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows per part from its three packed sums."""
    letters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    first, last = np.zeros(5, int), np.zeros(5, int)
    for i in range(5):
        first[i], last[i] = np.flatnonzero(letters[:, 0] == i)[0], np.flatnonzero(letters[:, -1] == i)[0]
    for batch in batches:
        for row in batch.to_pylist():
            every, good, toxic = (unpack(int.from_bytes(row[c], "little")) for c in SUMS)
            removed, good_lost, toxic_lost = (x[1:].reshape(len(ORDERS), 5) for x in (every, good, toxic))
            failing, unique = removed[first, 0], removed[last, 4]  # a filter's share when it comes first, and last
            shapley = np.array([removed[letters == i].sum() for i in range(5)])
            columns = {
                "kept": every[0] - removed.cumsum(axis=1), "removed": removed, "redundant": failing[letters] - removed,
                "unique_fails": unique[letters], "good_lost": good_lost, "toxic_lost": toxic_lost, "shapley": shapley[letters],
            }
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * STEPS, pa.string()),
                    pa.array([order for order in ORDERS for _ in FILTERS], pa.string()),
                    pa.array(list(range(1, 6)) * len(ORDERS), pa.int32()),
                    *[pa.array(x.ravel(), pa.int64()) for x in columns.values()],
                ],
                ["part", "filter_order", "step", *columns],
            )


def masks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask, good, toxic of every document."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    part = F.coalesce(docs[part_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), part.alias("part"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    slim = stored(
        rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text"), F.col("words")).alias("mask")),
        "audit-masks",
    )
    smallest = slim.groupBy("digest").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("n"))
    copied = stored(smallest.filter("n > 1"), "audit-copies")
    marks = labels.filter(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = join_by_key(slim, copied, "digest", "n", F.col("id"), "left").join(marks, "id", "left")
    later = F.when(F.col("id") > F.col("smallest"), 1 << 4).otherwise(0)
    return judged.select(
        "part", (F.col("mask") + later).alias("mask"), F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """600 rows per part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``labels`` has ``id_col``, quality and toxic.
    """
    schema = "part string, lane int, every binary, good binary, toxic binary"
    sums = masks(docs, labels, id_col, text_col, part_col).mapInArrow(_sum_masks, schema)
    for keys in (["part", "lane"], ["part"]):
        sums = sums.groupBy(*keys).applyInArrow(_add, schema)
    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return sums.mapInArrow(_report, f"part string, filter_order string, step int, {longs}")
