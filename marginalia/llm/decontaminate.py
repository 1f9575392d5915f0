"""Benchmark decontamination (operator 6): pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(m * error_rate)
edits. It is split into k + 1 pieces; whatever k edits touch, one piece occurs
unchanged (pigeonhole), so an exact search for all pieces of all items in one
pass over a text finds every candidate place. Each place is verified with
Myers' bit-parallel edit distance over the window the piece allows.

Texts and items are compared after lower-casing and reducing white space to
single spaces. Items go to the executors in blocks of at most ``MAX_ITEMS_BYTES``
of text, one pass over the documents per block, whatever the size of the test set.

Defined cases: null and empty items match nothing; a null text counts as empty;
an item shorter than ``MIN_ITEM`` characters must match exactly; rows that
repeat an item give a match each; an empty table gives no match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


ERROR_RATE = 0.08
MIN_ITEM = 20
MAX_ITEMS_BYTES = 8 << 20

GRAM = 3


def normal(text: str | None) -> str:
    """Lower case, single spaces, no space at either end."""
    return " ".join((text or "").lower().split())


def budget(item: str, error_rate: float = ERROR_RATE) -> int:
    """Edits allowed in an occurrence of a normalised item."""
    return int(len(item) * error_rate) if len(item) >= MIN_ITEM else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between the item and any substring of the text, and where such a substring ends."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, at
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
    return best, end


class Matcher:
    """All items of a block against one text."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        import ahocorasick

        self._items = [(row, text, budget(text, error_rate)) for row, text in items if text]
        self._grams = [[text[i : i + GRAM] for i in range(len(text) - GRAM + 1)] for _, text, _ in self._items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, edits) in enumerate(self._items):
            for at, piece in pieces(text, edits):
                found.setdefault(piece, []).append((i, at))
        self._search = ahocorasick.Automaton()
        for piece, places in found.items():
            self._search.add_word(piece, (len(piece), places))
        if found:
            self._search.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item row, distance, end) of every item that occurs, at its best place."""
        if not len(self._search):
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self._search.iter(text):
            for i, at in places:
                _, item, edits = self._items[i]
                start = last + 1 - length - at
                windows.setdefault(i, []).append((start - edits, start + len(item) + edits))
        out = []
        for i, spans in windows.items():
            row, item, edits = self._items[i]
            place = text.find(item)
            if place >= 0:
                out.append((row, 0, place + len(item)))
                continue
            best, end = len(item) + 1, 0
            spans.sort()
            low, high = spans[0]
            for a, b in [*spans[1:], (None, None)]:  # windows that overlap are searched as one
                if a is not None and a <= high:
                    high = max(high, b)
                    continue
                window = text[max(low, 0) : max(high, 0)]
                held = {window[j : j + GRAM] for j in range(len(window) - GRAM + 1)}
                if sum(g in held for g in self._grams[i]) >= len(self._grams[i]) - GRAM * edits:
                    distance, stop = myers(item, window)
                    if distance < best:
                        best, end = distance, max(low, 0) + stop
                low, high = a, b
            if best <= edits:
                out.append((row, best, end))
        return out


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", error_rate: float = ERROR_RATE, most: int = MAX_ITEMS_BYTES, carry: tuple = (),
) -> DataFrame:
    """One row per document and item found in it: id, item, distance, end (in the normalised text), and ``carry``."""
    tests = items.select(items[item_col].alias("item"), F.coalesce(items[item_text_col].cast("string"), F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text")).alias("b"), F.max(F.octet_length("text")).alias("m")).first()
    blocks = max(1, math.ceil((total["b"] or 0) / max(1, most - (total["m"] or 0))))
    rows = docs.select(
        docs[id_col].alias("_id"), *[docs[c].alias(f"_carry{i}") for i, c in enumerate(carry)],
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"),
    )
    kept = rows.columns[:-1]
    item_type = tests.schema["item"].dataType
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    schema = ", ".join([*kinds, f"item {item_type.simpleString()}", "distance int", "end int"])
    out = None
    for block in range(blocks):  # one block unless the test set outgrows a broadcast
        chosen = tests.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        block_out = rows.mapInArrow(_search([(r["item"], r["text"]) for r in chosen], to_arrow_type(item_type), error_rate, kept), schema)
        out = block_out if out is None else out.unionByName(block_out)
    return out.select(
        F.col("_id").alias(id_col), F.col("item").alias(item_col), "distance", "end",
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
    )


def _search(items: list[tuple], item_type: pa.DataType, error_rate: float, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher([(row, normal(text)) for row, (_, text) in enumerate(items)], error_rate)
        for batch in batches:
            at, item, distance, end = [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                for row, d, e in match(normal(text)):
                    at.append(i)
                    item.append(items[row][0])
                    distance.append(d)
                    end.append(e)
            took = batch.select(kept).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*took.columns, pa.array(item, item_type), pa.array(distance, pa.int32()), pa.array(end, pa.int32())],
                [*kept, "item", "distance", "end"],
            )

    return run


def clean(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: float = ERROR_RATE,
    most: int = MAX_ITEMS_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns, judged in the task that reads them."""
    tests = items.select(F.coalesce(items["text"].cast("string"), F.lit("")).alias("text")).distinct()
    total = tests.agg(F.sum(F.octet_length("text")).alias("b"), F.max(F.octet_length("text")).alias("m")).first()
    blocks = max(1, math.ceil((total["b"] or 0) / max(1, most - (total["m"] or 0))))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    hit = F.lit(False)
    for block in range(blocks):
        chosen = tests.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        hit = hit | _contains([r["text"] for r in chosen], error_rate)(text)
    return docs.filter(~hit)


def _contains(texts: list[str], error_rate: float):
    @F.pandas_udf("boolean")
    def contains(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher([(i, normal(t)) for i, t in enumerate(texts)], error_rate)
        for batch in batches:
            yield pd.Series([bool(match(normal(t))) for t in batch], dtype=bool)

    return contains
