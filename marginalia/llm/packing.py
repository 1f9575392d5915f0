"""Packing (operator 10): sequences of equal length with balanced attention cost.

A document is its ids plus an end id. Whole sequences are cut from the front of
long documents; the remainders are packed in blocks. A block of remainders with
T tokens gets ceil(T / length) sequences. Documents are taken in descending
length, each to the sequence of lowest estimated cost (linear plus quadratic in
the length of every piece) that still has room for all of it. A document that
fits nowhere is cut over the cheapest sequences with room, so a block pads less
than one sequence in all.

Each task tokenises and packs its own rows block by block; ids are never
shuffled and memory is bounded by one Arrow batch and one block. A sequence id
is the number of the partition and a counter, the same in every retry.

Defined cases: a null or empty text is the end id alone; a null id is carried
along; repeated rows are packed once per row; an empty table gives no piece.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

BLOCK = 4096  # remainders packed together
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"


def pack_block(lengths: list[int], size: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, first token, number of tokens), documents by index."""
    count = -(-sum(lengths) // size)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    room, spent = [size] * count, [0.0] * count
    open_, full, uncut = [(0.0, i) for i in range(count)], [], []

    def put(i: int, doc: int, at: int, n: int) -> None:
        sequences[i].append((doc, at, n))
        room[i] -= n
        spent[i] += linear * n + quadratic * n * n
        if room[i]:
            heapq.heappush(open_, (spent[i], i))

    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        n = lengths[doc]
        while full and -full[0][0] >= n:  # lengths fall, so a sequence set aside may have room now
            i = heapq.heappop(full)[1]
            heapq.heappush(open_, (spent[i], i))
        while open_ and room[open_[0][1]] < n:
            i = heapq.heappop(open_)[1]
            heapq.heappush(full, (-room[i], i))
        if open_:
            put(heapq.heappop(open_)[1], doc, 0, n)
        else:
            uncut.append(doc)
    open_ = [(spent[i], i) for i in range(count) if room[i]]
    heapq.heapify(open_)
    for doc in uncut:  # no sequence had room for all of it
        at, left = 0, lengths[doc]
        while left:
            i = heapq.heappop(open_)[1]
            n = min(left, room[i])
            put(i, doc, at, n)
            at, left = at + n, left - n
    return sequences


def padded(n: int, size: int) -> int:
    """Length after padding: a power of two stays as it is."""
    return n if n & (n - 1) == 0 else size


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0,
    linear: float = 1.0, quadratic: float = 1 / 1024, block: int = BLOCK, vocabulary: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset, padded_length."""
    end = end_id.to_bytes(4, "little")
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("_id", "_text")
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        base, used = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []  # (id, first token, ids, tokens of the document)
        out: list[tuple] = []

        def flush() -> None:
            nonlocal used
            for pieces in pack_block([len(w[2]) // 4 for w in waiting], size, linear, quadratic):
                length, offset = sum(n for _, _, n in pieces), 0
                for doc, at, n in pieces:
                    key, first, ids, tokens = waiting[doc]
                    out.append((key, first + at, n, ids[4 * at : 4 * (at + n)], tokens, base + used, offset, padded(length, size)))
                    offset += n
                used += 1
            waiting.clear()

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"]
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field("_id").type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4]
            for key, text in zip(batch.column("_id"), batch.column("_text")):
                key, ids = key.as_py(), encode(text.as_py()) + end
                tokens = len(ids) // 4
                whole = tokens // size * size
                for at in range(0, whole, size):
                    out.append((key, at, size, ids[4 * at : 4 * (at + size)], tokens, base + used, 0, size))
                    used += 1
                if whole < tokens:
                    waiting.append((key, whole, ids[4 * whole :], tokens))
                    if len(waiting) == block:
                        flush()
                if len(out) >= 8192:
                    yield emit()
        flush()
        if out:
            yield emit()

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
