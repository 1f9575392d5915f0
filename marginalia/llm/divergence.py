"""Source divergence audit over a K-squared quadtree (operator 13).

Documents fall into groups (lang, source). Every lang keeps the terms of at least
``MIN_DOCS`` of its documents; a group gives a kept term the chance
p = 1 + floor(10 ** 9 * (count + 1) / (N + V)). Part ``pair`` compares each two
groups of a lang over all kept terms, part ``term`` lists what a group uses more
than its lang.

1. Map tasks count terms, flushing partial counts, and two shuffles add them up
   per (lang, source, term) and per (lang, term).
2. The kept terms of a lang are hashed into blocks of about ``BLOCK`` nonzero
   counts (or as many as the lang has pairs of groups, if more). In a block the
   group-by-term matrix is a K-squared quadtree: each node has up to four
   children, and an all-zero quadrant has no node.
3. The tree is traversed once for all pairs of groups: a step looks at the
   quadrants of two row ranges over one column range. Two missing quadrants are
   priced for all their pairs by their width; else the eight combinations of
   halves follow, down to single counts. Terms that neither group of a pair uses
   are never touched one by one.
4. Pair sums of blocks add up in Spark, and blocks hand on their own first terms.

A block holds the member list of its lang besides its counts: the square root of
the pairs that the result lists.

Defined cases: null text, lang and source count as empty; a document without
terms still makes its group occur; a lang without kept terms gives its pairs the
value 0; the only source of a lang has no pair; rows that repeat count each; ties
of rank go by the item's UTF-8 bytes; very long texts are read whole; an empty
table gives no rows; further columns are ignored, so no name can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_by_key, stored

MIN_DOCS = 3
SCALE_STEPS = (10**4, 10**5)  # their product is the scale of chances; divided in two steps to stay in 64 bits
TOP = 200
BLOCK = 1 << 17
HELD = 300_000  # partial counts a map task holds before it hands them on
NODES = 1 << 15  # quadrant pairs expanded at a time
TILE = 7  # levels below which expansion is cut into pieces of NODES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, source, term): occurrences and documents."""
    term = re.compile(rb"[a-z\x80-\xff]+")  # of UTF-8 in lower case: what is neither an ASCII letter nor beyond ASCII separates
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text")):
            words = term.findall(text.as_buffer().to_pybytes().lower())
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from _flushed(held)
                held, size = {}, 0
    yield from _flushed(held)


def _flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(n), pa.string()),
                pa.array([source] * len(n), pa.string()),
                pa.array(list(n), pa.binary()).cast(pa.string()),
                pa.array(list(n.values()), pa.int64()),
                pa.array([docs[t] for t in n], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def chance(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (n + 1) / total), exact for totals below 9 * 10 ** 13."""
    coarse, rest = np.divmod((n + 1) * SCALE_STEPS[0], total)
    return 1 + coarse * SCALE_STEPS[1] + rest * SCALE_STEPS[1] // total


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of x at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class QuadTree:
    """K-squared tree of a sparse matrix: ``children[l]`` has four node numbers of level l - 1 (or -1) per node of level l."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> None:
        self.height = max(1, int(max(n_rows, n_columns, 2) - 1).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        self.order = np.argsort(code)  # node k of level 0 is entry order[k]
        code, self.children = code[self.order], [np.empty((0, 4), np.int64)]
        for _ in range(self.height):
            parents, at = np.unique(code >> np.uint64(2), return_inverse=True)
            own = np.full((len(parents) + 1, 4), -1, np.int64)  # the last row serves -1: a missing node has no children
            own[at, (code & np.uint64(3)).astype(np.int64)] = np.arange(len(code))
            self.children.append(own)
            code = parents

    def leaves(self, n_rows: int, n_columns: int, priced: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(g, h, a, b) for all columns and rows g < h where either has a count; a and b are level-0 nodes or -1.

        Two missing quadrants at level l add their width to ``priced[l][i, j]``.
        """
        root = 0 if len(self.children[-1]) > 1 else -1
        start = tuple(np.array([x]) for x in (0, 0, 0, root, root))
        if root < 0:
            priced[self.height][0, 0] += n_columns
            return
        todo = [(self.height, start)]
        while todo:
            level, nodes = todo.pop()
            if not level:
                i, j, _, a, b = nodes
                yield i, j, a, b
                continue
            if level <= TILE and len(nodes[0]) > NODES:
                todo += [(level, tuple(x[at : at + NODES] for x in nodes)) for at in range(0, len(nodes[0]), NODES)]
                continue
            todo.append((level - 1, self._expanded(level, nodes, n_rows, n_columns, priced[level - 1])))

    def _expanded(self, level: int, nodes: tuple[np.ndarray, ...], n_rows: int, n_columns: int, priced: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j, c, a, b = nodes
        below, side, parts = self.children[level], 1 << (level - 1), []
        for r, s, u in ((r, s, u) for r in (0, 1) for s in (0, 1) for u in (0, 1)):
            i2, j2, c2 = 2 * i + r, 2 * j + s, 2 * c + u
            inside = (j2 * side < n_rows) & (i2 * side < n_rows) & (c2 * side < n_columns) & ((i2 < j2) | ((i2 == j2) & (level > 1)))
            i2, j2, c2 = i2[inside], j2[inside], c2[inside]
            a2, b2 = below[a[inside], 2 * r + u], below[b[inside], 2 * s + u]
            zero = (a2 < 0) & (b2 < 0)
            np.add.at(priced, (i2[zero], j2[zero]), np.minimum(side, n_columns - c2[zero] * side))
            parts.append(tuple(x[~zero] for x in (i2, j2, c2, a2, b2)))
        return tuple(np.concatenate(x) for x in zip(*parts))


def pair_values(rows: np.ndarray, columns: np.ndarray, p: np.ndarray, p_zero: np.ndarray, n_columns: int) -> np.ndarray:
    """values[g, h] = sum over columns of floor((p - q) ** 2 / q), p of row g and q of row h.

    ``p`` has the chances of the nonzero counts at (rows, columns), ``p_zero`` those of a zero count in each row.
    """
    n_rows = len(p_zero)
    values = np.zeros((n_rows, n_rows), np.int64)
    if not n_columns or n_rows < 2:
        return values
    tree = QuadTree(rows, columns, n_rows, n_columns)
    priced = [np.zeros((-(-n_rows >> level),) * 2, np.int64) for level in range(tree.height + 1)]
    own = np.append(p[tree.order], 0)
    for g, h, a, b in tree.leaves(n_rows, n_columns, priced):
        x, y = np.where(a < 0, p_zero[g], own[a]), np.where(b < 0, p_zero[h], own[b])
        square = (x - y) ** 2
        np.add.at(values, (g, h), square // y)
        np.add.at(values, (h, g), square // x)
    width = np.zeros((n_rows, n_rows), np.int64)
    for level, part in enumerate(priced):
        width += part.repeat(1 << level, 0)[:n_rows].repeat(1 << level, 1)[:, :n_rows]
    width = np.triu(width, 1)
    width += width.T
    square = (p_zero[:, None] - p_zero[None, :]) ** 2
    return values + width * (square // p_zero[None, :])


def _block(table: pa.Table) -> pa.Table:
    """Pair sums and first terms of one block; rows without a term are the members of the lang with their N and V."""
    lang = table.column("lang")[0].as_py()
    is_member = pc.is_null(table.column("term"))
    members = table.filter(is_member).sort_by("source")
    entries = table.filter(pc.invert(is_member))
    names = members.column("source").combine_chunks()
    totals = members.column("n").to_numpy() + members.column("terms").to_numpy()
    terms = pc.unique(entries.column("term").combine_chunks())
    terms = terms.take(pc.sort_indices(terms))
    rows = pc.index_in(entries.column("source"), names).to_numpy().astype(np.int64)
    columns = pc.index_in(entries.column("term"), terms).to_numpy().astype(np.int64)
    n = entries.column("n").to_numpy()
    kept = int(members.column("terms")[0].as_py())
    if kept:
        p, p_zero = chance(n, totals[rows]), chance(np.zeros(len(names), np.int64), totals)
    else:
        p, p_zero = n, np.ones(len(names), np.int64)
    by_use = np.argsort(np.argsort(-np.bincount(columns, minlength=len(terms)), kind="stable"))  # often used terms first: larger empty quadrants
    values = pair_values(rows, by_use[columns], p, p_zero, len(terms))
    g, h = np.nonzero(~np.eye(len(names), dtype=bool))
    parts = [(names.take(pa.array(g)), "pair", names.take(pa.array(h)), values[g, h])]

    whole = np.zeros(len(terms), np.int64)
    np.add.at(whole, columns, n)
    q = chance(whole, np.int64(max(1, int(members.column("n").to_numpy().sum()) + kept)))[columns]
    more = np.flatnonzero(p > q)
    value = (p[more] - q[more]) ** 2 // q[more]
    ranked = np.lexsort((columns[more], -value, rows[more]))
    more, value = more[ranked], value[ranked]
    starts = np.searchsorted(rows[more], np.arange(len(names)))
    first = np.arange(len(more)) - starts[rows[more]] < TOP
    more, value = more[first], value[first]
    parts.append((names.take(pa.array(rows[more])), "term", terms.take(pa.array(columns[more])), value))
    return pa.concat_tables(
        pa.table(
            [pa.array([lang] * len(v), pa.string()), who.cast(pa.string()), pa.array([part] * len(v), pa.string()), item.cast(pa.string()), pa.array(v, pa.int64())],
            ["lang", "source", "part", "item", "value"],
        )
        for who, part, item, v in parts
    )


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, term, counts (source and n of every source that uses it) of the kept terms."""
    named = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    partial = docs.select(*named).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    entries = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = entries.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return terms.filter(F.col("docs") >= MIN_DOCS).select("lang", "term", "counts")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see the module's text."""
    terms = stored(term_counts(docs, text_col, lang_col, source_col), "divergence-terms")
    sums = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    named = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    groups = docs.select(*named).distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n"])
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.size("counts")).alias("entries"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept, "lang", "left").na.fill(0)
    each = F.greatest(F.lit(block), F.col("sources") * F.col("sources"))
    langs = stored(langs.select("lang", "terms", (1 + F.floor(F.col("entries") / each)).cast("int").alias("blocks")), "divergence-langs")
    members = groups.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "terms"
    )
    placed = join_by_key(terms, langs, "lang", "terms", F.col("term"))
    placed = placed.select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", F.explode("counts").alias("c"))
    counts = placed.select("lang", "block", "c.source", "term", "c.n", F.lit(None).cast("long").alias("terms"))
    found = members.unionByName(counts).groupBy("lang", "block").applyInArrow(
        _block, "lang string, source string, part string, item string, value long"
    )
    found = stored(found, "divergence-blocks")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    first = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(first)
