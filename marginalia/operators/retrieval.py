"""Embedding and top-k retrieval for many papers and questions at once."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import constants as K
from ..functions.quality import is_textual
from ..functions.text import blank_safe, digest_mod, keyword_score, let, once, strip, words
from .skew import first_per_key, hot_join, reliable, running_number, task_count, top_per_key

DIM = 1024
SCORE_DIGITS = 9


# --- embedding -------------------------------------------------------------------


def document_text(text: Column, caption: Column) -> Column:
    """V-02: what gets embedded, null when there is nothing."""
    return F.nullif(strip(F.coalesce(F.nullif(text, F.lit("")), caption)), F.lit(""))


def usable_vector(vector: Column, dim: int) -> Column:
    """V-02: an image vector of another dimension is discarded."""
    return F.when(F.size(vector) == dim, vector)


def embeddable(chunks: DataFrame, dim: int) -> DataFrame:
    """V-02: rows that can be embedded, with their text and usable image vector."""
    out = chunks.withColumn("document", document_text(F.col("text"), F.col("caption")))
    out = out.withColumn("image_vector", usable_vector(F.col("image_vector"), dim))
    return out.filter(F.col("document").isNotNull() | F.col("image_vector").isNotNull())


def encode(chunks: DataFrame, encoder: Callable[[Sequence[str]], Sequence[Sequence[float]]], text: str = "document") -> DataFrame:
    """V-02: vectors from a caller's batch encoder, one Arrow batch at a time."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = encoder(frame[text].tolist())
            yield frame.assign(embedding=[[float(v) for v in vector] for vector in vectors])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(batches, fields + ", embedding array<double>")


def bucket_of(token: Column, dim: int) -> Column:
    if 4096 % dim == 0:  # the low twelve bits of the digest decide
        return (F.conv(F.right(F.md5(token), F.lit(3)), 16, 10).cast("int") % dim).cast("int")
    return digest_mod(F.md5(token), dim, digits=32).cast("int")


def hash_vector(text: Column, dim: int = DIM) -> Column:
    """V-01: sparse normalised bag of hashed words, as struct(buckets, weights).

    Sorting the bucket numbers and measuring the runs keeps the whole vector
    inside its row: no token ever crosses a shuffle.
    """

    def runs(sorted_buckets: Column) -> Column:
        count = F.size(sorted_buckets)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda i: (i <= count)
            & ((i == 1) | (F.try_element_at(sorted_buckets, i) != F.try_element_at(sorted_buckets, F.greatest(i - 1, F.lit(1))))),
        )
        return let(starts, lambda at: measure(sorted_buckets, at, count))

    def measure(sorted_buckets: Column, at: Column, count: Column) -> Column:
        ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at), F.lit(1))), F.array(count + 1))
        sizes = F.zip_with(at, ends, lambda a, b: (b - a).cast("double"))
        buckets = F.transform(at, lambda i: F.element_at(sorted_buckets, i))
        def scaled(n: Column) -> Column:
            norm = F.sqrt(F.aggregate(n, F.lit(0.0), lambda acc, x: acc + x * x))
            return let(
                norm, lambda d: F.struct(buckets.alias("buckets"), F.transform(n, lambda v: v / d).alias("weights"))
            )

        return let(sizes, scaled)

    hashed = F.array_sort(F.transform(words(F.lower(blank_safe(text))), lambda t: bucket_of(t, dim)))
    return F.when(
        strip(text) == "",
        F.struct(F.array().cast("array<int>").alias("buckets"), F.array().cast("array<double>").alias("weights")),
    ).otherwise(let(hashed, runs))


def with_hash_vector(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    vector = chunks.withColumn("_v", F.explode(F.array(hash_vector(F.col("text"), dim))))
    return vector.withColumn("buckets", F.col("_v.buckets")).withColumn("weights", F.col("_v.weights")).drop("_v")


def vector_rows(embedded: DataFrame) -> DataFrame:
    """One row per non-zero component."""
    pairs = F.explode(F.arrays_zip("buckets", "weights")).alias("z")
    return embedded.select("chunk_id", pairs).select("chunk_id", F.col("z.buckets").alias("bucket"), F.col("z.weights").alias("weight"))


def fixed_query_vector(text: str, dim: int = DIM) -> dict[int, float]:
    """Vector of a constant query; there are at most a dozen of them."""
    counts = Counter(int(hashlib.md5(t.encode()).hexdigest(), 16) % dim for t in text.lower().split())
    norm = math.sqrt(sum(v * v for v in counts.values())) or 1.0
    return {bucket: n / norm for bucket, n in counts.items()}


def score_fixed_queries(embedded: DataFrame, queries: list[str], dim: int = DIM) -> DataFrame:
    """V-04/V-05: every chunk against a fixed list of queries, in one narrow pass.

    Components no query uses are dropped first, then each query adds up the few
    that remain. Adds ``query_no`` and ``score``; no join and no shuffle.
    """
    vectors = [fixed_query_vector(query, dim) for query in queries]
    wanted = sorted(set().union(*vectors))
    pairs = F.filter(F.arrays_zip("buckets", "weights"), lambda z: z["buckets"].isin(wanted))

    def dot(hits: Column, vector: dict[int, float]) -> Column:
        lookup = F.create_map(*[F.lit(v) for pair in sorted(vector.items()) for v in pair])
        return F.round(
            F.aggregate(
                hits, F.lit(0.0), lambda acc, z: acc + z["weights"] * F.coalesce(F.try_element_at(lookup, z["buckets"]), F.lit(0.0))
            ),
            SCORE_DIGITS,
        )

    hits = embedded.withColumn("_hits", F.explode(F.array(pairs)))
    scores = F.array(*[dot(F.col("_hits"), v) for v in vectors])
    return hits.select("*", F.posexplode(scores).alias("query_no", "score")).drop("_hits", "buckets", "weights")


def sweep(embedded: DataFrame, queries: list[str], k: int) -> DataFrame:
    """V-05: top ``k`` chunks per paper and query."""
    order = [F.desc("score"), F.col("chunk_id")]
    return top_per_key(score_fixed_queries(embedded, queries), ["paper_id", "query_no"], order, k, "rank")


def sweep_by_chunk(chunks: DataFrame, queries: list[str], k: list[int]) -> DataFrame:
    """V-05 with one row per chunk: ``hits``, an array of (query_no, rank), for the chunks among the ``k[query_no]`` best.

    Only ids and scores are ranked. A paper's hits, at most ``sum(k)``, then meet its
    chunks, so a text crosses one shuffle whatever the number of queries, and the rows
    of a paper lie together for the windows that follow. The hits are stored and counted
    first: they tell how many tasks keep those windows in memory.
    """
    slim = with_hash_vector(chunks.select("paper_id", "chunk_id", "text")).drop("text")
    order = [F.desc("score"), F.col("chunk_id")]
    top = top_per_key(score_fixed_queries(slim, queries), ["paper_id", "query_no"], order, max(k), "rank")
    wanted = F.element_at(F.array(*[F.lit(n) for n in k]), F.col("query_no") + 1)
    listed = top.filter(F.col("rank") <= wanted).groupBy("paper_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("query_no", "rank"))).alias("hits")
    )
    listed = reliable(listed)
    parts = task_count(listed)
    found = listed.repartition(parts, "paper_id").groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "hits"))).alias("_found"))
    met = chunks.repartition(parts, "paper_id").join(found, "paper_id").withColumn("hits", F.try_element_at("_found", F.col("chunk_id"))).drop("_found")
    return first_per_key(met.filter(F.col("hits").isNotNull()), ["paper_id", "chunk_id"], [F.col("text")])


HOT_POSTINGS = 4096  # postings of one (paper, bucket, impact) beyond which they are spread over parts
HOT_BLOCKS = 1000  # blocks spread; by pigeonhole any other holds less than a thousandth of all postings
POSTING_PARTS = 32
IMPACTS = 32  # impact classes; class n holds the weights in (2 ** -(n + 1) / 2, 2 ** -n / 2]


def postings(chunks: DataFrame, key: str, weight: str) -> DataFrame:
    """One row per non-zero component: key, paper_id, bucket, weight."""
    pairs = F.explode(F.arrays_zip("buckets", "weights")).alias("z")
    return chunks.select(key, "paper_id", pairs).select(key, "paper_id", F.col("z.buckets").alias("bucket"), F.col("z.weights").alias(weight))


def impact_class(weight: Column) -> Column:
    """0 for the largest weights; each class halves the square root of the weight range."""
    return F.least(F.lit(IMPACTS - 1), F.greatest(F.lit(0), F.floor(-2 * F.log2(weight)))).cast("int")


def posting_blocks(posted: DataFrame) -> DataFrame:
    """The postings of a (paper, bucket) cut by impact: paper_id, bucket, impact, n, low, high."""
    return posted.groupBy("paper_id", "bucket", "impact").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))


def needed_blocks(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """question_id, paper_id, bucket, impact of the blocks in which one of the ``k`` best chunks may show up.

    Within a bucket, blocks in order of impact tell a weight that ``k`` postings reach:
    times the question's weight, a score that ``k`` chunks are known to have. Buckets whose
    highest weights together stay below the best such score are not read: a chunk above
    it shows up in another bucket. Of the others a block is needed if its highest weight,
    with those of all the question's other buckets, can reach the score.
    ``asked``: question_id, paper_id, bucket, q.
    """
    listed = blocks.groupBy("paper_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("impact", "n", "low", "high"))).alias("blocks"))
    met = asked.join(listed, ["paper_id", "bucket"])  # at most IMPACTS entries a row

    def reach(blocks: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("low"))
        step = lambda acc, b: F.when(acc["n"] >= k, acc).otherwise(F.struct((acc["n"] + b["n"]).alias("n"), b["low"].alias("low")))
        return F.aggregate(blocks, start, step, lambda acc: F.when(acc["n"] >= k, acc["low"]).otherwise(0.0))

    rows = met.select(
        "question_id", "paper_id", "bucket", "q", "blocks", (F.col("q") * reach(F.col("blocks"))).alias("_known"),
        (F.col("q") * F.array_max(F.transform("blocks", lambda b: b["high"]))).alias("_most"),
    )
    whole = W.partitionBy("question_id", "paper_id")  # a question has as many rows as distinct words
    upward = whole.orderBy("_most", "bucket").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_threshold", F.max("_known").over(whole)).withColumn("_others", F.sum("_most").over(whole) - F.col("_most"))
    rows = rows.withColumn("_so_far", F.sum("_most").over(upward)).filter(F.col("_so_far") >= F.col("_threshold") - F.lit(1e-8))
    wanted = F.filter("blocks", lambda b: F.col("q") * b["high"] + F.col("_others") >= F.col("_threshold") - F.lit(1e-8))
    return rows.select("question_id", "paper_id", "bucket", F.explode(F.transform(wanted, lambda b: b["impact"])).alias("impact"))


FEW_QUESTIONS = 64  # questions of one paper that a chunk may meet in one row


def about_asked(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """The rows of papers that a question is about; the rest need not be read any further."""
    return rows.join(questions.select("paper_id").distinct(), "paper_id", "left_semi")


def by_number_asked(questions: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Questions of papers with at most ``FEW_QUESTIONS`` of them, and the others, None where there are none."""
    counted = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW_QUESTIONS)
    many = reliable(counted.select("paper_id"))
    if many.isEmpty():
        return questions, None
    return questions.join(many, "paper_id", "left_anti"), questions.join(many, "paper_id", "left_semi")


def with_asked(rows: DataFrame, questions: DataFrame, *columns: Column | str) -> DataFrame:
    """``rows`` of papers asked about, with ``_asked``: their questions, at most ``FEW_QUESTIONS`` structs of ``columns``."""
    listed = questions.groupBy("paper_id").agg(F.collect_list(F.struct(*columns)).alias("_asked"))
    return about_asked(rows, questions).join(listed, "paper_id")


def _dot(pairs: Column, held: Column) -> Column:
    return F.round(F.aggregate(pairs, F.lit(0.0), lambda acc, z: acc + z["weights"] * F.coalesce(F.try_element_at(held, z["buckets"]), F.lit(0.0))), SCORE_DIGITS)


def _scored_in_place(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, paper_id, chunk_id, score of every chunk of a paper and its few questions."""
    held = F.map_from_arrays("buckets", "weights").alias("_c")
    met = with_asked(chunks.select("chunk_id", "paper_id", held), questions, "question_id", F.arrays_zip("buckets", "weights").alias("q"))
    scores = F.transform("_asked", lambda a: F.struct(a["question_id"].alias("question_id"), _dot(a["q"], F.col("_c")).alias("score")))
    return met.select("paper_id", "chunk_id", F.explode(scores).alias("s")).select("s.question_id", "paper_id", "chunk_id", "s.score")


def sparse_nearest(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """V-04: the ``k`` best chunks of each question's paper, whatever their score.

    ``questions`` and ``chunks`` hold (id, paper_id, buckets, weights). A chunk meets
    the few questions of its paper in one row, and only ids and scores move on. Papers
    with more than ``FEW_QUESTIONS`` go through :func:`_scored_by_postings`.
    """
    few, many = by_number_asked(questions)
    scored = _scored_in_place(few, chunks)
    if many is not None:
        scored = scored.unionByName(_scored_by_postings(many, about_asked(chunks, many), k))
    either = scored.groupBy("question_id", "paper_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_per_key(either, ["question_id"], [F.desc("score"), F.col("chunk_id")], k, "rank")


def _scored_by_postings(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """question_id, paper_id, chunk_id, score of all chunks that may be among the ``k`` best.

    Postings lie in blocks of like impact; a question reads only the blocks that can hold one of
    its ``k`` best, and the chunks found there are scored whole, on their own
    vectors. Large blocks are spread over parts. A question with fewer than ``k``
    such chunks is filled up with score 0 from its paper's first chunks, of which
    ``k`` suffice.
    """
    posted = postings(chunks, "chunk_id", "c").withColumn("impact", impact_class(F.col("c")))
    keys = ["paper_id", "bucket", "impact"]
    blocks = reliable(posting_blocks(posted))
    hot = blocks.filter(F.col("n") > HOT_POSTINGS).orderBy(F.desc("n"), *keys).limit(HOT_BLOCKS).select(*keys, F.lit(True).alias("_hot"))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("chunk_id"), F.lit(POSTING_PARTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(POSTING_PARTS - 1))).otherwise(F.array(F.lit(0)))
    needed = needed_blocks(postings(questions, "question_id", "q"), blocks, k)
    needed = needed.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    spread = posted.drop("c").join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_hot")
    found = needed.join(spread, [*keys, "_part"]).select("question_id", "paper_id", "chunk_id").distinct()
    vectors = chunks.select("chunk_id", "paper_id", F.map_from_arrays("buckets", "weights").alias("_c"))
    texts = questions.select("question_id", "paper_id", F.arrays_zip("buckets", "weights").alias("_q"))
    both = found.join(vectors, ["chunk_id", "paper_id"]).join(texts, ["question_id", "paper_id"])
    scored = both.select("question_id", "paper_id", "chunk_id", _dot(F.col("_q"), F.col("_c")).alias("score"))
    best = top_per_key(scored, ["question_id"], [F.desc("score"), F.col("chunk_id")], k, "rank").drop("rank")
    first = top_per_key(chunks.select("paper_id", "chunk_id"), ["paper_id"], [F.col("chunk_id")], k, "_n").drop("_n")
    blank = questions.select("question_id", "paper_id").join(first, "paper_id").withColumn("score", F.lit(0.0))
    return best.unionByName(blank)


# --- dense top-k ----------------------------------------------------------------

SAMPLE_ROWS = 4096  # vectors that fix the centroids and the first thresholds; at most SAMPLE_BYTES
SAMPLE_BYTES = 32 << 20
CELLS = 256
BLOCK_ROWS = 8192  # vectors in one block
QUESTION_ROWS = 1024  # questions that meet a block at a time
SLACK = 1e-8  # scores are rounded, bounds are not


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms == 0, 1e-9, norms)[:, None]


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of a list column without nulls; an empty column has no dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _page_span(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest page of each question, NaN without a range."""
    ends = [rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("page_lo", "page_hi")]
    low, high = np.fmin(*ends), np.fmax(*ends)
    return np.maximum(low, 1), np.maximum(high, 1)


def _pages(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


class Cells:
    """Centroids of a bounded sample of the vectors, and each cell's size and radius.

    A score inside a cell lies within ``question * centroid +- radius`` (Cauchy-Schwarz
    on the vector's distance from its centroid), so a cell whose upper bound is below
    ``k`` known scores of a question is skipped.
    """

    def __init__(self, sample: pa.Table, cells: int = CELLS, rounds: int = 4) -> None:
        self.sample, self.pages = _units(sample.column("embedding")), _pages(sample.column("page"))
        self.centroids = self.sample[:: max(1, len(self.sample) // cells)][:cells]
        for _ in range(rounds if len(self.sample) else 0):
            own = np.argmax(self.sample @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)
            sums, sizes = np.zeros_like(self.centroids), np.bincount(own, minlength=len(self.centroids))
            np.add.at(sums, own, self.sample)
            self.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centroids)
        self.sizes, self.radii = np.zeros(len(self.centroids), int), np.zeros(len(self.centroids))

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cell of each vector and the distance from its centroid."""
        cell = np.argmax(units @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)
        return cell, np.linalg.norm(units - self.centroids[cell], axis=1)

    def visits(self, units: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """For each question, the cells that may hold one of its ``k`` best: a boolean matrix."""
        middle = units @ self.centroids.T
        spread = np.linalg.norm(units, axis=1)[:, None] * self.radii[None, :]
        known = units @ self.sample.T
        ranged = ~np.isnan(low)
        outside = ranged[:, None] & ~((self.pages >= low[:, None]) & (self.pages <= high[:, None]))
        known[outside] = -np.inf
        least = np.full(len(units), -np.inf)
        if known.shape[1] >= k:
            least = np.partition(known, -k, axis=1)[:, -k]
        # cells by their lower bound: the one in which the k-th vector falls bounds the k-th score as well
        order = np.argsort(-(middle - spread), axis=1)
        reached = np.cumsum(self.sizes[order], axis=1) >= k
        at = np.take_along_axis(order, reached.argmax(axis=1)[:, None], 1)
        by_cell = np.where(reached.any(axis=1) & ~ranged, np.take_along_axis(middle - spread, at, 1)[:, 0], -np.inf)
        return (middle + spread >= np.maximum(least, by_cell)[:, None] - SLACK) & (self.sizes > 0)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def fit_cells(vectors: DataFrame, cells: int = CELLS) -> tuple[Cells, DataFrame]:
    """Cells, and the vectors with ``cell``. The sample, and one row per cell, are all that reaches the driver."""
    dim = vectors.select(F.size("embedding").alias("d")).first()
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * max(1, dim[0] if dim else 1))))
    sample = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(rows).select("embedding", "page")
    fitted = Cells(sample.toArrow(), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = fitted.place(_units(batch.column("embedding")))
                yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("far", pa.array(far, pa.float64()))

    placed = reliable(vectors.mapInArrow(place, f"{_fields(vectors)}, cell int, far double"))
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():
        fitted.sizes[row["cell"]], fitted.radii[row["cell"]] = row["n"], row["r"]
    return fitted, placed.drop("far")


def route(questions: DataFrame, cells: Cells, k: int) -> DataFrame:
    """One row per question and cell that it has to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                question, cell = np.nonzero(cells.visits(_units(batch.column("embedding")), *_page_span(batch), k))
                yield batch.take(pa.array(question)).append_column("cell", pa.array(cell, pa.int32()))

    return questions.mapInArrow(run, f"{_fields(questions)}, cell int")


def _block_top_k(k: int, per_paper: bool, schema: pa.Schema):
    """Best ``k`` of one block of vectors for one block of questions."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.sort_by("chunk_id")  # ties go by id: a stable sort by score keeps this order
        scores = np.round(_units(asked.column("embedding")) @ _units(held.column("embedding")).T, SCORE_DIGITS)
        both = pa.chunked_array(asked.column("paper_id").chunks + held.column("paper_id").chunks, held.schema.field("paper_id").type)
        codes = both.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        wanted, paper = codes[: asked.num_rows], codes[asked.num_rows :]
        scoped = asked.column("paper_id").is_valid().to_numpy()
        low, high = _page_span(asked)
        page = _pages(held.column("page"))
        who, which = [], []
        for i in range(asked.num_rows):
            keep = paper == wanted[i] if scoped[i] else np.ones(len(page), bool)
            if not np.isnan(low[i]):
                keep &= (page >= low[i]) & (page <= high[i])
            at = np.flatnonzero(keep)
            if per_paper:
                at = at[np.lexsort((-scores[i, at], paper[at]))]
                starts = np.flatnonzero(np.r_[True, paper[at][1:] != paper[at][:-1]]) if len(at) else np.zeros(0, int)
                at = at[np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)])) < k]
            else:
                at = at[np.argsort(-scores[i, at], kind="stable")][:k]
            who.append(np.full(len(at), i))
            which.append(at)
        who, which = np.concatenate(who), np.concatenate(which)
        columns = [asked.column("question_id").take(pa.array(who)), *(held.column(c).take(pa.array(which)) for c in ("paper_id", "chunk_id"))]
        return pa.table([*columns, pa.array(scores[who, which])], names=schema.names).cast(schema)

    return run


def _met(asked: DataFrame, held: DataFrame, sizes: DataFrame, questions: int, k: int, per_paper: bool) -> DataFrame:
    """Candidates of every (cell, part, question block): blocks of vectors meet blocks of questions.

    asked  a question per row and ``cell`` it visits; held  vectors with ``cell``; sizes  cell, parts.
    """
    slices = max(1, math.ceil(questions / QUESTION_ROWS))
    asked = asked.withColumn("_slice", F.pmod(F.xxhash64("question_id"), F.lit(slices)).cast("int"))
    visited = asked.select("cell", "_slice").distinct()
    left = asked.join(sizes, "cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    places = sizes.join(visited, "cell").groupBy("cell", "parts").agg(F.collect_list("_slice").alias("slices"))
    right = hot_join(held, places, ["cell"], F.col("chunk_id"), "inner")
    right = right.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
    right = right.withColumn("_slice", F.explode("slices")).drop("slices", "parts")
    types = {f.name: f.dataType for f in held.schema.fields} | {"question_id": asked.schema["question_id"].dataType}
    names = ["question_id", "paper_id", "chunk_id"]
    schema = pa.schema([*[(c, to_arrow_type(types[c])) for c in names], ("score", pa.float64())])
    ddl = ", ".join(f"{c} {types[c].simpleString()}" for c in names) + ", score double"
    keys = ["cell", "_part", "_slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_top_k(k, per_paper, schema), ddl)


def nearest(questions: DataFrame, vectors: DataFrame, k: int, per_paper: bool = False) -> DataFrame:
    """V-03, V-05, V-06, V-07: exact cosine top-k.

    questions  question_id, embedding, paper_id (null = all papers), page_lo, page_hi (null = all pages)
    vectors    chunk_id, paper_id, page, embedding

    Vectors lie in cells. For open questions a cell surrounds a centroid, and a
    question visits only the cells whose bound reaches the score that ``k`` vectors
    are known to have; for questions about one paper, or about each paper, a cell
    is a hash bucket of papers. Cells are cut into parts of ``BLOCK_ROWS``; each
    part meets the questions that visit it, ``QUESTION_ROWS`` at a time, in one
    matrix product that keeps its own best ``k``. The vectors are scanned for the
    sample and once to be placed, whatever the number of questions.

    A null embedding of a question or chunk takes no part; the norm of a zero vector counts as
    1e-9, so it scores 0; ties go by ``chunk_id``; page bounds are clamped to 1 and swapped if
    inverted, and a chunk without a page is outside every range.
    """
    vectors = vectors.select("chunk_id", "paper_id", "page", "embedding").filter(F.col("embedding").isNotNull())
    asked = questions.select("question_id", "embedding", F.col("paper_id").cast(vectors.schema["paper_id"].dataType).alias("paper_id"), "page_lo", "page_hi")
    asked = reliable(asked.filter(F.col("embedding").isNotNull()))
    number = asked.count()
    by_paper = asked if per_paper else asked.filter(F.col("paper_id").isNotNull())
    found = []
    if not by_paper.isEmpty():
        found.append(_by_paper(by_paper, vectors, number, k, per_paper))
    if not per_paper and not (is_open := asked.filter(F.col("paper_id").isNull())).isEmpty():
        cells, placed = fit_cells(vectors)
        sizes = [(i, max(1, math.ceil(n / BLOCK_ROWS))) for i, n in enumerate(cells.sizes.tolist()) if n]
        sizes = vectors.sparkSession.createDataFrame(sizes, "cell int, parts int")
        found.append(_met(route(is_open, cells, k), placed, sizes, number, k, False))
    if not found:
        types = dict(asked.dtypes) | dict(vectors.dtypes)
        names = ", ".join(f"{c} {types[c]}" for c in ("question_id", "paper_id", "chunk_id"))
        return vectors.sparkSession.createDataFrame([], f"{names}, score double, rank int")
    keys = ["question_id", "paper_id"] if per_paper else ["question_id"]
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return top_per_key(hits, keys, [F.desc("score"), F.col("chunk_id")], k, "rank")


def _by_paper(asked: DataFrame, vectors: DataFrame, number: int, k: int, per_paper: bool) -> DataFrame:
    """Questions about one paper visit its bucket, questions about each paper all buckets."""
    buckets = max(1, math.ceil(vectors.count() / BLOCK_ROWS))
    cell = F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int")
    held = vectors.withColumn("cell", cell)
    sizes = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    if per_paper:
        routed = asked.withColumn(
            "cell", F.explode(F.when(F.col("paper_id").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(cell)))
        )
    else:
        routed = asked.withColumn("cell", cell)
    return _met(routed, held, sizes, number, k, per_paper)


def distance_score(score: Column) -> Column:
    """V-03: the vector-store form of the score, never negative."""
    return F.greatest(F.lit(0.0), score)


# --- pools ---------------------------------------------------------------------


def first_seen(hits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """V-09 / X-02: a chunk found by several queries counts where it came first."""
    return first_per_key(hits, [*keys, "chunk_id"], order)


def round_robin_by_page(pool: DataFrame, buckets: int = K.POOL_BUCKETS) -> DataFrame:
    """V-11: interleave page buckets; order by ``turn, bucket``."""
    span = pool.groupBy("paper_id").agg(F.min("page").alias("_low"), F.max("page").alias("_high"))
    width = F.greatest(F.lit(1), F.floor((F.col("_high") - F.col("_low") + 1) / buckets))
    rows = pool.join(span, "paper_id").withColumn(
        "bucket", F.least(F.floor((F.col("page") - F.col("_low")) / width), F.lit(buckets - 1)).cast("int")
    )
    order = [F.col("page"), F.col("chunk_id")]
    return running_number(rows.drop("_low", "_high"), ["paper_id", "bucket"], "page", order, "turn")


def keyword_scores(chunks: DataFrame, text: str) -> DataFrame:
    """V-14 in place: ``scores``, the keywords of each section in ``text``; null for pictures and rows without text."""
    written = F.when(F.col("modality").isin("text", "ocr"), F.lower(F.col(text)))
    scores = F.array(*[keyword_score(F.col("_low_text"), keywords) for keywords in K.SECTION_KEYWORDS.values()])
    lowered = chunks.withColumn("_low_text", once(written))
    return lowered.withColumn("scores", once(F.when(F.col("_low_text").isNotNull(), scores))).drop("_low_text")


def fallback_bucket(chunks: DataFrame) -> DataFrame:
    """V-14: the 18 chunks with the most section keywords, or the first 18 without any.

    Adds ``section`` and ``score``; sections are scored inside each chunk row.
    """
    low = F.col("_low")
    scores = F.array(
        *[
            F.struct(F.lit(name).alias("section"), keyword_score(low, keywords).alias("score"))
            for name, keywords in K.SECTION_KEYWORDS.items()
        ]
    )
    written = chunks.filter(F.col("modality").isin("text", "ocr"))
    lowered = written.withColumn("_low", once(F.lower(blank_safe(F.col("text")))))
    rows = lowered.select("*", F.explode(scores).alias("s")).select("*", "s.section", "s.score").drop("s", "_low")
    order = [F.desc("score"), F.col("rank"), F.col("chunk_id")]
    best = top_per_key(rows, ["paper_id", "section"], order, K.FALLBACK_CHUNKS_PER_SECTION, "place")
    top = F.max("score").over(W.partitionBy("paper_id", "section"))
    return best.withColumn("_top", top).filter((F.col("score") > 0) | (F.col("_top") == 0)).drop("_top")


def relevant_figures(questions: DataFrame, media: DataFrame, used_pages: DataFrame, k: int = 3) -> DataFrame:
    """V-13: figures of the question's paper by number asked, page used and shared words.

    questions(question_id, paper_id, text), media(paper_id, media_id, position, label, caption, page),
    used_pages(question_id, page).
    """
    asked = F.transform(
        F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:fig(?:ure)?s?|tables?)\.?\s*(\d{1,2})\b"), F.lit(1)), lambda n: n.cast("int")
    )

    def long_words(c: Column) -> Column:
        found = F.regexp_extract_all(F.lower(blank_safe(c)), F.lit("[a-z0-9]+"), F.lit(0))
        return F.array_distinct(F.filter(found, lambda w: F.length(w) > 3))

    q = questions.select("question_id", "paper_id", asked.alias("asked"), long_words(F.col("text")).alias("q_words"))
    m = media.select(
        "paper_id", "media_id", "position", "page", "label",
        F.regexp_extract("label", r"(\d{1,3})\s*$", 1).try_cast("int").alias("number"),
        long_words(F.col("caption")).alias("m_words"),
    )
    few, many = by_number_asked(q)
    scored = _figures_in_place(few, m, used_pages)
    if many is not None:
        scored = scored.unionByName(_figures_by_joins(many, about_asked(m, many), used_pages))
    return top_per_key(scored.filter(F.col("score") > 0), ["question_id"], [F.desc("score"), F.col("position")], k, "rank").select(
        "question_id", "media_id", "label", "score", "rank"
    )


def _figure_score(asked: Column, used: Column, common: Column) -> Column:
    return F.when(asked, 10).otherwise(0) + F.when(used, 3).otherwise(0) + F.least(F.lit(3), common)


def _figures_in_place(q: DataFrame, m: DataFrame, used_pages: DataFrame) -> DataFrame:
    """A figure meets the few questions of its paper in one row."""
    pages = used_pages.groupBy("question_id").agg(F.collect_set("page").alias("pages"))
    met = with_asked(m, q.join(pages, "question_id", "left"), "question_id", "asked", "q_words", "pages")

    def score(a: Column) -> Column:
        common = F.size(F.array_intersect(a["q_words"], F.col("m_words")))
        return _figure_score(F.array_contains(a["asked"], F.col("number")), F.array_contains(a["pages"], F.col("page")), common)

    scores = F.transform("_asked", lambda a: F.struct(a["question_id"].alias("question_id"), score(a).alias("score")))
    return met.select("media_id", "label", "position", F.explode(scores).alias("s")).select("s.question_id", "media_id", "label", "position", "s.score")


def _figures_by_joins(q: DataFrame, m: DataFrame, used_pages: DataFrame) -> DataFrame:
    """A pair scores only by a number, a page or a word that both name, so each of them is an equi-join."""
    used = used_pages.distinct().withColumn("used", F.lit(True))
    by_number = q.select("question_id", "paper_id", F.explode("asked").alias("number")).join(m, ["paper_id", "number"])
    by_page = q.select("question_id", "paper_id").join(used, "question_id").join(m, ["paper_id", "page"])
    by_word = q.select("question_id", "paper_id", F.explode("q_words").alias("_w")).join(
        m.select("paper_id", "media_id", F.explode("m_words").alias("_w")), ["paper_id", "_w"]
    )
    met = [rows.select("question_id", "paper_id", "media_id") for rows in (by_number, by_page, by_word)]
    found = met[0].unionByName(met[1]).unionByName(met[2]).distinct()
    pairs = found.join(q, ["question_id", "paper_id"]).join(m, ["paper_id", "media_id"]).join(used, ["question_id", "page"], "left")
    score = _figure_score(F.array_contains("asked", F.col("number")), F.col("used"), F.size(F.array_intersect("q_words", "m_words")))
    return pairs.withColumn("score", score).select("question_id", "media_id", "label", "position", "score")


def grounding_ids(cited: Column, retrieved: Column) -> Column:
    """V-16: chunk ids the citations point at, else the retrieved ones."""
    grounded = F.array_distinct(F.filter(F.transform(cited, lambda c: c["chunk_id"]), lambda i: blank_safe(i) != ""))
    return F.when(F.size(grounded) > 0, grounded).otherwise(retrieved)


def write_by_dimension(vectors: DataFrame, path: str) -> None:
    """V-15: one directory per vector dimension, so a changed encoder never mixes in."""
    vectors.withColumn("dim", F.size("embedding")).write.mode("overwrite").partitionBy("dim").parquet(path)


def read_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.filter(F.col("dim") == dim)


def textual(chunks: DataFrame) -> DataFrame:
    return chunks.filter(is_textual(F.col("modality"), F.col("text")))
