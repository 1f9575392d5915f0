"""MinHash near-deduplication (operator 9) with circulant permutations.

Two permutations give all coordinates of a signature: the first scatters the
shingles, the second is shifted circularly by k for coordinate k. The K shifted
values of one shingle are neighbours in the second permutation, so a signature
is the minimum over short slices of one array.

1. Texts with equal shingle sets form a class; classes are compared, not copies.
2. Signatures are cut into bands; classes that share a band are candidates. In
   every band bucket each class is compared with one centre, the one that meets
   most others over all its bands; that is linear in the bucket. Links are
   confirmed on the full shingle sets.
3. Linked classes form components. Buckets whose classes ended in different
   components may still hold links that no centre saw. Their classes go through
   an exact prefix filter over shingles, which finds every link between different
   components without forming the pairs of a bucket.

With 32 bands of 4 rows a pair at similarity 0.75 misses every band with
probability 5e-6. Hot buckets, classes and components are spread over salts.

Defined cases: null and empty texts have no shingles and are linked with
nothing; a null id takes part and never becomes a component id unless its
component has no other; rows that repeat id and text are one document; where an
id names two texts of a component the one with the smaller digest stays; an empty table gives no
rows; further columns never clash with internal names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash128, join_by_key, stored
from .shingles import WIDTH, linked, mix, shingle_sets

UNIVERSE_BITS = 20
BANDS, ROWS = 32, 4
PERCENT = 75
SLICE = 4096  # shingles whose slices are gathered at a time
TEXTS = 256  # texts hashed together


class CirculantMinHash:
    """Signatures of ``size`` coordinates from two permutations of a universe of 2 ** bits."""

    def __init__(self, size: int, bits: int = UNIVERSE_BITS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.shift = size, np.uint64(64 - bits)
        self.scatter, circle = (rng.permutation(np.arange(1 << bits, dtype=np.int32)) for _ in range(2))
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[: size - 1]]), size)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[(shingles >> self.shift).astype(np.int64)]
        best = np.full(self.size, np.iinfo(np.int32).max, np.int32)
        for at in range(0, len(places), SLICE):
            np.minimum(best, self.slices[places[at : at + SLICE]].min(axis=0), out=best)
        return best


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per signature and band."""
    cut = signed.reshape(-1, bands, rows).astype(np.uint64)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for row in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, row])
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    with np.errstate(over="ignore"):
        one = int(mix(shingles + np.uint64(7)).sum(dtype=np.uint64))
        two = int(mix(shingles ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64))
    return one.to_bytes(8, "big") + two.to_bytes(8, "big")


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int) -> DataFrame:
    """_id, digest, n, set_key, bands of every row; digest names the text, set_key is null without shingles."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(docs[id_col].alias("_id"), hash128(text).alias("digest"), text.alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = CirculantMinHash(bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = shingle_sets(part.column("_text").to_pylist(), width)
                keys = band_keys(np.stack([sign(s) for s in sets]), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        part.column("digest"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([k if len(s) else None for s, k in zip(sets, keys)], pa.list_(pa.int64())),
                    ],
                    ["_id", "digest", "n", "set_key", "bands"],
                )

    return source.mapInArrow(run, f"_id {kind}, digest binary, n long, set_key binary, bands array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are linked."""
    left = pairs.join(texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a")), "a")
    sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_weight"))
    right = sizes.join(texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b")), "b")
    both = join_by_key(left, right, "b", "_weight", F.col("a")).select("a", "b", "text_a", "text_b")
    both = both.sortWithinPartitions("b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ones = shingle_sets(part.column("text_a").to_pylist(), width)
                keep = []
                for i, one in enumerate(ones):
                    b = part.column("b")[i].as_py()
                    if b != last:
                        last, own = b, shingle_sets([part.column("text_b")[i].as_py()], width)[0]
                    keep.append(linked(one, own, percent))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _rare_pairs(classes: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of classes with different roots that can be linked, by an exact prefix filter.

    Shingles are ordered: first those held by one root only, then by the number
    of classes that hold them. Two linked sets share a shingle among the first
    n - ceil(n * percent / 100) + 1 of each; only shingles held by several roots
    can give a pair, so a class whose own part fills its prefix gives none. A
    pair is formed at its first common shingle: what follows it in either set
    bounds the intersection and must reach the size that a link needs.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                spelled = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.select(["set_key", "n", "root"]).columns, spelled], ["set_key", "n", "root", "shingles"])

    schema = "set_key binary, n long, root binary, shingles array<long>"
    spelled = classes.join(texts, "set_key").select("set_key", "n", "root", "text").mapInArrow(spell, schema)
    held = stored(spelled, "shingles").select("set_key", "n", "root", F.explode("shingles").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    counts = stored(counts.filter("lo <> hi").select("shingle", "held"), "shared-shingles")
    shared = join_by_key(held, counts, "shingle", "held", F.col("set_key"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = F.array_sort(F.collect_list(F.struct("held", "shingle")))
    own = shared.groupBy("set_key", "n", "root").agg(ranked.alias("ranked"))
    alone = F.col("n") - F.size("ranked")
    first = F.slice("ranked", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))
    rare = own.select("set_key", "n", "root", alone.alias("alone"), F.posexplode(first).alias("at", "s"))
    rare = stored(rare.select("set_key", "n", "root", "s.shingle", (F.col("n") - F.col("alone") - F.col("at")).alias("rest")), "prefixes")
    one, two = (rare.select("shingle", *[F.col(c).alias(c + x) for c in ("set_key", "n", "root", "rest")]) for x in ("_a", "_b"))
    total = F.col("n_a") + F.col("n_b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    reach = (100 + percent) * F.least("rest_a", "rest_b") >= percent * total
    met = one.join(two, "shingle").filter((F.col("root_a") != F.col("root_b")) & (F.col("set_key_a") > F.col("set_key_b")) & fits & reach)
    return met.select(F.col("set_key_a").alias("a"), F.col("set_key_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected edges (a, b); the root is the smallest node of its component.

    Alternating large and small stars: each step replaces edges by edges to a
    smaller neighbour until all components are stars. Minima combine before the
    shuffle and hot nodes are salted.
    """

    def hang(links: DataFrame, smaller: bool) -> DataFrame:
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_degree"))
        least = least.withColumn("m", F.least("m", "u"))
        met = join_by_key(links, least, "u", "_degree", F.col("v"))
        if smaller:
            moved = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        else:
            moved = met.filter("v > u").select(F.struct(F.col("v").alias("u"), "m").alias("e"))
        return moved.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()

    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        current = stored(hang(stored(hang(both, False), "large-star"), True), "small-star")
    roots = current.select(F.col("v").alias("u"), "v").distinct()
    return current.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """_id, digest, n, component_id, kept of every row."""
    signed = stored(signatures(docs, id_col, text_col, bands, rows, width), "signatures")
    classes = stored(
        signed.filter("n > 0").groupBy("set_key").agg(
            F.min(F.struct(F.col("_id").isNull().alias("unknown"), "_id", "digest")).alias("speaker"), F.count(F.lit(1)).alias("copies"),
            F.max("n").alias("n"), F.first("bands").alias("bands"),
        ),
        "classes",
    )
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    banded = classes.select(F.explode("bands").alias("band"), "set_key", "n")
    crowd = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "crowded-bands")
    crowded = stored(join_by_key(banded, crowd, "band", "members", F.col("set_key")), "bucket-members")
    hubs = crowded.groupBy("set_key").agg(F.sum("members").alias("hub"))  # who meets most others lies nearest to them
    met = crowded.join(hubs, "set_key").drop("members")
    buckets = met.groupBy("band").agg(F.max(F.struct("hub", "set_key", "n")).alias("centre"), F.count(F.lit(1)).alias("members"))
    near = join_by_key(met, buckets, "band", "members", F.col("set_key"))
    near = near.filter((F.col("set_key") != F.col("centre.set_key")) & fits(F.col("n"), F.col("centre.n")))
    first = stored(near.select(F.col("set_key").alias("a"), F.col("centre.set_key").alias("b")).distinct(), "star-pairs")

    spoken = classes.join(crowded.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "speaker")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    spelled = docs.select(docs[id_col].alias("_id"), hash128(text).alias("_digest"), text.alias("text"))
    same = (F.col("_digest") == F.col("speaker.digest")) & F.col("_id").eqNullSafe(F.col("speaker._id"))
    texts = spelled.join(spoken.hint("shuffle_hash"), same).select("set_key", "text").dropDuplicates(["set_key"])
    texts = stored(texts, "candidate-texts")

    links = stored(_confirm(first, texts, percent, width), "star-links")
    roots = components(links)
    label = F.coalesce("root", "set_key")
    named = crowded.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    members = stored(named.select("band", "set_key", "n", label.alias("root")), "bucket-roots")
    mixed = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"))
    mixed = mixed.filter("lo <> hi").select("band", "members")
    apart = join_by_key(members, mixed, "band", "members", F.col("set_key")).select("set_key", "n", "root").distinct()
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = _rare_pairs(stored(apart, "apart"), texts, percent, width).join(tried, ["a", "b"], "left_anti")
    more = stored(_confirm(stored(second, "cross-pairs"), texts, percent, width), "cross-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)

    sized = classes.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "speaker", "copies", label.alias("root"))
    of_root = sized.groupBy("root").agg(F.min("speaker").alias("first"), F.count(F.lit(1)).alias("_weight"))
    of_class = join_by_key(sized, of_root, "root", "_weight", F.col("set_key")).select("set_key", "first", "copies")
    slim = signed.select("_id", "digest", "n", "set_key")
    within = join_by_key(slim.filter("n > 0"), of_class, "set_key", "copies", F.col("_id"))
    stays = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("digest") == F.col("first.digest"))
    within = within.select("_id", "digest", "n", F.col("first._id").alias("component_id"), stays.alias("kept"))
    alone = slim.filter("n = 0").select("_id", "digest", "n", F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    return within.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_shingles, component_id, kept of every row; options as in ``_judged``.

    ``kept`` says that the id is its component's; where it names two texts of the component, both say so,
    and only ``keep_one`` chooses between them.
    """
    judged = _judged(docs, id_col, text_col, **options)
    own = F.col("_id").eqNullSafe(F.col("component_id"))
    return judged.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", own.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of every component, and all rows without shingles.

    Rows are named by id and text digest, so the decision joins back to exactly the row it was made for.
    """
    stay = _judged(docs, id_col, text_col, **options).filter("kept").select("_id", "digest").distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    packed = docs.select(row.alias("_row"), docs[id_col].alias("_own"), hash128(text).alias("_digest"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("digest"))
    kept = packed.join(stay.hint("shuffle_hash"), same, "left_semi")
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
