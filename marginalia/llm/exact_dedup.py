"""Exact deduplication (operator 3).

Texts are grouped by a 128-bit content hash; inside a hash the texts themselves
are grouping keys, so Spark compares their bytes and a collision never merges
two texts. Equal texts combine before the shuffle, so a group that owns a third
of all rows sends one row per map task.

Defined cases: a null text counts as empty; a null id is kept only in a group
that has no other id; rows that repeat both id and text are one document, all
flagged alike by ``decide`` and reduced to one row by ``keep_one``; an empty
table gives an empty result; further columns never clash with internal names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash128, join_by_key, stored


def decide(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: tuple = ()
) -> DataFrame:
    """One row per input row: ``id_col``, the columns of ``carry``, keep_id, group_size, kept.

    ``keep`` is ``smallest`` or ``largest``: the id that stays in its group.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_text"), hash128(text).alias("_hash"))
    groups = rows.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_size"), best("_id").alias("_keep"))
    per_hash = stored(
        groups.groupBy("_hash").agg(
            F.count(F.lit(1)).alias("_variants"), F.sum("_size").alias("_size"), best("_keep").alias("_keep")
        ),
        "exact-groups",
    )
    carried = [docs[c].alias(f"_carry{i}") for i, c in enumerate(carry)]
    wanted = [docs[id_col].alias("_id"), *carried, hash128(text).alias("_hash")]
    slim = docs.select(*wanted)
    out = join_by_key(slim, per_hash.filter("_variants = 1").drop("_variants"), "_hash", "_size", F.col("_id"))
    clashing = per_hash.filter("_variants > 1").select("_hash")
    if not clashing.isEmpty():  # two texts with one hash: decide these few by the text as well
        full = docs.select(*wanted, text.alias("_text")).join(clashing, "_hash", "left_semi")
        exact = groups.join(clashing, "_hash", "left_semi")
        out = out.unionByName(full.join(exact, ["_hash", "_text"]).select(*out.columns))
    return out.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, one per distinct text, with the columns of ``docs``."""
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    last = docs[id_col].isNull() if keep == "smallest" else docs[id_col].isNotNull()
    row = F.struct(
        last.alias("last"),
        docs[id_col].alias("id"),
        docs[text_col].isNull().alias("no_text"),
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"),
    )
    best = {"smallest": F.min, "largest": F.max}[keep]
    kept = (
        docs.select(hash128(text).alias("_hash"), text.alias("_text"), row.alias("_row"))
        .groupBy("_hash", "_text")
        .agg(best("_row").alias("_row"))
    )
    place = {c: F.col(f"_row.rest.c{i}") for i, c in enumerate(others)}
    place[text_col] = F.when(~F.col("_row.no_text"), F.col("_text"))
    return kept.select(*[place[c].alias(c) for c in docs.columns])
