"""Sharding (operator 5): vector bin packing of groups of equal texts.

Bytes, tokens and rows are balanced jointly. Groups are placed one after the
other, largest first, each on the shard where the dot product of its size and
the shard's residual capacity, both as shares, is highest. That order is
sequential, so its input is bounded: groups that hold at least one ``CELLS``th
of all bytes, tokens or rows (at most ``3 * CELLS`` of them, whatever the table)
are placed alone; all others are added up in ``CELLS`` cells by hash, each about
one ``CELLS``th of the rest, and placed as a cell. The rule is the same at every
size; equal texts always share a shard.

Defined cases: a null text has no bytes and is a group of its own together with
the empty text; a null id is numbered like any other; repeated rows are rows of
one group; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash128, stored

CELLS = 4096
SLOT_BUCKETS = 1024


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: bytes, tokens, rows), the largest dot product with the residual capacity first."""
    items = np.asarray(items, float).reshape(-1, 3)
    totals = np.maximum(items.sum(axis=0), 1)
    share = items / totals
    capacity = np.full((shards, 3), 1 / shards)
    where = np.zeros(len(items), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        best = int(np.argmax(capacity @ share[i]))
        where[i] = best
        capacity[best] -= share[i]
    return where


def shard(
    docs: DataFrame, shards: int, size: Column, tokens: Column, id_col: str = "doc_id", text_col: str = "text",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """id, size, the columns of ``carry``, shard and slot of every row; slots run from 0 without gaps."""
    carry = carry or {}
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].alias("_id"), hash128(text).alias("_group"), size.cast("long").alias("_size"),
        tokens.cast("long").alias("_tokens"), *[c.alias(f"_carry{i}") for i, c in enumerate(carry.values())],
    ).withColumn("_cell", F.pmod(F.xxhash64("_group"), F.lit(CELLS)).cast("int"))
    rows = stored(rows, "shard-rows")
    groups = stored(
        rows.groupBy("_group", "_cell").agg(
            F.sum("_size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
        ),
        "shard-groups",
    )
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).first()
    large = F.lit(False)
    for what in ("bytes", "tokens", "rows"):
        large = large | (F.col(what) * CELLS >= max(total[what] or 0, 1))
    alone = groups.filter(large)
    cells = groups.filter(~large).groupBy("_cell").agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")])
    items = (
        alone.select("_group", F.lit(None).cast("int").alias("_cell"), "bytes", "tokens", "rows")
        .unionByName(cells.select(F.lit(None).cast("binary").alias("_group"), "_cell", "bytes", "tokens", "rows"))
        .toPandas()  # at most 4 * CELLS rows
    )
    items = items.sort_values(["bytes", "tokens", "rows", "_cell", "_group"], ascending=False, key=_sortable).reset_index(drop=True)
    items["shard"] = place(items[["bytes", "tokens", "rows"]].to_numpy(), shards)
    spark = docs.sparkSession
    by_group, by_cell = items[items["_cell"].isna()], items[items["_cell"].notna()]
    groups_to = spark.createDataFrame(
        [(bytes(g), int(s)) for g, s in zip(by_group["_group"], by_group["shard"])], "_group binary, _alone int"
    )
    cells_to = spark.createDataFrame(
        [(int(c), int(s)) for c, s in zip(by_cell["_cell"], by_cell["shard"])], "_cell int, _shared int"
    )
    placed = rows.join(F.broadcast(groups_to), "_group", "left").join(F.broadcast(cells_to), "_cell", "left")
    placed = placed.withColumn("_shard", F.coalesce("_alone", "_shared")).drop("_alone", "_shared")
    return with_slots(placed).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"),
        *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
    )


def _sortable(column: pd.Series) -> pd.Series:
    if column.name == "_group":
        return column.map(lambda g: b"" if g is None else bytes(g))
    return column.astype(float)


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, bucket by bucket, so no task sorts a whole shard.

    The bucket is taken from the row, not its text: a group of copies spreads over all buckets.
    """
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_group"), F.lit(SLOT_BUCKETS)).cast("int"))
    before = W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy("_shard", "_bucket").orderBy("_id", "_group")
    numbered = placed.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["_shard", "_bucket"]).withColumn("_slot", (F.col("_offset") + F.col("_row")).cast("long"))
