"""URL filters (operator 8): rules first, a Bloom filter cascade for everything else.

The cascade is built over the complete key universe of the corpus: level 1
encodes the listed keys, level 2 the unlisted keys that level 1 lets through,
level 3 the listed keys that level 2 lets through, and so on until no false
positive is left. Membership of every key of the universe is then exact and
needs no join. Keys are cut into shards by hash, each built in its own task;
filters go to the executors in slices of at most ``MAX_SLICE`` bytes, one pass
of the judging step per slice, whatever the number of keys.

Defined cases: a null url, or one without ``://``, has an empty host and path;
an empty table or list gives no filter and lists nothing; repeated urls are
judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

SHARD_KEYS = 16_384
MAX_SLICE = 32 << 20
MAX_LEVELS = 500


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path`` and its action; null where none fits.

    A rule (action, host, path) fits its host and all subdomains when the url's path starts with the rule's.
    """
    name = action = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        action = F.when(fits, what).otherwise(action)
    return name, action


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)  # the key comes last, or the second would follow from the first


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(one: np.ndarray, two: np.ndarray, level: int, hashes: int, bits: int) -> Iterator[np.ndarray]:
    """Bit positions of keys on a level: double hashing, both hashes mixed anew on every level.

    Two keys that meet on one level must not meet on the next for that reason, or no filter ever tells them apart.
    """
    with np.errstate(over="ignore"):
        mixed = _mix(one.view(np.uint64) ^ _mix(two.view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)))
        step = _mix(two.view(np.uint64) ^ mixed) | np.uint64(1)
        for i in range(hashes):
            yield ((mixed + np.uint64(i) * step) >> np.uint64(11)) % np.uint64(bits)


def _through(bits: np.ndarray, one: np.ndarray, two: np.ndarray, level: int, hashes: int) -> np.ndarray:
    passed = np.ones(len(one), bool)
    for at in _places(one, two, level, hashes, len(bits) * 8):
        passed &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return passed


def build_levels(one: np.ndarray, two: np.ndarray, listed: np.ndarray) -> list[tuple[int, bytes]]:
    """The levels of one shard as (number of hashes, bits)."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, bytes]] = []
    while len(inside):
        if len(levels) > MAX_LEVELS:
            raise ValueError("the cascade does not end: two keys of the universe share both hashes")
        rate = min(0.5, len(inside) / max(len(outside), 1) / math.sqrt(2)) if not levels else 0.5
        hashes = max(1, round(math.log2(1 / rate)))
        bits = np.zeros(max(8, math.ceil(len(inside) * hashes / math.log(2) / 8)), np.uint8)
        for at in _places(one[inside], two[inside], len(levels), hashes, len(bits) * 8):
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        passed = outside[_through(bits, one[outside], two[outside], len(levels), hashes)]
        levels.append((hashes, bits.tobytes()))
        inside, outside = passed, inside
    return levels


def listed_by(levels: list[tuple[int, bytes]], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe."""
    verdict = np.zeros(len(one), bool)
    left = np.arange(len(one))
    for level, (hashes, bits) in enumerate(levels):
        left = left[_through(np.frombuffer(bits, np.uint8), one[left], two[left], level, hashes)]
        verdict[left] = level % 2 == 0
    return verdict


def build_cascade(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Filters (shard, n_shards, level, hashes, bits) from rows (key, listed); a key is listed if any of its rows is.

    ``shard_keys`` is the mean number of keys of a shard, the unit that one task holds in memory.
    """
    one, two = key_hashes(F.col("key"))
    keys = (
        universe.select(F.coalesce("key", F.lit("")).alias("key"), F.coalesce("listed", F.lit(False)).alias("listed"))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
        .select(one.alias("one"), two.alias("two"), "listed")
    )
    keys = stored(keys, "url-universe")
    shards = max(1, math.ceil(keys.count() / shard_keys))

    def build(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(rows["one"].to_numpy(), rows["two"].to_numpy(), rows["listed"].to_numpy(bool))
        names = ["shard", "n_shards", "level", "hashes", "bits"]
        return pd.DataFrame([(part[0], shards, i, h, b) for i, (h, b) in enumerate(levels)], columns=names)

    shard = F.pmod(F.col("two"), F.lit(shards)).cast("int")
    schema = "shard int, n_shards int, level int, hashes int, bits binary"
    return stored(keys.groupBy(shard.alias("shard")).applyInPandas(build, schema), "url-cascade")


def with_membership(rows: DataFrame, key: str, cascade: DataFrame, name: str = "listed", most: int = MAX_SLICE) -> DataFrame:
    """Add the boolean ``name``: is the row's key listed? Exact for every key of the cascade's universe."""
    spark = rows.sparkSession
    one, two = key_hashes(F.coalesce(F.col(key), F.lit("")))
    sizes = cascade.groupBy("shard", "n_shards").agg(F.sum(F.length("bits")).alias("bytes"))
    total = sizes.agg(F.sum("bytes").alias("b"), F.max("n_shards").alias("n"), F.max("bytes").alias("m")).first()
    if not total["b"]:
        return rows.withColumn(name, F.lit(False))
    slices = max(1, math.ceil(total["b"] / max(1, most - total["m"])))
    shards = total["n"]
    found = F.lit(False)
    for part in range(slices):  # one slice unless the filters outgrow a broadcast
        mine = cascade.filter(F.pmod("shard", F.lit(slices)) == part).orderBy("shard", "level").collect()
        levels: dict[int, list[tuple[int, bytes]]] = {}
        for r in mine:
            levels.setdefault(r["shard"], []).append((r["hashes"], bytes(r["bits"])))
        found = found | _member(spark.sparkContext.broadcast(levels), shards)(one, two)
    return rows.withColumn(name, found)


def _member(sent, shards: int):
    @F.pandas_udf("boolean")
    def member(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.to_numpy(np.int64), b.to_numpy(np.int64)
        shard, out = b % shards, np.zeros(len(a), bool)
        for s in np.unique(shard):
            if s in sent.value:
                at = np.flatnonzero(shard == s)
                out[at] = listed_by(sent.value[s], a[at], b[at])
        return pd.Series(out)

    return member


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: Column, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, address, rule, listed, verdict of every row.

    ``listed`` is a boolean Column over ``pages`` that puts the row's address
    (host + path) on the block list. Rules decide first, the list decides the rest.
    """
    host, path = split_url(pages[url_col])
    rows = pages.select(pages[id_col].alias("_id"), host.alias("host"), path.alias("path"), listed.alias("_listed"))
    rows = rows.withColumn("address", F.concat("host", "path"))
    cascade = build_cascade(rows.select(F.col("address").alias("key"), F.col("_listed").alias("listed")))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    judged = with_membership(rows.drop("_listed"), "address", cascade).withColumn("rule", rule)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", "address", "rule", "listed", verdict.alias("verdict"))
