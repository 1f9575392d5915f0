import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import sharding, url_filter


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_placing_balances_all_three(shards):
    rng = np.random.default_rng(2)
    items = np.stack([rng.pareto(1.5, 4000) * 1000 + 1, rng.pareto(1.5, 4000) * 200 + 1, rng.integers(1, 30, 4000)], 1)
    where = sharding.place(items, shards)
    for d in range(3):
        loads = np.bincount(where, items[:, d], shards)
        assert loads.max() - loads.min() < 0.02 * loads.mean() + items[:, d].max() * (shards > 1) * 0.2
    assert len(sharding.place(np.empty((0, 3)), shards)) == 0


def test_groups_slots_and_defined_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w" * int(rng.integers(0, 400)) + str(i % 700)) for i in range(1000)] + [(None, None), (5000, ""), (5001, None), (5002, "z" * 200_000)]
    rows += [(6000 + i, "the same text") for i in range(300)] + [(7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    text = F.coalesce("text", F.lit(""))
    out = sharding.shard(docs, 4, F.octet_length(text) + 1, F.octet_length(text), carry={"crc": F.crc32(text.cast("binary"))}).collect()
    assert len(out) == len(rows)
    homes, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in out:
        homes[r["crc"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter((r["doc_id"], r["size"]) for r in out) == collections.Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    assert sharding.shard(docs.limit(0), 4, F.lit(1), F.lit(1)).count() == 0


def test_query_balances_bytes(spark, sf):
    from marginalia.llm.queries import QUERIES

    rows = QUERIES["op5_sharding"](spark, sf.replace("0.001", "0.01")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    loads, rows_in = collections.Counter(), collections.Counter()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        loads[r["shard"]] += r["size"]
        rows_in[r["shard"]] += 1
    assert len(rows) == len(texts) and set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_urls_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "http://example.org?x", "http://b.example.org/en/15#y", "http://xcom/de/1",
        "http://x.com/de/1", "http://com/fr/", "http://É.com/fr/a", "http://badexample.org/es/", "x://y://z/p", "http://h/" + "p" * 50_000,
    ]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(3, urls[3], "x")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"][:20], r["rule"], r["verdict"]) for r in url_filter.judge(rows, RULES, F.col("page_id") == 7).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("a.example.org", "/es/x", "example.org/es/", "block"), 5: ("example.org", "", None, "allow"),
        6: ("b.example.org", "/en/15", "example.org/en/1", "block"), 7: ("xcom", "/de/1", None, "block"),
        8: ("x.com", "/de/1", "com/de/", "block"), 9: ("com", "/fr/", "com/fr/", "allow"), 10: ("É.com", "/fr/a", "com/fr/", "allow"),
        11: ("badexample.org", "/es/", "org/", "allow"), 12: ("y:", "//z/p", None, "allow"), 13: ("h", "/" + "p" * 19, None, "allow"),
    }
    assert url_filter.judge(rows.limit(0), RULES, F.lit(True)).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 0.99, 1.0])
def test_cascade_is_exact_on_its_universe(share):
    rng = np.random.default_rng(9)
    one, two = (rng.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    listed = rng.random(20_000) < share
    levels = url_filter.build_levels(one, two, listed)
    assert (url_filter.listed_by(levels, one, two) == listed).all()
    if share == 0.01:
        assert sum(len(b) for _, b in levels) * 8 < 20 * listed.sum()


def test_cascade_in_shards_and_slices(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    rows = rows.unionByName(spark.createDataFrame([(None, None), ("k1", True), ("k1", False)], "key string, listed boolean"))
    cascade = url_filter.build_cascade(rows, shard_keys=300)
    for most in (url_filter.MAX_SLICE, 400):  # one pass, and several
        out = url_filter.with_membership(rows.select("key").distinct(), "key", cascade, most=most).collect()
        assert len(out) == 5001
        assert all(r["listed"] == (r["key"] is not None and (r["key"] == "k1" or int(r["key"][1:]) % 7 == 0)) for r in out)


def test_cascade_ends_for_keys_alike_in_low_bits():
    """A pair whose first hashes agree in their low bits once met on every small level, and the cascade never ended."""
    one = np.array([0, 1 << 40, 1 << 50, (1 << 40) + (1 << 50)], np.int64)
    two = np.array([5, 6, 7, 8], np.int64)
    listed = np.array([True, False, True, False])
    levels = url_filter.build_levels(one, two, listed)
    assert len(levels) < 50
    assert (url_filter.listed_by(levels, one, two) == listed).all()
    for same in (one, two):  # either hash alone tells two keys apart
        other = np.full(4, 3, np.int64)
        pair = (same, other) if same is one else (other, same)
        assert (url_filter.listed_by(url_filter.build_levels(*pair, listed), *pair) == listed).all()


def test_many_shards_end():
    rng = np.random.default_rng(0)
    for _ in range(40):
        one, two = (rng.integers(-(2**63), 2**63 - 1, 16_384) for _ in range(2))
        levels = url_filter.build_levels(one, two, rng.random(16_384) < 0.3)
        assert len(levels) < 60


def test_the_two_hashes_are_no_function_of_each_other(spark):
    """Chained in the other order, keys that share the first hash shared the second too."""
    one, two = url_filter.key_hashes(F.concat(F.lit("k"), F.col("id")))
    chained = F.xxhash64(F.concat(F.lit("k"), F.col("id")), F.lit("second"))
    assert spark.range(100).filter(two == chained).count() == 0
    assert spark.range(100).select(one.alias("a"), two.alias("b")).distinct().count() == 100
