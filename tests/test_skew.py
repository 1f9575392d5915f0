"""The split forms agree with the plain ones, with tiny buckets so that every seam is crossed."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators import skew


def _rows(spark):
    return spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 17)).alias("key"), F.col("id").alias("position"),
        F.when(F.col("id") % 23 == 5, F.concat(F.lit("h"), "id")).alias("heading"),
    )


def test_carry_forward(spark):
    rows = _rows(spark)
    got = skew.carry_forward(rows, ["key"], "position", F.col("heading"), "label", "Document", width=7)
    window = W.partitionBy("key").orderBy("position")
    want = rows.withColumn("label", F.coalesce(F.last("heading", True).over(window), F.lit("Document")))
    cols = ["key", "position", "label"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_running_number(spark):
    rows = _rows(spark).withColumn("page", F.floor(F.col("position") / 5))
    got = skew.running_number(rows, ["key"], "page", [F.col("page"), F.col("position")], "n", width=3)
    want = rows.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("page", "position")) - 1)
    assert sorted(map(tuple, got.select("key", "position", "n").collect())) == sorted(map(tuple, want.select("key", "position", "n").collect()))


def test_global_rank(spark):
    rows = _rows(spark).repartition(9)
    got = skew.global_rank(rows, [F.col("key"), F.desc("position")], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 401))
    assert [(r["key"], -r["position"]) for r in got] == sorted((r["key"], -r["position"]) for r in got)


def test_hot_join(spark):
    rows = _rows(spark)
    dim = rows.groupBy("key").agg(F.max("position").alias("top"))
    assert [r["key"] for r in skew.hot_keys(rows, ["key"], 1).collect()] == ["hot"]
    got = skew.hot_join(rows, dim, ["key"], F.col("position"))
    assert got.count() == 400
    assert got.filter("top is null").count() == 0


def test_top_per_key_limits_before_the_shuffle(spark):
    plan = skew.top_per_key(_rows(spark), ["key"], [F.col("position")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
