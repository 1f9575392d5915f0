import pandas as pd
from pyspark.sql import functions as F

from marginalia.llm import common


def test_tied_weights_lose_no_rows(spark):
    def anew(batches):
        """The rows in another order at every evaluation, as a shuffle may deliver them."""
        yield pd.concat(list(batches)).sample(frac=1)

    keys = 3 * common.TOP_KEYS
    tied = spark.range(keys).select(F.col("id").alias("key"), F.lit(2).cast("long").alias("weight"))
    tied = tied.repartition(1).mapInPandas(anew, "key long, weight long")
    rows = spark.range(2 * keys).select((F.col("id") % keys).alias("key"), F.col("id").alias("row"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = common.join_by_key(rows, tied, "key", "weight", F.col("row")).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted(r["row"] for r in got) == list(range(2 * keys))
