import base64
import datetime
import hashlib
import random

from pyspark.sql import functions as F

from marginalia.llm import warc
from marginalia.llm.common import new_folder



def clock():
    return F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0)))


def archive(spark, rows, least_bytes=0, parts=3):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, _key string")
    folder = new_folder(spark, "test-warc")
    warc.write(pages.repartition(parts), folder, clock(), least_bytes=least_bytes)
    return folder, warc.merge(warc.read(spark, folder)).collect()


def test_round_trip_and_revisits(spark):
    tricky = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [
        (5, "http://a.b/x", "same"), (2, "http://a.b/x#f", "same"), (9, None, "same"), (None, "http://n/", "same"), (3, "http://c/", None),
        (4, "http://c/?q", ""), (6, "http://é/ü", "größe 😀"), (7, "http://t/\r\nX: y", tricky), (8, "no url", tricky * 3), (10, "http://l/", "l" * 500_000),
        (11, "http://r/", "twice"), (11, "http://r/", "twice"),
    ]
    folder, got = archive(spark, rows)
    by = {r["page"]: r for r in got}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    types = {i: (by[i]["record_type"], by[i]["refers_to"]) for i in by}
    assert types[2] == ("response", None) and types[5] == types[9] == types[None] == ("revisit", 2)
    assert types[3] == ("response", None) and types[4] == ("revisit", 3)
    assert all(types[i] == ("response", None) for i in (6, 7, 8, 10, 11))
    keys = [(r["url_key"], r["captured_at"]) for r in got]
    assert keys == sorted(keys) and by[5]["url_key"] == by[2]["url_key"] == "b,a)/x"
    assert by[5]["captured_at"] == datetime.datetime.fromtimestamp(1_600_000_005, datetime.UTC).replace(tzinfo=None)
    files = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{folder}/part-*").collect()}
    for r in got:  # the index leads to the record
        record = next(warc.parse(files[r["run"]][r["offset"] : r["offset"] + r["length"]]))
        assert record["fields"]["WARC-Type"] == r["record_type"]
        if r["page"] == 7:
            assert record["payload"].decode() == tricky


def test_small_payloads_are_never_revisits(spark):
    _, got = archive(spark, [(1, "http://a/", "ab"), (2, "http://a/", "ab"), (3, "http://a/", "abcd"), (4, "http://a/", "abcd")], least_bytes=3)
    assert {r["page"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}
    assert archive(spark, [])[1] == []


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        order = [(runs[r][i], r, i) for r, i in warc.LoserTree(runs)]
        assert order == sorted(order) and len(order) == sum(map(len, runs))


def test_a_long_history_spreads_over_ranges(spark):
    rows = [(i, "http://one/url", str(i)) for i in range(400)] + [(1000 + i, f"http://h{i % 7}/{i}", str(-i)) for i in range(100)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _, got = archive(spark, rows, parts=6)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    keys = [(r["url_key"], r["captured_at"], r["page"]) for r in got]
    assert keys == sorted(keys) and len(keys) == 500 and len({r["run"] for r in got}) > 1


def test_histories_are_in_order_of_the_encoded_url(spark):
    rows = [(1, "http://t/\r\nz", "a"), (2, "http://t/!a", "b"), (3, "http://t/%0Aq", "c")]
    _, got = archive(spark, rows, parts=1)
    keys = [r["url_key"] for r in got]
    assert keys == sorted(keys) and len(keys) == 3


def test_dates_are_utc_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "y")], "page_id long, url string, html string")
        moments = {1: 1_600_000_000, 2: 1_615_703_400}  # the second: 02:30 New York time that the clocks skip, read as UTC 06:30
        clock = F.timestamp_seconds(F.when(F.col("page_id") == 1, moments[1]).otherwise(moments[2]))
        folder = new_folder(spark, "test-warc-zone")
        warc.write(pages, folder, clock)
        written = "".join(r["value"] for r in spark.read.text(f"{folder}/part-*").filter("value like '%WARC-Date%'").collect())
        assert "2020-09-13T12:26:40Z" in written and "2021-03-14T06:30:00Z" in written
        back = warc.merge(warc.read(spark, folder)).select("page", F.unix_seconds("captured_at").alias("s")).collect()
        assert {r["page"]: r["s"] for r in back} == moments
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
