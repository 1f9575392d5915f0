import datetime
import random

from pyspark.sql import functions as F

from marginalia.catalog import all_oracles, all_queries
from marginalia.functions import constants as K
from marginalia.operators import jobs, merge
from marginalia.sources import readers
from marginalia.streaming import streams

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://host.example/abs/2401.00001v2</id><title> A
 Title </title><summary>Text  here.</summary><published>2024-01-02T00:00:00Z</published><updated>bad</updated>
<author><name>A. One</name></author><author><name> </name></author><category term="cs.CL"/>
<link rel="alternate" href="http://a"/><link title="pdf" href="http://p"/></entry>
<entry><id>http://host.example/abs/cs.CL/0301001</id><title>T</title><summary>S</summary></entry></feed>"""


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    rows = {r.article_id: r for r in readers.atom_papers(spark, str(tmp_path / "feed.xml")).collect()}
    first = rows["2401.00001"]
    assert (first.paper_id, first.version, first.title, first.authors, first.categories) == ("2401-00001", "v2", "A Title", ["A. One"], ["cs.CL"])
    assert (str(first.published), first.updated, first.pdf_url, first.abs_url) == ("2024-01-02", None, "http://p", "http://a")


def test_uploads(spark, tmp_path):
    from pyspark.sql import functions as F

    for name, data in (("a.pdf", b"same"), ("b.PDF", b"same"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    files = readers.binary_uploads(spark, str(tmp_path))
    judged = files.withColumn("reason", readers.upload_verdict(F.col("path"), F.lit(None).cast("string"), F.col("length")))
    good = judged.filter("reason is null").withColumn("paper_id", readers.upload_id(F.col("content")))
    assert good.select("paper_id").distinct().count() == 1
    assert [r.reason for r in judged.filter("reason is not null").collect()] == ["not_a_pdf"]
    # the file reader skips empty files, so an empty upload is judged by its recorded length
    empty = readers.upload_verdict(F.lit("d.pdf"), F.lit(None).cast("string"), F.lit(0))
    assert spark.range(1).select(empty).first()[0] == "empty"


def test_append_and_stream(spark, tmp_path):
    rows = spark.range(5).selectExpr("id as paper_id", "concat('word ', id, ' and more') as text", "1 as version")
    merge.append(rows, str(tmp_path / "docs"))
    merge.append(rows.filter("paper_id = 3").selectExpr("paper_id", "'changed text' as text", "2 as version"), str(tmp_path / "docs"))
    docs = streams.read_log(spark, str(tmp_path / "docs"), rows.schema, files_per_batch=2)
    query, table = streams.chunk_arrivals(spark, docs, str(tmp_path / "out"), str(tmp_path / "state"), 2, 0, buckets=4)
    query.awaitTermination()
    chunks = streams.current_chunks(table).collect()
    assert sorted(c.text for c in chunks if c.paper_id == 3) == ["changed text"]
    assert sum(c.paper_id != 3 for c in chunks) == 8 and all(len(c.buckets) == len(c.weights) > 0 for c in chunks)


ARRIVING = "paper_id long, text string, version long"


def test_a_batch_rewrites_only_its_buckets_and_counts_once(spark, tmp_path):
    table = streams.BucketTable(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], "k int, n long").schema, buckets=8)

    def add(stored, fresh):
        return stored.unionByName(fresh).groupBy("k").agg(F.sum("n").alias("n"))

    first = spark.createDataFrame([(k, 1) for k in range(40)], "k int, n long")
    table.merge(first, 0, add)
    before = table._places()
    again = spark.createDataFrame([(3, 5)], "k int, n long")
    for _ in range(2):  # the second time the batch is replayed
        table.merge(again, 1, add)
    after = table._places()
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == len(after) == 8
    assert {r.k: r.n for r in table.read().collect()} == {k: 6 if k == 3 else 1 for k in range(40)}
    # a batch that died before its list was written is not seen, and is written anew
    add(table.read(), again).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(tmp_path / "t/data/2"))
    assert sum(r.n for r in table.read().collect()) == 45
    table.merge(again, 2, add)
    assert sum(r.n for r in table.read().collect()) == 50


def test_a_document_sent_again_replaces_its_chunks(spark, tmp_path):
    sent = [
        [(1, "one two three four", 1), (2, "five six", 1), (2, "five six seven eight", 2)],
        [(1, "new text", 3), (3, None, 1), (4, " ", 1)],
        [(1, "too late now", 2), (2, None, 3)],
    ]
    schema = spark.createDataFrame([], ARRIVING).schema
    for n, rows in enumerate(sent):
        spark.createDataFrame(rows, ARRIVING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = streams.read_log(spark, str(tmp_path / "in"), schema)
        query, table = streams.chunk_arrivals(spark, docs, str(tmp_path / "out"), str(tmp_path / "state"), 2, 0)
        query.awaitTermination()
    got = sorted((r.paper_id, r.ordinal, r.text) for r in streams.current_chunks(table).collect())
    assert got == [(1, 0, "new text")]  # paper 2 came back empty


EVENTS = "event_id long, job_id string, paper_id long, stage string, status string, ts timestamp"


def test_states_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (i, f"j{i % 9}", i % 9, rng.choice(K.STAGE_ORDER), rng.choice(["running", "done", "error"]), start + datetime.timedelta(minutes=rng.randrange(90)))
        for i in range(300)
    ]
    events = spark.createDataFrame(rows, EVENTS)
    want = sorted(map(tuple, jobs.job_state(jobs.reconcile_stages(jobs.latest_stage_status(events))).collect()))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        base = tmp_path / str(seed)
        for at in range(0, 300, 110):
            batch = rows[at : at + 110] + rows[:5]  # some come twice
            spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(base / "in"))
            query, table = streams.stage_states(spark, streams.read_log(spark, str(base / "in"), events.schema), str(base / "out"), str(base / "state"))
            query.awaitTermination()
        assert sorted(map(tuple, streams.job_states(table).collect())) == want


def test_days_are_counted_to_the_last_with_late_rows(spark, tmp_path):
    day = lambda n, h: datetime.datetime(2024, 1, n, h)
    batches = [[(1, 7, day(1, 9)), (1, 7, day(1, 10)), (1, 8, day(2, 9))], [(1, 9, day(1, 8)), (2, 7, day(5, 23))]]
    for rows in batches:
        spark.createDataFrame(rows, "paper_id int, card_id int, reviewed_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = streams.read_log(spark, str(tmp_path / "in"), spark.createDataFrame([], "paper_id int, card_id int, reviewed_at timestamp").schema)
        query, table = streams.daily_activity(spark, log, str(tmp_path / "out"), str(tmp_path / "state"), ["paper_id"])
        query.awaitTermination()
    got = sorted((r.paper_id, r.day.day, r.reviews, r.cards) for r in streams.activity_per_day(table, ["paper_id"]).collect())
    assert got == [(1, 1, 3, 2), (1, 2, 1, 1), (2, 5, 1, 1)]


def test_job_snapshots_merge_their_arrays(spark):
    schema = "job_id string, n int, stages array<struct<stage:string,status:string>>, log array<struct<at:int,line:string>>"
    base = spark.createDataFrame([("a", 1, [("x", "done"), ("y", "running")], [(1, "l1"), (2, "l2")]), ("b", 1, None, None)], schema)
    new = spark.createDataFrame([("a", 2, [("y", "done"), ("z", "running")], [(2, "l2"), (3, "l3")]), ("c", 5, [("x", "done")], None)], schema)
    got = {r.job_id: r for r in merge.upsert_job_snapshots(base, new).collect()}
    assert [tuple(s) for s in got["a"].stages] == [("x", "done"), ("y", "done"), ("z", "running")] and got["a"].n == 2
    assert [e.line for e in got["a"].log] == ["l1", "l2", "l3"]
    assert got["b"].stages is None and got["c"].log == [] and got["c"].n == 5


def test_vectors_by_dimension(spark, sf, tmp_path):
    from marginalia.operators import retrieval
    from marginalia.sources import views

    vectors = views.vectors(spark, sf)
    retrieval.write_by_dimension(vectors, str(tmp_path / "v"))
    stored = retrieval.read_dimension(spark.read.parquet(str(tmp_path / "v")), 64)
    assert stored.count() == vectors.count()
    assert "PartitionFilters: [isnotnull(dim" in stored._jdf.queryExecution().toString()


def test_user_encoder(spark):
    from marginalia.operators import retrieval

    rows = spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, document string")
    out = retrieval.encode(rows, lambda texts: [[len(t), 1.0] for t in texts]).orderBy("id").collect()
    assert [r.embedding for r in out] == [[2.0, 1.0], [3.0, 1.0]]


def test_every_statement_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
    assert len(all_queries()) > 150


def test_entry(spark):
    from __spark_entry__ import entry

    frame = entry(spark)
    assert frame.columns == ["position", "card_id", "strength", "last_reviewed_at", "paper_title", "paper_label"]
    assert frame.count() == 150


def test_stored_job_and_question_rows_with_broken_fields(spark):
    from marginalia.operators import library

    jobs = spark.createDataFrame(
        [("a", "running", "OCR", 40, '[{"stage":"OCR"}]', None), ("b", "lost", None, 140, "broken", "[]"), ("c", None, None, None, None, None)],
        "job_id string, state string, current_stage string, percent int, stages string, log string",
    ).selectExpr("*", "'p' as paper_id", "cast(null as string) as error_message")
    got = {r["job_id"]: r for r in library.job_rows(jobs).collect()}
    assert [tuple(s) for s in got["a"]["stages"]] == [("OCR", "pending", None, False)] and got["a"]["log"] == [] and got["a"]["valid"]
    assert got["b"]["state"] is None and got["b"]["stages"] == [] and not got["b"]["valid"] and not got["c"]["valid"]

    columns = "question_id quiz_id paper_id prompt kind difficulty options correct_option_id correct_answer_text accepted_answers explanation"
    columns = f"{columns} citation_section citation_chunk_id citation_snippet".split()
    stored = [
        ["q", "z", "p", None, "essay", None, '["x", {"id": 1}, 3]', None, None, "{", None, "Errata", None, None],
        ["r", "z", "p", "Why?", "true_false", "apply", None, "true", None, '["yes"]', "So.", "Methods", "c1", None],
    ]
    rows = spark.createDataFrame(stored, ", ".join(f"{c} string" for c in columns)).selectExpr("*", "0 as index", "3 as citation_page")
    q, r = library.question_rows(rows).orderBy("question_id").collect()
    assert (q["prompt"], q["kind"], q["difficulty"], q["accepted_answers"], q["citation"]) == ("", "multiple_choice", "recall", [], None)
    assert [tuple(o) for o in q["options"]] == [("1", "")] and r["options"] == [] and r["accepted_answers"] == ["yes"]
    assert tuple(r["citation"]) == ("Methods", 3, "c1", "") and (r["kind"], r["difficulty"]) == ("true_false", "apply")
