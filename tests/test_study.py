from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marginalia.operators import quiz as Z
from marginalia.operators import study as S


def _log(spark, ratings):
    start = datetime(2024, 1, 1)
    rows = []
    for card, newest_first in ratings.items():
        for i, rating in enumerate(reversed(newest_first)):
            rows.append((len(rows), card, rating, start + timedelta(hours=i)))
    return spark.createDataFrame(rows, "review_id long, card_id string, rating string, reviewed_at timestamp_ntz")


def test_strength(spark):
    log = _log(spark, {"a": ["got_it", "almost", "again"], "b": ["good", "easy", "hard"], "c": ["again", "got_it", "got_it"], "d": ["got_it", "odd"]})
    got = {r.card_id: r.strength for r in S.card_strength(log, "2024-01-01 12:00:00").collect()}
    assert got == {"a": 2, "b": 3, "c": 0, "d": 1}


def test_requeue(spark):
    rows = spark.createDataFrame([(0, 20, "again"), (0, 2, "again"), (0, 20, "got_it"), (3, 50, "almost")], "i int, n int, r string")
    got = [r[0] for r in rows.select(S.requeue_position(F.col("i"), F.col("n"), F.col("r"))).collect()]
    assert got == [7, 3, None, 16]


def test_day_follows_the_time_zone(spark):
    log = spark.createDataFrame([(1, datetime(2024, 1, 2, 3, 0))], "review_id long, reviewed_at timestamp_ntz")
    as_of = "2024-01-01 23:00:00"
    assert log.filter(S.seen_on_day(as_of, "America/New_York")).count() == 1
    assert log.filter(S.seen_on_day(as_of, "UTC")).count() == 0


def test_queue_order(spark):
    cards = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "card_id string, paper_id int")
    log = _log(spark, {"a": ["got_it"], "b": ["again"], "c": ["again", "again"]})
    queue = S.session_queue(cards, log, "2024-01-05 00:00:00").orderBy("position").collect()
    assert [r.card_id for r in queue] == ["d", "b", "c", "a"]


def test_started_at(spark):
    end = datetime(2024, 5, 1, 12)
    rows = spark.createDataFrame([("2024-05-01T11:00:00+00:00", end), ("junk", end), ("2024-05-01T13:00:00Z", end), (None, end)], "raw string, f timestamp")
    got = [r[0] for r in rows.select(Z.started_at(F.col("raw"), F.col("f"))).collect()]
    assert got == [datetime(2024, 5, 1, 11), end, end, end]


def test_best_score_prefers_full_attempts(spark):
    rows = [("a1", 1, "full", 0.9), ("a2", 1, "retry", 1.0), ("a3", 2, "retry", 0.4)]
    attempts = spark.createDataFrame([(*r, ["q"]) for r in rows], "attempt_id string, quiz_id long, mode string, score double, missed array<string>")
    got = {r.attempt_id: r.quiz_best_score for r in Z.attempt_history(attempts).collect()}
    assert got == {"a1": 0.9, "a2": 0.9, "a3": 0.4}
