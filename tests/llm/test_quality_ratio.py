import collections
import hashlib
import math
import random
import re

from marginalia.llm import quality_ratio as Q

DOCS = "doc_id long, text string, _words string, cell int, kept string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def grams(text, buckets):
    h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in WORD.findall(text)]
    return [x % buckets for x in h] + [(a * 40503 + b * 7919 + 1) % 2**32 % buckets for a, b in zip(h, h[1:])]


def judged(rows, trusted):
    total = sum(len(grams(t or "", 2)) for _, t in rows)
    size = 1
    while size * 2 * Q.FILL <= total and size < Q.BUCKETS:
        size *= 2
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t or "", size))
        if i in trusted:
            target.update(grams(t or "", size))
    ratio = {
        c: round(math.log(((target[c] + 1) / (target.total() + size)) / ((n + 1) / (raw.total() + size))) * 1e6) for c, n in raw.items()
    }
    out = []
    for i, t in rows:
        own, found = base(t or ""), grams(t or "", size)
        score = sum(ratio[c] for c in found)
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        out.append((i, *own, failed, not failed and score >= -100_000 * len(found), len(found), score))
    return out


def test_judgement_equals_the_direct_computation(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é#", "THE!!", "|", "a b"]
    rows = [(i, " ".join(rng.choices(vocabulary[: rng.randint(5, 64)], k=rng.randint(0, 90)))) for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(12))
    rows += [
        (200, None), (201, ""), (202, " \n\t\r "), (None, rows[3][1]), (5, rows[5][1]), (203, f"{passage} x y\n{passage}\n\n{passage} z"),
        (204, "same same " * 40), (205, "line one\nline one \nline one\n\n \n"), (206, " ".join(f"long{i % 7000}" for i in range(30_000))),
    ]
    trusted = [i for i in range(0, 120, 3)]
    ids = spark.createDataFrame([(i,) for i in [*trusted, 3, None, 999]], "doc_id long")
    got = collections.Counter(tuple(r) for r in Q.judge(docs(spark, rows), ids).collect())
    assert got == collections.Counter(judged(rows, set(trusted)))


def test_trusted_ids_beyond_the_bound_are_joined(spark, monkeypatch):
    rows = [(i, f"w{i % 4} x y z " * 8) for i in range(20)]
    ids = spark.createDataFrame([(i,) for i in range(0, 20, 4)], "doc_id long")
    want = sorted(map(tuple, Q.judge(docs(spark, rows), ids).collect()))
    monkeypatch.setattr(Q, "BROADCAST_IDS", 2)
    assert sorted(map(tuple, Q.judge(docs(spark, rows), ids).collect())) == want


def test_no_document_and_no_target(spark):
    nobody = spark.createDataFrame([], "doc_id long")
    assert Q.judge(docs(spark, []), nobody).count() == 0
    rows = [(1, "a b c " * 10), (2, None)]
    assert collections.Counter(map(tuple, Q.judge(docs(spark, rows), nobody).collect())) == collections.Counter(judged(rows, set()))


def test_cells_grow_with_the_corpus_up_to_their_bound():
    assert [Q.folded_size(n) for n in (0, 127, 256, 128 << 13, 1 << 40)] == [1, 1, 2, 1 << 13, Q.BUCKETS]


def test_labelled_quality_is_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    trusted = labels.filter("quality = 1 and doc_id % 2 = 0").select("doc_id")  # half of the labels, judged on the others
    out = Q.judge(spark.read.parquet(f"{folder}/documents.parquet"), trusted).filter("not base_failed")
    seen = out.join(labels.filter("doc_id % 2 = 1"), "doc_id")
    every, kept = (dict(x.groupBy("quality").count().collect()) for x in (seen, seen.filter("kept")))
    assert kept[1] / every[1] > 0.995 and kept.get(0, 0) / every[0] < 0.1


def test_the_plan_has_no_python(spark):
    rows = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, _text string")
    ids = spark.createDataFrame([(1,)], "doc_id long")
    plan = Q.judge(rows, ids)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
