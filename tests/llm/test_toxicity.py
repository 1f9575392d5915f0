import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import toxicity



def ids():
    return F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == 2


def corpus(n=1600, seed=5):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("aeinrst"), rng.integers(2, 7))) for _ in range(300)]
    bad = ["kwvz" + x for x in ("o", "um", "ig", "ax")]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        toxic = int(i % 9 == 0)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    odd = [(9001, None, 0), (9002, "", 0), (None, "aei kwvzum rst kwvzo ins kwvzig", 0), (9003, "a " * 100_000, 0), (9003, "a " * 100_000, 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + odd], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, ids()).collect()
    assert len(got) == len(rows) + len(odd)
    scores = {r["doc_id"]: r["_score"] for r in got}
    assert all(0 <= s <= 1 for s in scores.values())
    unseen = [(scores[i] >= 0.3, bool(y)) for i, _, y in rows if i % 4 == 2]
    assert np.mean([a == b for a, b in unseen]) > 0.97
    assert scores[9001] == scores[9002] < 0.3 and scores[None] > 0.3


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["_score"] for r in toxicity.score(docs, none, ids()).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), none, ids()).count() == 0


def test_ratios_equal_a_direct_computation(spark):
    texts = [(t, y) for _, t, y in corpus(120)]
    got = {r["gram"]: r["ratio"] for r in toxicity.ratios(spark.createDataFrame(texts, "text string, toxic long"), 4, 0.75, 1.0).collect()}
    count, chars = [{}, {}], {}
    for text, y in texts:
        s = f" {' '.join(text.lower().split())} "
        for i in range(len(s) - 3):
            count[y][s[i : i + 4]] = count[y].get(s[i : i + 4], 0) + 1
    every = set(count[0]) | set(count[1])
    for g in every:
        codes = np.array([ord(c) for c in g], np.uint32)
        chars[g] = int(toxicity._grams(codes, 4).view(np.int64)[0])
    want = {}
    for g in every:
        group = [h for h in every if h[:3] == g[:3]]
        pool = lambda h: count[0].get(h, 0) + count[1].get(h, 0)
        cut = lambda n: max(n - 0.75, 0)
        kept = sum(cut(pool(h)) for h in group)
        held = kept / sum(pool(h) for h in group)
        shared = sum(h[1:] == g[1:] for h in every) / sum(h[1:3] == g[1:3] for h in every)
        p = []
        for y in (0, 1):
            own = sum(cut(count[y].get(h, 0)) for h in group)
            share = cut(count[y].get(g, 0)) / own if own else cut(pool(g)) / kept
            p.append(held * share + (1 - held) * shared)
        if np.log(p[1] / p[0]) > 1.0:
            want[chars[g]] = np.log(p[1] / p[0])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_labelled_row_takes_part(spark, monkeypatch):
    n, fitted, curve = 24_000, [], []
    docs = spark.range(n).selectExpr("id as doc_id", "concat('aei rst ', id % 9, if(id % 10 = 0, ' kwvzum', ''), ' ins') as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic")
    count, fit = toxicity.ratios, toxicity.fit_curve
    monkeypatch.setattr(toxicity, "ratios", lambda rows, *a: fitted.append(rows.count()) or count(rows, *a))
    monkeypatch.setattr(toxicity, "fit_curve", lambda rows, *a: curve.append(rows.count()) or fit(rows, *a))
    scored = toxicity.score(docs, labels, ids())
    assert fitted[0] + curve[0] == n - n // 4
    assert scored.filter((F.col("_score") >= 0.3) != (F.col("doc_id") % 10 == 0)).count() == 0
