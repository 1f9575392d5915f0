import collections
import itertools
import random
import re

from marginalia.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, mask int, part string, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, p, 9, "x", "y") for i, t, p in rows], DOCS)


def failing(rows):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, p in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        bad = ""
        bad += "A" if len(words) < 100 else ""
        bad += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        bad += "C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else ""
        bad += "D" if re.search(r"[#$%&*|]", t) else ""
        bad += "E" if i is not None and smallest[t] < i else ""
        out.append((i, p or "", bad))
    return out


def brute(rows, labels):
    out, failed = [], failing(rows)
    for part in {p for _, p, _ in failed}:
        own = [(i, bad) for i, p, bad in failed if p == part]
        removed_in = collections.defaultdict(list)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in bad for _, bad in own)
                good = sum(any(q == 1 for q, _ in labels.get(i, [])) for i, _ in removed if i is not None)
                toxic = sum(any(x == 1 for _, x in labels.get(i, [])) for i, _ in removed if i is not None)
                removed_in[f].append(len(removed))
                out.append((part, order, step, len(left), len(removed), fails - len(removed), sum(bad == f for _, bad in own), good, toxic, f))
        out = [(*r[:9], sum(removed_in[r[9]])) if r[0] == part and len(r) == 10 and isinstance(r[9], str) else r for r in out]
    return sorted(out)


def test_audit_equals_stepwise_filtering(spark):
    rng = random.Random(5)
    long = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    rows = [(i, rng.choice([long(120, 5000), long(120, 60), long(20, 50), long(110, 4000).upper(), long(130, 9000) + " #"]), rng.choice("ab")) for i in range(60)]
    rows += [(100 + i, rows[i][1], rng.choice(["a", "b", None])) for i in range(30)]
    rows += [(None, rows[1][1], "a"), (None, None, None), (7, rows[7][1], "a"), (200, None, "b"), (201, "", "b"), (202, long(60_000, 50_000), "a")]
    labels = {i: [(rng.choice([0, 1, None]), rng.choice([0, 1, None]))] for i in range(0, 130, 2)}
    labels[0].append((1, 1))
    marks = [(i, q, x) for i, each in labels.items() for q, x in each] + [(None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, A.audit(docs(spark, rows), table).collect()))
    assert got == brute(rows, labels)
    assert len(got) == 600 * 3


def test_counters_never_touch_their_neighbours():
    full = (1 << A.FIELD_BITS) - 1
    packed = A.outcomes(0b10101) * full
    counters = A.unpack(packed)
    assert set(counters) == {0, full} and counters[0] == full and (counters[1:].reshape(120, 5).sum(axis=1) == full).all()
    assert A.unpack(sum(A.outcomes(m) for m in range(32)))[0] == 32 and A.outcomes(0) == 1


def test_sums_merge_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "LANE", 2)
    rows = [(i, f"t{i % 7} #", "abc"[i % 3]) for i in range(90)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, A.audit(docs(spark, rows).repartition(9), none).collect())) == brute(rows, {})


def test_no_document(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs(spark, []), none).count() == 0
