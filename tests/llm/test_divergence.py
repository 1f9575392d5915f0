import collections
import random
import re

import numpy as np

from marginalia.llm import divergence as D

DOCS = "doc_id long, text string, lang string, source string, term string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], DOCS)


def brute(rows):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        words = [(s, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, own, s in rows if own == lang]
        seen = collections.Counter(w for _, ws in words for w in set(ws))
        kept = [w for w, n in seen.items() if n >= 3]
        counts = {s: collections.Counter() for s, _ in words}
        for s, ws in words:
            counts[s].update(w for w in ws if seen[w] >= 3)

        def chances(c):
            return {w: 1 + 10**9 * (c[w] + 1) // (c.total() + len(kept)) for w in kept}

        p, whole = {s: chances(c) for s, c in counts.items()}, chances(sum(counts.values(), collections.Counter()))
        for s in counts:
            pair = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            term = [(w, (p[s][w] - whole[w]) ** 2 // whole[w]) for w in kept if counts[s][w] and p[s][w] > whole[w]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= 200]
    return sorted(out)


def made_up(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "aeiouéüЖ" for b in ("", "n", "nt", "R", "st", "ll", "漢")]
    vocabulary += [a + b for a in vocabulary for b in ("ka", "lo", "mi", "tu")]
    rows = [
        (" ".join(rng.choices(vocabulary[: rng.randint(3, len(vocabulary))], k=rng.randint(0, 60))) + rng.choice(["", "!", "1x2"]), rng.choice("def"), f"s{rng.randrange(9)}")
        for _ in range(150)
    ]
    rows += [(None, "d", "s0"), ("", "d", "quiet"), ("once only here", "g", "s1"), ("b", "g", "s2"), (None, None, None), ("one one one", None, "s1")]
    rows += [("tie Tie TIE", "h", "s1")] * 4 + [("tie", "h", "s2"), ("abc " * 40_000, "d", "s3")]
    return rows


def test_audit_equals_the_direct_computation(spark):
    rows = made_up()
    want = brute(rows)
    for block in (D.BLOCK, 16):
        got = sorted(tuple(r) for r in D.audit(docs(spark, rows), block=block).collect())
        assert got == want


def test_partial_counts_may_be_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 5)
    monkeypatch.setattr(D, "NODES", 3)
    rows = made_up(4)[:60]
    assert sorted(tuple(r) for r in D.audit(docs(spark, rows)).collect()) == brute(rows)


def test_tree_prices_empty_quadrants_without_visiting_them():
    rng = np.random.default_rng(1)
    rows = np.repeat(np.arange(6), 40)
    columns = np.concatenate([rng.choice(np.arange(300 * g, 300 * g + 200), 40, replace=False) for g in range(6)])
    p, zero = rng.integers(50, 10**9, 240), rng.integers(1, 40, 6)
    dense = np.repeat(zero[:, None], 2000, 1)
    dense[rows, columns] = p
    want = [[sum(int((x - y) ** 2 // y) for x, y in zip(dense[g], dense[h])) if g != h else 0 for h in range(6)] for g in range(6)]
    assert (D.pair_values(rows, columns, p, zero, 2000) == np.array(want)).all()
    tree = D.QuadTree(rows, columns, 6, 2000)
    priced = [np.zeros((8, 8), np.int64) for _ in range(tree.height + 1)]
    visited = sum(len(leaf[0]) for leaf in tree.leaves(6, 2000, priced))
    assert visited == 240 * 5  # each count once per other row; all else came by quadrants
    assert sum(int(level.sum()) for level in priced[4:]) > 0


def test_chances_stay_exact_with_huge_counts():
    n, total = 7 * 10**13, 8 * 10**13 + 1
    assert D.chance(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


def test_no_document(spark):
    assert D.audit(docs(spark, [])).count() == 0
