import collections
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, minhash
from marginalia.llm.shingles import linked, shingle_sets

DOCS = "doc_id long, text string, _hash string, kept string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


def test_exact_decisions(spark):
    rows = [(1, "a"), (5, "a"), (3, "b"), (None, "b"), (4, None), (2, ""), (None, "c"), (7, "d"), (7, "d"), (8, "z" * 300_000)]
    got = collections.Counter(tuple(r) for r in exact_dedup.decide(docs(spark, rows), keep="largest", carry=("kept",)).collect())
    want = [
        (1, "y", 5, 2, False), (5, "y", 5, 2, True), (3, "y", 3, 2, True), (None, "y", 3, 2, False), (4, "y", 4, 2, True),
        (2, "y", 4, 2, False), (None, "y", None, 1, True), (7, "y", 7, 2, True), (7, "y", 7, 2, True), (8, "y", 8, 1, True),
    ]
    assert got == collections.Counter(want)
    least = {r["doc_id"]: r["keep_id"] for r in exact_dedup.decide(docs(spark, rows)).collect()}
    assert least[5] == 1 and least[4] == 2
    assert exact_dedup.decide(docs(spark, [])).count() == 0


def test_exact_survivors_keep_their_columns(spark):
    rows = [(1, "a"), (5, "a"), (3, "b"), (None, "b"), (4, None), (2, ""), (7, "d"), (7, "d")]
    for keep, ids in (("largest", [3, 4, 5, 7]), ("smallest", [1, 2, 3, 7])):
        out = exact_dedup.keep_one(docs(spark, rows), keep=keep)
        assert out.columns == ["doc_id", "text", "_hash", "kept", "n"]
        assert sorted(r["doc_id"] for r in out.collect()) == ids
    kept = {r["doc_id"]: r["text"] for r in exact_dedup.keep_one(docs(spark, rows), keep="largest").collect()}
    assert kept[4] is None


def test_a_hash_collision_does_not_merge_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "hash128", lambda text: F.unhex(F.substring(F.md5(F.substring(text, 1, 1)), 1, 4)))
    rows = [(1, "ax"), (2, "ay"), (3, "ax"), (4, "b"), (5, "ay")]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.decide(docs(spark, rows)).collect())
    assert got == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 4, 1), (5, 2, 2)]
    assert exact_dedup.keep_one(docs(spark, rows)).count() == 3


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            part[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def near(spark, rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}


def test_shingles_equal_python_sets():
    texts = ["", "   ", "One", "a b c d", "A b\tc\x0bd  E", "x y z a b " * 50, "naïve Ünïcode ÀB c d e f\x1cg h", "w" * 5000 + " a b c d e"]
    for text, got in zip(texts, shingle_sets(texts)):
        w = words_of(text)
        assert len(got) == (len({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}) if w else 0), text


def test_link_test_is_exact():
    one, two = np.arange(100, dtype=np.uint64), np.arange(14, 115, dtype=np.uint64)
    for shift in range(40):
        a, b = set(one.tolist()), set((two + np.uint64(shift)).tolist())
        assert linked(one, two + np.uint64(shift), 75) == (100 * len(a & b) >= 75 * len(a | b))


def test_near_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    rows, key = [], 100
    for _ in range(60):  # a crowd around one text: some pairs link, many only nearly
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = f"e{rng.integers(0, 100_000)}"
        rows.append((key, " ".join(words)))
        key += 1
    rows += [(i, " ".join(f"u{x}" for x in rng.integers(0, 50_000, rng.integers(1, 60)))) for i in range(40)]
    rows += [(900, rows[3][1]), (901, rows[3][1].upper()), (902, None), (903, ""), (904, "a b c"), (905, "A  b\tc"), (906, "a b")]
    assert near(spark, rows) == brute(rows)


def test_near_defined_cases(spark):
    text = " ".join(f"t{i}" for i in range(40))
    got = minhash.near_duplicates(docs(spark, [(None, text), (4, text), (3, text + " x"), (None, None), (9, "v " * 50_000)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 0, None), (-1, 36, 3), (3, 37, 3), (4, 36, 3), (9, 1, 9)]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    out = minhash.keep_one(docs(spark, [(None, text), (4, text), (3, text + " x"), (None, None)]))
    assert out.columns == ["doc_id", "text", "_hash", "kept", "n"]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "None"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([0, i]), bytes([0, i + 1])) for i in range(60)] + [(b"\x09\x01", b"\x09\x02")], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in minhash.components(edges).collect()}
    assert len(roots) == 63 and {roots[bytes([0, i])] for i in range(61)} == {b"\x00\x00"} and roots[b"\x09\x02"] == b"\x09\x01"


def test_kept_is_the_components_own_id(spark):
    """An id that names two texts of its component is that component's in both rows; the survivor is one row."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(7, words), (7, words + " more"), (9, words)]
    out = minhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(7, 7, True), (7, 7, True), (9, 7, False)]
    assert minhash.keep_one(docs(spark, rows)).count() == 1
