import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import decontaminate as d


def distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=120))
@settings(max_examples=150, deadline=None)
def test_myers_equals_dynamic_programming(item, text):
    best, end = d.myers(item, text)
    assert best == distance_in(item, text) and 0 <= end <= len(text)


def edited(text, edits, rng):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        rng.choice([lambda: letters.__setitem__(at, "#"), lambda: letters.insert(at, "~"), lambda: letters.pop(at)])()
    return "".join(letters)


def test_every_occurrence_within_the_budget_is_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    docs = []
    for i in range(300):
        body = " ".join(word() for _ in range(40))
        key, text = rng.choice(items)
        if i % 3:
            allowed = d.budget(d.normal(text))
            text = edited(text.upper() if i % 2 else text, rng.randint(0, allowed + 6), rng)
            body = f"{body}\n {text} {body}"
        docs.append((i, body))
    want = {
        (i, k) for i, body in docs for k, text in items
        if distance_in(d.normal(text), d.normal(body)) <= d.budget(d.normal(text))
    }
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for most in (d.MAX_ITEMS_BYTES, 1500):  # one block of items, and several
        got = {(r["doc_id"], r["item_id"]) for r in d.matches(frame, tests, most=most).collect()}
        assert got == want and len(want) > 100
        left = d.clean(frame, tests, most=most)
        assert left.columns == frame.columns
        assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_defined_cases(spark):
    tests = spark.createDataFrame([(1, None), (2, ""), (None, "short one"), (4, "a longer test item of the set"), (4, "a longer test item of the set")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a SHORT  one here"), (3, "y " * 100_000 + "a longer tst item of the set")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"] or -1, r["distance"]) for r in d.matches(docs, tests).collect())
    assert got == [(-1, -1, 0), (3, 4, 1), (3, 4, 1)]
    assert sorted(r["doc_id"] for r in d.clean(docs, tests).collect()) == [1, 2]
    assert d.matches(docs.limit(0), tests).count() == 0 and d.matches(docs, tests.limit(0)).count() == 0
    assert d.clean(docs, tests.limit(0)).count() == 4
