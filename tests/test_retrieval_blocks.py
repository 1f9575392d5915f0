"""Joins that must not form all pairs: block postings, containment, greedy scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.operators import clean, report, retrieval


def _passages(rng, papers, each):
    words = [f"w{i}" for i in range(200)]
    return [
        (p, f"{p}-{i:04d}", " ".join(rng.choices(words[: 10 + 40 * (i % 5)], k=rng.randint(3, 40)))) for p in range(papers) for i in range(each)
    ]


def _sparse_direct(questions, chunks, k):
    import hashlib
    import math
    from collections import Counter

    def vector(text):
        counts = Counter(int(hashlib.md5(t.encode()).hexdigest()[-3:], 16) % 1024 for t in text.lower().split())
        norm = math.sqrt(sum(v * v for v in counts.values())) or 1.0
        return {b: v / norm for b, v in counts.items()}

    held, out = [(p, c, vector(t)) for p, c, t in chunks], []
    for q, paper, text in questions:
        asked = vector(text)
        scores = sorted((-round(sum(w * v.get(b, 0.0) for b, w in asked.items()), 9), c) for p, c, v in held if p == paper)
        out += [(q, c, n, -s) for n, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 3])
def test_sparse_top_k_equals_the_direct_computation(spark, monkeypatch, hot):
    monkeypatch.setattr(retrieval, "HOT_POSTINGS", hot)
    rng = random.Random(8)
    chunks = [*_passages(rng, 3, 120), (7, "7-0", "alone"), (7, "7-1", "")]
    questions = [(f"q{i}", rng.choice([0, 1, 2, 7]), " ".join(f"w{rng.randrange(250)}" for _ in range(rng.randint(1, 9)))) for i in range(40)]
    questions += [("known", 7, "alone"), ("blank", 1, " "), ("nowhere", 99, "w1")]
    c = retrieval.with_hash_vector(spark.createDataFrame(chunks, "paper_id int, chunk_id string, text string"))
    q = retrieval.with_hash_vector(spark.createDataFrame(questions, "question_id string, paper_id int, text string"))
    got = sorted((r.question_id, r.chunk_id, r["rank"], r.score) for r in retrieval.sparse_nearest(q, c, 5).collect())
    want = _sparse_direct(questions, chunks, 5)
    assert [(a, b, n, pytest.approx(s, abs=2e-9)) for a, b, n, s in want] == got


def test_blocks_that_cannot_reach_the_threshold_are_not_read(spark):
    chunks = [(1, f"a{i}", "rare rare rare rare common") for i in range(6)] + [(1, f"b{i}", f"common x{i} y{i} z{i} u{i} v{i}") for i in range(300)]
    c = retrieval.with_hash_vector(spark.createDataFrame(chunks, "paper_id int, chunk_id string, text string"))
    q = retrieval.with_hash_vector(spark.createDataFrame([("q", 1, "rare rare rare common")], "question_id string, paper_id int, text string"))
    posted = retrieval.postings(c, "chunk_id", "c").withColumn("impact", retrieval.impact_class(F.col("c")))
    blocks = retrieval.posting_blocks(posted)
    needed = retrieval.needed_blocks(retrieval.postings(q, "question_id", "q"), blocks, 5)
    met = posted.join(needed.drop("question_id"), ["paper_id", "bucket", "impact"]).select("chunk_id").distinct()
    assert sorted(r[0] for r in met.collect()) == [f"a{i}" for i in range(6)]


LINES = "paper_id int, line_no int, text string"
CITED = "paper_id int, position int, marker int, snippet string, page int, chunk_id string"


def _match_direct(lines, cited):
    letters = lambda t: set(re.findall("[a-z]+", (t or "").lower()))
    out = []
    for paper, no, text in lines:
        words, marker = letters(text), re.search(r"\[(\d+)\]", text or "")
        best = None
        for p, position, m, snippet, _, chunk in cited:
            if p == paper:
                share = len(words & letters(snippet)) / len(words) if words else 0.0
                score = 2.0 if marker and int(marker[1]) == m else share
                if score >= K.CITATION_MATCH_FLOOR and (best is None or (-score, position) < best[:2]):
                    best = (-score, position, chunk)
        if best:
            out.append((paper, no, best[2], -best[0]))
    return sorted(out)


def test_best_citation_equals_the_direct_comparison(spark):
    rng = random.Random(3)
    words = [a + b for a in "abcdefghij" for b in "klmnop"]
    text = lambda most: " ".join(rng.choices(words[: rng.randint(4, 60)], k=rng.randint(0, most)))
    lines = [(p, i, text(14) + (f" [{rng.randint(1, 9)}]" if i % 7 == 0 else "")) for p in range(3) for i in range(60)] + [(0, 900, None), (9, 1, "no one")]
    cited = [(p, i, i + 1, text(50), i, f"{p}:{i}") for p in range(3) for i in range(12)] + [(0, 40, 41, None, 1, "none")]
    got = report.match_citations(spark.createDataFrame(lines, LINES), spark.createDataFrame(cited, CITED), ["paper_id"])
    assert sorted((r.paper_id, r.line_no, r.chunk_id, r.score) for r in got.collect()) == _match_direct(lines, cited)


def test_pairs_of_a_large_section_grow_linearly(spark):
    """10,000 lines and as many citations of one section: a line meets the citations that share a rare word."""
    names = lambda i: " ".join("".join(chr(97 + int(d)) for d in f"{7919 * i + j:07d}") for j in range(9))
    rows = spark.range(10_000).select("id").collect()
    lines = [(1, r.id, f"the model of {names(r.id)}") for r in rows]
    cited = [(1, r.id, r.id + 20_000, f"of the {names(r.id)} and the model", 1, f"c{r.id}") for r in rows]
    frame = spark.createDataFrame(lines, LINES), spark.createDataFrame(cited, CITED)
    got = report.match_citations(*frame, ["paper_id"])
    assert got.filter(F.col("chunk_id") == F.concat(F.lit("c"), F.col("line_no"))).count() == 10_000
    made = report.citation_candidates(*report._matched_words(*frame, ["paper_id"]), ["paper_id"]).count()
    assert made < 60_000  # not 100,000,000


def _diverse_direct(rows, limit):
    picked, skipped = [], []
    for row in rows:
        if len(picked) == limit:
            break
        words = row[1]
        clash = any(words & w and len(words & w) / len(words | w) > K.MAX_JACCARD for _, w in picked)
        (skipped if clash else picked).append((row[0], words))
    return [c for c, _ in picked + skipped[: limit - len(picked)]]


def test_diversified_scan_equals_the_list_fold(spark):
    rng = random.Random(6)
    words = [f"word{a}{b}" for a in "abcdef" for b in "ghijk"]
    rows = [(rng.choice([1, 2, 3, None]), f"c{i:03d}", " ".join(rng.sample(words[: rng.randint(3, 30)], 3)), i) for i in range(300)] + [(4, "x", "", 1), (4, "y", None, 2)]
    chunks = spark.createDataFrame(rows, "paper_id int, chunk_id string, text string, rank int")
    for limit in (1, 6, 40):
        out = clean.diversify(chunks, ["paper_id"], limit, ["rank", "chunk_id"]).collect()
        for paper in {r[0] for r in rows}:
            own = [(c, set((t or "").split())) for p, c, t, _ in sorted(rows, key=lambda r: r[3]) if p == paper]
            got = [r.chunk_id for r in sorted((r for r in out if r.paper_id == paper), key=lambda r: r.position)]
            assert got == _diverse_direct(own, limit)
            assert sorted(r.position for r in out if r.paper_id == paper) == list(range(len(got)))


def test_few_citations_cross_no_shuffle_of_words(spark):
    word = lambda i: "w" + chr(97 + i // 10) + chr(97 + i % 10)
    cited = [(1, i, i, f"alpha beta {word(i)}", 1, f"c{i}") for i in range(1, 6)] + [(2, i, i, f"gamma {word(i)}", 1, f"d{i}") for i in range(1, 71)]
    lines = [(1, 0, f"alpha beta {word(3)}"), (1, 1, "nothing here [2]"), (1, 2, "no match"), (2, 0, f"gamma {word(70)}")]
    got = report.match_citations(spark.createDataFrame(lines, LINES), spark.createDataFrame(cited, CITED), ["paper_id"])
    assert sorted((r.paper_id, r.line_no, r.chunk_id) for r in got.collect()) == [(1, 0, "c3"), (1, 1, "c2"), (2, 0, "d70")]
    few = report.match_citations(spark.createDataFrame(lines[:3], LINES), spark.createDataFrame(cited[:5], CITED), ["paper_id"])
    assert "Window" not in few._jdf.queryExecution().optimizedPlan().toString()  # no word is ranked, no pair is listed


@pytest.mark.parametrize("few", [64, 2])
def test_few_and_many_questions_of_a_paper_give_the_same_chunks(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW_QUESTIONS", few)
    monkeypatch.setattr(retrieval, "HOT_POSTINGS", 3)
    rng = random.Random(5)
    chunks = [*_passages(rng, 3, 60), (7, "7-0", "alone"), (7, "7-1", "")]
    asked = [(f"q{i}", rng.choice([0, 0, 1, 7]), " ".join(f"w{rng.randrange(250)}" for _ in range(rng.randint(1, 9)))) for i in range(20)]
    asked += [("one", 2, "w1 w2"), ("blank", 1, " "), ("nowhere", 99, "w1"), ("nothing", None, "w1")]
    c = retrieval.with_hash_vector(spark.createDataFrame(chunks, "paper_id int, chunk_id string, text string"))
    q = retrieval.with_hash_vector(spark.createDataFrame(asked, "question_id string, paper_id int, text string"))
    got = sorted((r.question_id, r.chunk_id, r["rank"], r.score) for r in retrieval.sparse_nearest(q, c, 5).collect())
    assert [(a, b, n, pytest.approx(s, abs=2e-9)) for a, b, n, s in _sparse_direct(asked, chunks, 5)] == got


def test_only_chunks_of_papers_asked_about_are_vectorised(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "one two\nthree"), (2, "four")], "doc_id long, text string").write.parquet(path)
    lines = spark.read.parquet(path).select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    asked = spark.createDataFrame([("q", 1, "two")], "question_id string, paper_id long, text string")
    chunks = retrieval.about_asked(lines.withColumn("chunk_id", F.concat_ws("-", "paper_id", "n")), asked)
    found = retrieval.sparse_nearest(retrieval.with_hash_vector(asked), retrieval.with_hash_vector(chunks), 3)
    assert [(r.question_id, r.chunk_id) for r in found.orderBy("rank").collect()] == [("q", "1-0"), ("q", "1-1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("LeftSemi") > plan.index("Generate explode(array(") and "impact" not in plan  # below the vectors


@pytest.mark.parametrize("few", [64, 1])
def test_figures_of_few_and_many_questions(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW_QUESTIONS", few)
    media = [(1, f"m{i}", i, f"Figure {i + 1}", f"alpha{i % 4} beta{i % 3} gamma", i // 2 + 1) for i in range(9)] + [(2, "n", 0, None, None, None)]
    asked = [("a", 1, "alpha1 beta2 in figure 3"), ("b", 1, "nothing"), ("c", 2, "alpha1"), ("d", 1, "gamma beta1"), ("e", None, "gamma")]
    used = [("a", 1), ("a", 1), ("b", 4), ("c", 1), ("d", None)]
    out = retrieval.relevant_figures(
        spark.createDataFrame(asked, "question_id string, paper_id int, text string"),
        spark.createDataFrame(media, "paper_id int, media_id string, position int, label string, caption string, page int"),
        spark.createDataFrame(used, "question_id string, page int"),
    )
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t or "") if len(w) > 3}
    want = []
    for q, paper, text in asked:
        numbers = [int(n) for n in re.findall(r"figure (\d+)", text)]
        scored = [
            (-(10 * (i + 1 in numbers) + 3 * ((q, page) in used and page is not None) + min(3, len(words(text) & words(caption)))), i, m)
            for p, m, i, _, caption, page in media if p == paper
        ]
        want += [(q, m, -s, n) for n, (s, _, m) in enumerate(sorted(x for x in scored if x[0])[:3], 1)]
    assert sorted((r.question_id, r.media_id, r.score, r["rank"]) for r in out.collect()) == sorted(want)
