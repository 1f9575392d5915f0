"""Greedy operators against plain restatements on small inputs, and invariants of the plans."""

import collections
import inspect
import re

import numpy as np
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.operators import chunking, clean, layout, mining, retrieval
from marginalia.plans import deck, quiz, report
from marginalia.sources import views


def test_token_windows(spark):
    for n in (0, 1, 9, 10, 11, 17, 18, 40):
        text = " ".join(f"w{i}" for i in range(n))
        got = spark.range(1).select(chunking.token_windows(F.lit(text), 10, 3)).first()[0]
        tokens, want, at = text.split(), [], 0
        if n <= 10:
            want = [text]
        else:
            while True:
                want.append(" ".join(tokens[at : at + 10]))
                if at + 10 >= n:
                    break
                at += 7
        assert got == want, n


def test_greedy_groups(spark, sf):
    from marginalia.catalog.text import _blocks

    rows = chunking.merge_groups(_blocks(spark, sf), 60).collect()
    pages = {}
    for r in rows:
        pages.setdefault((r.paper_id, r.page), []).append(r)
    for page in pages.values():
        page.sort(key=lambda r: r.ordinal)
        group, size, closed, kind = -1, 0, True, None
        for r in page:
            fits = not closed and not r.atomic and kind == (r.modality, r.provenance) and size + r.tokens <= 60
            group, size = (group, size + r.tokens) if fits else (group + 1, r.tokens)
            closed, kind = r.atomic, (r.modality, r.provenance)
            assert r.group_no == group


def test_diversify(spark, sf):
    chunks = views.passages(spark, sf).withColumn("rank", F.col("ordinal"))
    got = {}
    for r in clean.diversify(chunks, ["paper_id"], 6, ["rank", "chunk_id"]).collect():
        got.setdefault(r.paper_id, []).append((r.position, r.chunk_id))
    papers = {}
    for r in chunks.select("paper_id", "rank", "chunk_id", "text").collect():
        papers.setdefault(r.paper_id, []).append((r.rank, r.chunk_id, r.text))
    stop = set(K.PROSE_STOPWORDS)
    for paper, rows in papers.items():
        picked, skipped = [], []
        for _, chunk, text in sorted(rows):
            bag = {t for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9'’\-]*", text.lower()) if len(t) > 2 and t not in stop}
            close = any(bag and other and len(bag & other) / len(bag | other) > 0.6 for _, other in picked)
            (skipped if close or len(picked) >= 6 else picked).append((chunk, bag))
        want = [c for c, _ in picked] + [c for c, _ in skipped][: 6 - len(picked)]
        assert [c for _, c in sorted(got[paper])] == want


def test_overlapping_regions(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 10.0, 10.0, 90.0, 90.0), (1, 1, 3, 90.0, 90.0, 190.0, 190.0), (1, 1, 4, 0.0, 200.0, 30.0, 300.0)]
    df = spark.createDataFrame(rows, "paper_id int, page int, region_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.region_id for r in layout.drop_overlapping(df).collect()) == [1, 3]


def test_hash_vector(spark):
    import hashlib
    import math
    from collections import Counter

    text = "the cat The dog  sat\ton cat"
    got = spark.createDataFrame([(text,)], "text string").select(retrieval.hash_vector(F.col("text")).alias("v")).first().v
    counts = Counter(int(hashlib.md5(t.encode()).hexdigest(), 16) % 1024 for t in text.lower().split())
    norm = math.sqrt(sum(v * v for v in counts.values()))
    assert dict(zip(got.buckets, (round(w, 9) for w in got.weights))) == {b: round(n / norm, 9) for b, n in counts.items()}


def test_nearest_slices_agree(spark, sf, monkeypatch):
    vectors = views.vectors(spark, sf)
    none = F.lit(None).cast("int")
    questions = vectors.select(
        F.col("chunk_id").alias("question_id"), "embedding", none.alias("paper_id"), none.alias("page_lo"), none.alias("page_hi")
    )
    whole = sorted(map(tuple, retrieval.nearest(questions, vectors, 5).collect()))
    monkeypatch.setattr(retrieval, "QUESTION_ROWS", 7)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 9)
    assert sorted(map(tuple, retrieval.nearest(questions, vectors, 5).collect())) == whole
    assert {r[2] for r in whole if r[-1] == 1} == {r[0] for r in whole}  # a vector is nearest to itself


def _clustered(rng, clusters=20, each=40, dim=16):
    middles = rng.normal(size=(clusters, dim)) * 10
    rows = [(f"c{i:04d}", i % 7 if i % 50 else None, i % 11 if i % 13 else None, (middles[i % clusters] + rng.normal(size=dim)).tolist()) for i in range(clusters * each)]
    return [*rows, ("zero", 1, 2, [0.0] * dim), ("none", 1, 2, None), *[(f"same{i}", 3, 4, rows[5][3]) for i in range(9)]]


def _direct(questions, vectors, k, per_paper):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1e-9)
    out = []
    for qid, q, paper, low, high in questions:
        if q is None:
            continue
        hits = collections.defaultdict(list)
        for cid, p, page, v in vectors:
            ranged = low is not None or high is not None
            ends = [max(x, 1) for x in (low, high) if x is not None]
            if v is None or (paper is not None and p != paper) or (ranged and (page is None or not min(ends) <= page <= max(ends))):
                continue
            hits[p if per_paper else None].append((-round(float(unit(q) @ unit(v)), 9), cid, p))
        for rows in hits.values():
            out += [(qid, p, cid, -s, n) for n, (s, cid, p) in enumerate(sorted(rows, key=lambda r: r[:2])[:k], 1)]
    return sorted(out, key=repr)


def test_nearest_equals_the_direct_computation(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = _clustered(rng)
    scopes = [(None, None, None), (3, None, None), (None, 9, 2), (5, 0, 4), (99, None, None), (None, 4, None)]
    questions = [(f"q{i}", vectors[int(rng.integers(len(vectors) - 12))][3] if i % 9 else [0.0] * 16, *scopes[i % 6]) for i in range(40)] + [("blank", None, None, None, None)]
    q = spark.createDataFrame(questions, "question_id string, embedding array<double>, paper_id int, page_lo int, page_hi int")
    v = spark.createDataFrame(vectors, "chunk_id string, paper_id int, page int, embedding array<double>")
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 50)
    for per_paper in (False, True):
        got = [tuple(r) for r in retrieval.nearest(q, v, 4, per_paper).collect()]
        rounded = sorted(((a, p, c, round(s, 9), n) for a, p, c, s, n in got), key=repr)
        assert rounded == [(a, p, c, round(s, 9), n) for a, p, c, s, n in _direct(questions, vectors, 4, per_paper)]
    assert retrieval.nearest(q.limit(0), v, 4).columns == retrieval.nearest(q, v, 4).columns


def test_cells_beyond_the_bound_are_skipped(spark):
    rng = np.random.default_rng(5)
    vectors = [r for r in _clustered(rng, 40, 60) if r[3] is not None]
    v = spark.createDataFrame(vectors, "chunk_id string, paper_id int, page int, embedding array<double>")
    cells, placed = retrieval.fit_cells(v, 40)
    none = F.lit(None).cast("int")
    q = v.select(F.col("chunk_id").alias("question_id"), "embedding", none.alias("paper_id"), none.alias("page_lo"), none.alias("page_hi"))
    visited, used = retrieval.route(q, cells, 5).count(), int((cells.sizes > 0).sum())
    assert placed.count() == len(vectors) == cells.sizes.sum()
    assert visited < 0.2 * used * len(vectors)  # most cells are skipped; the test above shows that no hit is lost


def test_no_question_reaches_the_driver():
    source = inspect.getsource(retrieval)
    assert "toPandas" not in source


def test_glance_draft(spark):
    rows = [
        (1, 0, "we propose a framework for this problem", 1), (1, 1, "the dataset and benchmark are large", 2),
        (1, 2, "accuracy is 91 percent", 3), (1, 3, "the problem is hard to solve", 4),
    ]
    df = spark.createDataFrame(rows, "paper_id int, pos long, sentence string, marker int").withColumn("low", F.lower("sentence"))
    body = report.glance_draft(df).first().body.split("\n\n")
    assert body == [
        "**Problem** — the problem is hard to solve [4]", "**Approach** — we propose a framework for this problem [1]",
        "**Evidence** — the dataset and benchmark are large [2]", "**Headline result** — accuracy is 91 percent [3]",
        "**Read this if** — Not stated in the retrieved passages.",
    ]


def test_outline_invariants(spark, sf):
    outline = report.plan_outline(views.passages(spark, sf)).collect()
    per_section = {}
    for r in outline:
        per_section.setdefault((r.paper_id, r.section), []).append(r)
    for (_, section), rows in per_section.items():
        assert len({r.chunk_id for r in rows}) == len(rows)
        if section != "Figures":
            assert len(rows) <= K.DETAIL_PARAMS["standard"]["k"]
        else:
            assert all(r.modality in ("ocr", "vision", "image") for r in rows)


def test_pool_limit_and_rotation(spark, sf):
    pool = report.rotated_pool(views.passages(spark, sf), limit=8)
    assert pool.groupBy("paper_id").count().agg(F.max("count")).first()[0] <= 8


def test_deck_is_stable_and_unique(spark, sf):
    from marginalia.catalog.decks import _full_deck

    cards = _full_deck(spark, sf).collect()
    keys = [(c.paper_id, c.content_key) for c in cards]
    assert len(set(keys)) == len(keys)
    counts = {}
    for c in cards:
        counts[c.paper_id] = counts.get(c.paper_id, 0) + 1
        assert len(c.back) >= K.MIN_BACK_CHARS and len(c.front) <= K.MAX_FRONT_CHARS + 1
    assert max(counts.values()) <= 20
    assert sorted(keys) == sorted((c.paper_id, c.content_key) for c in _full_deck(spark, sf).collect())


def test_quiz_invariants(spark, sf):
    from marginalia.catalog.decks import _sources

    sources = _sources(spark, sf)
    assert sources.groupBy("paper_id").count().agg(F.max("count")).first()[0] <= K.MAX_SOURCES
    empty = spark.createDataFrame([], "paper_id long, prompt string")
    questions = quiz.build_quizzes(sources, empty, 10).collect()
    quizzes = {}
    for q in questions:
        quizzes.setdefault(q.paper_id, []).append(q)
    for rows in quizzes.values():
        assert [q["index"] for q in sorted(rows, key=lambda q: q["index"])] == list(range(len(rows)))
        assert len(rows) <= 10
        for q in rows:
            if q.kind == "multiple_choice":
                assert [o.id for o in q.options] == list("abcd") and q.correct_option_id in "abcd"


def test_asked_questions_are_avoided(spark, sf):
    from marginalia.catalog.decks import _sources

    sources = _sources(spark, sf).cache()
    empty = spark.createDataFrame([], "paper_id long, prompt string")
    first = quiz.build_quizzes(sources, empty, 3).select("paper_id", "prompt").collect()
    again = quiz.build_quizzes(sources, spark.createDataFrame(first), 3).select("paper_id", "prompt").collect()
    repeated = set(map(tuple, first)) & set(map(tuple, again))
    assert len(repeated) < len(first) / 2


DRAFTS = "paper_id long, kind string, difficulty string, family string, source_id string, prompt string, prompt_key string, anchor string, seq int"


def _picked(spark, drafts, asked, count):
    valid = spark.createDataFrame([(1, *(("true_false", "recall", *d) if len(d) == 6 else d)) for d in drafts], DRAFTS)
    before = spark.createDataFrame([(1, p) for p in asked], "paper_id long, prompt string")
    chosen = quiz.select_questions(valid, before, count).join(valid.withColumn("draft_id", quiz.draft_id()), ["paper_id", "draft_id"])
    return [r.prompt for r in chosen.orderBy("index").collect()]


def test_selection_respects_caps_and_relaxes_them_in_order(spark):
    drafts = [
        ("numeric" if i % 2 else "definition", f"s{i // 2}", f"p{i}", f"p{i}", "same" if i < 6 else f"a{i}", i)
        for i in range(12)
    ]
    # one per source, two per anchor, two per family of four; p8 was asked before
    assert _picked(spark, drafts, ["p8"], 4) == ["p0", "p2", "p7", "p9"]
    # three per family of five; then the source rule falls, at last the ban on p8
    assert _picked(spark, drafts, ["p8"], 5) == ["p0", "p2", "p6", "p9", "p11"]
    assert _picked(spark, drafts, ["p8"], 6)[-1] == "p10" and _picked(spark, drafts, ["p8"], 7)[-1] == "p11"
    everything = _picked(spark, drafts, ["p8"], 30)
    assert everything[-1] == "p8" and len(everything) == 8 and sum(p in ("p0", "p1", "p2", "p3", "p4", "p5") for p in everything) == 2


def test_a_rejected_draft_does_not_cost_its_slot_the_turn(spark):
    first, second = ("multiple_choice", "recall"), ("true_false", "recall")
    drafts = [
        (*first, "definition", "s0", "pc", "pc", "a", 0), (*first, "definition", "s2", "pd", "pd", "b", 1),
        (*second, "numeric", "s0", "pa", "pa", "c", 0), (*second, "numeric", "s3", "pb", "pb", "d", 1),
    ]
    assert _picked(spark, drafts, [], 2) == ["pc", "pb"]
    # the second slot offers four drafts a turn; the fifth comes in the next turn, after the first slot's second
    crowd = [(*second, "numeric", "s0", f"x{i}", f"x{i}", "c", i) for i in range(4)] + [(*second, "numeric", "s9", "late", "late", "e", 9)]
    assert _picked(spark, [*drafts[:2], *crowd], [], 3) == ["pc", "pd", "late"]


def test_slots_take_turns_in_tier_order(spark):
    kinds = [(k, t) for t in K.DIFFICULTIES for k in K.QUESTION_KINDS]
    drafts = [(*kinds[i % 9], "definition", f"s{i}", f"p{i}", f"p{i}", f"a{i}", i) for i in range(27)]
    assert _picked(spark, drafts, [], 20) == [f"p{i}" for i in range(20)]


def test_interleave_takes_turns(spark):
    rows = [(1, b, i, "fact", f"front {b} {i}", f"wide {b} {i}", "back") for b, n in ((1, 3), (2, 1), (3, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "paper_id int, bucket int, place int, origin string, front string, wide_front string, back string")
    out = deck.interleave(df.withColumn("seen_before", F.lit(False)), 5).orderBy("position").collect()
    assert [(r.bucket, r.place) for r in out] == [(1, 0), (2, 0), (3, 0), (1, 1), (3, 1)]


def test_whole_deck_mixes_report_and_pool(spark):
    sections = spark.createDataFrame(
        [
            (1, "Key Concepts", "**Span attention** — the share of the input that is in view at every step of the model [1]."),
            (2, "Key Concepts", "The model reaches 37.5 points on the benchmark, which is more than all of the earlier systems reach."),
        ],
        "paper_id long, name string, body string",
    )
    cited = spark.createDataFrame([(1, "Key Concepts", 1, 1, "x", 4, "c4")], "paper_id long, name string, position int, marker int, snippet string, page int, chunk_id string")
    pool = spark.createDataFrame(
        [(1, "p1", 2, 0, "A gating unit is defined as the part of the network that decides which of its inputs are used."),
         (4, "p9", 3, 0, "A gating unit is defined as the part of the network that decides which of its inputs are used.")],
        "paper_id long, chunk_id string, page int, seq int, text string",
    )
    papers = spark.createDataFrame(
        [(i, "", "This abstract says that the method needs 12 steps, far fewer than the 40 steps of the older methods.") for i in (1, 2, 3, 4)],
        "paper_id long, title string, abstract string",
    )
    terms, facts = deck.term_cards(sections, cited), deck.report_candidates(sections, cited, 20).filter("bucket = 3")
    assert [r.paper_id for r in terms.collect()] == [1]
    assert [(r.paper_id, r.section) for r in facts.collect()] == [(2, "Key Concepts")]  # prose instead of terms
    none = spark.createDataFrame([], "paper_id long, content_key string")
    made = deck.build_whole_deck(sections, cited, pool.withColumn("rank", F.col("seq")), papers, none).collect()
    by = {p: {r.section for r in made if r.paper_id == p} for p in (1, 2, 3)}
    assert len([r for r in made if r.paper_id == 1]) >= 2 and "Key Concepts" in by[1] and by[3] == {"Overview"}


def test_an_unanswered_study_question_keeps_its_row(spark, sf):
    titles = spark.createDataFrame([(-5, "No passages")], "paper_id long, title string")
    rows = report.study_questions(report.plan_outline(views.passages(spark, sf)), titles).collect()
    assert [r.number for r in sorted(rows, key=lambda r: r.number)] == list(range(1, len(rows) + 1)) and rows
    assert {r.answer for r in rows} == {K.UNANSWERED_QUESTION} and {r.chunk_id for r in rows} == {None}


def test_a_stored_address_comes_first(spark):
    from marginalia.operators import library

    rows = [(1, "2401.00001", "arXiv", "https://own.example/a", "T", ["A B"]), (2, "2401.00002", "arXiv", "", "T", ["A B"])]
    papers = spark.createDataFrame(rows, "paper_id int, article_id string, article_label string, abs_url string, title string, authors array<string>")
    papers = papers.withColumn("published", F.lit(None).cast("date"))
    got = {r.paper_id: r.paper.url for r in library.citation_record(papers).collect()}
    assert got == {1: "https://own.example/a", 2: "https://arxiv.org/abs/2401.00002"}


def test_distractors_are_the_next_fitting_ones_on_the_ring_whatever_the_rounds(spark):
    import hashlib

    body = lambda i: "shared words of one copied passage" if i % 3 else f"alpha{i} beta{i} gamma{i} delta{i}"
    rows = [(p, i, f"s{i}", "Methods", body(i), f"Term {i}", "c") for p, n in ((1, 30), (2, 1), (3, 3)) for i in range(1, n + 1)]
    sources = spark.createDataFrame(rows, "paper_id long, no long, source_id string, section string, body string, term string, chunk_id string")

    def expected(paper):
        ring = sorted((r for r in rows if r[0] == paper), key=lambda r: hashlib.sha1(f"{paper}|{r[2]}".encode()).hexdigest())
        turned = {r[2]: ring[i + 1 :] + ring[:i] for i, r in enumerate(ring)}
        return {(paper, s): [o[5] for o in others if not (o[1] % 3 and int(s[1:]) % 3)][:3] for s, others in turned.items()}

    want = {k: v for paper in (1, 2, 3) for k, v in expected(paper).items()}
    for rounds in ((None,), (2, 5, None), quiz.RING_ROUNDS):
        out = quiz.with_distractors(sources, rounds).collect()
        assert {(r["paper_id"], r["source_id"]): [o["term"] for o in r["others"]] for r in out} == want
        assert {r["paper_id"]: r["definitions"] for r in out} == {1: 30, 2: 1, 3: 3}



def test_first_round_of_distractors_explodes_no_neighbours(spark, monkeypatch):
    """Slices of a ring see all neighbours, and one round moves a text no oftener than its rows."""
    lines = [(p, i, f"s{i}", f"Term {i}", f"alpha{i} beta{i % 5} gamma{i} body of line {i}") for p, size in ((1, 23), (2, 9), (3, 8), (4, 3), (5, 1)) for i in range(size)]
    sources = spark.createDataFrame(lines, "paper_id int, no int, source_id string, term string, body string")

    def listed(rounds):
        return {(r["paper_id"], r["no"]): [(o["step"], o["term"]) for o in r["others"]] for r in quiz.with_distractors(sources, rounds).collect()}

    want = listed((None,))
    for rows in (4, 8):
        monkeypatch.setattr(quiz, "RING_SLICE", rows)
        assert listed((4, None)) == want
    ringed = sources.selectExpr("*", "cast(no as bigint) as at", "count(1) over (partition by paper_id) as n")
    plan = quiz._next_in_slice(ringed, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(paper_id") == 2

def test_header_with_capitals_beyond_ascii_is_removed(spark):
    from marginalia.operators import clean

    header = "ÈRE  MENTEUX\n\n" + " ".join(["ÉLAN DE LA MÊME REVUE"] * 5)  # the blanks differ from its normal form
    rows = spark.createDataFrame([(1, f"c{i}", i, i, f"{header} {w} closes the page") for i, w in enumerate(["alpha", "beta", "gamma"])], "paper_id int, chunk_id string, page int, rank int, text string")
    got = [r.text for r in clean.strip_running_headers(rows, ["paper_id"]).orderBy("rank").collect()]
    assert got == ["alpha closes the page", "beta closes the page", "gamma closes the page"]


def test_outline_and_pool_move_a_text_once(spark, sf):
    """A text crosses one shuffle, however many queries find its chunk, and rows are marked as the joins would leave them."""
    rows = views.passages(spark, sf)
    swept = retrieval.sweep_by_chunk(rows, K.SWEEP_QUERIES, [3] * len(K.SWEEP_QUERIES))
    want = retrieval.sweep(retrieval.with_hash_vector(rows), K.SWEEP_QUERIES, 3).select("chunk_id", "query_no", "rank").collect()
    got = swept.select("chunk_id", F.explode("hits").alias("h")).select("chunk_id", "h.query_no", "h.rank").collect()
    assert sorted(got) == sorted(want)
    marked = clean.mark_narrative(swept.withColumn("rank", F.col("hits")[0]), ["paper_id"])
    joined = clean.narrative_chunks(swept.withColumn("rank", F.col("hits")[0]), ["paper_id"], allow_fallback=False)
    kept = marked.filter("clean is not null").select("chunk_id", "clean", "low_prose").collect()
    assert sorted(kept) == sorted(tuple(r) for r in joined.select("chunk_id", "text", "low_prose").collect())
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_outline_tasks_follow_the_hits(spark, sf, monkeypatch):
    from marginalia.operators import retrieval, skew

    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    chunks = views.passages(spark, sf)
    swept = retrieval.sweep_by_chunk(chunks, K.SWEEP_QUERIES, [3] * len(K.SWEEP_QUERIES))
    # tasks sized by the bytes of their input spilled in the windows that follow
    assert swept.rdd.getNumPartitions() == -(-swept.count() // 100) > 4


def test_texts_read_before_they_are_listed_are_cleaned_alike(spark):
    head = "Annals of Repeated Headers and Their Cutting, Volume Nine, " * 2
    texts = [head + f"then the study number {n} is on the data and it was seen in the field." for n in range(4)]
    texts += ["Figure 1: a caption", "https://host.example/1", None, "The plain text is the same in all of the sections.", "The plain text is the same in all of the sections!"]
    rows = spark.createDataFrame([(1, f"c{n}", n + 1, n, t) for n, t in enumerate(texts)], "paper_id int, chunk_id string, page int, rank int, text string")
    listed = clean.read_texts(rows).crossJoin(spark.createDataFrame([(0,), (1,)], "section_no int")).filter("section_no = 0 or page > 2")
    scope = ["paper_id", "section_no"]
    marked = clean.mark_narrative(listed, scope).filter("clean is not null").select(*scope, "chunk_id", "clean", "low_prose")
    plain = clean.narrative_chunks(listed.drop(*clean.READ), scope, allow_fallback=False).filter("text <> ''").select(*scope, "chunk_id", "text", "low_prose")
    assert sorted(marked.collect()) == sorted(plain.collect())
    cut = marked.filter("chunk_id = 'c2'").collect()
    assert {r["section_no"]: r["clean"].startswith("Annals") for r in cut} == {0: False, 1: True}  # two pages make no header


def test_claims_are_found_once_and_take_the_snippet_of_their_citation(spark):
    name = K.CLAIM_SECTIONS[0]
    body = "The model reads every line of the paper and counts its words. It is trained on the whole of the text for days.\n\nNothing of this kind was ever seen in the older corpus before."
    sections = spark.createDataFrame([(1, name, body)], "paper_id long, name string, body string")
    cited = [(1, name, 1, 1, body.split("\n")[0], 3, "c1"), (1, name, 2, 2, "quite another matter", 4, "c2")]
    citations = spark.createDataFrame(cited, "paper_id long, name string, position int, marker int, snippet string, page int, chunk_id string")
    got = quiz.claim_sources(sections, citations)
    rows = [(r["body"], r["chunk_id"], r["cited"]) for r in got.orderBy("a").collect()]
    assert [(r[1], r[2]) for r in rows] == [("c1", cited[0][4])] * 2 + [(None, None)]
    # the chain that finds the claims stood in the plan twice
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_glance_makes_its_candidates_once_and_keeps_papers_without_any_label(spark):
    rows = [(1, 1, "We propose a novel method for the problem of reading long texts aloud."), (2, 1, "Nothing of that kind stands in this long and plain line of text.")]
    inputs = spark.createDataFrame(rows, "paper_id long, marker int, text string").withColumn("chunk_id", F.lit("c"))
    out = report.glance_draft(report.glance_candidates(inputs, None))
    bodies = dict(out.collect())
    assert "We propose a novel method" in bodies[1] and bodies[2].count("Not stated in the retrieved passages.") == 5
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_named_sentences_are_found_whatever_their_blanks(spark):
    rows = [(1, 1, "c", "It DOES \n not work at all in the dark conditions of a cave. The other lines say nothing of the kind to anyone.")]
    chunks = spark.createDataFrame(rows, "paper_id long, rank int, chunk_id string, text string")
    every = [r.sentence for r in mining.sentence_candidates(chunks, ["paper_id"]).collect()]
    named = [r.sentence for r in mining.sentence_candidates(chunks, ["paper_id"], ["does not", "a.b"]).collect()]
    assert len(every) == 2 and named == ["It DOES not work at all in the dark conditions of a cave."]


def test_ocr_words_travel_without_structs(spark):
    rows = [(1, 2, "beta", 50), (1, 0, "alpha", 90), (1, 1, "skipped", -1), (2, 0, "tiny", 10)]
    out = layout.ocr_regions(spark.createDataFrame(rows, "id int, position int, word string, conf int"), ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, "alpha beta", 0.7)]
    assert "collect_list(struct" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rejected_drafts_take_no_slot_of_a_quiz(spark, monkeypatch):
    """Validation comes before the choice: a quiz is full as long as valid drafts are left."""
    schema = (
        "paper_id long, family string, kind string, difficulty string, seq int, prompt string, options array<struct<id:string,text:string>>,"
        " correct_option_id string, correct_answer_text string, accepted_answers array<string>, explanation string, source_id string, anchor string"
    )

    def draft(seq, source, prompt, explanation, answer):
        return (1, "numeric", "short_answer", "recall", seq, prompt, [], None, answer, [answer], explanation, source, f"a{seq}")

    said = "The paper states this value plainly."
    rows = [
        draft(0, "s1", "Which value is missing here: 37?", said, "37"),  # tells its answer
        draft(1, "s1", "Which value is missing there?", said, "38"),
        draft(2, "s2", "Which value is missing at the end?", "Too short.", "39"),
        draft(3, "s3", "Which value is missing at the start?", said, "40"),
    ]
    monkeypatch.setattr(quiz, "draft_pool", lambda sources: spark.createDataFrame(rows, schema))
    sources = spark.createDataFrame([(1, f"s{i}", "Methods", 1, f"c{i}", "x") for i in (1, 2, 3)], "paper_id long, source_id string, section string, page int, chunk_id string, snippet string")
    none = spark.createDataFrame([], "paper_id long, prompt string")
    got = sorted((q["index"], q["correct_answer_text"]) for q in quiz.build_quizzes(sources, none, 2).collect())
    assert got == [(0, "38"), (1, "40")]
