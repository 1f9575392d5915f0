import collections

import pytest

from marginalia.llm import decontaminate, packing
from marginalia.llm.queries import ORACLES, QUERIES

from .test_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """Ids kept by every stage over the smallest tables."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS, name
        rows = docs.collect()
        out.append({r["doc_id"]: r["text"] for r in rows})
        assert len(out[-1]) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_order_of_stages():
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_against_brute_force(spark, sf, kept):
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    clean, unique, apart, safe = kept
    assert set(clean) == {i for i, p in scores.items() if not p}
    last = {}
    for i, text in clean.items():
        last[text] = max(i, last.get(text, i))
    assert set(unique) == set(last.values())
    assert set(apart) == {i for i, (_, _, stays) in brute(list(unique.items())).items() if stays}
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = decontaminate.Matcher(list(enumerate(items)), decontaminate.ERROR_RATE)
    assert set(safe) == {i for i, t in apart.items() if not found(decontaminate.normal(t))}
    assert not any(item in decontaminate.normal(t) for t in safe.values() for item in items)


def test_run_packs_what_is_left(spark, sf, kept):
    pieces = QUERIES["pipeline"](spark, sf).collect()
    tokens = collections.Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    assert set(tokens) == set(kept[-1])
    assert all(tokens[p["doc_id"]] == p["doc_tokens"] for p in pieces)


def test_empty_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0, name


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES) and packing.BLOCK == 4096
