import collections

import numpy as np
import pytest

from marginalia.llm import packing, token_counts
from marginalia.llm.common import new_folder
from marginalia.llm.tokens import Encoder, vocabulary_path

TEXTS = [
    "", " ", "plain words here", "two  spaces", " lead", "trail ", "tab\tand\nline\n\nend", "a\n b", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "a<|endoftext|>b <|endoftext", "don't stop'll",
    "naïve Über 中文 text 😀 emoji", "word " * 500, "a" * 3000, "1234 5678\u00a0nbsp", "mixed \r\n ends", "\x1c odd \x1f", "a \u2003 b",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(reference, spark, sf):
    encode = Encoder()
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in texts * 2:  # the second time from the cache
        assert np.frombuffer(encode(text), "<u4").tolist() == reference(text), text


@pytest.mark.parametrize("seed", range(5))
def test_a_block_is_full_and_balanced(seed):
    lengths = np.random.default_rng(seed).integers(1, 1024, 700).tolist()
    sequences = packing.pack_block(lengths, 1024, 1.0, 1 / 1024)
    assert len(sequences) == -(-sum(lengths) // 1024)
    assert all(sum(n for _, _, n in s) <= 1024 for s in sequences)
    covered = collections.defaultdict(list)
    for s in sequences:
        for doc, at, n in s:
            covered[doc].append((at, n))
    for doc, parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == lengths[doc]
    cost = [sum(n + n * n / 1024 for _, _, n in s) for s in sequences]
    assert np.std(cost) / np.mean(cost) < 0.25
    assert packing.pack_block([], 1024, 1.0, 0.1) == []


def test_pieces_cover_every_document(spark, reference):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, None, "c"), (3, "two  spaces", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    pieces = packing.pack(docs, size=64, block=5).collect()
    of, placed = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        placed[p["sequence_id"]].append(p)
        assert len(p["ids"]) == 4 * p["length"]
    for s in placed.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64 and {p["padded_length"] for p in s} == {at if at & (at - 1) == 0 else 64}
    for i, text in enumerate(TEXTS):
        want = reference(text) + [0]
        got = sorted(of[i], key=lambda p: p["start"])
        times = 2 if i == 3 else 1
        assert sum(p["length"] for p in got) == times * len(want) and {p["doc_tokens"] for p in got} == {len(want)}
        if times == 1:
            assert np.frombuffer(b"".join(bytes(p["ids"]) for p in got), "<u4").tolist() == want
    assert [bytes(p["ids"]) for p in of[None]] == [b"\0\0\0\0"]
    assert packing.pack(docs.limit(0)).count() == 0


EVENT = "op string, doc_id long, source string, lang string, version string, seq long, tokens long, extra string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EVENT)


def totals(store):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def test_rollup_of_signed_batches(spark):
    store = token_counts.RollupStore(spark, new_folder(spark, "test-rollup"))
    assert totals(store) == {}
    first = events(spark, [
        ("insert", 1, "a", "en", "v1", 1, 10), ("insert", 2, "a", "en", "v1", 1, 5), ("insert", 3, None, None, None, 1, None),
        ("insert", 1, "a", "en", "v2", 1, 7), ("insert", 2, "a", "en", "v1", 1, 5), ("insert", None, "b", "de", "v1", 1, 2),
    ])
    assert store.commit("1", first) and not store.commit("1", first)
    assert totals(store) == {("a", "en", "v1"): (2, 15), ("a", "en", "v2"): (1, 7), (None, None, None): (1, 0), ("b", "de", "v1"): (1, 2)}
    second = events(spark, [
        ("revise", 1, "a", "en", "v1", 2, 12), ("delete", 2, None, None, "v1", 2, None), ("delete", 99, None, None, "v1", 2, None),
        ("revise", None, "b", "fr", "v1", 2, 4), ("insert", 4, "c", "es", "v1", 1, 1), ("delete", 4, None, None, "v1", 2, 0),
    ])
    assert store.commit("2", second) and not store.commit("2", second)
    assert totals(store) == {("a", "en", "v1"): (1, 12), ("a", "en", "v2"): (1, 7), (None, None, None): (1, 0), ("b", "fr", "v1"): (1, 4)}
    assert store.commit("3", first.limit(0)) and store.batches() == ["1", "2", "3"]


def test_a_torn_batch_is_applied_once(spark):
    store = token_counts.RollupStore(spark, new_folder(spark, "test-rollup"))
    rows = events(spark, [("insert", 1, "a", "en", "v1", 1, 10)])
    rows.write.parquet(f"{store.folder}/entries/batch=1")  # the writer was lost before its commit
    assert totals(store) == {} and store.commit("1", rows)
    assert totals(store) == {("a", "en", "v1"): (1, 10)}


def test_token_query_against_the_library(spark, sf, reference):
    from marginalia.llm.queries import QUERIES

    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    want = collections.defaultdict(lambda: (0, 0))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r["doc_id"] not in toxic:
            n, t = want[r["source"], r["lang"], "byte_bpe_50k"]
            want[r["source"], r["lang"], "byte_bpe_50k"] = (n + 1, t + len(reference(r["text"] or "")))
    got = {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    assert got == want
