import collections
import tempfile

from marginalia.llm.queries import QUERIES
from marginalia.llm.tokens import Encoder


def test_documents_without_an_own_id_are_all_counted(spark):
    rows = [
        (None, "one text", "a", "en"), (None, "another, longer text", "a", "en"), (None, "another, longer text", "a", "en"),
        (None, "one text", "b", "en"), (None, None, "b", None), (None, "", "b", None), (7, "first", "a", "en"), (7, "second of the id", "a", "en"),
        (8, "sent twice", "a", "en"), (8, "sent twice", "a", "en"), (9, "bad", "a", "en"), (9, "bad as well", "a", "en"), (10, "good", None, "de"),
    ]
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
    labels = [(9, 1), (10, 0), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    encode, want = Encoder("byte_bpe_50k.tiktoken"), collections.defaultdict(lambda: (0, 0))
    for i, (doc_id, text, source, lang) in enumerate(rows):
        if doc_id != 9 and not (doc_id is not None and rows[i] in rows[:i]):
            docs, tokens = want[source, lang]
            want[source, lang] = (docs + 1, tokens + len(encode(text or "")) // 4)
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in QUERIES["op1_token_counts"](spark, folder).collect()}
    assert got == want
