"""Token counts (operator 1): additive rollups maintained by signed deltas.

A store is a folder on shared storage. Every committed batch adds two tables:
``entries`` (per document and tokenizer version, the signed change of its state)
and ``totals`` (the same changes added up by source, language and version). The
``totals`` table is written last and Spark's ``_SUCCESS`` mark on it is the
commit: a batch whose mark exists is never applied again, a half-written batch
is overwritten by the retry, and readers ignore it.

Events: op (``insert``, ``delete``, ``revise``), doc_id, source, lang, version,
tokens, seq. An insert or a revised count sets the document's state for that
version, a delete clears it; the store subtracts the state it knew before. Of
several events for one document and version in a batch the one with the largest
seq holds (ties: the largest op, source, language and count). A delete of an
unknown document changes nothing. Where an id does not name one document, the
optional columns ``part`` (which document under the id) and ``docs`` (how many
equal ones the event stands for, 1 without it) tell them apart; see ``named``.

Defined cases: a null source, language, version, id or part is a key like any
other; a null count is 0; rows that repeat an event change nothing; an empty
batch commits empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash128, path_exists
from .tokens import Encoder

KEY = ["doc_id", "part", "version"]
GROUP = ["source", "lang", "version"]


class RollupStore:
    """Signed token totals in ``folder``. One writer commits at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._batches = spark, folder.rstrip("/"), []

    def _path(self, batch: str, kind: str) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def batches(self) -> list[str]:
        """Committed batches, found by their marks."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(n.removeprefix("batch=") for n in names if path_exists(self.spark, f"{self.folder}/totals/{n}/_SUCCESS"))

    def _read(self, kind: str, columns: str) -> DataFrame:
        known = [self._path(b, kind) for b in self.batches()]
        reader = self.spark.read.schema(columns)
        return reader.parquet(*known) if known else self.spark.createDataFrame([], columns)

    def state(self) -> DataFrame:
        """doc_id, part, version, source, lang, tokens and docs of every document now counted."""
        signed = self._read("entries", "doc_id bigint, part binary, version string, source string, lang string, tokens bigint, docs bigint")
        summed = signed.groupBy(*KEY, "source", "lang").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        return summed.filter("docs <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens."""
        signed = self._read("totals", "source string, lang string, version string, tokens bigint, docs bigint")
        summed = signed.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply a batch once; False when it was applied before."""
        if path_exists(self.spark, f"{self._path(batch, 'totals')}/_SUCCESS"):
            return False
        for column, default in (("part", F.lit(None).cast("binary")), ("docs", F.lit(1))):
            events = events if column in events.columns else events.withColumn(column, default)
        tokens, many = F.coalesce("tokens", F.lit(0)).cast("long"), F.col("docs").cast("long")
        last = F.max(F.struct("seq", "op", "source", "lang", (tokens * many).alias("tokens"), many.alias("docs")))
        new = events.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "part", "version").agg(last.alias("e"))
        new = new.select(*KEY, "e.op", "e.source", "e.lang", "e.tokens", "e.docs", F.lit(True).alias("touched"))
        old = self.state().select(*[F.col(c).alias(f"old_{c}") for c in (*KEY, "source", "lang", "tokens", "docs")])
        same = new["doc_id"].eqNullSafe(old["old_doc_id"]) & new["part"].eqNullSafe(old["old_part"]) & new["version"].eqNullSafe(old["old_version"])
        both = new.join(old.withColumn("known", F.lit(True)), same, "left")
        undo = F.when(F.col("known"), F.struct(
            F.col("old_source").alias("source"), F.col("old_lang").alias("lang"),
            (-F.col("old_tokens")).alias("tokens"), (-F.col("old_docs")).alias("docs"),
        ))
        redo = F.when(F.col("op") != "delete", F.struct("source", "lang", "tokens", "docs"))
        changes = F.filter(F.array(undo, redo), lambda c: c.isNotNull())
        entries = both.select(*KEY, F.explode(changes).alias("c")).select(*KEY, "c.source", "c.lang", "c.tokens", "c.docs")
        entries.write.mode("overwrite").parquet(self._path(batch, "entries"))
        written = self.spark.read.schema(entries.schema).parquet(self._path(batch, "entries"))
        sums = written.groupBy(*GROUP).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        sums.write.mode("overwrite").parquet(self._path(batch, "totals"))
        return True


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``part``, a hash of the text (null: empty), so that different texts under one id are different
    documents; without an id, source and language are hashed as well."""
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    origin = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in ("source", "lang")]
    return docs.withColumn("part", hash128(F.when(F.col(id_col).isNull(), F.concat(text, *origin)).otherwise(text)))


def merged(events: DataFrame) -> DataFrame:
    """One event of equal ones, with ``docs``: every row without an id is a document, rows with an id are one."""
    many = F.when(F.col("doc_id").isNull(), F.count(F.lit(1))).otherwise(F.lit(1))
    return events.groupBy(*events.columns).agg(many.alias("docs"))


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", name: str = "tokens") -> DataFrame:
    """Replace the text of every row by its number of tokens (null text: 0)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = Encoder(vocabulary)
        for texts in batches:
            yield pd.Series([len(encode(t)) // 4 for t in texts], dtype="int64")

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(*[docs[c] for c in docs.columns if c not in (text_col, name)], count(text).alias(name))
