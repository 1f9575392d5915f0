"""WARC archives (operator 7): writing, reading back, and an external index merge.

Writing: one record per page. Of pages with equal payloads the one with the
smallest id becomes a response, the others revisit records that refer to it;
only digests meet to decide that. Every task writes one uncompressed WARC file
through Spark's own committer (a failed attempt leaves nothing), ordered by URL
key and time: a locally sorted capture run.

Reading: files are parsed by their Content-Length fields, the payload digest of
every response is checked, and each run gives its index entries in order.

Merging: entries are cut into ranges of (URL key, time, page), so a URL with very
many captures spreads over several ranges; inside a range the slices of all runs
are merged k-way with a loser tree into globally ordered capture histories.

Defined cases: a null payload is empty; a null url has an empty URL key and no
target field; a null id never becomes the response of a group that has an id;
rows that repeat id and payload are one capture each, all of the same type;
line ends in a url are percent-encoded; an empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, stored
from .url_filter import split_url

END = "\r\n"
STAMP = "yyyy-MM-dd'T'HH:mm:ssX"


def utc_stamp(moment: Column) -> Column:
    """WARC-Date of a moment, whatever the session's time zone."""
    seconds = F.unix_seconds(moment)
    clock = F.pmod(seconds, F.lit(86_400))
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")
    parts = [F.floor(clock / 3600), F.floor(clock / 60) % 60, clock % 60]
    return F.when(moment.isNotNull(), F.format_string("%sT%02d:%02d:%02dZ", day, *[p.cast("int") for p in parts]))


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 20 bits, five hexadecimal digits, give four characters."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the url from its path on without fragment."""
    host, _ = split_url(url)
    rest = F.regexp_extract(url, r"^.*?://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(F.instr(url, "://") > 0, key).otherwise(F.coalesce(url, F.lit("")))


def decisions(pages: DataFrame, id_col: str, payload: Column, least_bytes: int) -> DataFrame:
    """(_id, _digest, _first) of the pages that become revisit records."""
    slim = pages.select(pages[id_col].alias("_id"), base32_sha1(payload).alias("_digest"), F.octet_length(payload).alias("_bytes"))
    slim = slim.filter(F.col("_bytes") >= least_bytes).drop("_bytes")
    groups = slim.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    again = join_by_key(slim, groups, "_digest", "_copies", F.col("_id"))
    return again.filter(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_digest", "_first").distinct()


def write(
    pages: DataFrame, folder: str, captured_at: Column, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", least_bytes: int = 0,
) -> None:
    """Write ``pages`` as WARC files into ``folder``. Payloads of fewer than ``least_bytes`` bytes are never revisits."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    again = stored(decisions(pages, id_col, payload, least_bytes), "revisits")  # of known size: Spark broadcasts it if small
    rows = pages.select(
        pages[id_col].alias("_page"), pages[url_col].alias("_url"), captured_at.alias("_time"), payload.alias("_payload"),
        base32_sha1(payload).alias("_own"), F.octet_length(payload).alias("_bytes"),
    )
    same = F.col("_page").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest"))
    target = F.replace(F.replace("_url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.join(again, same, "left").withColumn("_target", target).withColumn("_key", url_key(F.col("_target")))
    revisit = F.col("_digest").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("_bytes"), F.lit(END + END))
    name = lambda page: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))
    line = lambda field, value: F.coalesce(F.concat(F.lit(f"{field}: "), value, F.lit(END)), F.lit(""))
    block = F.when(revisit, F.octet_length(head)).otherwise(F.octet_length(head) + F.col("_bytes"))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(name(F.col("_page")), F.concat(F.lit("<urn:unnamed:"), F.expr("uuid()"), F.lit(">")))),
        line("WARC-Date", utc_stamp(F.col("_time"))),
        line("WARC-Target-URI", F.col("_target")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_own"))),
        line("WARC-Refers-To", F.when(revisit, name(F.col("_first")))),
        F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}")).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("_bytes").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", block.cast("string")),
        F.lit(END), head, F.when(revisit, F.lit("")).otherwise(F.col("_payload")),
    )
    runs = rows.sortWithinPartitions("_key", "_time", "_page").select(record.alias("value"))
    runs.write.option("lineSep", END + END).text(folder)  # the separator is the end of a WARC record


def parse(content: bytes) -> Iterator[dict]:
    """Records of a WARC file: fields, offset, length, payload (None without one)."""
    at = 0
    while at < len(content):
        body = content.index(b"\r\n\r\n", at) + 4
        first, *lines = content[at : body - 4].decode("utf-8", "surrogateescape").split(END)
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        stop = body + int(fields["Content-Length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end at {stop}")
        payload = None
        if fields["WARC-Type"] == "response":
            payload = content[content.index(b"\r\n\r\n", body, stop) + 4 : stop]
        yield {"fields": fields, "offset": at, "length": stop + 4 - at, "payload": payload}
        at = stop + 4


ENTRY = (
    "file string, position long, offset long, length long, page string, url string, captured_at string, "
    "record_type string, payload_bytes long, payload_digest string, refers_to string"
)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = lambda name: name[10:-1] if name and name.startswith("<urn:page:") else None
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows: list[tuple] = []
            for position, record in enumerate(parse(content.as_py())):
                fields, payload = record["fields"], record["payload"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(fields["X-Payload-Length"])
                if payload is not None:
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (found, len(payload)) != (digest, size):
                        raise ValueError(f"the payload at {path}:{record['offset']} does not match its digest")
                rows.append((
                    path.rsplit("/", 1)[-1], position, record["offset"], record["length"], page(fields["WARC-Record-ID"]),
                    fields.get("WARC-Target-URI"), fields["WARC-Date"], fields["WARC-Type"], size, digest, page(fields.get("WARC-Refers-To")),
                ))
            kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 4, pa.int64(), *[pa.string()] * 2]
            names = [c.split(" ")[0] for c in ENTRY.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Index entries of all archives in ``folder``, in the order of each run."""
    files = spark.read.format("binaryFile").load(f"{folder}/part-*").select("path", "content")
    entries = files.mapInArrow(_entries, ENTRY)
    return entries.select(
        url_key(F.col("url")).alias("url_key"), F.to_timestamp("captured_at", STAMP).alias("captured_at"),
        F.col("page").cast(id_type).alias("page"), "record_type", "payload_bytes", "payload_digest",
        F.col("refers_to").cast(id_type).alias("refers_to"), F.col("file").alias("run"), "position", "offset", "length",
    )


class LoserTree:
    """K-way merge: the losers of a tournament stay in the tree, the winner's next key replays one path."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._build(1) if self.k > 1 else self.k - 1

    def _beats(self, a: int, b: int) -> bool:
        """Does run a come before run b? A finished run loses to every other."""
        if self.at[a] == len(self.runs[a]):
            return False
        if self.at[b] == len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        ahead, behind = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = behind
        return ahead

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position in it) of all keys in order."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._beats(self.losers[node], self.winner):
                    self.losers[node], self.winner = self.winner, self.losers[node]
                node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    last = lambda v: (v is not None, v or 0)
    runs, starts, before = [], [], None
    stamps = rows.column("captured_at").cast(pa.int64()).to_pylist()
    for i, (run, *key) in enumerate(zip(rows.column("run").to_pylist(), rows.column("url_key").to_pylist(), stamps, rows.column("page").to_pylist())):
        if run != before:
            runs.append([])
            starts.append(i)
            before = run
        runs[-1].append((key[0], last(key[1]), last(key[2])))
    order = [starts[run] + at for run, at in LoserTree(runs)]
    yield from rows.take(pa.array(order, pa.int64())).to_batches(max_chunksize=8192)


def merge(entries: DataFrame) -> DataFrame:
    """Entries of all runs in the order of URL key, capture time and page."""
    entries = stored(entries, "warc-runs")
    ranges = entries.repartitionByRange("url_key", "captured_at", "page").sortWithinPartitions("run", "position")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return ranges.mapInArrow(_merge, schema)
