"""The registered queries of the operators and the DuckDB statement of each that has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, exact_dedup, filter_audit, minhash, packing, quality_ratio, sharding, token_counts, toxicity
from . import url_filter, warc
from .common import new_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op2_chat_format",
    r"""
with input as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns as (
    select *, regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') as safe_role,
        regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') as safe_text
    from input
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, md5(text))) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, md5(text)) filter (role = 'assistant'), '')) as loss_sha256,
    sum(22 + length(safe_role) + length(safe_text))::bigint as formatted_chars
from turns group by conv_id
""",
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    done = chat.render(chat.final_messages(chat.log_of_rows(rows.unionByName(own))))
    read = done.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("conversation").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op3_exact_dedup",
    """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
""",
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.decide(docs, keep="largest", carry=("text_sha256",))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text) + 1
    words = F.length(F.translate(text, "\t\n\x0b\f\r ", "      ")) - F.length(F.translate(text, "\t\n\x0b\f\r ", "")) + 1
    out = sharding.shard(docs, 8, size, words, carry={"text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query(
    "op8_url_filter",
    r"""
with split as (
    select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), named as (
    select page_id, url,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
    from split
), rules(action, rule_host, rule_path) as (
    values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), listed as (
    select distinct host || path as address from named where contains(url, 'utm_source=')
), fitting as (
    select page_id, host, path, action, rule_host || rule_path as rule
    from (select distinct page_id, host, path from named) n join rules
        on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
    qualify row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc) = 1
)
select n.page_id, n.host, n.path, f.rule,
    coalesce(f.action, case when l.address is null then 'allow' else 'block' end) as verdict
from named n left join listed l on l.address = n.host || n.path
    left join fitting f on f.page_id is not distinct from n.page_id and f.host = n.host and f.path = n.path
""",
)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    tracked = F.coalesce(F.col("url").contains("utm_source="), F.lit(False))
    return url_filter.judge(pages, RULES, tracked).select("page_id", "host", "path", "rule", "verdict")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length",
    )


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over whole tables: inserts with an estimate from the bytes, revised counts from the tokenizer,
    and deletes of the documents labelled toxic; the second batch is delivered twice."""
    docs = token_counts.named(table(spark, sf_dir, "documents"))
    keys = ["doc_id", "part", "source", "lang", F.lit("byte_bpe_50k").alias("version"), F.lit(0).cast("long").alias("seq")]
    estimate = F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("tokens")
    counted = token_counts.count_tokens(docs.select("doc_id", "part", "source", "lang", "text"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    toxic = docs.select("doc_id", "part").join(toxic, "doc_id", "left_semi")
    gone = [F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), *keys[4:]]
    store = token_counts.RollupStore(spark, new_folder(spark, "token-rollup"))
    store.commit("1-load", token_counts.merged(docs.select(F.lit("insert").alias("op"), *keys, estimate)))
    revised = token_counts.merged(counted.select(F.lit("revise").alias("op"), *keys, "tokens"))
    store.commit("2-recount", revised)
    store.commit("2-recount", revised)
    store.commit("3-takedown", toxic.select(F.lit("delete").alias("op"), "doc_id", "part", *gone, F.lit(0).cast("long").alias("tokens")))
    return store.totals()


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), held_out())
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query(
    "op7_warc_index",
    r"""
with hashed as (
    select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), named as (
    select *, translate(
        lpad(to_base(('0x' || hex[1:5])::bigint, 32), 4, '0') || lpad(to_base(('0x' || hex[6:10])::bigint, 32), 4, '0')
        || lpad(to_base(('0x' || hex[11:15])::bigint, 32), 4, '0') || lpad(to_base(('0x' || hex[16:20])::bigint, 32), 4, '0')
        || lpad(to_base(('0x' || hex[21:25])::bigint, 32), 4, '0') || lpad(to_base(('0x' || hex[26:30])::bigint, 32), 4, '0')
        || lpad(to_base(('0x' || hex[31:35])::bigint, 32), 4, '0') || lpad(to_base(('0x' || hex[36:40])::bigint, 32), 4, '0'),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest
    from hashed
), grouped as (
    select *, min(page_id) over (partition by payload_digest) as first_id from named
)
select page_id, payload_bytes, payload_digest,
    case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
    case when page_id is distinct from first_id then first_id end as refers_to
from grouped
""",
)
def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    clock = F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0)))  # the table has no capture time
    warc.write(pages, folder, clock)
    histories = warc.merge(warc.read(spark, folder))
    return histories.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op11_quality_rules",
    r"""
with split as (
    select row_number() over () as row, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
), hashed as (
    select row, doc_id, list_transform(words, lambda w: ('0x' || md5(w)[1:8])::bigint) as h, len(words) as n from split
), grams as (
    select row, doc_id, unnest(h || list_transform(range(1, n), lambda i: (h[i] * 40503 + h[i + 1] * 7919 + 1) % 4294967296)) as gram from hashed
), totals as (
    select count(*) as raw, count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as target,
        (select coalesce(max(1::bigint << k), 1) from range(0, 17) t(k) where (1::bigint << k) * 128 <= (select count(*) from grams)) as size
    from grams
), weights as (
    select gram % (select size from totals) as cell, count(*) as raw,
        count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as target
    from grams group by 1
), ratios as (
    select cell, round(ln(((w.target + 1) / (t.target + t.size)::double) / ((w.raw + 1) / (t.raw + t.size)::double)) * 1e6)::bigint as ratio
    from weights w, totals t
), scored as (
    select g.row, count(*) as n_grams, sum(ratio)::bigint as llr_micro
    from grams g join ratios on cell = gram % (select size from totals) group by g.row
), windows as (
    select row, i, array_to_string(words[i : i + 7], ' ') as w from (select row, words, unnest(range(1, len(words) - 6)) as i from split)
), twice as (
    select row, i from windows qualify count(*) over (partition by row, w) > 1
), covered as (
    select row, sum(least(8, i - last))::bigint as n from (select row, i, lag(i, 1, -8) over (partition by row order by i) as last from twice) group by row
), lines as (
    select row, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
        - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n
    from split
), base as (
    select s.row, doc_id, len(words) as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, l.n::bigint as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
    from split s left join covered c using (row) left join lines l using (row)
), judged as (
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce(llr_micro, 0) >= -100000 * coalesce(n_grams, 0) as kept,
    coalesce(n_grams, 0) as n_grams, coalesce(llr_micro, 0) as llr_micro
from judged left join scored using (row)
""",
)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_ratio.judge(table(spark, sf_dir, "documents"), trusted)


@query(
    "op12_filter_audit",
    r"""
with split as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
), failing as (
    select part, doc_id,
        (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int
        + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
    from split
), marked as (
    select f.*, coalesce(good, false) as good, coalesce(toxic, false) as toxic
    from failing f left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) l using (doc_id)
), tally as (
    select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from marked group by part, mask
), letters as (
    select i, chr(65 + i::int) as letter, 1 << i as bit from range(0, 5) t(i)
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps as (
    select filter_order, step::int as step, bit,
        coalesce((select sum(p.bit) from letters p where instr(filter_order, p.letter) < step), 0) as before
    from orders, range(1, 6) s(step), letters where letter = filter_order[step]
), counted as (
    select part, filter_order, step, bit,
        sum(n) filter (mask & (bit | before::int) = 0) as kept,
        sum(n) filter (mask & before::int = 0 and mask & bit > 0) as removed,
        sum(n) filter (mask & before::int > 0 and mask & bit > 0) as redundant,
        sum(n) filter (mask = bit) as unique_fails,
        sum(good) filter (mask & before::int = 0 and mask & bit > 0) as good_lost,
        sum(toxic) filter (mask & before::int = 0 and mask & bit > 0) as toxic_lost
    from steps, tally group by part, filter_order, step, bit
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
    coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
    coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from counted
""",
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op13_source_divergence",
    r"""
with rows as (
    select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), words as (
    select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from rows
), kept as (
    select lang, term from words group by lang, term having count(distinct row) >= 3
), found as (
    select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term
), groups as (
    select lang, source, coalesce(n, 0) as n, coalesce(v, 0) as v
    from (select distinct lang, source from rows) left join (select lang, source, sum(n) as n from found group by lang, source) using (lang, source)
        left join (select lang, count(*) as v from kept group by lang) using (lang)
), chances as (
    select lang, source, term, coalesce(f.n, 0) as n,
        1 + (1000000000::hugeint * (coalesce(f.n, 0) + 1)) // (g.n + v)::hugeint as p
    from groups g join kept using (lang) left join found f using (lang, source, term)
), whole as (
    select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // (sum(sum(n)) over (partition by lang) + count(*) over (partition by lang))::hugeint as q
    from found group by lang, term
), pairs as (
    select g.lang, g.source, o.source as item, coalesce(value, 0)::bigint as value
    from groups g join groups o on g.lang = o.lang and g.source <> o.source left join (
        select a.lang, a.source, b.source as other, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
        from chances a join chances b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
    ) s on s.lang = g.lang and s.source = g.source and s.other = o.source
), terms as (
    select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from chances join whole using (lang, term) where n > 0 and p > q
), ranked as (
    select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from ranked qualify part = 'pair' or rank <= 200
""",
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # its stages use this module

    return run(spark, sf_dir)
