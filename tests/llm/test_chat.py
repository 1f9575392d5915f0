import hashlib

from pyspark.sql import functions as F

from marginalia.llm import chat

LOG = "conversation long, message long, seq long, kind string, role string, text string"


def done(spark, events):
    rows = chat.render(chat.final_messages(spark.createDataFrame(events, LOG)))
    read = rows.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conversation"]: r for r in read.collect()}


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 1, 1, "start", "user", "Hel"), (1, 1, 2, "delta", "user", "lo"),
        (1, 2, 3, "start", "assistant", ""), (1, 2, 4, "delta", "assistant", "draft"),
        (1, 2, 5, "regenerate", "assistant", None), (1, 2, 7, "delta", "assistant", "b"), (1, 2, 6, "delta", "assistant", "a"),
        (1, 1, 8, "edit", "user", "Hi"), (1, 1, 9, "delta", "user", "!"), (1, 1, 9, "delta", "user", "!"),
    ]
    row = done(spark, events)[1]
    assert [tuple(t) for t in row["turns"]] == [("user", "Hi!"), ("assistant", "ab")]
    assert row["loss"] == "ab" and row["n_turns"] == 2


def test_control_strings_survive_the_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "a\\</s>", "<\\/s>", "[INST][/INST]<s>", "\\\\n[", "", "<<s>>", "\n</s>\n"]
    events = [(1, i, i, "start", "assistant", t) for i, t in enumerate(nasty)]
    row = done(spark, events)[1]
    assert [t["text"] for t in row["turns"]] == nasty
    assert row["loss"] == "".join(nasty)
    assert row["formatted"].count("</s>") == len(nasty) and row["formatted"].count("[INST]") == len(nasty)


def test_defined_cases(spark):
    events = [(None, None, None, None, None, None), (2, 1, 1, "start", "assistant", "é" * 100_000), (2, 2, 2, "start", "user", None)]
    rows = done(spark, events)
    assert [tuple(t) for t in rows[None]["turns"]] == [("", "")]
    assert len(rows[2]["loss"]) == 100_000 and rows[2]["turns"][1]["text"] == ""
    assert done(spark, []) == {}


def test_rows_that_repeat_a_turn_are_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "user", "first")], "conversation long, turn long, role string, text string")
    out = chat.render(chat.final_messages(chat.log_of_rows(rows))).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in out["t"]] == ["first", "x", "x"]


def test_query_against_python(spark, sf):
    from marginalia.llm.queries import QUERIES

    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {
        c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), sha("".join(b for a, b in t if a == "assistant")))
        for c, t in turns.items()
    }
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in QUERIES["op2_chat_format"](spark, sf).collect()}
    assert got == want
