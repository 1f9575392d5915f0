"""Chat formatting (operator 2): final messages from an event log, rendered for training.

Event log: conversation, message, seq, kind, role, text. Kinds: ``start`` opens
a message (its text, if any, begins it), ``delta`` appends streamed text,
``edit`` replaces what the message said so far, ``regenerate`` discards it and
lets later deltas write it anew. Only DataFrame functions are used.

The log is partitioned by conversation and message and ordered by ``seq``; each
message folds on its own, so the events of a hot conversation spread over many
tasks, and only final messages meet in the row that holds the conversation.

Template: every turn is ``<s>[INST] role [/INST]text</s>``. A control string
inside a role or text is broken by a backslash after its first character and a
backslash is doubled, so no control string survives inside a text and
``unescape`` restores it exactly.

Defined cases: a null text, role or kind counts as empty (an unknown kind
appends); a null conversation, message or seq sorts first and is a key like any
other; events that repeat a seq are folded in the order of kind and text, and an
event repeated in every column is applied once; an empty log gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"
CONTROL = r"</?s>|\[/?INST\]"


def escape(text: Column) -> Column:
    """Break control strings, reversibly."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?=/?(?:s>|INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_messages(log: DataFrame) -> DataFrame:
    """(conversation, message, opened, role, text): each message after its last event."""
    plain = log.select(
        "conversation", "message", "seq",
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    events = F.array_sort(F.collect_set(F.struct("seq", "kind", "text", "role")))
    folded = plain.groupBy("conversation", "message").agg(events.alias("events"))
    resets = F.col("events.kind")
    last = F.array_position(F.reverse(F.transform(resets, lambda k: k.isin("edit", "regenerate"))), True)
    count = F.size("events")
    begin = F.when(last > 0, count - last.cast("int") + 1).otherwise(F.lit(1))
    current = F.slice("events", begin, count)
    said = F.transform(current, lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"]))
    roles = F.filter(F.col("events.role"), lambda r: r != "")
    return folded.select(
        "conversation", "message", F.col("events")[0]["seq"].alias("opened"),
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(said, "").alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conversation, n_turns, formatted, loss_spans) of every conversation.

    ``loss_spans`` has one entry per turn: start and length, in code points
    within that turn's piece of ``formatted`` (pieces end before ``</s>``), of
    the text the loss is taken on; its length is 0 where ``role`` is not ``learn``.
    """
    head = F.concat(F.lit(OPEN + HEAD), escape(F.col("role")), F.lit(TAIL))
    said = escape(F.col("text"))
    turn = F.struct(
        "opened", "message",
        F.concat(head, said, F.lit(CLOSE)).alias("piece"),
        F.struct(
            F.length(head).alias("start"),
            F.when(F.col("role") == learn, F.length(said)).otherwise(F.lit(0)).alias("length"),
        ).alias("loss"),
    )
    turns = messages.select("conversation", turn.alias("turn"))
    whole = turns.groupBy("conversation").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole.select(
        "conversation", F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"), F.col("turns.loss").alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a rendered conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    start = len(OPEN + HEAD) + 1

    def parse(p: Column) -> Column:
        tail = F.instr(p, TAIL)
        role = F.substring(p, F.lit(start), tail - start)
        text = F.substring(p, tail + len(TAIL), F.length(p))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, parse)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    under = F.zip_with(pieces, spans, lambda p, s: F.substring(p, s["start"] + 1, s["length"]))
    return F.array_join(F.transform(under, unescape), "")


def log_of_rows(rows: DataFrame) -> DataFrame:
    """An event log from finished rows (conversation, turn, role, text).

    Every row opens a message and streams its text in two deltas. Rows that
    repeat a turn are messages of their own, ordered by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("start").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.substring("text", F.lit(1), half).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.substring("text", half + 1, F.length("text")).alias("text")),
    )
    same = rows.select("conversation", "turn", role.alias("role"), text.alias("text"))
    same = same.groupBy("conversation", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn(
        "message", F.struct("turn", "role", F.md5("text").alias("digest"), "copy")
    )
    events = each.withColumn("event", F.explode(parts))
    return events.select(
        "conversation", "message", F.struct("message", "event.step").alias("seq"),
        F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text"),
    )
