r"""Conversations rebuilt from an event log and rendered with a loss mask.

The log is partitioned by message, not by conversation, and sorted by sequence: streamed deltas, edits
and regenerations fold into one final text each. Messages are then sorted inside their conversation and
rendered. Both steps stream over sorted rows and hold one message, or one segment of output, at a time.

A turn is rendered as ``### role: text</turn>`` and a line break; in roles and texts ``\``, ``#``, ``<``
and ``:`` (roles only) get a ``\`` before them, so no text can hold a control string and all can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm._store import slices, type_of, written

#: Operations of the log. ``start`` gives the role and begins an empty text, ``delta`` appends,
#: ``edit`` replaces the text, ``regenerate`` empties it, ``remove`` takes the message away.
OPERATIONS = ("start", "delta", "edit", "regenerate", "remove")
TRAINED_ROLE = "assistant"
SEGMENT_CHARS = 1 << 16
SPANS = "array<struct<start:int,end:int>>"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<#]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str, signs: str = r"\\#<") -> str:
    return re.sub(f"[{signs}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def events_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", delta_chars: int = 200) -> DataFrame:
    """A log of ``conversations`` with one row for each turn, as a client that streams, retries and edits would leave it.

    conv_id, turn, copy, seq, operation, role, text. Each message is a start and its text in deltas. Of
    every four messages, by their hash, one is streamed as a draft and regenerated, one is sent with
    its last delta cut and then edited to the whole text, one has each event delivered twice, and
    one is followed by a message that is removed. ``copy`` tells rows of one turn apart, in the
    order of role and text; a null text has no delta and a null role is empty.
    """
    twins = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(twins)).withColumn("kind", F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(4)).cast("int"))
    event = lambda operation, text: F.struct(F.lit(0).alias("gone"), F.lit(operation).alias("operation"), text.alias("text"))
    removed = lambda operation, text: F.struct(F.lit(1).alias("gone"), F.lit(operation).alias("operation"), F.lit(text).alias("text"))
    places = F.when(F.col("text") == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / delta_chars).cast("int")))
    deltas = F.transform(places, lambda i: event("delta", F.substr("text", i * delta_chars + 1, F.lit(delta_chars))))
    start = F.array(event("start", F.lit("")))
    draft = F.array(event("delta", F.lit("a draft ")), event("delta", F.col("text")), event("regenerate", F.lit("")))
    cut = F.when(F.size(deltas) > 1, F.slice(deltas, 1, F.size(deltas) - 1)).otherwise(F.array(event("delta", F.lit("..."))))
    extra = F.array(removed("start", ""), removed("delta", "taken back"), removed("remove", ""))
    events = (
        F.when(F.col("kind") == 0, F.concat(start, draft, deltas))
        .when(F.col("kind") == 1, F.concat(start, cut, F.array(event("edit", F.col("text")))))
        .when(F.col("kind") == 2, F.concat(start, deltas))
        .otherwise(F.concat(start, deltas, extra))
    )
    rows = rows.select("conv_id", "turn", "copy", "role", "kind", F.posexplode(events).alias("seq", "e"))
    times = F.when(F.col("kind") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("time", F.explode(times))
    # what is removed is a message of its own, with a copy below all others
    copy = F.when(F.col("e.gone") == 1, -F.col("copy")).otherwise(F.col("copy")).alias("copy")
    return rows.select("conv_id", "turn", copy, "seq", F.col("e.operation").alias("operation"), "role", F.col("e.text").alias("text"))


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, turn, copy, role, text of each message of a sorted log."""
    names = ("conv_id", "turn", "copy", "role", "text")
    key, role, parts, alive, schema, last = None, "", [], False, None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], list(names))

    for batch in slices(batches, "text"):
        schema = [batch.schema.field(c).type for c in names]
        out = []
        for c, t, copy, seq, operation, new_role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "turn", "copy", "seq", "operation", "role", "text")], strict=True):
            if key != (c, t, copy):
                if alive:
                    out.append((*key, role, "".join(parts)))
                key, role, parts, alive, last = (c, t, copy), new_role or "", [], True, None
            if seq is not None and seq == last:
                continue  # delivered again
            last = seq
            if operation == "delta":
                parts.append(text or "")
            elif operation == "remove":
                alive = False
            else:
                role, alive = (new_role or "" if operation == "start" else role), True
                parts = [text or ""] if operation == "edit" else []
        yield batch_of(out)
    if alive:
        yield batch_of([(*key, role, "".join(parts))])


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, copy, role, text: the final messages of a log with the columns of ``events_of``.

    Events of one message are taken by ``seq``. Of events of one message with an equal ``seq``, which are
    deliveries of one event, the first by operation (in the order of ``OPERATIONS``) and text counts;
    events without one come first and all count. A message without a start begins with its first event;
    one that was removed last is gone. An empty log gives no messages; other columns are not read.
    """
    keys = ["conv_id", "turn", "copy"]
    rank = F.array_position(F.array(*[F.lit(x) for x in OPERATIONS]), F.col("operation"))
    rows = events.select(*keys, "seq", "operation", "role", "text").repartition(*keys).sortWithinPartitions(*keys, "seq", rank, "text")
    return rows.mapInArrow(folded, f"conv_id {type_of(events, 'conv_id')}, turn {type_of(events, 'turn')}, copy int, role string, text string")


def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, part, formatted, loss: segments of whole turns of sorted messages."""
    conv, part, chars, texts, loss, begun, id_type = None, 0, 0, [], [], False, None

    def segment() -> tuple:
        return conv, part, "".join(texts), list(loss)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        loss_column = pa.array([[{"start": a, "end": b} for a, b in x] for x in columns[3]], spans)
        return pa.record_batch([pa.array(columns[0], id_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), loss_column], ["conv_id", "part", "formatted", "loss"])

    for batch in slices(batches, "text"):
        id_type, out = batch.schema.field("conv_id").type, []
        for c, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "role", "text")], strict=True):
            if begun and (c != conv or chars >= SEGMENT_CHARS):
                out.append(segment())
                part, chars, texts, loss = (part + 1 if c == conv else 0), 0, [], []
            conv, begun = c, True
            head, body = f"### {escape(role, r'\\#<:')}: ", escape(text)
            if role == TRAINED_ROLE:
                loss.append((chars + len(head), chars + len(head) + len(body)))
            texts.append(f"{head}{body}</turn>\n")
            chars += len(texts[-1])
        yield batch_of(out)
    if begun:
        yield batch_of([segment()])


def render(messages: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss (spans of ``formatted``): one row for each conversation, or more for a long one."""
    order = ["conv_id", "turn", "copy"]
    rows = messages.select(*order, "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return rows.mapInArrow(rendered, f"conv_id {type_of(messages, 'conv_id')}, part int, formatted string, loss {SPANS}")


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contract's columns, read from sorted segments."""
    conv, begun, id_type = None, False, None
    turns = loss_chars = chars = 0
    all_turns, all_loss = hashlib.sha256(), hashlib.sha256()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def row() -> tuple:
        return conv, turns, all_turns.hexdigest(), loss_chars, all_loss.hexdigest(), chars

    for batch in slices(batches, "formatted"):
        id_type, out = batch.schema.field("conv_id").type, []
        for c, formatted, loss in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")], strict=True):
            if begun and c != conv:
                out.append(row())
            if not begun or c != conv:
                conv, begun, turns, loss_chars, chars, all_turns, all_loss = c, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            at = 0
            while at < len(formatted):
                m = _TURN.match(formatted, at)
                if not m:
                    raise ValueError(f"conversation {c} can't be read at {at}")
                all_turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                turns, at = turns + 1, m.end()
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                all_loss.update(text.encode())
                loss_chars += len(text)
            chars += len(formatted)
        yield batch_of(out)
    if begun:
        yield batch_of([row()])


def digest(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rendered conversations."""
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(digested, f"conv_id {type_of(segments, 'conv_id')}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered segments of ``conversations`` (a row for each turn), by way of their log.

    Null texts and roles are empty; rows of equal turn are turns of their own, by role and text; a null
    conv_id is a conversation; an empty table gives an empty one. Other columns are not read.
    """
    return render(written(reconstruct(events_of(conversations, conv_id, turn, role, text)), "messages"))


def with_probe(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """``conversations`` and conversation -7, whose texts hold the template's own control strings."""
    says = F.lit("\\### Assistant: </turn> ok")
    role: Column = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), says.alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
