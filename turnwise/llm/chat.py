"""Chat formatting from event logs.

A log has one row an event: conv_id, turn (place of the message), message (its
key), seq (order of events), event, role, text. Events of a message are folded
in order of seq:

* ``start``       opens the message with a role;
* ``delta``       appends text;
* ``edit``        replaces the text so far;
* ``regenerate``  discards the text so far;
* ``retract``     removes the message.

Events of unknown kind are an error. A message without ``start`` has the last
role its events name, else an empty one. Logs are partitioned by conversation and
message and sorted by sequence, so one long conversation is folded by many
tasks, a task holding one message at a time. Each message is rendered where it is
folded; the turns of a conversation are its segments in order of turn (ties: of
the rendered text).

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts every ``<``,
backslashes, ``|`` gets one backslash more before the ``|``, so no text forms a
control string; dropping one restores it. Line feeds and backslashes of a role
are escaped as well. The loss mask covers the text of each assistant turn.

Defined cases: events of equal seq are folded in order of event, role and text;
a text of any length is folded in memory by one task; null roles and texts are empty; a null conv_id is a conversation
of its own; repeated events apply again; an empty log gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn long, segment string, loss_start long, loss_end long"
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A segment and the span of its loss mask (empty but for assistants)."""
    head = "<|im_start|>" + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    end = len(head) + len(body)
    return head + body + "<|im_end|>\n", (len(head) if role == "assistant" else end), end


def parse(segments: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns."""
    out, at = [], 0
    for m in _SEGMENT.finditer(segments):
        if m.start() != at:
            break
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
        out.append((role, unescape(m[2])))
        at = m.end()
    if at != len(segments):
        raise ValueError("not a rendered conversation")
    return out


def fold(events: DataFrame) -> DataFrame:
    """Rendered final messages of an event log, one row each."""

    def run(batches):
        key = turn = None
        role, parts, alive, any_ = "", [], True, False

        def done():
            text, a, b = render(role, "".join(parts))
            return key[0], turn, text, a, b

        def table(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "turn", "segment", "loss_start", "loss_end"])

        rows, size = [], 0
        for batch in batches:
            for conv, t, message, event, who, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != (conv, message) or not any_:
                    if any_ and alive:
                        rows.append(done())
                        size += len(rows[-1][2])
                        if size > 8_000_000:
                            yield table(rows)
                            rows, size = [], 0
                    key, turn, role, parts, alive, any_ = (conv, message), t, "", [], True, True
                if event == "start":
                    role, parts, alive = who or "", [], True
                elif event == "delta":
                    parts.append(text or "")
                elif event == "edit":
                    parts = [text or ""]
                elif event == "regenerate":
                    parts = []
                elif event == "retract":
                    alive = False
                else:
                    raise ValueError(f"unknown event {event!r}")
                role = who if who is not None else role
        if any_ and alive:
            rows.append(done())
        if rows:
            yield table(rows)

    log = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "message", "event", "role", "text", "seq")
    ordered = log.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "event", "role", "text")
    return ordered.drop("seq").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what its rendered turns hold: counts and digests.

    Streams the segments in order; a digest is a running state, so a conversation
    of any length needs no more than one segment at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, state, rows = None, None, []

        def row():
            n, turns, chars, loss, size = state
            return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size

        def table(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now != (conv,):
                    if now is not None:
                        rows.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                masked = unescape(text[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(text)
            if len(rows) > 10_000:
                yield table(rows)
                rows = []
        if now is not None:
            rows.append(row())
        if rows:
            yield table(rows)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def event_log(turns: DataFrame) -> DataFrame:
    """A log whose fold gives back ``turns`` (conv_id, turn, role, text).

    Assistants stream a draft, regenerate and stream the text in two deltas;
    others send a first version and edit it.
    """
    text, half = F.coalesce("text", F.lit("")), F.expr("cast(length(coalesce(text, '')) / 2 as int)")

    def event(seq: int, kind: str, role, said):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("event"), role.alias("role"), said.alias("text"))

    none = F.lit(None).cast("string")
    role = F.coalesce("role", F.lit(""))
    streamed = F.array(event(0, "start", role, none), event(1, "delta", none, F.substring(text, 1, 12)), event(2, "regenerate", none, none), event(3, "delta", none, F.substr(text, F.lit(1), half)), event(4, "delta", none, F.substr(text, half + 1)))
    edited = F.array(event(0, "start", role, none), event(1, "delta", none, F.substring(text, 1, 12)), event(2, "edit", none, text))
    log = turns.withColumn("message", F.monotonically_increasing_id()).withColumn("e", F.explode(F.when(role == "assistant", streamed).otherwise(edited)))
    return log.select("conv_id", "turn", "message", "e.seq", "e.event", "e.role", "e.text")
