"""Conversations rebuilt from their event logs and rendered under a chat template."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import whole_runs

KINDS = ("message", "delta", "edit", "regenerate")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates; the backslashes between sign and rest are the escape.
CONTROL = re.compile(r"(<)(\\*)(\||/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])")
ESCAPED = re.compile(r"(<)\\(\\*)(\||/?s>|</?SYS>>)|(\[)\\(\\*)(/?INST\])")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

FORMATTED = "formatted string, n_turns long, loss_spans array<struct<start:long,end:long>>"


def _join(match: re.Match, more: str) -> str:
    sign, slashes, rest = match.groups()[:3] if match.group(1) else match.groups()[3:]
    return sign + more + slashes + rest


def escape(text: str) -> str:
    """One backslash more inside every control string, escaped ones included."""
    return CONTROL.sub(lambda m: _join(m, "\\"), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: _join(m, ""), text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def fold(events: Iterator[tuple]) -> list[list]:
    """[role, text parts] of the messages that are left after all (kind, message, role, text) events.

    message: a further message. delta: text for the end of the message of that name,
    which it opens if there is none. edit: that message gets a new text, and what came
    after it goes. regenerate: that message starts anew from the event's text, and what
    came after it goes. edit and regenerate open a message that isn't there. A role
    other than null replaces the message's. Events of another kind do nothing.
    """
    messages: list[list] = []
    place: dict = {}
    for kind, name, role, text in events:
        at = place.get(name)
        if kind not in KINDS:
            continue
        if kind == "message" or at is None:
            place[name] = len(messages)
            messages.append([role or "", [text or ""], name])
            continue
        message = messages[at]
        if role is not None:
            message[0] = role
        if kind == "delta":
            message[1].append(text or "")
            continue
        message[1] = [text or ""]
        for dropped in messages[at + 1 :]:
            if place.get(dropped[2], -1) > at:
                del place[dropped[2]]
        del messages[at + 1 :]
    return messages


def render(messages: list[list], loss_role: str) -> tuple[str, list[dict]]:
    out, spans, at = [], [], 0
    for role, parts, *_ in messages:
        head, text = f"{OPEN}{escape_role(role)}\n", escape("".join(parts))
        if role == loss_role:
            spans.append({"start": at + len(head), "end": at + len(head) + len(text)})
        out.append(head + text + CLOSE)
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def format_conversations(events: DataFrame, conv_type: str = "long", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, n_turns and loss_spans (in code points).

    ``events`` has conv_id, seq, message (a name, or null), kind, role and text; other columns
    are left out. The log is dealt by conversation and sorted by seq, with ties by
    message, kind, role and text, so that the result doesn't depend on the order of the
    rows; a repeated "message" row is one more message. Events without a conv_id form a
    conversation of their own. A null text counts as empty, a null role as the empty role. A
    conversation is one row of the result and therefore one task's: it's read as a stream,
    and only its messages are held.
    """

    def run(batches):
        for table in whole_runs(batches, ["conv_id"]):
            data = table.to_pydict()
            ids, rows = data["conv_id"], list(zip(data["kind"], data["message"], data["role"], data["text"]))
            out: dict[str, list] = {"conv_id": [], "formatted": [], "n_turns": [], "loss_spans": []}
            first = 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and ids[i] == ids[first]:
                    continue
                messages = fold(rows[first:i])
                text, spans = render(messages, loss_role)
                for name, value in zip(out, (ids[first], text, len(messages), spans)):
                    out[name].append(value)
                first = i
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema(
        [
            ("conv_id", pa.string() if conv_type == "string" else pa.int64()),
            ("formatted", pa.string()),
            ("n_turns", pa.int64()),
            ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )
    log = events.select(
        F.col("conv_id").cast(conv_type), "seq", F.col("message").cast("string"), F.col("kind").cast("string"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    order = ["conv_id", "seq", "message", "kind", "role", "text"]
    return log.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"conv_id {conv_type}, {FORMATTED}")
