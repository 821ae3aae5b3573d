"""Event logs, templates and their way back."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tonemill.llm import chat, queries

SIGNS = st.text(alphabet="<>|[]/\\sSYINT%0A\n im_start end", max_size=40)
PIECES = st.lists(st.sampled_from(["<|", "<\\|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "|>", "<|im_end|>\n", "<|im_start|>user\n", "x", "%0A", "\n"]), max_size=12).map("".join)
EVENTS = "conv_id long, seq long, message string, kind string, role string, text string, formatted string"


@settings(max_examples=300, deadline=None)
@given(SIGNS | PIECES)
def test_escapes_come_back(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert "<|" not in escaped and "</s>" not in escaped and "[INST]" not in escaped and "[/INST]" not in escaped


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(SIGNS | PIECES | st.sampled_from(["user", "assistant"]), SIGNS | PIECES), max_size=5))
def test_rendered_turns_come_back(turns):
    text, spans = chat.render([[role, [said], None] for role, said in turns], "assistant")
    assert chat.parse(text) == turns
    assert [chat.unescape(text[s["start"] : s["end"]]) for s in spans] == [said for role, said in turns if role == "assistant"]


def format_(spark, events):
    rows = [(*e, "extra") for e in events]
    return {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, EVENTS)).collect()}


def test_deltas_edits_and_regenerations_fold(spark):
    events = [
        (1, 1, "q", "message", "user", "hi"), (1, 2, "a", "delta", "assistant", "he"), (1, 3, "a", "delta", None, "llo"),
        (1, 4, "a", "regenerate", None, None), (1, 5, "a", "delta", None, "good "), (1, 6, "a", "delta", None, "day"),
        (1, 7, "q2", "message", "user", "more"), (1, 8, "q", "edit", None, "hi!"), (1, 9, "a", "delta", "assistant", "new"),
        (1, 10, "a", "noise", None, "nothing"), (2, 1, None, "message", None, None), (2, 1, None, "message", None, None),
        (None, 3, "x", "edit", "assistant", "late"), (None, 1, "x", "delta", "user", "early"),
    ]
    got = format_(spark, events)
    assert chat.parse(got[1].formatted) == [("user", "hi!"), ("assistant", "new")]
    assert chat.parse(got[2].formatted) == [("", ""), ("", "")] and got[2].n_turns == 2
    assert chat.parse(got[None].formatted) == [("assistant", "late")]
    assert format_(spark, events[::-1]).keys() == got.keys()
    assert all(format_(spark, events[::-1])[k].formatted == r.formatted for k, r in got.items())


def test_long_conversations_and_none(spark):
    events = [(5, i, str(i), "message", "assistant" if i % 2 else "user", f"text {i} [INST]") for i in range(3000)]
    row = format_(spark, events)[5]
    assert row.n_turns == 3000 and len(row.loss_spans) == 1500
    back = queries.read_back(chat.format_conversations(spark.createDataFrame([(*e, "") for e in events], EVENTS))).first()
    loss = "".join(e[5] for e in events if e[4] == "assistant")
    assert (back.loss_chars, back.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert back.formatted_chars == len(row.formatted)
    assert format_(spark, []) == {}
