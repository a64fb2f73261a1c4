from __future__ import annotations

import hashlib
import random

from loresift.llm import chat
from loresift.llm.common import settle

SCHEMA = "conv_id long, turn long, role string, text string, position int, loss string"


def make(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3)


def read_back(spark, rows):
    return {r.conv_id: r for r in chat.read_conversations(settle(chat.format_conversations(make(spark, rows)), "c")).collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible_and_leave_no_control_string():
    template, draw = chat.Template(), random.Random(1)
    parts = [*template.controls, "\\", "#", "<", "</turn>", "23;", "\\23;", "\n", "a", "### User", "##", "</tur", "n>"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(8)))
        safe = template.escape(text)
        assert template.unescape(safe) == text
        assert not any(c in safe for c in template.controls)
        assert template.role_of(template.head(text)) == text


def test_digests_and_order(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [
        (1, 2, "assistant", "É" * 5), (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 3, "user", said),
        (1, 4, "assistant", said), (2, 0, "assistant", "first"), (2, 1, None, "?"), (3, 0, "user", "x " * 100_000),
        (4, 0, "tool </turn>", ""), (4, 0, "assistant", "b"), (4, 0, "assistant", "b"), (4, None, "user", "a"),
    ]
    got = read_back(spark, rows)
    assert set(got) == {1, 2, 3, 4}
    for i, r in got.items():
        turns = sorted(
            [(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == i]
        )
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == digest("".join(f"{role}\n{text}\n" for *_, role, text in turns))
        learnt = "".join(text for *_, role, text in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), digest(learnt))
    assert (got[1].turns_in_order, got[1].complete) == (True, True)
    assert (got[3].turns_in_order, got[3].complete) == (True, False)
    assert not got[2].turns_in_order and not got[4].turns_in_order


def test_segments_carry_loss_flags(spark):
    segments = chat.format_conversations(make(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")])).collect()
    whole = "".join(s.text for s in sorted(segments, key=lambda s: (s.position, s.segment)))
    assert whole == "### User: hi</turn>\n### Assistant: ho</turn>\n"
    assert [s.text for s in segments if s.loss] == ["ho"]
    assert read_back(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")])[1].formatted_chars == len(whole)


def test_empty_table(spark):
    rows = make(spark, [(1, 0, "user", "hi")]).where("false")
    assert chat.read_conversations(chat.format_conversations(rows)).collect() == []
