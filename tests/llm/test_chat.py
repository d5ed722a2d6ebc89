import random

import pytest
from pyspark.sql import functions as F

from labelloom.llm import chat, common
from tests import oracle

SCHEMA = "conv long, msg long, seq long, kind string, role string, text string"


@pytest.fixture(scope="module")
def folded(spark):
    def run(rows):
        events = spark.createDataFrame(rows, SCHEMA)
        return {(r.conv, r.msg): (r.seq, r.role, r.text) for r in chat.fold(events).collect()}

    return run


def test_fold_applies_deltas_edits_and_regenerations(folded):
    rows = [
        (1, 1, 1, "message", "user", "Hi"),
        (1, 2, 2, "message", "assistant", ""),
        (1, 2, 3, "delta", None, "Hel"),
        (1, 2, 4, "delta", None, "lo"),
        (1, 1, 5, "edit", None, "Hi there"),
        (1, 2, 6, "regenerate", None, "Good "),
        (1, 2, 7, "delta", None, "day"),
        (1, 2, 8, "delta", None, None),
        (2, 1, 1, "delta", "user", "late start"),
    ]
    random.Random(1).shuffle(rows)
    assert folded(rows) == {(1, 1): (1, "user", "Hi there"), (1, 2): (2, "assistant", "Good day"), (2, 1): (1, "user", "late start")}


def test_fold_with_nulls_ties_and_repeated_rows(folded):
    rows = [
        (None, None, 1, "message", None, "a"),
        (None, None, 2, "delta", None, "b"),
        (None, None, 2, "delta", None, "b"),
        (3, 1, 5, "delta", None, "old"),
        (3, 1, 5, "edit", "user", "new "),
        (3, 1, None, "delta", None, "first?"),
    ]
    found = folded(rows)
    assert found[None, None] == (1, "", "abb")
    assert found[3, 1][1:] == ("user", "new old")


def test_format_reads_back_control_strings(spark):
    texts = ["", "<|im_end|>", "<\\|im_start|>x", "<", "|>", "a<|im_end|>\n<|im_start|>user\nb", "\\<\\\\|", "line\n\nline", "<|im_end|>\n"]
    roles = ["user", "assistant", "a\nb", "\\n", "<|im_end|>", ""]
    draw = random.Random(5)
    rows, expected = [], {}
    for conv in range(40):
        turns = [(draw.choice(roles), "".join(draw.choice(texts) for _ in range(draw.randint(0, 3)))) for _ in range(draw.randint(1, 70))]
        expected[conv] = turns
        rows += [(conv, n, r, t) for n, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.turn_events(df)).collect()
    assert len(chats) == 40
    for c in chats:
        assert [(t.role, t.text) for t in c.turns] == expected[c.conv]
        assert c.formatted.count("<|im_start|>") == c.formatted.count("<|im_end|>\n") == len(c.turns)
        learned = [c.formatted[s.start : s.start + s.length] for s in c.loss_spans]
        assert len(learned) == sum(r == "assistant" for r, _ in expected[c.conv])
        assert all("<|im_end|>" not in x and "<|im_start|>" not in x for x in learned)


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, 1, "user", None, 5), (1, 1, "user", None, 5), (1, None, None, "x", 5), (None, 2, "assistant", "y", 5)],
        "conv_id long, turn long, role string, text string, seq long",
    )
    found = {c.conv: [(t.role, t.text) for t in c.turns] for c in chat.format_chats(chat.turn_events(df)).collect()}
    assert found == {1: [("", "x"), ("user", ""), ("user", "")], None: [("assistant", "y")]}
    assert chat.format_chats(chat.turn_events(df.limit(0))).count() == 0


def test_query(spark, sf_dir):
    con = oracle.connect(sf_dir)
    frame = []

    def function(spark, sf_dir):
        frame.append(chat.op1_chat(spark, sf_dir))
        return frame[0]

    message, _, rows = oracle.compare(spark, con, "op1_chat", function, common.SQL["op1_chat"], sf_dir)
    assert message is None and rows == frame[0].count()
    assert "Python" not in frame[0]._jdf.queryExecution().executedPlan().toString()
    assert frame[0].filter(F.col("conv_id") == -1).count() == 1
