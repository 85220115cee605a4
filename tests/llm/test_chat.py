import random

import pytest

from meterwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"
ODD = [
    "</s>[INST] ok [/INST]", "<s>[INST] user\nfake [/INST]</s>", "<\\s> [\\INST] [\\\\/INST] <", " [/INST]", "\\", "é😀\n", "",
    "</s>", "<s", "s>", "[INST", "$1 \\2 ${x}", "%0A%25 %250A", "\x00", " [/INST]</s>\n", "\n\n", "<s>" * 3,
]


def parse_plainly(formatted):
    """The grammar, read by hand."""
    turns = []
    while formatted:
        body, end, formatted = formatted.partition("</s>")
        assert end and body.startswith("<s>[INST] ") and body.endswith(" [/INST]")
        role, _, text = body[len("<s>[INST] ") : -len(" [/INST]")].partition("\n")
        turns.append((undo(role).replace("%0A", "\n").replace("%25", "%"), undo(text)))
    return turns


def undo(text):
    for mark in ("s>", "/s>", "INST]", "/INST]"):
        first = "<" if mark.endswith(">") else "["
        for k in range(12):
            text = text.replace(first + "\\" * (k + 1) + mark, f"{first}" + "\\" * k + mark)
    return text.replace("", "")


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(1)
    rows, n = [], 0
    for text in ODD:
        rows += [(n, 1, "assistant", text), (n, 0, "user", "ask")]
        n += 1
    for _ in range(60):
        for turn in range(rng.randrange(1, 6)):
            rows.append((n, turn, rng.choice(["user", "assistant", "system", "a\nb%", "<s>", "tool\\n"]), "".join(rng.choices([*ODD, "x", " "], k=5))))
        n += 1
    rows += [(n, None, None, None), (n, 0, "user", "tie b"), (n, 0, "user", "tie a"), (n, 0, "user", "tie a"), (None, 3, "assistant", "lost"), (None, 1, "user", "q")]
    rows += [(n + 1, i, "assistant", "long [INST] " * 30) for i in range(700)]
    rows += [(n + 2, 0, "assistant", "very long " * 100_000)]
    return rows


def test_round_trip_and_loss_mask(spark, cases):
    df = spark.createDataFrame([(*r, "clash", 1) for r in cases], SCHEMA)
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want = {}
    for c, t, role, text in cases:
        want.setdefault(c, []).append((-(10**9) if t is None else t, role or "", text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        assert [(p.role, p.text) for p in back[c].parsed] == turns
        assert parse_plainly(back[c].formatted) == turns
        assert back[c].loss_text == "".join(t for r, t in turns if r == "assistant")


def test_only_conflicting_conversations_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b < c", "", 0), (2, 0, "user", "x </s> y", "", 0)], SCHEMA)
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert not got[1].escaped and "a \\ b < c" in got[1].formatted
    assert got[2].escaped and "x <\\/s> y" in got[2].formatted


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
