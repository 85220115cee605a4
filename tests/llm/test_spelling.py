import re
import zlib
from collections import Counter

import numpy as np
import pytest

from meterwise.llm import spelling as sp

SCHEMA = "doc_id long, text string, word string, n int, node string"


def plain_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    words = plain_words(rows)
    form, near = {}, {}
    for w, n in words.items():
        close = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        near[w] = len(close)
        best = min(close, default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    base = ["separate", "garantie", "élèment", "Zusammenhang", "straßen", "aaaaaa", "abcabc", "cabcab", "ÉCOLES"]
    letters = "abcdefgéÉ"
    texts = []
    for word in base:
        texts += [f"{word} {word.upper()}, {word}-x9{word}"] * 30
        for _ in range(25):
            p = int(rng.integers(0, len(word)))
            c = letters[int(rng.integers(0, len(letters)))]
            new = [word[:p] + word[p + 1 :], word[:p] + c + word[p:], word[:p] + c + word[p + 1 :]][int(rng.integers(0, 3))]
            texts += [f"{new} {new}"] * int(rng.integers(1, 12))
    rows = list(enumerate(texts))
    rows += [(8000, "levelone " * 6), (8001, "levelonf " * 40), (8002, "lexelonf " * 300)]
    rows += [(None, "garantie garantie"), (None, None), (5, None), (6, ""), (7, "separate"), (7, "separate")]
    rows += [(9000, "elephant " * 20_000), (9001, "x" * 50_000 + " ")] + [(9002 + i, "y" * 3000 + " " + "y" * 2999 + "z") for i in range(9)]
    return rows


@pytest.mark.parametrize("tile", [8, 1024])
def test_matches_all_pairs(spark, rows, tile):
    df = spark.createDataFrame([(*r, "clash", 1, "n") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in sp.variants(df, tile=tile).collect())
    want = plain(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(len(r[0]) == 3000 for r in want)


def test_chains_end_at_their_last_word(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w3")]
    got = dict(map(tuple, sp.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert set(got.values()) == {"w13"} and len(got) == 14


def test_empty_table(spark):
    out = sp.variants(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
