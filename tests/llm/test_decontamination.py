import random

import pytest

from meterwise.llm import decontamination as dc

DOCS = "doc_id long, text string, item_id string, coverage int"
ITEMS = "item_id long, text string, doc_id int"


def plain_tiles(a, b, least):
    """Greedy string tiling by trying every pair of positions."""
    mark_a, mark_b, total, tiles = set(), set(), 0, 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in mark_a and j + n not in mark_b:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return total, tiles
        n, i, j = best
        mark_a |= set(range(i, i + n))
        mark_b |= set(range(j, j + n))
        total, tiles = total + n, tiles + 1


def test_tiling_matches_the_plain_algorithm():
    rng = random.Random(2)
    for _ in range(150):
        item = rng.choices("abcd", k=rng.randrange(6, 30))
        other = rng.choices("abcd", k=12)
        parts = [item[i : i + 7] for i in range(0, len(item), 7)]
        rng.shuffle(parts)
        text = [w for p in parts for w in (*p, *rng.choices("abcdx", k=rng.randrange(3)))]
        block = dc.Block.build([(0, other), (1, item), (2, ["z"] * 6)], 5)
        got = {i: (n, tiles) for i, n, tiles, _ in dc.tile_text(block, " ".join(text), 5)}
        want = plain_tiles(text, item, 5)
        assert got.get(1, (0, 0)) == want
        assert 2 not in got


def test_repetitive_texts_need_linear_memory():
    import tracemalloc

    block = dc.Block.build([(0, ["again"] * 20_000), (1, ["tick", "tock"] * 10_000)], 5)
    tracemalloc.start()
    got = dc.tile_text(block, "again " * 50_000, 5)
    assert got == [(0, 20_000, 1, 20_000)]
    assert {g[0]: g[1] for g in dc.tile_text(block, "tick tock " * 7_000 + "x " + "again " * 40, 5)} == {0: 40, 1: 14_000}
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_items_that_seeds_can_not_cover_are_left_out():
    item = [f"w{i}" for i in range(20)]
    block = dc.Block.build([(0, item)], 5)
    text = " ".join(item[:9])
    assert dc.tile_text(block, text, 5) == [(0, 9, 1, 20)] and dc.tile_text(block, text, 5, 0.5) == []
    assert dc.tile_text(block, text, 5, 0.45) == [(0, 9, 1, 20)]


@pytest.fixture(scope="module")
def tables(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    swapped = " ".join(words[20:] + ["between", "them"] + words[:20])
    rows = [
        (1, f"Before. {item.upper()}! After"), (2, swapped), (3, " ".join(words[:18])), (4, " ".join(words[:21]) + " other"),
        (5, None), (6, ""), (7, "clean " * 50_000), (8, "filler " * 50_000 + item.replace(" ", ",\n")), (1, item), (None, item),
        (9, " ".join(w for w in words for _ in range(2))), (10, "short one here"), (11, " ".join(words[i] for i in range(0, 40, 2))),
    ]
    items = [(100, item), (101, None), (102, "short one here"), (103, ""), (104, "quite another text of nine words or so indeed"), (105, item)]
    return (spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], DOCS),
            spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS))


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_matches_and_filter(tables, block_words):
    docs, items = tables
    got = dc.matches(docs, items, block_words=block_words).collect()
    assert sorted((str(r.doc_id), r.item_id, r.matched_words, r.item_words) for r in got) == sorted(
        (d, i, n, 40) for d, n in (("1", 40), ("1", 40), ("2", 40), ("4", 21), ("8", 40), ("None", 40)) for i in (100, 105))
    assert {r.n_tiles for r in got if r.doc_id == 2} == {2}
    kept = dc.drop_contaminated(docs, items, block_words=block_words)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9, 10, 11]


def test_empty_tables(spark, tables):
    docs, items = tables
    assert dc.matches(docs, items.limit(0)).count() == 0
    assert dc.matches(docs.limit(0), items).count() == 0
    assert dc.drop_contaminated(docs, items.limit(0)).count() == docs.count()
