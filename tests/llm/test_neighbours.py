import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int, query string, rank int"


def plain(rows, k):
    """The k nearest candidates of every hundredth id, by all distances."""
    good = [
        (i, np.array(v, np.float32).astype(float)) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for p, (i, q) in enumerate(good):
        if i % 100 == 0:
            other = [(float(nn.distances(v[None], q)[0]), j) for o, (j, v) in enumerate(good) if o != p and len(v) == len(q)]
            out[i] = sorted(other)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 1) for r in rows], SCHEMA)


def search(spark, rows, **options):
    got = {}
    for r in nn.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 32))
    data = centres[rng.integers(0, 6, 1500)] + 0.4 * rng.normal(size=(1500, 32))
    data[1::50] = data[0::50] + 0.01 * rng.normal(size=(30, 32))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)]


@pytest.mark.parametrize("block", [64, 2048])
def test_recall_against_all_distances(spark, rows, block):
    got, want = search(spark, rows, block=block), plain(rows, 10)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert recall(got, want) >= 0.95
    # What is found has its exact distance, in order.
    assert all(g == sorted(g) for g in got.values())
    exact = {q: dict((j, d) for d, j in w) for q, w in plain(rows, len(rows)).items()}
    assert all(exact[q][j] == d for q, g in got.items() for d, j in g)
    # The planted copies are the nearest.
    assert all(got[q][0] == want[q][0] for q in want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [5.0, 5.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [None, 1.0]),
            (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (200, [1.0, 2.0]), (201, [-1e30, 3.0]), (202, [1e-30, 3.0])]
    assert search(spark, rows, miss=1e-9) == {q: w for q, w in plain(rows, 10).items() if w}


def test_ties_and_copies_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0, float(i % 2)]) for i in range(700)] + [(2, [1.0, 0.0, 0.0])]
    got = search(spark, rows, block=50, miss=1e-9)
    assert [j for _, j in got[100]] == [0, 2, 2, 4, 6, 8, 10, 12, 14, 16] and {d for d, _ in got[100]} == {0.0}


def test_empty_table_and_no_queries(spark, rows):
    assert search(spark, []) == {}
    assert nn.nearest(frame(spark, rows[:50]), F.lit(False)).count() == 0


def test_threshold_keeps_its_promise():
    rng = np.random.default_rng(0)
    hit = (np.abs(rng.normal(size=(20_000, nn.PROJECTIONS))) <= nn.HALF_WIDTH).sum(axis=1)
    assert (hit < nn.threshold()).mean() <= nn.MISS * 1.2
