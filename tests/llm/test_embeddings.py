import math

import numpy as np
import pytest

from meterwise.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node int"


def plain(rows):
    """All pairs of each label in double precision."""
    good = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    up = list(range(len(good)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(good)
    for i, (_, a, la) in enumerate(good):
        for j in range(i):
            _, b, lb = good[j]
            if la == lb and len(a) == len(b):
                a64, b64 = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if a64 @ b64 / math.sqrt(a64 @ a64) / math.sqrt(b64 @ b64) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    low = {}
    for i, r in enumerate(good):
        low[find(i)] = min(r[0], low.get(find(i), r[0]))
    out = [(r[0], links[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(good)]
    kept = [id(r) for r in good]
    return out + [(r[0], 0, r[0], r[0] is not None) for r in rows if id(r) not in kept]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out, n = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            base = rng.normal(size=16)
            for spread in (0.0, 0.05, 0.3, 0.35, 0.4):
                v = base + spread * rng.normal(size=16)
                out.append((n, v.astype(np.float32).tolist(), label))
                n += 1
    hot = rng.normal(size=16)
    out += [(n + i, (hot + 0.01 * rng.normal(size=16)).astype(np.float32).tolist(), 2) for i in range(90)]
    out += [(2000 + i, hot.astype(np.float32).tolist(), 2) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    out += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, [nan] + [1.0] * 15, 1), (3005, [inf] * 16, 1),
            (None, [1.0] * 16, 1), (3006, [1.0] * 16, 1), (3006, [1.0] * 16, 1), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1), (3009, [1e-30] * 16, 1), (3010, [3e38] * 16, 1)]
    return out


@pytest.mark.parametrize("tile", [16, 1024])
def test_matches_all_pairs(spark, rows, tile):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = em.near_duplicates(df, tile=tile).collect()
    key = lambda r: repr(tuple(r))
    assert sorted([tuple(r) for r in got], key=key) == sorted(plain(rows), key=key)


def test_bounds_hold_and_settle_most_pairs():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(400, 64))
    data[200:] = data[:200] + 0.38 * rng.normal(size=(200, 64))
    q = em.Quantised(data)
    exact = data @ data.T / np.outer(q.norms, q.norms)
    near = (q.factors @ q.factors.T) * np.outer(q.scale, q.scale)
    bound = q.error[:, None] + q.length[:, None] * q.error[None, :]
    assert np.all(np.abs(exact - near) <= bound + 1e-12) and bound.max() < 0.03
    assert np.array_equal(em.linked(q, q, slice(0, 400), 0.93), exact >= 0.93)


def test_empty_table(spark):
    assert em.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_alone_settle_pairs_and_survive_packing():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 32))
    data[150:] = data[:150] + 0.35 * rng.normal(size=(150, 32))
    q = em.Quantised(data)
    codes = em.Codes.unpacked(q.packed())
    exact = data @ data.T / np.outer(q.norms, q.norms) >= 0.93
    sure, undecided = em.settle_by_codes(codes, codes, slice(0, 300), 0.93)
    assert exact[sure].all() and not exact[~sure & ~undecided].any()
    assert 0 < undecided.sum() < 1000
    weight = np.ones(300, np.int64)
    by_codes, _, unsettled = em.compare(codes, weight, 300, 0.93)
    part = np.flatnonzero(unsettled)
    some = em.Codes.unpacked([q.packed()[k] for k in part])
    by_codes[part] += em.compare(some, weight[part], len(part), 0.93, data[part])[0]
    assert np.array_equal(by_codes, exact.sum(axis=1) - 1)
