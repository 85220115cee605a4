import math
from fractions import Fraction

import numpy as np
import pytest

from meterwise.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, component string, w int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 1) for r in rows], SCHEMA)


def plain(rows, count=32):
    """Double-precision eigenvectors of the centred covariance."""
    ids = [i for i, _ in rows]
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)) + 1_000_000
    gap = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(gap.T @ gap / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    deviation = [sum((len(x) * v - s) ** 2 for v, s in zip(row, sums)) for row in whole]
    return ids, deviation, gap @ vectors / np.sqrt(np.abs(values)), values / values.sum(), min(count, x.shape[1])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    data = rng.normal(size=(400, 40)) * np.linspace(0.2, 3, 40) + rng.normal(size=40) * 5
    data[:, 3] += 2 * data[:, 5]
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)]


def test_matches_double_precision(spark, rows):
    got = wh.whiten(frame(spark, rows)).collect()
    ids, deviation, white, share, count = plain(rows)
    assert count == 32 and len(got) == 400 * 32 and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-10
    table = np.zeros((400, 32))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == 400 and r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-10 * r["explained"]
    sign = np.sign((table * white[:, :32]).sum(axis=0))
    assert np.abs(table * sign - white[:, :32]).max() < 1e-8
    cov = np.cov(table.T, bias=True)
    assert np.abs(cov - np.eye(32)).max() < 1e-10


def test_odd_rows_are_left_out(spark, rows):
    nan, inf = float("nan"), float("inf")
    few = [(i, v[:4]) for i, v in rows[:60]]
    odd = [(900, None), (901, []), (902, [nan] * 4), (903, [inf, 0.0, 0.0, 0.0]), (904, [None] * 4), (905, [1.0] * 5)]
    more = [(None, few[0][1]), (1, few[1][1]), (906, [0.0] * 4)]
    got = wh.whiten(frame(spark, few + odd + more)).collect()
    ids, deviation, white, share, count = plain(few + more)
    assert len(got) == 63 * 4 and sorted({repr(r["vec_id"]) for r in got}) == sorted({repr(i) for i in ids})
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)


def test_multiple_and_missing_eigenvalues(spark):
    corners = [(k, [float(s) if j == i else 0.0 for j in range(6)]) for k, (i, s) in enumerate((i, s) for i in range(5) for s in (-1, 1))]
    got = wh.whiten(frame(spark, corners)).collect()
    # Five equal eigenvalues, and a dimension without variance.
    assert {r["component"] for r in got} == {1, 2, 3, 4, 5} and got[0]["identity_error"] < 1e-10
    assert all(abs(r["explained"] - 0.2) < 1e-12 for r in got)


def test_huge_entries(spark):
    data = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3e38, -7.0]), (3, [0.0, 0.5])]
    got = wh.whiten(frame(spark, data)).collect()
    assert {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = wh.whiten(frame(spark, rows))
    assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]


def test_characteristic_polynomial_and_roots():
    rng = np.random.default_rng(1)
    a = rng.integers(-9, 9, (7, 7))
    m = (a @ a.T).astype(object)
    p = 2_147_483_647
    # Faddeev and LeVerrier, in fractions.
    coefficients, b = [Fraction(1)], np.zeros((7, 7), object)
    for k in range(1, 8):
        b = m.dot(b) + coefficients[-1] * np.eye(7, dtype=int).astype(object)
        coefficients.append(-sum(m.dot(b)[i, i] for i in range(7)) / k)
    poly = [int(c) for c in reversed(coefficients)]
    assert [c % p for c in poly] == wh.characteristic_mod(m, p).tolist()
    values = np.linalg.eigvalsh((a @ a.T).astype(float))[::-1]
    for k in range(1, 8):
        low, high, bits = wh.bracket(poly, k)
        assert wh.above(poly, low, bits) >= k > wh.above(poly, high, bits)
        assert math.isclose(low / 2**bits, values[k - 1], rel_tol=1e-9)


def test_exact_products_of_large_numbers():
    x = np.array([[2**40 + 1, -3], [5, 2**62], [1 << 25, 7]], np.int64)
    whole = x.astype(object)
    assert (wh.exact_products(x) == whole.T @ whole).all()
    assert (wh.exact_products(x[2:]) == whole[2:].T @ whole[2:]).all()
