import numpy as np
import pytest

from meterwise.operators import moments


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    table = np.stack([x, 1e6 + 0.5 * x + rng.normal(size=500), rng.integers(0, 2, 500), np.full(500, 0.1)], 1)
    return [[None if rng.random() < 0.1 else float(v) for v in row] for row in table]


@pytest.mark.parametrize("parts", [1, 7])
def test_matches_numpy_over_the_rows_where_both_are_present(spark, rows, parts):
    df = spark.createDataFrame(rows, "`a.b` double, c double, d double, e double").repartition(parts)
    names = ["a.b", "c", "d", "e"]
    table = moments.moment_matrix(df, names).withColumn("r", moments.pearson()).collect()
    data = np.array([[np.nan if v is None else v for v in row] for row in rows])
    assert len(table) == 10
    for line in table:
        x, y = (data[:, names.index(line[f])] for f in ("feature_1", "feature_2"))
        both = ~np.isnan(x) & ~np.isnan(y)
        assert line.pairs == both.sum()
        if "e" in (line.feature_1, line.feature_2):
            assert line.r is None
        else:
            assert line.r == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-9)
            assert line.covariance == pytest.approx(np.cov(x[both], y[both])[0, 1] * (both.sum() - 1), rel=1e-6)
    spread = {r.feature: r.variance for r in moments.sample_variances(moments.moment_matrix(df, names)).collect()}
    assert spread["e"] == 0 and spread["c"] == pytest.approx(np.nanvar(data[:, 1], ddof=1), rel=1e-9)


def test_no_rows_and_no_values(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert moments.moment_matrix(empty, ["a", "b"]).collect() == []
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double").coalesce(1)
    got = {(r.feature_1, r.feature_2): r for r in moments.moment_matrix(nulls, ["a", "b"]).collect()}
    assert got["a", "a"].pairs == 0 and got["b", "b"].spread_1 == 0.5
    assert moments.sample_variances(moments.moment_matrix(nulls, ["a"])).first().variance is None


@pytest.mark.parametrize("parts", [1, 7])
def test_moments_of_single_columns(spark, rows, parts):
    cells = [[*row, None, float("nan") if k % 2 else 1.0] for k, row in enumerate(rows)]
    df = spark.createDataFrame(cells, "`a.b` double, c double, d double, e double, f double, g double").repartition(parts)
    got = {r.feature: r for r in moments.column_moments(df, ["a.b", "c", "d", "e", "f", "g"]).collect()}
    data = np.array([[np.nan if v is None else v for v in row] for row in rows])
    for k, c in enumerate(["a.b", "c", "d", "e"]):
        assert (got[c].rows, got[c].filled) == (500, (~np.isnan(data[:, k])).sum())
        assert (got[c].low, got[c].high) == (np.nanmin(data[:, k]), np.nanmax(data[:, k]))
        assert got[c].variance == pytest.approx(np.nanvar(data[:, k], ddof=1), rel=1e-9)
    assert got["f"].filled == 0 and got["f"].low is None and got["f"].high is None and got["f"].variance is None
    assert got["g"].low == 1.0 and np.isnan(got["g"].high)
    assert moments.column_moments(df.where("false"), ["c"]).collect() == []
