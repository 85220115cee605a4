import numpy as np
import pandas as pd
import pytest

from meterwise.operators import outliers, profiling as ops
from tests.conftest import by


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    n = 600
    x = rng.exponential(2, n).round(2)
    frame = pd.DataFrame({
        "x": x, "near_x": x + rng.normal(0, 0.05, n), "flag": rng.integers(0, 2, n).astype(float),
        "few": rng.integers(0, 6, n).astype(float), "same": np.ones(n),
        "hour_Late": rng.integers(0, 2, n).astype(float),
        "y": (0.2 * x + rng.normal(0, 0.3, n)).clip(0).round(2),
    })
    frame.loc[::50, "few"] = np.nan
    return frame


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table).replace(float("nan"), None).cache()


COLS = ["x", "near_x", "flag", "few", "same", "hour_Late"]


def test_missingness_and_describe(df, table):
    missing = ops.missingness(df).collect()
    assert [r["column"] for r in missing] == ["few"]
    assert missing[0]["missing"] == pytest.approx(table["few"].isna().mean())
    got = by(ops.describe(df, ["x", "few"]).collect(), "column")
    for c in ("x", "few"):
        want = table[c].describe(percentiles=[0.01, 0.5, 0.99])
        for mine, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"),
                             ("q01", "1%"), ("q50", "50%"), ("q99", "99%")):
            assert got[c][mine] == pytest.approx(want[theirs])


def test_skew_and_target_profile_match_bias_corrected_pandas(df, table):
    row = ops.target_profile(df, "y", "tip_amount").first()
    assert row["skew"] == pytest.approx(table["y"].skew())
    assert row["kurtosis"] == pytest.approx(table["y"].kurtosis())
    assert row["zero_pct"] == pytest.approx((table["y"] == 0).mean() * 100)
    skews = by(ops.skew_profile(df, ["x", "few"]).collect(), "feature")
    assert skews["x"]["skew"] == pytest.approx(table["x"].skew())
    assert skews["x"]["suggested_transform"] == "log1p"
    assert skews["few"]["suggested_transform"] == "none"


def test_log_advice_is_never_given_for_the_log_target(df):
    assert ops.target_profile(df, "x", "tip_amount").first()["suggest_log1p_target"] is True
    assert ops.target_profile(df, "x", "log_tip").first()["suggest_log1p_target"] is False


def test_feature_groups(df):
    kinds = ops.groups_by_kind(ops.feature_groups(df, COLS))
    assert kinds == {"dummy": ["hour_Late"], "binary": ["flag", "same"], "low_card": ["few"],
                     "continuous": ["x", "near_x"]}


def test_correlations_match_pandas_and_skip_constants(df, table):
    got = by(ops.feature_target_correlations(df, COLS).collect(), "feature")
    assert set(got) == set(COLS) - {"same"}
    for c in got:
        both = table[[c, "y"]].dropna()
        assert got[c]["pearson_corr"] == pytest.approx(both[c].corr(both["y"]), abs=1e-9)
        assert got[c]["spearman_corr"] == pytest.approx(
            both[c].rank().corr(both["y"].rank()), abs=1e-9)
    order = [r["feature"] for r in ops.feature_target_correlations(df, COLS).collect()]
    assert set(order[:2]) == {"x", "near_x"}


def test_high_pairs_low_variance_and_constants(df):
    pairs = ops.high_correlations(df, COLS, 0.9).collect()
    assert [(r["feature_1"], r["feature_2"]) for r in pairs] == [("x", "near_x")]
    assert ops.high_correlations(df, ["x"], 0.9).count() == 0
    low = ops.low_variance(df, COLS).collect()
    assert [(r["feature"], r["level"]) for r in low] == [("same", "zero")]
    assert [r["feature"] for r in ops.constant_columns(df, COLS).collect()] == ["same"]


def test_scaling_advice(spark, df):
    skews = ops.skew_profile(df, ["x"])
    assert ops.scaling_advice(df, [], skews).first()["recommended_scaler"] == "none"
    wide = spark.createDataFrame([(1.0, 1000.0), (2.0, 90000.0), (2.5, 5.0)], "a double, b double")
    row = ops.scaling_advice(wide, ["a", "b"], ops.skew_profile(wide, ["a", "b"])).first()
    assert row["recommend_scaling"] and row["recommended_scaler"] == "StandardScaler"


def test_variable_check(df, table):
    got = ops.variable_check(df, ["x"]).first()
    q1, q3 = table["x"].quantile([0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert got["outlier_count_1p5_iqr"] == ((table["x"] < low) | (table["x"] > high)).sum()


def test_axis_limits(spark, df):
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    row = ops.axis_limits(flat, "v").first()
    assert (row[0], row[1]) == (pytest.approx(2.85), pytest.approx(3.15))
    assert ops.axis_limits(flat.where("v > 9"), "v").count() == 0


def test_bounds_clip_once_and_drop_inclusively(df, table):
    bounds = outliers.as_bounds(outliers.fit_bounds(df, ["x"], 0.05, 0.95))
    low, high = table["x"].quantile([0.05, 0.95])
    assert bounds["x"] == (pytest.approx(low), pytest.approx(high))
    once = outliers.winsorise(df, bounds)
    assert outliers.clip_counts(once, bounds).first()["cells_clipped"] == 0
    clipped = ((table["x"] < low) | (table["x"] > high)).sum()
    assert outliers.winsor_summary(df, bounds).first()["cells_clipped"] == clipped
    assert outliers.drop_outside(df, bounds).count() == len(table) - clipped
    assert outliers.drop_summary(df, bounds).first()["rows_removed"] == clipped
    with pytest.raises(ValueError):
        outliers.apply_bounds(df, bounds, "other")
    with pytest.raises(KeyError):
        outliers.fit_bounds(df, ["nope"])


def test_median_fill_and_population_scaling(spark, df, table):
    filled = outliers.fill_medians(df, ["few"]).toPandas()["few"]
    assert filled.isna().sum() == 0
    assert (filled[table["few"].isna()] == table["few"].median()).all()
    scaler = outliers.as_scaler(outliers.fit_scaler(df, ["x", "same"]))
    assert scaler["same"] == (1.0, 1.0)
    assert scaler["x"][1] == pytest.approx(table["x"].std(ddof=0))
    back = outliers.unscale(outliers.scale(df.select("x"), {"x": scaler["x"]}), {"x": scaler["x"]})
    assert back.toPandas()["x"].to_numpy() == pytest.approx(table["x"].to_numpy())


def test_spearman_pairs_only_features_with_nulls(df, table, monkeypatch):
    asked = []
    pair_sums = ops._pair_sums
    monkeypatch.setattr(ops, "_pair_sums", lambda rows, columns, y: asked.extend(columns) or pair_sums(rows, columns, y))
    whole = by(ops.spearman_with_target(df, ["x", "flag", "same", "hour_Late"]).collect(), "feature")
    assert not asked and set(whole) == {"x", "flag", "hour_Late"}
    both = by(ops.spearman_with_target(df, COLS).collect(), "feature")
    assert asked == ["few"] and both["few"]["spearman_corr"] is not None
    assert whole["x"]["spearman_corr"] == pytest.approx(table["x"].rank().corr(table["y"].rank()), abs=1e-12)


def test_spearman_leaves_out_rows_without_a_target(spark):
    rows = [(1.0, 5.0, 1.0), (2.0, None, 9.0), (2.0, 4.0, None), (3.0, 1.0, 4.0), (4.0, 1.0, 3.0), (9.0, None, None)]
    frame = pd.DataFrame(rows, columns=["a", "y", "b"])
    got = by(ops.spearman_with_target(spark.createDataFrame(rows, "a double, y double, b double"), ["a", "b"]).collect(), "feature")
    for c in "ab":
        kept = frame[[c, "y"]].dropna()
        assert got[c]["spearman_corr"] == pytest.approx(kept[c].rank().corr(kept["y"].rank()), abs=1e-12)


def test_profiles_follow_from_given_counts(spark, df):
    counts = ops.column_counts(df, COLS)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([], df.schema)  # with counts given, the rows are not read again
    for given, made in (
        (ops.feature_groups(none, COLS, counts=counts), ops.feature_groups(df, COLS)),
        (ops.skew_profile(none, ["x", "few"], counts=counts), ops.skew_profile(df, ["x", "few"])),
    ):
        one, two = (by(table.collect(), "feature") for table in (given, made))
        assert set(one) == set(two)
        for c in one:
            assert [pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in one[c]] == list(two[c])
