import numpy as np
import pandas as pd
import pytest

from meterwise.operators import quantiles as ops

PROBS = {"a": 0.0, "b": 0.003, "c": 0.25, "d": 0.5, "e": 0.997, "f": 1.0}


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(7)
    # One group holds most rows, with many repeats; others are small, negative and heavy-tailed.
    frame = pd.concat([
        pd.DataFrame({"g": 1, "v": np.round(rng.exponential(3, 4000), 2)}),
        pd.DataFrame({"g": 2, "v": rng.normal(0, 1000, 101)}),
        pd.DataFrame({"g": 3, "v": [5.0]}),
        pd.DataFrame({"g": 4, "v": [None, None]}),
    ])
    df = spark.createDataFrame(frame.astype({"v": float}))
    df = df.withColumn("v", df.v.cast("double")).replace(float("nan"), None)
    got = {r["g"]: r for r in ops.exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == {1, 2, 3}
    for g in got:
        values = frame.loc[frame.g == g, "v"].to_numpy(dtype=float)
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_quantiles_without_groups_and_null_group_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 4.0)], "g string, v double")
    row = ops.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert row["m"] == 2.0
    grouped = {r["g"]: r["m"] for r in ops.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert grouped == {None: 1.5, "x": 4.0}


def test_many_columns_in_one_job(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 8.0)], "x double, y double")
    got = {r["column"]: r["m"] for r in ops.column_quantiles(df, ["x", "y"], {"m": 0.5}).collect()}
    assert got == {"x": 2.0, "y": 8.0}


def test_average_ranks_match_pandas(spark):
    values = [3.0, 1.0, 3.0, 3.0, -2.0, 1.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["rank"] for r in ops.average_ranks(df, [], "v").collect()}
    want = pd.Series(values).rank(method="average")
    assert all(got[v] == w for v, w in zip(values, want, strict=True))


def test_running_totals_of_two_measures(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.1, 1), (0.1, 0), (0.9, 1), (0.5, 0)], "s double, t int")
    counts = ops.value_counts(df, [], "s", {"n": F.count(F.lit(1)), "pos": F.sum("t")})
    rows = ops.running_totals(counts, [], "s", ["n", "pos"]).orderBy("s").collect()
    assert [(r["n_before"], r["pos_before"]) for r in rows] == [(0, 0), (2, 1), (3, 1)]
    assert {(r["n_total"], r["pos_total"]) for r in rows} == {(4, 2)}


def test_one_group_in_a_narrow_band_spreads_over_the_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    settled = []
    monkeypatch.setattr(ops, "settle", lambda df: settled.append(df.cache()) or settled[-1])
    with_small = spark.range(40_000).select(F.lit(1).alias("g"), (F.rand(3) / 1000).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ops.running_totals(ops.value_counts(with_small, ["g"], "v"), ["g"], "v").toPandas().sort_values("v")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [r["count"] for r in settled[0].groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * 40_000
    assert (ranked["n_before"].to_numpy() == np.arange(len(ranked))).all() and set(ranked["n_total"]) == {40_000}


def test_counts_of_columns_with_nulls_nan_and_signed_zero(spark):
    rows = [(1.0, 0.0, None), (1.0, -0.0, None), (None, float("nan"), None), (3.0, 7.0, None), (2.0, float("nan"), None)]
    df = spark.createDataFrame(rows, "`a.b` double, c double, d double").repartition(3)
    got = {(r["column"], str(r["value"])): (r["n"], r["ranked"], r["rank_sum"]) for r in ops.column_counts(df, ["a.b", "c", "d"], "c").collect()}
    assert got["a.b", "1.0"] == (2, 2, 0.0) and got["a.b", "None"][0] == 1 and got["a.b", "3.0"] == (1, 1, 7.0)
    assert got["c", "0.0"][0] == 2 and got["c", "nan"][0] == 2 and got["d", "None"][0] == 5 and len(got) == 8
