import hashlib
import math

import pytest
from pyspark.sql import functions as F

from meterwise.operators import sampling as ops


def frame(spark, rows=500, parts=4):
    return spark.range(rows).select(
        F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("c")
    ).repartition(parts)


def order(keys, seed=42):
    return sorted(keys, key=lambda k: hashlib.md5(f"{k}|{seed}".encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 137, 500, 900])
def test_exact_size_and_same_rows_for_any_partitioning(spark, n):
    want = set(order(range(500))[:n])
    for parts in (1, 7):
        got = [r["k"] for r in ops.take_rows(frame(spark, parts=parts), n, ["k"]).collect()]
        assert len(got) == min(n, 500) and set(got) == want


def test_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        ops.take_rows(frame(spark), 0, ["k"])


def test_split_is_complete_and_stratified(spark):
    rows = ops.split_rows(frame(spark), ["k"], 0.2, 42, ["c"]).collect()
    assert len(rows) == 500
    for c in (0, 1):
        part = [r for r in rows if r["c"] == c]
        valid = {r["k"] for r in part if r["is_valid"]}
        size = math.ceil(len(part) * 0.2)
        assert valid == set(order(r["k"] for r in part)[:size])


def test_split_with_one_class(spark):
    rows = ops.split_rows(frame(spark).where("c = 0"), ["k"], 0.2, 42, ["c"]).collect()
    assert sum(r["is_valid"] for r in rows) == 90


def test_null_stratum_keeps_its_rows(spark):
    df = frame(spark, 40).withColumn("c", F.when(F.col("k") < 20, 1))
    assert ops.split_rows(df, ["k"], 0.5, 42, ["c"]).count() == 40


def test_quotas_add_up_to_the_cap(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2 + [("c",)] * 1, "c string")
    quotas = {r["c"]: r["quota"] for r in ops.stratified_quotas(df, "c", 5).collect()}
    assert sum(quotas.values()) == 5 and quotas["a"] in (3, 4)


def test_stratified_cap_has_exact_size(spark):
    got = ops.cap_stratified(frame(spark), 101, ["k"], "c").groupBy("c").count().collect()
    sizes = {r["c"]: r["count"] for r in got}
    assert sum(sizes.values()) == 101 and sizes[1] == 10


def test_cap_leaves_small_frames_whole(spark):
    assert ops.cap_rows(frame(spark), 10_000, ["k"]).count() == 500


def test_more_strata_than_the_expression_takes(spark, monkeypatch):
    df = frame(spark).withColumn("c", F.when(F.col("k") < 480, F.col("k") % 6))
    want = sorted(map(tuple, ops.split_rows(df, ["k"], 0.2, 42, ["c"]).collect()))
    monkeypatch.setattr(ops, "MAX_STRATA", 2)
    got = ops.split_rows(df, ["k"], 0.2, 42, ["c"])
    assert sorted(map(tuple, got.collect())) == want and got.columns[: len(df.columns)] == df.columns
