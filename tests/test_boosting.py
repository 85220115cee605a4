import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from meterwise.plans import boosting, trees
from meterwise.plans import models as plan

NAMES = ["a", "b", "c", "d", "none"]
PARAMS = {"learning_rate": 0.3, "num_leaves": 15, "max_depth": None, "min_child_samples": 20, "subsample": 0.8, "colsample": 0.7}


def _rows(spark, n, parts):
    rng = np.random.default_rng(n)
    a, b, noise = rng.random(n), rng.exponential(3, n), rng.normal(0, 0.2, n)
    c, d = rng.integers(0, 4, n), rng.random(n) < 0.1
    rows = zip(*(v.tolist() for v in (a, b, c.astype(float), d.astype(float), np.zeros(n), 5 + 3 * a + c * a + 2 * d + np.log1p(b) + noise)),
               range(n), strict=True)
    frame = spark.createDataFrame(list(rows), "a double, b double, c double, d double, none double, label double, id int")
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(frame.coalesce(parts))
    return vectors.select("features", "label", (F.col("id") % 5 == 3).alias("is_valid")).persist()


def _single_fits(rows, rounds, seed):
    """Losses of one forest fit a round, each reading and binning all rows."""
    tree, now, losses = plan.boosted_tree(PARAMS, seed), rows.withColumn("score", F.lit(0.0)), []
    for at in range(rounds):
        gap = F.col("label") - F.col("score")
        goal = (2.0 * gap if at else F.col("label")).alias("label")
        model = tree.copy({tree.seed: seed + at}).fit(now.where("NOT is_valid").select("features", goal))
        step = PARAMS["learning_rate"] if at else 1.0
        now = model.transform(now).withColumn("score", F.col("score") + step * F.col("prediction")).drop("prediction")
        losses.append(now.where("is_valid").agg(F.avg(gap * gap)).first()[0])
    return losses


# Splits from all rows, from more and from less than two fifths of them.
@pytest.mark.parametrize("n", [3000, 20_000, 40_000])
def test_rounds_are_those_of_single_fits(spark, monkeypatch, n):
    rows = _rows(spark, n, 3)
    wanted = _single_fits(rows, 3, 11)
    monkeypatch.setattr(boosting, "SETTLE_ROUNDS", 1)
    for limit in (10**9, 0):
        monkeypatch.setattr(boosting, "LOCAL_ROWS", limit)
        monkeypatch.setattr(plan.RandomForestRegressor, "fit", None)
        state = plan.fit_boosted_to_best({**PARAMS, "n_estimators": 3}, 11, rows, 99)
        monkeypatch.undo()
        monkeypatch.setattr(boosting, "SETTLE_ROUNDS", 1)
        assert state.losses == pytest.approx(wanted, rel=1e-9)
    held = state.model(3).transform(rows.where("is_valid"))
    assert held.agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0] == pytest.approx(wanted[-1], rel=1e-9)
    rows.unpersist()


def test_random_numbers_are_those_of_spark(spark):
    jvm = spark.sparkContext._jvm
    for seed in (0, 42, -7, 2**40 + 3):
        theirs, (ours, state) = jvm.org.apache.spark.util.random.XORShiftRandom(seed), trees.doubles(trees.hashed_seed(seed), 700)
        assert [theirs.nextDouble() for _ in range(701)] == [*ours, trees.doubles(state, 1)[0][0]]
        java, own = jvm.java.util.Random(seed), trees.JavaRandom(seed)
        assert [java.nextLong() for _ in range(9)] == [own.long() for _ in range(9)]


def test_registered_models_run_at_full_size(spark, monkeypatch):
    from meterwise.catalog import modelling

    asked = []

    def fit(*_, **more):
        asked.append(more)
        raise StopIteration

    monkeypatch.setattr(modelling, "package", lambda *_: None)
    monkeypatch.setattr(modelling, "report", lambda *_: None)
    monkeypatch.setattr(modelling.plan, "fit_boosted", fit)
    monkeypatch.setattr(modelling.plan, "model_years", lambda *_, **more: asked.append(more))
    with pytest.raises(StopIteration):
        modelling.tune_boosted(spark, "/root/testdata/sf0.001")
    modelling.model_years(spark, "/root/testdata/sf0.001")
    assert asked == [{"trials": 40}, {}]


def test_a_fit_goes_on_from_the_best_trial(spark):
    rows = _rows(spark, 3000, 2)
    begun = plan.fit_boosted_to_best({**PARAMS, "n_estimators": 4}, 5, rows, 99)
    whole, more = (plan.fit_boosted_to_best({**PARAMS, "n_estimators": 7}, 5, rows, 99, b) for b in (None, begun))
    assert more.losses == pytest.approx(whole.losses, rel=1e-12) and more.trees[:4] == begun.trees and len(begun.trees) == 4
    rows.unpersist()
