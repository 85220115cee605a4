import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.operators import features
from meterwise.plans import models as plan

KEYS = ["k"]


@pytest.fixture(scope="module")
def clean(spark):
    """Synthetic cleaned trips whose tip depends on the fare and whose tipping on the hour."""
    rng = np.random.default_rng(9)
    n = 1500
    miles = rng.exponential(3, n).clip(0.2, 30)
    fare = 3 + 2.5 * miles + rng.uniform(0, 1, n)
    hour = rng.integers(0, 24, n)
    tipped = rng.uniform(size=n) < np.where(hour < 12, 0.95, 0.55)
    tip = np.where(tipped, 0.2 * fare + rng.normal(0, 0.3, n), 0).clip(0).round(2)
    pick = rng.integers(0, 1000, (n, 6))
    rows = [
        (i, int(1 + pick[i, 0] % 4), 1, ["Queens", "Bronx", None, "Harbor"][pick[i, 1] % 4],
         int(hour[i]), int(1 + pick[i, 2] % 12), int(1 + i % 7), bool(pick[i, 3] % 7 > 4),
         bool(pick[i, 4] % 9 == 0), False, False, float(miles[i]),
         float(miles[i] * 4 + rng.uniform(0, 3)), float(rng.uniform(5, 30)),
         float(round(fare[i], 2)), float(0.5 * (pick[i, 5] % 3)), 0.5, 0.3, None, None, 0.0, float(tip[i]),
         float(tip[i] / fare[i]), float(fare[i] + tip[i]), 2019)
        for i in range(n)
    ]
    kinds = {**C.CLEAN_COLUMNS}
    schema = "k int, " + ", ".join(
        f"{c} {'double' if kinds[c].startswith(('decimal', 'float')) else kinds[c]}"
        for c in C.MODEL_SAMPLE_COLUMNS
    ) + ", year int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def package(clean):
    return plan.build_dataset(clean, KEYS, 2019, target_rows=1400)


@pytest.fixture(scope="module")
def report(package):
    return plan.prep_checks(package.train, package.columns)


def test_dataset_has_no_leakage_and_bounds_from_train(package):
    assert not set(package.columns) & set(C.LEAKAGE_COLUMNS + C.ENCODED_AWAY)
    assert "borough_Harbor" in package.columns and "borough_Bronx" not in package.columns
    assert package.train.count() + package.valid.count() == 1400
    for part in (package.train, package.valid):
        for c, (low, high) in package.bounds.items():
            row = part.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
            assert row["a"] >= low - 1e-9 and row["b"] <= high + 1e-9
    row = package.outlier_summary.first()
    assert row["train"]["rows_before"] + row["valid"]["rows_before"] == 1400


def test_matrix_rejects_text_and_unknown_targets(clean):
    with pytest.raises(ValueError):
        features.build_model_matrix(clean, "tip_amount", KEYS)
    with pytest.raises(ValueError):
        features.build_model_matrix(clean, "fare_amount", KEYS)


def test_correlated_walk():
    pairs = [("a", "b", 0.99), ("b", "c", 0.95), ("c", "d", 0.92), ("e", "f", 0.91)]
    strength = {"a": 0.5, "b": 0.2, "c": 0.4}
    variance = {"c": 1.0, "d": 2.0}
    # b is weaker than a; b, c is skipped; c has the smaller variance; e, f only have names.
    assert plan.weaker_of_pairs(pairs, strength, variance) == ["b", "c", "f"]


def test_linear_fit_matches_least_squares(package, report):
    fit = plan.fit_linear(package, report)
    prep = plan.prepare(package.train.where("y > 0"), package.valid.where("y > 0"), KEYS,
                        package.columns, report, drop_near_zero=True, drop_correlated=True)
    local = prep.train.toPandas()
    design = np.column_stack([local[prep.columns].to_numpy(dtype=float), np.ones(len(local))])
    want, *_ = np.linalg.lstsq(design, local["y"].to_numpy(), rcond=None)
    coef = {r["feature"]: r["coef"] for r in fit.table.collect()}
    assert [coef[c] for c in prep.columns] == pytest.approx(want[:-1], abs=1e-6)
    assert fit.intercept == pytest.approx(want[-1], abs=1e-6)
    assert set(prep.info["constant_cols_dropped"]) >= {"mta_tax", "rate_code", "borough_EWR"}


def test_logistic_penalty_matches_a_direct_solution(package, report):
    fit = plan.fit_logistic(package, report)
    prep = plan.prepare(package.train, package.valid, KEYS, package.columns, report,
                        drop_near_zero=True, drop_correlated=True)
    local = prep.train.toPandas()
    x = local[prep.columns].to_numpy(dtype=float)
    y = (local["y"] > 0).to_numpy(dtype=float)
    w, b = np.array([dict(zip([r["feature"] for r in fit.table.collect()],
                              [r["log_odds_coef"] for r in fit.table.collect()],
                              strict=True))[c] for c in prep.columns]), fit.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # At the optimum of 0.5 |w|^2 + sum of losses the gradient vanishes.
    assert np.abs(w + x.T @ (p - y)).max() < 0.5 and abs((p - y).sum()) < 0.05


def test_trees_beat_the_naive_models(package, report):
    boosted = plan.fit_boosted(package, report, fixed={"n_estimators": 20, "num_leaves": 15,
                                                       "learning_rate": 0.2})
    naive = plan.naive_regression(package)
    assert boosted.model.getNumTrees > 1
    assert boosted.metrics.first()["rmse"] < 0.7 * naive.metrics.first()["rmse"]
    forest = plan.fit_forest(package, report, fixed={"n_estimators": 20, "max_depth": 6})
    assert plan.naive_classification(package).metrics.first()["roc_auc"] == 0.5
    assert forest.metrics.first()["roc_auc"] > 0.6
    assert all(" " not in r["feature"] for r in boosted.table.collect())


def test_best_round_waits_for_patience():
    losses = [5.0, 4.0, 4.5, 3.9, 4.0, 4.0, 4.0, 1.0]
    assert plan.best_round(losses, 3) == 4 and plan.best_round(losses, 4) == 8
    assert plan.best_round([2.0], 5) == 1


def _marked(clean):
    rows = clean.select("k", "trip_distance", "pickup_hour", "fare_amount", F.col("tip_amount").alias("label"))
    rows = rows.withColumn("is_valid", F.col("k") % 5 == 0)
    return VectorAssembler(inputCols=["trip_distance", "pickup_hour", "fare_amount"], outputCol="features").transform(rows)


BOOSTED = {"learning_rate": 0.3, "n_estimators": 30, "num_leaves": 7, "max_depth": None,
           "min_child_samples": 5, "subsample": 1.0, "colsample": 1.0}


def test_staged_trees_are_those_of_boosting_at_once(clean):
    marked = _marked(clean)
    state = plan.fit_boosted_to_best(BOOSTED, 7, marked, 99)
    whole = GBTRegressor(seed=7, stepSize=0.3, maxIter=30, maxDepth=3, minInstancesPerNode=5,
                         featureSubsetStrategy="all").fit(marked.where("NOT is_valid"))
    held = marked.where("is_valid")
    assert state.losses == pytest.approx(whole.evaluateEachIteration(held, "squared"), rel=1e-9)
    assert state.settled == 25 and len(state.trees) == 30  # a checkpoint lies in between
    model = state.model(30)
    assert model.treeWeights == whole.treeWeights and model.getNumTrees == 30
    assert model.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray(), abs=0.01)


def test_boosting_without_held_rows_has_no_loss(clean):
    state = plan.fit_boosted_to_best({**BOOSTED, "n_estimators": 3}, 7, _marked(clean).withColumn("is_valid", F.lit(False)), 99)
    assert state.losses == [float("inf")] * 3 and state.best == 1


def test_package_scans_decode_only_the_columns_used(package):
    plans = [p.select("y")._jdf.queryExecution().executedPlan().toString() for p in (package.train, package.valid)]
    assert all("ReadSchema: struct<y:double,is_valid:boolean>" in p for p in plans)


def test_a_fit_does_not_cache_its_rows_a_second_time(package, report, monkeypatch):
    held = []
    monkeypatch.setattr(plan.DataFrame, "persist", lambda self, *a: held.append(a) or self)
    plan.fit_linear(package, report)
    plan.fit_logistic(package, report)
    plan.fit_forest(package, report, fixed={"n_estimators": 2, "max_depth": 2})
    assert held == []


def test_boosting_states_share_the_cached_rows(clean):
    marked = _marked(clean).persist()
    states = [plan.boosting.start(marked, 0.1) for _ in range(3)]
    assert not any(s.rows.is_cached for s in states)
    assert all("InMemoryTableScan" in s.rows._jdf.queryExecution().executedPlan().toString() for s in states)
    for s in states:
        s.close()
    assert marked.is_cached
    marked.unpersist()


def test_boosting_stops_after_its_patience_and_resumes(clean):
    marked = _marked(clean)
    eager = {**BOOSTED, "n_estimators": 200, "learning_rate": 0.9, "num_leaves": 31}
    state = plan.fit_boosted_to_best(eager, 7, marked, 4)
    assert len(state.trees) == state.best + 4 < 200 and state.model().getNumTrees == state.best
    assert min(state.losses) == state.losses[state.best - 1]
    once = plan.fit_boosted_to_best({**BOOSTED, "n_estimators": 12}, 7, marked, 99)
    twice = plan.fit_boosted_to_best({**BOOSTED, "n_estimators": 5}, 7, marked, 99)
    plan.boosting.advance(twice, plan.boosted_tree(BOOSTED, 7), 12, 99, 7)
    assert twice.losses == pytest.approx(once.losses, rel=1e-12)


def test_halving_trains_the_better_trials_further(spark):
    trained = {}

    class State:
        open = True

        def close(self):
            self.open = False

    states = []

    def begin(params):
        states.append(State())
        return states[-1]

    def train(params, state, size):
        assert state.open
        trained.setdefault(params["x"], []).append(size)
        return params["x"] + 1.0 / size

    drawn = iter(range(10))
    out = plan._halve(spark, lambda rng: {"x": next(drawn), "n_estimators": 100 + rng.randint(0, 0)}, begin, train,
                      5, 10, 1, True, None, 2)
    # Ten trials of 5 rounds, four of 15, two of 45, the last to its own end.
    assert [len(trained[x]) for x in range(10)] == [4, 3, 2, 2, 1, 1, 1, 1, 1, 1]
    assert trained[0] == [5, 15, 45, 100] and out.best["x"] == 0 and not any(s.open for s in states)
    rows = out.table.collect()
    assert [r["trained_to"] for r in rows] == [100, 45, 15, 15] + [5] * 6
    assert out.value == min(r["value"] for r in rows)


def test_forest_votes_add_up(package, report):
    fit = plan.fit_forest(package, report, trials=3, fixed={"n_estimators": 12, "max_depth": 4})
    rows = fit.info["tuning"].table.collect()
    assert sorted(r["trained_to"] for r in rows) == [10, 10, 12]
    assert fit.info["tuning"].value == max(r["value"] for r in rows) > 0.6


def test_search_is_seeded_and_bounded(package, report):
    small = {"n_estimators": 3, "num_leaves": 7, "max_depth": 3}
    fit = plan.fit_boosted(package, report, trials=2, fixed=small)
    tuning = fit.info["tuning"]
    assert tuning.trials == 2 and tuning.table.count() == 2
    assert tuning.value == min(r["value"] for r in tuning.table.collect())
    import random

    drawn = plan.boosted_trial(random.Random(1))
    assert drawn == plan.boosted_trial(random.Random(1))
    assert 0.01 <= drawn["learning_rate"] <= 0.2 and 31 <= drawn["num_leaves"] <= 255
    assert plan.depth_for(63) == 6 and plan.depth_for(255, 4) == 4


def test_yearly_run_writes_its_tables(clean, spark, tmp_path):
    summary = plan.model_years(
        clean, [2019], KEYS, str(tmp_path), target_rows=600,
        boosted={"fixed": {"n_estimators": 3, "num_leaves": 7}},
        forest={"fixed": {"n_estimators": 3, "max_depth": 4}},
    ).collect()
    assert len(summary) == 1 and len(summary[0]) == 27 and summary[0]["sample_rows"] == 600
    table = spark.read.option("header", True).csv(f"{tmp_path}/year_2019/regression_model_comparison")
    assert table.count() == 3


def test_registered_yearly_run_takes_every_year(spark, monkeypatch):
    from meterwise.catalog import modelling

    taken = []
    monkeypatch.setattr(modelling.plan, "model_years", lambda rows, years, *_, **__: taken.extend(years) or rows)
    rows = modelling.model_years(spark, "/root/testdata/sf0.001")
    every = {r["year"] for r in rows.select("year").distinct().collect()}
    assert len(every) > 2 and taken == sorted(every)
