"""Tip models: data package, preparation, fits, tuning, comparison and yearly runs."""

import math
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.functions.numeric import clipped_log1p
from meterwise.operators import features, metrics, outliers, profiling, sampling
from meterwise.operators.moments import moment_matrix
from meterwise.plans import boosting
from meterwise.session import hand_over, settle
from meterwise.sources import results, trips

Y = "y"


# --- data package --------------------------------------------------------------
@dataclass
class Package:
    """Train and valid rows with keys, ``y`` and numeric features, and how they were made."""

    train: DataFrame
    valid: DataFrame
    keys: list[str]
    columns: list[str]
    target: str
    bounds: outliers.Bounds
    method: str
    outlier_summary: DataFrame


def build_dataset(
    clean: DataFrame,
    keys: Sequence[str],
    year: int | None = None,
    target: str = "tip_amount",
    target_rows: int | None = None,
    seed: int = C.SEED,
    outlier_columns: Sequence[str] = C.MODEL_OUTLIER_COLUMNS,
    method: str = "winsor",
    lower: float = C.WINSOR_QUANTILES[0],
    upper: float = C.WINSOR_QUANTILES[1],
    valid_fraction: float = 0.2,
) -> Package:
    """Encode, split by tipped or not, and bound outliers learned on train only.

    All rows are used; ``target_rows`` asks for a sample of that size instead.
    """
    keys = list(keys)
    rows = sampling.cap_rows(trips.pick(clean, year), target_rows, keys, seed)
    sample = hand_over(features.model_sample(rows, keys), "sample")
    encoded, _ = features.encode_model_features(sample)
    matrix = features.build_model_matrix(encoded, target, keys)
    columns = features.feature_columns(matrix, keys)
    marked = matrix.withColumn("_tipped", (F.col(Y) > 0).cast("int"))
    parts = hand_over(
        sampling.split_rows(marked, keys, valid_fraction, seed, ["_tipped"]).drop("_tipped"), "parts"
    )
    train, valid = parts.where("NOT is_valid"), parts.where("is_valid")
    bounded = [c for c in outlier_columns if c in columns]
    bounds = (
        outliers.as_bounds(outliers.fit_bounds(train, bounded, lower, upper)) if bounded else {}
    )
    summaries = [
        outliers.bounds_summary(part, bounds, method).select(F.struct("*").alias(name))
        for name, part in (("train", train), ("valid", valid))
    ]
    summary = summaries[0].select(
        F.lit(method).alias("method"),
        F.array(*[F.lit(c) for c in bounded]).alias("columns_used"),
        "train",
        summaries[1].scalar().alias("valid"),
    )
    train, valid = (
        outliers.apply_bounds(p, bounds, method).select(*keys, Y, *[f"`{c}`" for c in columns])
        for p in (train, valid)
    )
    return Package(train, valid, keys, columns, target, bounds, method, summary)


# --- preparation ---------------------------------------------------------------
@dataclass
class PrepReport:
    """Diagnostics of the train rows; the tables have at most one row per feature or pair."""

    target: DataFrame
    groups: dict[str, list[str]]
    group_table: DataFrame
    correlations: DataFrame
    skews: DataFrame
    pairs: DataFrame
    low_variance: DataFrame
    scaling: DataFrame
    moments: DataFrame

    def log_columns(self) -> list[str]:
        chosen = self.skews.where("suggested_transform = 'log1p'").select("feature")
        return [r["feature"] for r in chosen.collect()]

    def strengths(self) -> dict[str, float]:
        rows = self.correlations.select("feature", "abs_spearman").collect()
        return {r["feature"]: r["abs_spearman"] for r in rows}

    def counts(self) -> DataFrame:
        return profiling.profile_counts(
            self.group_table, self.pairs, self.low_variance, self.scaling
        )


def prep_checks(
    train: DataFrame,
    columns: Sequence[str],
    target: str = "tip_amount",
    corr_cutoff: float = C.CORR_CUTOFF,
    skew_cutoff: float = C.SKEW_CUTOFF,
) -> PrepReport:
    """All diagnostics of the train rows; each table is one job, however many features.

    Correlations and variances all follow from one moment matrix; kinds, shapes, quantiles and
    ranks from one table of counted values.
    """
    table_of_moments = settle(moment_matrix(train, [*columns, Y]))
    counts = profiling.ranked_counts(train, columns, Y)
    table = settle(profiling.feature_groups(train, columns, counts=counts))
    groups = profiling.groups_by_kind(table)
    continuous = groups["continuous"]
    skews = settle(profiling.skew_profile(train, continuous, skew_cutoff, counts))
    return PrepReport(
        target=profiling.target_profile(train, Y, target),
        groups=groups,
        group_table=table,
        correlations=settle(
            profiling.feature_target_correlations(train, columns, Y, table_of_moments, counts)
        ),
        skews=skews,
        pairs=settle(
            profiling.high_correlations(
                train, continuous + groups["low_card"], corr_cutoff, table_of_moments
            )
        ),
        low_variance=profiling.low_variance(train, columns, table_of_moments),
        scaling=profiling.scaling_advice(train, continuous, skews, counts),
        moments=table_of_moments,
    )


def weaker_of_pairs(
    pairs: Sequence[tuple[str, str, float]],
    strength: dict[str, float | None],
    variance: dict[str, float | None],
) -> list[str]:
    """Features to drop, one per correlated pair, walking the pairs from the strongest.

    A pair with a feature already dropped is skipped. The feature with the weaker target
    correlation goes, else the one with the smaller variance, else the later name. The walk is
    sequential by definition and runs over the few pairs of the profile.
    """
    dropped: list[str] = []
    for a, b, _ in pairs:
        if a in dropped or b in dropped:
            continue
        for table in (strength, variance):
            left, right = table.get(a), table.get(b)
            if left is not None and right is not None:
                dropped.append(a if left < right else b)
                break
        else:
            dropped.append(max(a, b))
    return sorted(dropped)


@dataclass
class Prepared:
    train: DataFrame
    valid: DataFrame
    columns: list[str]
    info: dict[str, object] = field(default_factory=dict)


def prepare(
    train: DataFrame,
    valid: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    report: PrepReport,
    log: bool = False,
    scale: bool = False,
    drop_near_zero: bool = False,
    drop_correlated: bool = False,
    near_zero: float = C.NEAR_ZERO_VARIANCE,
) -> Prepared:
    """Log, scale, then prune constant, near-zero and correlated features; fits see train only."""
    columns = list(columns)
    log_columns = [c for c in report.log_columns() if c in columns] if log else []
    scale_columns = [c for c in report.groups["continuous"] if c in columns] if scale else []

    def transform(df):
        logged = df.withColumns({c: clipped_log1p(F.col(c)) for c in log_columns})
        return outliers.scale(logged, scaler) if scaler else logged

    scaler: dict[str, tuple[float, float]] = {}
    if scale_columns:
        scaler = outliers.as_scaler(outliers.fit_scaler(transform(train), scale_columns))
    train, valid = transform(train), transform(valid)
    spreads = profiling.column_spreads(train, columns).collect()
    constant = [r["feature"] for r in spreads if r["constant"]]
    columns = [c for c in columns if c not in constant]
    variance = {r["feature"]: r["variance"] for r in spreads}
    tiny = [c for c in columns if drop_near_zero and 0 < variance[c] <= near_zero]
    columns = [c for c in columns if c not in tiny]
    correlated: list[str] = []
    if drop_correlated:
        pairs = [
            (r["feature_1"], r["feature_2"], r["abs_corr"])
            for r in report.pairs.collect()
            if r["feature_1"] in columns and r["feature_2"] in columns
        ]
        correlated = weaker_of_pairs(pairs, report.strengths(), variance)
        columns = [c for c in columns if c not in correlated]
    wanted = [*keys, Y, *[f"`{c}`" for c in columns]]
    info = {
        "log_cols": log_columns,
        "scale_cols": scale_columns,
        "constant_cols_dropped": constant,
        "near_zero_cols_dropped": tiny,
        "high_corr_cols_dropped": correlated,
        "n_features_out": len(columns),
    }
    return Prepared(train.select(*wanted), valid.select(*wanted), columns, info)


# --- fits ----------------------------------------------------------------------
@dataclass
class Fit:
    name: str
    predictions: DataFrame
    metrics: DataFrame
    seconds: float = 0.0
    table: DataFrame | None = None
    intercept: float | None = None
    model: object = None
    info: dict[str, object] = field(default_factory=dict)


def _assembled(df: DataFrame, columns: Sequence[str], label) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        df.select(
            *[c for c in df.columns if c not in columns],
            *[F.col(f"`{c}`").cast("double").alias(c) for c in columns],
        )
    )
    return vectors.withColumn("label", label)


def _positive(df: DataFrame) -> DataFrame:
    return df.where(F.col(Y) > 0)


_TIPPED = (lambda: (F.col(Y) > 0).cast("double"))


def _regression_rows(model, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    scored = model.transform(valid)
    return scored.select(
        *keys,
        F.col("label").alias("y_true"),
        F.col("prediction").alias("y_pred"),
        (F.col("label") - F.col("prediction")).alias("residual"),
    )


def _class_rows(model, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return model.transform(valid).select(
        *keys,
        F.col("label").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability")[1].alias("y_prob"),
    )


def naive_regression(package: Package) -> Fit:
    """The train mean of positive targets predicts every positive valid row."""
    mean = _positive(package.train).agg(F.avg(Y)).scalar()
    rows = _positive(package.valid).select(
        *package.keys, F.col(Y).alias("y_true"), mean.alias("y_pred")
    )
    rows = rows.withColumn("residual", F.col("y_true") - F.col("y_pred"))
    return Fit("naive_mean_tip_regression", rows, metrics.regression_metrics(rows))


def naive_classification(package: Package) -> Fit:
    """The majority class with the train rate as probability."""
    rate = package.train.agg(F.avg((F.col(Y) > 0).cast("int"))).scalar()
    rows = package.valid.select(
        *package.keys, (F.col(Y) > 0).cast("int").alias("y_true"), rate.alias("y_prob")
    )
    rows = rows.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
    return Fit("naive_majority_tip_classifier", rows, metrics.classification_metrics(rows))


def coefficient_table(spark, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    table = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, coef double"
    )
    return table.withColumn("abs_coef", F.abs("coef")).orderBy(F.col("abs_coef").desc(), "feature")


def logistic_table(spark, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    table = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values, strict=True)],
        "feature string, log_odds_coef double",
    )
    return table.select(
        "feature",
        "log_odds_coef",
        F.exp("log_odds_coef").alias("odds_ratio"),
        F.abs("log_odds_coef").alias("abs_log_odds_coef"),
    ).orderBy(F.col("abs_log_odds_coef").desc(), "feature")


def importance_table(spark, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    table = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values, strict=True)],
        "feature string, importance double",
    )
    return table.orderBy(F.col("importance").desc(), "feature")


def _timed_fit(estimator, train: DataFrame):
    """Spark's estimators cache the form of the rows that they pass over; a second copy is not made."""
    started = time.perf_counter()
    return estimator.fit(train), time.perf_counter() - started


def fit_linear(package: Package, report: PrepReport) -> Fit:
    """Least squares on tipped rows, unscaled, without near-constant or redundant features."""
    prep = prepare(
        _positive(package.train), _positive(package.valid), package.keys, package.columns, report,
        drop_near_zero=True, drop_correlated=True,
    )
    train = _assembled(prep.train, prep.columns, F.col(Y))
    model, seconds = _timed_fit(LinearRegression(regParam=0.0, solver="normal"), train)
    rows = hand_over(
        _regression_rows(model, _assembled(prep.valid, prep.columns, F.col(Y)), package.keys), "scored"
    )
    table = coefficient_table(rows.sparkSession, prep.columns, model.coefficients)
    return Fit("simple_linear_regression", rows, metrics.regression_metrics(rows), seconds, table,
               float(model.intercept), model, prep.info)


def fit_logistic(package: Package, report: PrepReport) -> Fit:
    """Tipped or not; the penalty equals C = 1 on the summed loss."""
    prep = prepare(
        package.train, package.valid, package.keys, package.columns, report,
        drop_near_zero=True, drop_correlated=True,
    )
    train = _assembled(prep.train, prep.columns, _TIPPED())
    estimator = LogisticRegression(
        regParam=1.0 / max(package.train.count(), 1),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=500,
    )
    model, seconds = _timed_fit(estimator, train)
    rows = hand_over(
        _class_rows(model, _assembled(prep.valid, prep.columns, _TIPPED()), package.keys), "scored"
    )
    table = logistic_table(rows.sparkSession, prep.columns, model.coefficients)
    return Fit("simple_logistic_regression", rows, metrics.classification_metrics(rows), seconds,
               table, float(model.intercept), model, prep.info)


def depth_for(leaves: int, max_depth: int | None = None) -> int:
    """Level-wise depth that allows about as many leaves as a leaf-wise limit."""
    depth = max(1, math.ceil(math.log2(leaves)))
    return min(depth, max_depth) if max_depth else depth


# Untuned boosted trees and forest.
BOOSTED_DEFAULTS = {
    "learning_rate": 0.05, "n_estimators": 500, "num_leaves": 63, "max_depth": None,
    "min_child_samples": 20, "subsample": 0.8, "colsample": 0.8,
}
FOREST_DEFAULTS = {
    "n_estimators": 400, "max_depth": None, "min_samples_leaf": 5, "max_features": "sqrt",
    "class_weight": "balanced", "criterion": "gini",
}


BOOSTING_PATIENCE = 75
TUNING_PATIENCE = 50


def boosted_tree(params: dict, seed: int) -> RandomForestRegressor:
    """The tree of one boosting round: all rows or a part of them, drawn without replacement."""
    tree = RandomForestRegressor(
        featuresCol="features", labelCol="label", seed=seed, numTrees=1, bootstrap=False,
        maxDepth=min(30, depth_for(params["num_leaves"], params.get("max_depth"))),
        minInstancesPerNode=params["min_child_samples"], subsamplingRate=params["subsample"],
        featureSubsetStrategy=str(float(params["colsample"])),
    )
    return tree.setFeatureSubsetStrategy("all") if params["colsample"] >= 1 else tree


def best_round(losses: Sequence[float], patience: int) -> int:
    """Number of rounds with the lowest loss before ``patience`` rounds bring no lower one."""
    best = 0
    for at, loss in enumerate(losses):
        if loss < losses[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def fit_boosted_to_best(
    params: dict, seed: int, marked: DataFrame, patience: int, begun: boosting.Staged | None = None
) -> boosting.Staged:
    """Boosting that stops on the rows marked ``is_valid``, which it does not learn from.

    At most ``patience`` rounds beyond the best one are fitted, and none twice. ``begun`` is a fit of
    the same parameters, seed and rows, whose rounds are taken over.
    """
    state = boosting.start(marked, params["learning_rate"])
    if begun:
        state.trees, state.losses = list(begun.trees), list(begun.losses)
    return boosting.advance(state, boosted_tree(params, seed), params["n_estimators"], patience, seed)


def forest_estimator(params: dict, seed: int) -> RandomForestClassifier:
    """No depth limit becomes Spark's limit of 30; log loss is the entropy criterion."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", seed=seed, numTrees=params["n_estimators"],
        maxDepth=min(30, params["max_depth"] or 30),
        minInstancesPerNode=params["min_samples_leaf"],
        featureSubsetStrategy=params["max_features"] or "all",
        impurity="gini" if params["criterion"] == "gini" else "entropy",
    )
    return forest.setWeightCol("weight") if params["class_weight"] else forest


def balanced_weight(df: DataFrame) -> DataFrame:
    """rows / (2 x rows of the class), from one aggregation."""
    n = df.agg(F.count(F.lit(1)).alias("all"), F.sum("label").alias("ones")).first()
    ones = n["ones"] or 0.0
    one = n["all"] / (2.0 * ones) if ones else 1.0
    zero = n["all"] / (2.0 * (n["all"] - ones)) if n["all"] > ones else 1.0
    return df.withColumn("weight", F.when(F.col("label") == 1, one).otherwise(zero))


def _log_uniform(rng: random.Random, low: float, high: float) -> float:
    return math.exp(rng.uniform(math.log(low), math.log(high)))


def boosted_trial(rng: random.Random) -> dict:
    return {
        "learning_rate": _log_uniform(rng, 0.01, 0.2),
        "n_estimators": rng.randint(300, 1400),
        "num_leaves": rng.randint(31, 255),
        "max_depth": rng.randint(4, 16),
        "min_child_samples": rng.randint(20, 300),
        "subsample": rng.uniform(0.6, 1.0),
        "colsample": rng.uniform(0.6, 1.0),
    }


def forest_trial(rng: random.Random) -> dict:
    return {
        "n_estimators": rng.randint(200, 900),
        "max_depth": rng.choice([None, 8, 12, 16, 24, 32]),
        "min_samples_leaf": rng.randint(1, 20),
        "max_features": rng.choice(["sqrt", "log2", None]),
        "class_weight": rng.choice(["balanced", None]),
        "criterion": rng.choice(["gini", "entropy", "log_loss"]),
    }


@dataclass
class Tuning:
    best: dict
    value: float
    trials: int
    seconds: float
    table: DataFrame
    state: object = None


#: A rung trains its trials to so many rounds or trees times the rung before, and passes on one
#: trial in as many.
HALVING = 3
FIRST_ROUNDS = 25
FIRST_TREES = 10


def _halve(
    spark,
    draw: Callable[[random.Random], dict],
    begin: Callable[[dict], object],
    train: Callable[[dict, object, int], float],
    first: int,
    trials: int,
    seed: int,
    lowest: bool,
    fixed: dict | None,
    parallelism: int,
) -> Tuning:
    """Seeded random search with successive halving.

    All trials are trained to a small size; the better third goes on to three times that size,
    from the trees it has, until one is left, which is trained to its end. A trial's value is its
    best so far, so the last one's is the best of all. Trials of a rung are independent Spark
    jobs submitted a few at a time.
    """
    if trials <= 0:
        raise ValueError(f"trials must be positive (got {trials})")
    rng = random.Random(seed)
    drawn = [{**draw(rng), **(fixed or {})} for _ in range(trials)]
    started = time.perf_counter()
    states = [begin(params) for params in drawn]
    sizes, values = [0] * trials, [0.0] * trials
    left, size = list(range(trials)), first
    better = (lambda i: (values[i], i)) if lowest else (lambda i: (-values[i], i))
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        while True:
            goal = {i: drawn[i]["n_estimators"] if len(left) == 1 else min(size, drawn[i]["n_estimators"]) for i in left}
            for i, value in zip(left, pool.map(lambda i: train(drawn[i], states[i], goal[i]), left)):
                values[i], sizes[i] = value, goal[i]
            if len(left) == 1:
                break
            kept = sorted(left, key=better)[: math.ceil(len(left) / HALVING)]
            for i in set(left) - set(kept):
                states[i].close()
            left, size = kept, size * HALVING
    states[left[0]].close()
    seconds = time.perf_counter() - started
    table = spark.createDataFrame(
        [(i, str(p), n, float(v)) for i, (p, n, v) in enumerate(zip(drawn, sizes, values, strict=True))],
        "trial int, params string, trained_to int, value double",
    )
    return Tuning(drawn[left[0]], float(values[left[0]]), trials, seconds, table, states[left[0]])


def tune_boosted(
    train: DataFrame,
    keys: Sequence[str],
    trials: int = 40,
    seed: int = C.SEED,
    inner_fraction: float = 0.2,
    fixed: dict | None = None,
    parallelism: int = 4,
) -> Tuning:
    """Lowest inner RMSE; the inner hold-out also picks the round. ``train`` is assembled."""
    inner = sampling.split_rows(train, keys, inner_fraction, seed + 1)
    inner = inner.select("features", "label", "is_valid").persist(StorageLevel.MEMORY_AND_DISK)

    def grow(params, state, rounds):
        boosting.advance(state, boosted_tree(params, seed), rounds, TUNING_PATIENCE, seed)
        return math.sqrt(min(state.losses))

    out = _halve(
        train.sparkSession, boosted_trial, lambda p: boosting.start(inner, p["learning_rate"]), grow,
        FIRST_ROUNDS, trials, seed, True, fixed, parallelism,
    )
    inner.unpersist()
    return out


@dataclass
class _Votes:
    """Hold-out rows with the summed probability of the trees fitted so far."""

    rows: DataFrame
    trees: int = 0
    value: float | None = None

    def close(self) -> None:
        self.rows.unpersist()


def tune_forest(
    train: DataFrame,
    keys: Sequence[str],
    trials: int = 30,
    seed: int = C.SEED,
    inner_fraction: float = 0.2,
    max_rows: int | None = 150_000,
    fixed: dict | None = None,
    parallelism: int = 4,
) -> Tuning:
    """Highest inner AUC on a stratified hold-out of a stratified row cap.

    A trial that goes on fits only the trees that it lacks and adds their votes. As a trial's
    value counts its best AUC so far.
    """
    capped = sampling.cap_stratified(train, max_rows, keys, "label", seed)
    inner = sampling.split_rows(capped, keys, inner_fraction, seed + 1, ["label"])
    inner = inner.select("features", "label", "is_valid").persist(StorageLevel.MEMORY_AND_DISK)
    fitting = balanced_weight(inner.where("NOT is_valid")).persist(StorageLevel.MEMORY_AND_DISK)
    held = inner.where("is_valid").select("features", F.col("label").cast("int").alias("y_true"), F.lit(0.0).alias("votes"))

    def grow(params, state, trees):
        fresh = trees - state.trees
        if fresh > 0:
            model = forest_estimator({**params, "n_estimators": fresh}, seed + state.trees).fit(fitting)
            share = fresh * vector_to_array("probability")[1]
            rows = model.transform(state.rows).select("features", "y_true", (F.col("votes") + share).alias("votes"))
            rows = settle(rows)
            state.rows, state.trees = rows, trees
            scored = rows.select("y_true", (F.col("votes") / trees).alias("y_prob"))
            auc = metrics.ranking_metrics(scored).first()["roc_auc"]
            auc = 0.5 if auc is None else auc
            state.value = auc if state.value is None else max(auc, state.value)
        return state.value

    out = _halve(train.sparkSession, forest_trial, lambda p: _Votes(held), grow, FIRST_TREES, trials, seed, False,
                 fixed, parallelism)
    inner.unpersist()
    fitting.unpersist()
    return out


def fit_boosted(
    package: Package,
    report: PrepReport,
    seed: int = C.SEED,
    trials: int = 0,
    fixed: dict | None = None,
    patience: int = BOOSTING_PATIENCE,
) -> Fit:
    """Boosted trees on tipped rows, logged and scaled; an inner hold-out picks the round."""
    prep = prepare(
        _positive(package.train), _positive(package.valid), package.keys, package.columns, report,
        log=True, scale=True,
    )
    train = _assembled(prep.train, prep.columns, F.col(Y))
    tuning = tune_boosted(train, package.keys, trials, seed, fixed=fixed) if trials else None
    params = tuning.best if tuning else {**BOOSTED_DEFAULTS, **(fixed or {})}
    marked = sampling.split_rows(train, package.keys, 0.2, seed + 1)
    marked = marked.select("features", "label", "is_valid").persist(StorageLevel.MEMORY_AND_DISK)
    started = time.perf_counter()
    # The search marks the same rows, so its best trial is the begin of this fit.
    staged = fit_boosted_to_best(params, seed, marked, patience, tuning and tuning.state)
    model = staged.model(best_round(staged.losses, patience))
    seconds = time.perf_counter() - started
    staged.close()
    marked.unpersist()
    rows = hand_over(
        _regression_rows(model, _assembled(prep.valid, prep.columns, F.col(Y)), package.keys), "scored"
    )
    plain = [c.replace(" ", "_") for c in prep.columns]
    found = model.featureImportances.toArray().tolist()
    # The joined trees know features up to the last one they use.
    table = importance_table(rows.sparkSession, plain, found + [0.0] * (len(plain) - len(found)))
    info = {**prep.info, "params": params, "tuning": tuning, "rounds_fitted": len(staged.trees)}
    return Fit("optimized_boosted_regression", rows, metrics.regression_metrics(rows), seconds,
               table, None, model, info)


def fit_forest(
    package: Package,
    report: PrepReport,
    seed: int = C.SEED,
    trials: int = 0,
    fixed: dict | None = None,
    max_tune_rows: int | None = 150_000,
) -> Fit:
    """Random forest for tipped or not, logged features, class-balanced weights."""
    prep = prepare(package.train, package.valid, package.keys, package.columns, report, log=True)
    train = _assembled(prep.train, prep.columns, _TIPPED())
    tuning = (
        tune_forest(train, package.keys, trials, seed, max_rows=max_tune_rows, fixed=fixed)
        if trials
        else None
    )
    params = tuning.best if tuning else {**FOREST_DEFAULTS, **(fixed or {})}
    model, seconds = _timed_fit(forest_estimator(params, seed), balanced_weight(train))
    rows = hand_over(
        _class_rows(model, _assembled(prep.valid, prep.columns, _TIPPED()), package.keys), "scored"
    )
    table = importance_table(rows.sparkSession, prep.columns, model.featureImportances.toArray())
    info = {**prep.info, "params": params, "tuning": tuning}
    return Fit("optimized_random_forest_classifier", rows, metrics.classification_metrics(rows),
               seconds, table, None, model, info)


# --- suite and reports -----------------------------------------------------------
REGRESSION_COLUMNS = ["model", "rmse", "mae", "r2", "fit_seconds"]
CLASS_COLUMNS = ["model", "roc_auc", "avg_precision", "f1", "precision", "recall", "accuracy",
                 "fit_seconds"]


def metric_row(fit: Fit) -> DataFrame:
    return fit.metrics.withColumns(
        {"model": F.lit(fit.name), "fit_seconds": F.lit(float(fit.seconds))}
    )


def compare_regressions(rows: Sequence[DataFrame]) -> DataFrame:
    table = rows[0].select(*REGRESSION_COLUMNS)
    for row in rows[1:]:
        table = table.unionByName(row.select(*REGRESSION_COLUMNS))
    return table.orderBy("rmse", "model")


def compare_classifiers(rows: Sequence[DataFrame]) -> DataFrame:
    table = rows[0].select(*CLASS_COLUMNS)
    for row in rows[1:]:
        table = table.unionByName(row.select(*CLASS_COLUMNS))
    return table.orderBy(F.col("roc_auc").desc(), "model")


def winner(table: DataFrame, metric: str, lowest: bool) -> DataFrame:
    order = F.col(metric).asc_nulls_last() if lowest else F.col(metric).desc_nulls_last()
    return table.orderBy(order, "model").limit(1)


def top_rows(table: DataFrame, column: str, n: int, largest: bool = True) -> DataFrame:
    order = F.col(column).desc() if largest else F.col(column).asc()
    return table.orderBy(order, "feature").limit(n)


def baseline_table(regression: DataFrame, classification: DataFrame) -> DataFrame:
    """Both naive models stacked; columns one of them lacks are null."""
    return regression.unionByName(classification, allowMissingColumns=True)


@dataclass
class Suite:
    fits: dict[str, Fit]
    regression_table: DataFrame
    classification_table: DataFrame


def run_suite(
    package: Package,
    report: PrepReport | None = None,
    seed: int = C.SEED,
    boosted: dict | None = None,
    forest: dict | None = None,
) -> Suite:
    """Two naive models, linear, boosted, logistic and forest, with their comparison tables.

    ``boosted`` and ``forest`` take ``trials`` and ``fixed`` for the two tuned fits.
    """
    report = report or prep_checks(package.train, package.columns, package.target)
    fits = {
        "naive_regression": naive_regression(package),
        "simple_linear": fit_linear(package, report),
        "optimized_regression": fit_boosted(package, report, seed, **(boosted or {})),
        "naive_classification": naive_classification(package),
        "simple_logistic": fit_logistic(package, report),
        "optimized_random_forest": fit_forest(package, report, seed, **(forest or {})),
    }
    names = list(fits)
    rows = {n: metric_row(f) for n, f in fits.items()}
    return Suite(
        fits,
        settle(compare_regressions([rows[n] for n in names[:3]])).orderBy("rmse", "model"),
        settle(compare_classifiers([rows[n] for n in names[3:]])).orderBy(
            F.col("roc_auc").desc(), "model"
        ),
    )


def interpretation(suite: Suite, n: int = 10) -> dict[str, DataFrame]:
    """Strongest coefficients both ways, importances, and the baseline probability."""
    linear, logistic = suite.fits["simple_linear"], suite.fits["simple_logistic"]
    spark = suite.regression_table.sparkSession
    base = spark.createDataFrame(
        [(linear.intercept, logistic.intercept)],
        "linear_intercept double, logistic_intercept_log_odds double",
    ).withColumn(
        "logistic_baseline_tip_prob", 1.0 / (1.0 + F.exp(-F.col("logistic_intercept_log_odds")))
    )
    coefs = linear.table.select("feature", "coef")
    odds = logistic.table.select("feature", "log_odds_coef", "odds_ratio")
    return {
        "linear_positive": top_rows(coefs, "coef", n),
        "linear_negative": top_rows(coefs, "coef", n, largest=False),
        "logistic_positive": top_rows(odds, "log_odds_coef", n),
        "logistic_negative": top_rows(odds, "log_odds_coef", n, largest=False),
        "boosted_importance_top": top_rows(
            suite.fits["optimized_regression"].table, "importance", n
        ),
        "forest_importance_top": top_rows(
            suite.fits["optimized_random_forest"].table, "importance", n
        ),
        "baseline": base,
    }


def year_summary(year: int | None, package: Package, suite: Suite) -> DataFrame:
    """One row: sizes, tip shares, winners and their gain over the naive models."""
    spark = package.train.sparkSession
    shares = {
        name: metrics.tip_share(part, [], Y).first()
        for name, part in (("train", package.train), ("valid", package.valid))
    }
    reg = winner(suite.regression_table, "rmse", True).first()
    cls = winner(suite.classification_table, "roc_auc", False).first()
    naive_reg = suite.regression_table.where(
        F.col("model") == suite.fits["naive_regression"].name).first()
    naive_cls = suite.classification_table.where(
        F.col("model") == suite.fits["naive_classification"].name).first()
    removed = package.outlier_summary.select("train.rows_removed", "valid.rows_removed").first()
    before = package.outlier_summary.select(
        F.col("train.rows_before") + F.col("valid.rows_before")).first()[0]

    def tuning(fit):
        return suite.fits[fit].info.get("tuning")

    boosted, forest = tuning("optimized_regression"), tuning("optimized_random_forest")
    row = {
        "year": 0,
        "target": package.target,
        "sample_rows": before,
        "train_rows": shares["train"]["rows"],
        "valid_rows": shares["valid"]["rows"],
        "train_tip_share_pct": shares["train"]["tip_share_pct"],
        "valid_tip_share_pct": shares["valid"]["tip_share_pct"],
        "outlier_method": package.method,
        "outlier_cols_used_n": len(package.bounds),
        "outlier_train_rows_removed": removed[0],
        "outlier_valid_rows_removed": removed[1],
        "best_reg_model": reg["model"],
        "best_reg_rmse": reg["rmse"],
        "best_reg_mae": reg["mae"],
        "best_reg_r2": reg["r2"],
        "naive_reg_rmse": naive_reg["rmse"],
        "best_reg_rmse_gain_vs_naive": naive_reg["rmse"] - reg["rmse"],
        "best_cls_model": cls["model"],
        "best_cls_roc_auc": cls["roc_auc"],
        "best_cls_avg_precision": cls["avg_precision"],
        "best_cls_f1": cls["f1"],
        "naive_cls_roc_auc": naive_cls["roc_auc"],
        "best_cls_auc_gain_vs_naive": cls["roc_auc"] - naive_cls["roc_auc"],
        "opt_boosted_tuned": boosted is not None,
        "opt_boosted_trials": boosted.trials if boosted else 0,
        "opt_rf_tuned": forest is not None,
        "opt_rf_trials": forest.trials if forest else 0,
    }
    # A package of several years has no year.
    return spark.createDataFrame([row]).select(*row).withColumn("year", F.lit(year).cast("bigint"))


def export_year(package: Package, suite: Suite, summary: DataFrame, folder: str, n: int = 10):
    """Comparison, coefficient, prediction, interpretation and summary tables as CSV."""
    naive = [metric_row(suite.fits[f]) for f in ("naive_regression", "naive_classification")]
    frames = {
        "regression_model_comparison": suite.regression_table,
        "classification_model_comparison": suite.classification_table,
        "baseline_model_summary": baseline_table(
            naive[0].select(*REGRESSION_COLUMNS), naive[1].select(*CLASS_COLUMNS)
        ),
        "outlier_summary_flat": results.flatten(
            package.outlier_summary.withColumn("columns_used", F.array_join("columns_used", ","))
        ),
        "year_summary": summary,
        **{f"interpretation_{k}": v for k, v in interpretation(suite, n).items()},
    }
    for name, fit in suite.fits.items():
        frames[f"{name}_predictions"] = fit.predictions.drop(*package.keys)
        if fit.table is not None:
            frames[f"{name}_table"] = fit.table
    for name, frame in frames.items():
        results.write_csv(frame, f"{folder}/{name}")


def model_years(
    clean: DataFrame,
    years: Sequence[int],
    keys: Sequence[str],
    folder: str | None = None,
    seed: int = C.SEED,
    boosted: dict | None = None,
    forest: dict | None = None,
    parallelism: int = 4,
    **dataset,
) -> DataFrame:
    """One suite per year and the stacked year summaries; ``parallelism`` years run at a time."""

    def one(year: int) -> DataFrame:
        package = build_dataset(clean, keys, year, seed=seed, **dataset)
        suite = run_suite(package, None, seed, boosted, forest)
        summary = year_summary(year, package, suite)
        if folder:
            export_year(package, suite, summary, f"{folder}/year_{year}")
        return summary

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return results.stack_years(list(pool.map(one, sorted(years))))
