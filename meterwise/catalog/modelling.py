"""Model queries. Metrics and preparation have SQL; fitted models are checked by rows."""

from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import _declared_once, clean
from meterwise.catalog.features import FEATURES, MATRIX, matrix
from meterwise.catalog.profiling import CONTINUOUS, LOW_CARD, union
from meterwise.catalog.zones import rounded
from meterwise.operators import metrics, profiling
from meterwise.plans import models as plan
from meterwise.sources import results

KEYS = ["trip_key"]
# Small forests and few boosting rounds; the operators are the same at any size.
BOOSTED = {"n_estimators": 50, "num_leaves": 31, "learning_rate": 0.1}
FOREST = {"n_estimators": 15, "max_depth": 8}


@_declared_once
def package(spark, sf):
    return plan.build_dataset(clean(spark, sf), KEYS)


@_declared_once
def report(spark, sf):
    data = package(spark, sf)
    return plan.prep_checks(data.train, data.columns, data.target)


BOUNDED = C.MODEL_OUTLIER_COLUMNS
DATASET = MATRIX + """,
parts AS (
  SELECT *, row_number() OVER (PARTITION BY y > 0 ORDER BY md5(concat_ws('|', trip_key, '42')))
    <= ceil(count(*) OVER (PARTITION BY y > 0) * 0.2e0) AS is_valid FROM matrix
),
limits AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.003) AS lo_{c}, quantile_cont({c}, 0.997) AS hi_{c}" for c in BOUNDED
) + """ FROM parts WHERE NOT is_valid),
ready AS (
  SELECT trip_key, is_valid, y, """ + ", ".join(
    f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" if c in BOUNDED else f'"{c}"' for c in FEATURES
) + """ FROM parts, limits
),
train AS (SELECT * FROM ready WHERE NOT is_valid),
held_out AS (SELECT * FROM ready WHERE is_valid)"""

def _both_parts(data):
    train = data.train.withColumn("is_valid", F.lit(False))
    return train.union(data.valid.withColumn("is_valid", F.lit(True)))


@query(
    "h25_dataset_builder",
    S.from_clean(
        "SELECT trip_key, is_valid, y, " + ", ".join(
            f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in FEATURES
        ) + " FROM ready",
        DATASET,
    ),
)
def dataset_builder(spark, sf):
    data = plan.build_dataset(clean(spark, sf), KEYS)
    shown = [F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) for c in data.columns]
    return _both_parts(data).select("trip_key", "is_valid", "y", *shown)


@query(
    "h25_outlier_summary",
    S.from_clean(
        "SELECT 'winsor' AS method, " + ", ".join(
            f"""'winsor' AS {p}_method, count(*) FILTER ({cond}) AS {p}_rows_before,
count(*) FILTER ({cond}) AS {p}_rows_after, 0 AS {p}_rows_removed, 0e0 AS {p}_rows_removed_pct,
""" + " + ".join(
                f"count(*) FILTER ({cond} AND ({c} < lo_{c} OR {c} > hi_{c}))" for c in BOUNDED
            ) + f" AS {p}_cells_clipped"
            for p, cond in (("train", "NOT is_valid"), ("valid", "is_valid"))
        ) + " FROM parts, limits",
        DATASET,
    ),
)
def outlier_summary(spark, sf):
    return results.flatten(package(spark, sf).outlier_summary.drop("columns_used"))


@query(
    "d27_tip_share_by_split",
    S.from_clean(
        """SELECT is_valid, count(*) AS rows,
round(avg(CAST(y > 0 AS INT)) * 100, 6) AS tip_share_pct FROM ready GROUP BY is_valid""",
        DATASET,
    ),
)
def tip_share_by_split(spark, sf):
    out = metrics.tip_share(_both_parts(package(spark, sf)), ["is_valid"])
    return rounded(out, "tip_share_pct")


@query(
    "h01_naive_regression",
    S.from_clean(
        """SELECT trip_key, y AS y_true,
round((SELECT avg(y) FROM train WHERE y > 0), 9) AS y_pred,
round(y - (SELECT avg(y) FROM train WHERE y > 0), 9) AS residual FROM held_out WHERE y > 0""",
        DATASET,
    ),
)
def naive_regression(spark, sf):
    rows = plan.naive_regression(package(spark, sf)).predictions
    return rounded(rows, "y_pred", "residual", digits=9)


@query(
    "h02_naive_classification",
    S.from_clean(
        """SELECT trip_key, CAST(y > 0 AS INT) AS y_true, round(rate, 9) AS y_prob,
CAST(rate >= 0.5 AS INT) AS y_pred
FROM held_out, (SELECT avg(CAST(y > 0 AS INT)) AS rate FROM train)""",
        DATASET,
    ),
)
def naive_classification(spark, sf):
    return rounded(plan.naive_classification(package(spark, sf)).predictions, "y_prob", digits=9)


_LOGGED = union(
    f"SELECT '{c}' AS feature, skewness({c}) AS skew, min({c}) AS low FROM train" for c in CONTINUOUS
)


@query(
    "h03_log_columns",
    S.from_clean(
        f"SELECT feature FROM ({_LOGGED}) WHERE abs(skew) >= 1 AND low >= 0", DATASET
    ),
)
def log_columns(spark, sf):
    chosen = report(spark, sf).log_columns()
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


_PAIRED = [(a, b) for i, a in enumerate(CONTINUOUS + LOW_CARD)
           for b in (CONTINUOUS + LOW_CARD)[i + 1:]]
_STRENGTH = union(
    f"""SELECT '{c}' AS feature, (SELECT abs(corr(rx, ry)) FROM (
SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM train)) AS strength"""
    for c in CONTINUOUS + LOW_CARD
)


@query(
    "h04_correlated_drop",
    S.from_clean(
        """SELECT dropped FROM (
WITH RECURSIVE walk(place, gone) AS (
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT walk.place + 1, CASE WHEN list_contains(gone, feature_1) OR list_contains(gone, feature_2)
    THEN gone ELSE list_append(gone, loser) END
  FROM walk JOIN ordered ON ordered.place = walk.place + 1)
SELECT unnest(gone) AS dropped FROM walk WHERE place = (SELECT max(place) FROM walk))""",
        DATASET,
        "strengths AS (" + _STRENGTH + """),
correlated AS (""" + union(
            f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, abs(corr({a}, {b})) AS r FROM train"
            for a, b in _PAIRED
        ) + """),
ordered AS (
  SELECT feature_1, feature_2, row_number() OVER (ORDER BY r DESC, feature_1, feature_2) AS place,
    CASE WHEN one.strength < two.strength THEN feature_1 ELSE feature_2 END AS loser
  FROM correlated JOIN strengths one ON one.feature = feature_1
    JOIN strengths two ON two.feature = feature_2 WHERE r >= 0.4)""",
    ),
)
def correlated_drop(spark, sf):
    """Features dropped when every pair at or above 0.4 counts as correlated, with the pairs."""
    data, checks = package(spark, sf), report(spark, sf)
    columns = checks.groups["continuous"] + checks.groups["low_card"]
    pairs = profiling.high_correlations(data.train, columns, 0.4, checks.moments)
    walked = [(r["feature_1"], r["feature_2"], r["abs_corr"]) for r in pairs.collect()]
    dropped = plan.weaker_of_pairs(
        walked, checks.strengths(), profiling.variances(data.train, columns, checks.moments)
    )
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


def _transformed(c: str) -> str:
    """SQL of one continuous feature after the optional log, as the report decides it."""
    return (
        f"CASE WHEN (SELECT abs(skewness({c})) >= 1 AND min({c}) >= 0 FROM train)"
        f" THEN ln(1 + greatest({c}, 0)) ELSE {c} END"
    )


@query(
    "h05_preprocess_frame",
    S.from_clean(
        "SELECT trip_key, is_valid, y, " + ", ".join(
            f"""round((t_{c} - (SELECT avg(t_{c}) FROM logged WHERE NOT is_valid))
  / (SELECT stddev_pop(t_{c}) FROM logged WHERE NOT is_valid), 5) AS {c}""" for c in CONTINUOUS
        ) + ", passenger_count FROM logged",
        DATASET + ", logged AS (SELECT trip_key, is_valid, y, passenger_count, " + ", ".join(
            f"{_transformed(c)} AS t_{c}" for c in CONTINUOUS) + " FROM ready WHERE y > 0)",
    ),
)
def preprocess_frame(spark, sf):
    """Boosted-tree preparation: log by the report, then scaling fitted on tipped train rows."""
    data = package(spark, sf)
    positive = [p.where("y > 0") for p in (data.train, data.valid)]
    prep = plan.prepare(*positive, KEYS, data.columns, report(spark, sf), log=True, scale=True)
    train = prep.train.withColumn("is_valid", F.lit(False))
    both = train.union(prep.valid.withColumn("is_valid", F.lit(True)))
    out = both.select("trip_key", "is_valid", "y", *CONTINUOUS,
                      F.col("passenger_count").cast("int").alias("passenger_count"))
    return rounded(out, *CONTINUOUS, digits=5)


@query(
    "h06_prep_checks",
    S.from_clean(
        """SELECT count(*) AS train_rows, round(skewness(y), 6) AS target_skew,
round(kurtosis(y), 6) AS target_kurtosis, (SELECT count(*) FROM (""" + union(
            f"SELECT abs(corr({a}, {b})) AS r FROM train" for a, b in _PAIRED
        ) + """) WHERE r >= 0.9) AS high_corr_pairs, (SELECT count(*) FROM (""" + union(
            f'SELECT var_samp("{c}") AS v FROM train' for c in FEATURES
        ) + """) WHERE v <= 1e-4) AS low_variance_features FROM train""",
        DATASET,
    ),
)
def prep_checks(spark, sf):
    data = package(spark, sf)
    checks = plan.prep_checks(data.train, data.columns, data.target)
    out = checks.target.select(
        F.col("n").alias("train_rows"),
        F.col("skew").alias("target_skew"),
        F.col("kurtosis").alias("target_kurtosis"),
        checks.pairs.agg(F.count(F.lit(1))).scalar().alias("high_corr_pairs"),
        checks.low_variance.agg(F.count(F.lit(1))).scalar().alias("low_variance_features"),
    )
    return rounded(out, "target_skew", "target_kurtosis")


# --- metrics over a deterministic score ----------------------------------------
SCORES = MATRIX + """,
scores AS (
  SELECT y AS tip, fare_amount * 0.15e0 AS guess, CAST(y > 0 AS INT) AS y_true,
    floor(trip_distance / (trip_distance + 5e0) * 100e0) / 100e0 AS y_prob,
    CAST(floor(trip_distance / (trip_distance + 5e0) * 100e0) / 100e0 >= 0.5e0 AS INT) AS y_pred
  FROM matrix
)"""


def _scores(spark, sf):
    miles = F.col("trip_distance").cast("double")
    prob = F.floor(miles / (miles + 5.0) * 100.0) / 100.0
    return matrix(spark, sf).select(
        F.col("y").alias("tip"),
        (F.col("fare_amount") * 0.15).alias("guess"),
        (F.col("y") > 0).cast("int").alias("y_true"),
        prob.alias("y_prob"),
        (prob >= 0.5).cast("int").alias("y_pred"),
    )


@query(
    "h13_regression_metrics",
    S.from_clean(
        """SELECT count(*) AS rows, round(avg(abs(tip - guess)), 6) AS mae,
round(sqrt(avg((tip - guess) ** 2)), 6) AS rmse,
round(1 - sum((tip - guess) ** 2) / (var_pop(tip) * count(*)), 6) AS r2 FROM scores""",
        SCORES,
    ),
)
def regression_metrics(spark, sf):
    out = metrics.regression_metrics(_scores(spark, sf), "tip", "guess")
    return rounded(out, "mae", "rmse", "r2")


@query(
    "h14_label_metrics",
    S.from_clean(
        """SELECT round((tp + tn) / n, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9)
AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM (
  SELECT count(*) AS n, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
    count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
    count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM scores)""",
        SCORES,
    ),
)
def label_metrics(spark, sf):
    out = metrics.label_metrics(_scores(spark, sf))
    return rounded(out, "accuracy", "precision", "recall", "f1", digits=9)


@query(
    "h15_roc_auc",
    S.from_clean(
        """SELECT round((sum(place) FILTER (y_true = 1) - p * (p + 1) / 2.0) / (p * (n - p)), 9)
AS roc_auc FROM (
  SELECT y_true, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2.0
    AS place, sum(y_true) OVER () AS p, count(*) OVER () AS n FROM scores) GROUP BY p, n""",
        SCORES,
    ),
)
def roc_auc(spark, sf):
    out = metrics.ranking_metrics(_scores(spark, sf)).select("roc_auc")
    return rounded(out, "roc_auc", digits=9)


@query(
    "h16_average_precision",
    S.from_clean(
        """SELECT round(sum(pos / total * (tp / seen)), 9) AS avg_precision FROM (
  SELECT sum(y_true) AS pos, sum(sum(y_true)) OVER () AS total,
    sum(sum(y_true)) OVER (ORDER BY y_prob DESC) AS tp,
    sum(count(*)) OVER (ORDER BY y_prob DESC) AS seen FROM scores GROUP BY y_prob)""",
        SCORES,
    ),
)
def average_precision(spark, sf):
    out = metrics.ranking_metrics(_scores(spark, sf)).select("avg_precision")
    return rounded(out, "avg_precision", digits=9)


_NAIVE = DATASET + """,
known AS (SELECT avg(y) FILTER (y > 0) AS mean, avg(CAST(y > 0 AS INT)) AS rate FROM train),
reg AS (
  SELECT 'naive_mean_tip_regression' AS model, 0e0 AS fit_seconds,
    sqrt(avg((y - mean) ** 2)) AS rmse, avg(abs(y - mean)) AS mae,
    1 - sum((y - mean) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM held_out, known WHERE y > 0
),
cls AS (
  SELECT 'naive_majority_tip_classifier' AS model, 0e0 AS fit_seconds, 0.5e0 AS roc_auc,
    avg(CAST(y > 0 AS INT)) AS share, max(rate) AS rate FROM held_out, known
)"""


@query(
    "h27_baseline_table",
    S.from_clean(
        """SELECT model, fit_seconds, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
round(r2, 6) AS r2, CAST(NULL AS DOUBLE) AS roc_auc, CAST(NULL AS DOUBLE) AS avg_precision,
CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall,
CAST(NULL AS DOUBLE) AS accuracy FROM reg
UNION ALL SELECT model, fit_seconds, NULL, NULL, NULL, roc_auc, round(share, 6),
round(CASE WHEN rate >= 0.5 THEN 2 * share / (share + 1) ELSE 0 END, 6),
round(CASE WHEN rate >= 0.5 THEN share ELSE 0 END, 6), CASE WHEN rate >= 0.5 THEN 1e0 ELSE 0 END,
round(CASE WHEN rate >= 0.5 THEN share ELSE 1 - share END, 6) FROM cls""",
        _NAIVE,
    ),
)
def baseline_table(spark, sf):
    data = package(spark, sf)
    reg = plan.metric_row(plan.naive_regression(data)).select(*plan.REGRESSION_COLUMNS)
    cls = plan.metric_row(plan.naive_classification(data)).select(*plan.CLASS_COLUMNS)
    out = plan.baseline_table(reg, cls)
    names = [c for c in out.columns if c not in ("model", "fit_seconds")]
    return rounded(out, *names)


_COEF = union(
    f"""SELECT '{c}' AS feature, CASE WHEN min("{c}") < max("{c}") THEN corr("{c}", y) END AS coef
FROM matrix""" for c in FEATURES
)


@query(
    "f02_top_coefficients",
    S.from_clean(
        f"""SELECT feature, round(coef, 6) AS coef, 'positive' AS side FROM (
  SELECT * FROM ({_COEF}) WHERE coef IS NOT NULL ORDER BY coef DESC, feature LIMIT 5)
UNION ALL SELECT feature, round(coef, 6), 'negative' FROM (
  SELECT * FROM ({_COEF}) WHERE coef IS NOT NULL ORDER BY coef, feature LIMIT 5)""",
        MATRIX,
    ),
)
def top_coefficients(spark, sf):
    """The strongest positive and negative target correlations, as a coefficient table."""
    table = profiling.pearson_with_target(matrix(spark, sf), FEATURES)
    table = table.withColumnRenamed("pearson_corr", "coef")
    out = plan.top_rows(table, "coef", 5).withColumn("side", F.lit("positive")).union(
        plan.top_rows(table, "coef", 5, largest=False).withColumn("side", F.lit("negative"))
    )
    return rounded(out, "coef")


_GUESSES = {"flat_rate": "fare_amount * 0.15e0", "per_mile": "trip_distance * 0.6e0",
            "per_minute": "duration_min * 0.2e0"}


@query(
    "f05_winner",
    S.from_clean(
        "SELECT model, round(rmse, 6) AS rmse FROM (" + union(
            f"SELECT '{n}' AS model, sqrt(avg((y - {e}) ** 2)) AS rmse FROM matrix"
            for n, e in _GUESSES.items()
        ) + ") ORDER BY rmse, model LIMIT 1",
        MATRIX,
    ),
)
def winner(spark, sf):
    rows = matrix(spark, sf)
    rates = {"flat_rate": ("fare_amount", 0.15), "per_mile": ("trip_distance", 0.6),
             "per_minute": ("duration_min", 0.2)}
    parts = [
        metrics.regression_metrics(
            rows.select("y", (F.col(c).cast("double") * rate).alias("guess")), "y", "guess"
        ).select(F.lit(name).alias("model"), "rmse")
        for name, (c, rate) in rates.items()
    ]
    table = parts[0].union(parts[1]).union(parts[2])
    return rounded(plan.winner(table, "rmse", True), "rmse")


# --- fitted: rows only ---------------------------------------------------------
@query("h07_linear_regression")
def linear_regression(spark, sf):
    return plan.fit_linear(package(spark, sf), report(spark, sf)).metrics


@query("h08_logistic_regression")
def logistic_regression(spark, sf):
    return plan.fit_logistic(package(spark, sf), report(spark, sf)).metrics


@query("h09_boosted_trees")
def boosted_trees(spark, sf):
    return plan.fit_boosted(package(spark, sf), report(spark, sf), fixed=BOOSTED).metrics


@query("h10_random_forest")
def random_forest(spark, sf):
    return plan.fit_forest(package(spark, sf), report(spark, sf), fixed=FOREST).metrics


@query("h11_tune_boosted")
def tune_boosted(spark, sf):
    """Forty trials over the whole search space."""
    fit = plan.fit_boosted(package(spark, sf), report(spark, sf), trials=40)
    return fit.info["tuning"].table


@query("h12_tune_forest")
def tune_forest(spark, sf):
    fit = plan.fit_forest(package(spark, sf), report(spark, sf), trials=3,
                          fixed={"n_estimators": 30, "max_depth": 8})
    return fit.info["tuning"].table


@query("h17_prediction_tables")
def prediction_tables(spark, sf):
    return plan.fit_linear(package(spark, sf), report(spark, sf)).predictions


@query("h18_linear_coefficients")
def linear_coefficients(spark, sf):
    return plan.fit_linear(package(spark, sf), report(spark, sf)).table


@query("h19_logistic_coefficients")
def logistic_coefficients(spark, sf):
    return plan.fit_logistic(package(spark, sf), report(spark, sf)).table


@query("h20_importances")
def importances(spark, sf):
    return plan.fit_forest(package(spark, sf), report(spark, sf), fixed=FOREST).table


@_declared_once
def suite(spark, sf):
    return plan.run_suite(
        package(spark, sf), report(spark, sf), boosted={"fixed": BOOSTED}, forest={"fixed": FOREST}
    )


@query("h21_interpretation")
def interpretation(spark, sf):
    """All seven tables, stacked as (part, feature, value)."""
    out = None
    for part, table in plan.interpretation(suite(spark, sf), 5).items():
        if part == "baseline":
            cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in table.columns]
            rows = table.select(F.inline(F.array(*cells)))
        else:
            rows = table.select("feature", F.col(table.columns[1]).alias("value"))
        rows = rows.select(F.lit(part).alias("part"), "feature", "value")
        out = rows if out is None else out.union(rows)
    return out


@query("h22_model_comparison")
def model_comparison(spark, sf):
    run = suite(spark, sf)
    return run.regression_table.unionByName(run.classification_table, allowMissingColumns=True)


@query(
    "h23_full_suite",
    S.from_clean(
        union(
            f"SELECT '{fit}' AS fit, count(*) AS rows FROM held_out" + (" WHERE y > 0" if tipped else "")
            for fit, tipped in (
                ("naive_regression", True), ("naive_classification", False), ("simple_linear", True),
                ("simple_logistic", False), ("optimized_regression", True), ("optimized_random_forest", False),
            )
        ),
        DATASET,
    ),
)
def full_suite(spark, sf):
    """Rows predicted by every model of the suite."""
    parts = [
        fit.predictions.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("fit"), "rows")
        for name, fit in suite(spark, sf).fits.items()
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.union(part)
    return table


@query("h24_year_summary")
def year_summary(spark, sf):
    """The summary row of a package of all years: its year is null."""
    return plan.year_summary(None, package(spark, sf), suite(spark, sf))


@query("h26_model_years")
def model_years(spark, sf):
    """Every year that the data holds, boosted trees and forests at their full sizes."""
    rows = clean(spark, sf)
    years = [r["year"] for r in rows.select("year").distinct().orderBy("year").collect()]
    return plan.model_years(rows, years, KEYS)
