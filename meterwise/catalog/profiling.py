"""Profile queries over the encoded feature matrix."""


from meterwise import constants as C
from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import clean
from meterwise.catalog.features import DUMMIES, FEATURES, MATRIX, NUMERIC, matrix
from meterwise.catalog.zones import rounded
from meterwise.operators import profiling as ops
from meterwise.operators.moments import moment_matrix
from meterwise.operators.quantiles import column_counts
from meterwise.session import settle

CONTINUOUS = ["trip_distance", "duration_min", "speed_mph", "fare_amount"]
LOW_CARD = ["passenger_count", "extra"]


def union(parts):
    return "\nUNION ALL ".join(parts)


@query(
    "d09_missingness",
    S.from_clean(
        'SELECT "column", round(missing, 9) AS missing FROM (' + union(
            f"""SELECT '{c}' AS "column", avg(CAST({c} IS NULL AS INT)) AS missing FROM clean"""
            for c in C.CLEAN_COLUMNS
        ) + ") WHERE missing > 0"
    ),
)
def missingness(spark, sf):
    return rounded(ops.missingness(clean(spark, sf).select(*C.CLEAN_COLUMNS)), "missing", digits=9)


@query(
    "d10_describe",
    S.from_clean(
        union(
            f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean,
round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
round(quantile_cont({c}, 0.01), 6) AS q01, round(quantile_cont({c}, 0.5), 6) AS q50,
round(quantile_cont({c}, 0.99), 6) AS q99 FROM matrix""" for c in NUMERIC
        ),
        MATRIX,
    ),
)
def describe(spark, sf):
    out = ops.describe(matrix(spark, sf), NUMERIC)
    return rounded(out, "mean", "std", "min", "max", "q01", "q50", "q99")


_CHECKED = C.PROFILE_COLUMNS


@query(
    "d11_variable_check",
    S.from_clean(
        union(
            f"""SELECT '{c}' AS "column", count(v) AS n, round(max(q01), 6) AS q01,
round(max(q99), 6) AS q99, round(max(lo), 6) AS iqr_low, round(max(hi), 6) AS iqr_high,
count(*) FILTER (v < lo OR v > hi) AS outlier_count_1p5_iqr,
round(count(*) FILTER (v < lo OR v > hi) / count(v) * 100, 6) AS outlier_pct_1p5_iqr
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM clean), (
  SELECT q01, q99, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM (
    SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) AS q01,
      quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
      quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75,
      quantile_cont(CAST({c} AS DOUBLE), 0.99) AS q99 FROM clean))""" for c in _CHECKED
        )
    ),
)
def variable_check(spark, sf):
    out = ops.variable_check(clean(spark, sf), _CHECKED)
    return rounded(out, "q01", "q99", "iqr_low", "iqr_high", "outlier_pct_1p5_iqr")


@query(
    "d16_target_profile",
    S.from_clean(
        """SELECT 'tip_amount' AS target, count(y) AS n, round(avg(y), 6) AS mean,
round(skewness(y), 6) AS skew, round(kurtosis(y), 6) AS kurtosis,
round(count(*) FILTER (y = 0) / count(y) * 100, 6) AS zero_pct,
round(count(*) FILTER (y < 0) / count(y) * 100, 6) AS negative_pct,
abs(skewness(y)) >= 1 AND count(*) FILTER (y < 0) = 0 AS suggest_log1p_target FROM matrix""",
        MATRIX,
    ),
)
def target_profile(spark, sf):
    out = ops.target_profile(matrix(spark, sf), "y", "tip_amount")
    return rounded(out, "mean", "skew", "kurtosis", "zero_pct", "negative_pct")


_SKEW_SQL = union(
    f"""SELECT '{c}' AS feature, skewness({c}) AS skew, quantile_cont({c}, 0.01) AS q01,
quantile_cont({c}, 0.99) AS q99, min({c}) AS min, max({c}) AS max,
(quantile_cont({c}, 0.99) - quantile_cont({c}, 0.01))
  / nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0) AS tail FROM matrix"""
    for c in CONTINUOUS + LOW_CARD
)


@query(
    "d17_skew_profile",
    S.from_clean(
        f"""SELECT feature, round(skew, 6) AS skew, round(abs(skew), 6) AS abs_skew,
round(q01, 6) AS q01, round(q99, 6) AS q99, round(min, 6) AS min, round(max, 6) AS max,
round(tail, 6) AS tail_ratio_99_01_to_iqr,
CASE WHEN abs(skew) < 1 THEN 'none' WHEN min >= 0 THEN 'log1p' ELSE 'yeo-johnson' END
  AS suggested_transform FROM ({_SKEW_SQL})""",
        MATRIX,
    ),
)
def skew_profile(spark, sf):
    out = ops.skew_profile(matrix(spark, sf), CONTINUOUS + LOW_CARD)
    return rounded(out, "skew", "abs_skew", "q01", "q99", "min", "max", "tail_ratio_99_01_to_iqr")


_GROUPS_SQL = union(
    [f"""SELECT '{c}' AS feature, {i} AS position, count(DISTINCT {c}) AS distinct_values,
CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' WHEN count(DISTINCT {c}) <= 10 THEN 'low_card'
  ELSE 'continuous' END AS kind FROM matrix""" for i, c in enumerate(NUMERIC)]
    + [f"SELECT '{n}', {i}, CAST(NULL AS BIGINT), 'dummy'"
       for i, (n, _, _) in enumerate(DUMMIES, len(NUMERIC))]
)


@query(
    "d18_feature_types",
    S.from_clean(f"SELECT feature, distinct_values, kind FROM ({_GROUPS_SQL})", MATRIX),
)
def feature_types(spark, sf):
    out = ops.feature_groups(matrix(spark, sf), FEATURES)
    return out.select("feature", "distinct_values", "kind")


_PEARSON = union(
    f"""SELECT '{c}' AS feature, CASE WHEN min("{c}") < max("{c}") THEN corr("{c}", y) END
AS pearson_corr FROM matrix""" for c in FEATURES
)
_RANKED = """,
long_rows AS (
  SELECT feature, value, y FROM (
    UNPIVOT (SELECT y, {casts} FROM matrix) ON {names} INTO NAME feature VALUE value)
),
ranks AS (
  SELECT feature,
    rank() OVER (PARTITION BY feature ORDER BY value)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY feature ORDER BY y)
      + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
  FROM long_rows
)""".format(
    casts=", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in FEATURES),
    names=", ".join(f'"{c}"' for c in FEATURES),
)


@query(
    "d19_pearson_with_target",
    S.from_clean(
        f"""SELECT feature, round(pearson_corr, 6) AS pearson_corr FROM ({_PEARSON})
WHERE pearson_corr IS NOT NULL""",
        MATRIX,
    ),
)
def pearson_with_target(spark, sf):
    return rounded(ops.pearson_with_target(matrix(spark, sf), FEATURES), "pearson_corr")


_SPEARMAN = """SELECT feature, corr(rx, ry) AS spearman_corr FROM ranks GROUP BY feature
HAVING min(rx) < max(rx) AND min(ry) < max(ry)"""


@query(
    "d20_spearman_with_target",
    S.from_clean(
        f"SELECT feature, round(spearman_corr, 6) AS spearman_corr FROM ({_SPEARMAN})",
        MATRIX + _RANKED,
    ),
)
def spearman_with_target(spark, sf):
    return rounded(ops.spearman_with_target(matrix(spark, sf), FEATURES), "spearman_corr")


@query(
    "f03_correlations_sorted",
    S.from_clean(
        f"""SELECT feature, round(pearson_corr, 6) AS pearson_corr,
round(spearman_corr, 6) AS spearman_corr, round(abs(pearson_corr), 6) AS abs_pearson,
round(abs(spearman_corr), 6) AS abs_spearman
FROM ({_PEARSON}) p LEFT JOIN ({_SPEARMAN}) s USING (feature) WHERE pearson_corr IS NOT NULL
ORDER BY abs_spearman DESC, abs_pearson DESC""",
        MATRIX + _RANKED,
    ),
)
def correlations_sorted(spark, sf):
    out = ops.feature_target_correlations(matrix(spark, sf), FEATURES)
    return rounded(out, "pearson_corr", "spearman_corr", "abs_pearson", "abs_spearman")


_PAIRS = CONTINUOUS + LOW_CARD + ["congestion_surcharge"]


@query(
    "d21_high_correlations",
    S.from_clean(
        "SELECT feature_1, feature_2, round(abs_corr, 6) AS abs_corr FROM (" + union(
            f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, abs(corr({a}, {b})) AS abs_corr
FROM matrix""" for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :]
        ) + ") WHERE abs_corr >= 0.5",
        MATRIX,
    ),
)
def high_correlations(spark, sf):
    return rounded(ops.high_correlations(matrix(spark, sf), _PAIRS, 0.5), "abs_corr")


@query(
    "d22_low_variance",
    S.from_clean(
        """SELECT feature, round(variance, 9) AS variance,
CASE WHEN variance <= 1e-12 THEN 'zero' ELSE 'near_zero' END AS level FROM (""" + union(
            f"""SELECT '{c}' AS feature, var_samp("{c}") AS variance FROM matrix""" for c in FEATURES
        ) + ") WHERE variance <= 1e-4",
        MATRIX,
    ),
)
def low_variance(spark, sf):
    return rounded(ops.low_variance(matrix(spark, sf), FEATURES), "variance", digits=9)


_SPREAD = union(
    f"SELECT stddev_samp({c}) AS std, max({c}) - min({c}) AS span, skewness({c}) AS skew FROM matrix"
    for c in CONTINUOUS
)


@query(
    "d23_scaling_advice",
    S.from_clean(
        f"""SELECT std_ratio >= 20 OR range_ratio >= 100 AS recommend_scaling,
CASE WHEN std_ratio >= 20 OR range_ratio >= 100 THEN 'StandardScaler'
  ELSE 'optional_for_linear_models' END AS recommended_scaler,
round(std_ratio, 6) AS std_ratio, round(range_ratio, 6) AS range_ratio,
round(skew_rate, 6) AS skew_flag_rate_pct,
CASE WHEN NOT (std_ratio >= 20 OR range_ratio >= 100) THEN
  'Scale differences are moderate; scaling is optional unless model class requires it.'
WHEN skew_rate >= 30 THEN
  'Large scale differences with heavy skew; standard scaling after log transform is recommended.'
ELSE 'Large scale differences with moderate skew; standard scaling is appropriate.' END AS reason
FROM (SELECT max(std) / min(std) AS std_ratio, max(span) / min(span) AS range_ratio,
  avg(CAST(abs(skew) >= 1 AS INT)) * 100 AS skew_rate FROM ({_SPREAD}) WHERE std > 0)""",
        MATRIX,
    ),
)
def scaling_advice(spark, sf):
    rows = matrix(spark, sf)
    counts = settle(column_counts(rows, CONTINUOUS))
    out = ops.scaling_advice(rows, CONTINUOUS, ops.skew_profile(rows, CONTINUOUS, counts=counts), counts)
    return rounded(out, "std_ratio", "range_ratio", "skew_flag_rate_pct")


@query(
    "d34_constant_columns",
    S.from_clean(
        "SELECT feature FROM (" + union(
            f"""SELECT '{c}' AS feature, count(DISTINCT "{c}") + max(CAST("{c}" IS NULL AS INT)) AS n
FROM matrix""" for c in FEATURES
        ) + ") WHERE n <= 1",
        MATRIX,
    ),
)
def constant_columns(spark, sf):
    return ops.constant_columns(matrix(spark, sf), FEATURES)


@query(
    "d35_axis_limits",
    S.from_clean(
        """SELECT round(lo - (hi - lo) * 0.03, 6) AS axis_low, round(hi + (hi - lo) * 0.03, 6)
AS axis_high FROM (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM matrix)""",
        MATRIX,
    ),
)
def axis_limits(spark, sf):
    return rounded(ops.axis_limits(matrix(spark, sf), "y", (0.01, 0.99), 0.03), "axis_low",
                   "axis_high")


@query(
    "h28_profile_counts",
    S.from_clean(
        f"""SELECT * FROM (
  SELECT count(*) FILTER (kind = 'continuous') AS continuous_n,
    count(*) FILTER (kind = 'low_card') AS low_card_n, count(*) FILTER (kind = 'binary') AS binary_n,
    count(*) FILTER (kind = 'dummy') AS dummy_n FROM ({_GROUPS_SQL})),
(SELECT count(*) AS high_corr_pairs_n FROM (""" + union(
            f"SELECT abs(corr({a}, {b})) AS r FROM matrix"
            for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :]
        ) + """) WHERE r >= 0.9),
(SELECT count(*) FILTER (v <= 1e-12) AS zero_var_n,
  count(*) FILTER (v > 1e-12 AND v <= 1e-4) AS near_zero_var_n FROM (""" + union(
            f'SELECT var_samp("{c}") AS v FROM matrix' for c in FEATURES
        ) + f""")),
(SELECT max(std) / min(std) >= 20 OR max(span) / min(span) >= 100 AS recommend_scaling,
  CASE WHEN max(std) / min(std) >= 20 OR max(span) / min(span) >= 100 THEN 'StandardScaler'
    ELSE 'optional_for_linear_models' END AS recommended_scaler
 FROM ({_SPREAD}) WHERE std > 0)""",
        MATRIX,
    ),
)
def profile_counts(spark, sf):
    # Two scans of the cleaner, one for the moments and one for the counted values.
    rows = matrix(spark, sf)
    moments = settle(moment_matrix(rows, FEATURES))
    counts = settle(column_counts(rows, [c for c in FEATURES if not c.startswith(C.DUMMY_PREFIXES)]))
    return ops.profile_counts(
        ops.feature_groups(rows, FEATURES, counts=counts),
        ops.high_correlations(rows, _PAIRS, moments=moments),
        ops.low_variance(rows, FEATURES, moments),
        ops.scaling_advice(rows, CONTINUOUS, ops.skew_profile(rows, CONTINUOUS, counts=counts), counts),
    )
