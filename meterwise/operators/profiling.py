"""Column profiles, outlier checks, correlations and preparation advice.

Statistics for many columns come from one wide aggregation that is then turned into one row
per column; quantiles and ranks come from the distributed operators in ``quantiles``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.functions.numeric import sample_kurtosis, sample_skew
from meterwise.functions.sizing import broadcast_within
from meterwise.operators.moments import column_moments, moment_matrix, pearson, sample_variances
from meterwise.operators.quantiles import (
    average_ranks,
    column_counts,
    column_quantiles,
    exact_quantiles,
    long_values,
    quantiles_of_columns,
    running_totals,
)
from meterwise.session import settle


def _num(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are present; null when either is constant."""
    x, y = F.when(_num(b).isNotNull(), _num(a)), F.when(_num(a).isNotNull(), _num(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: dict[str, Column],
    label: str = "feature",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per column with aggregates over ``value`` (and the ``keep`` columns).

    Rows are unpivoted and grouped by column name. The map side combines them to one row per
    column and task, and the generated code stays small however many columns there are; one wide
    aggregation grows past what the JVM compiles.
    """
    grouped = long_values(df, columns, keep).groupBy(F.col("column").alias(label))
    return grouped.agg(*[m.alias(name) for name, m in measures.items()])


def missingness(df: DataFrame) -> DataFrame:
    """Share of nulls per column, only columns with any, largest first."""
    flags = df.select(*[F.col(f"`{c}`").isNull().cast("int").alias(c) for c in df.columns])
    share = per_column(flags, df.columns, {"missing": F.avg("value")}, "column")
    return share.where(F.col("missing") > 0).orderBy(F.col("missing").desc(), "column")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, extremes and the 1, 50 and 99 percent points of numeric columns."""
    basics = per_column(
        df,
        columns,
        {
            "mean": F.avg("value"),
            "std": F.stddev_samp("value"),
            "min": F.min("value"),
            "max": F.max("value"),
        },
        "column",
    )
    marks = column_quantiles(df, columns, {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return basics.join(marks, "column", "left")


def variable_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent points, 1.5 x IQR fences and the values beyond them, for many columns at once."""
    marks = column_quantiles(df, columns, {"q01": 0.01, "q25": 0.25, "q75": 0.75, "q99": 0.99})
    spread = F.col("q75") - F.col("q25")
    fences = marks.withColumns(
        {"iqr_low": F.col("q25") - 1.5 * spread, "iqr_high": F.col("q75") + 1.5 * spread}
    )
    # One row per profiled column, so the fences become literals of a single counting pass.
    rows = {r["column"]: r for r in fences.collect()}
    if len(rows) < len(columns):
        raise ValueError("a column has no numeric values")

    def fence(name):
        pairs = [F.lit(x) for c, r in rows.items() for x in (c, r[name])]
        return F.create_map(*pairs)[F.col("column")]

    beyond = (F.col("value") < fence("iqr_low")) | (F.col("value") > fence("iqr_high"))
    counts = per_column(
        df, columns, {"n": F.count("value"), "outliers": F.count_if(beyond)}, "column"
    )
    known = df.sparkSession.createDataFrame(
        [(c, r["q01"], r["q99"], r["iqr_low"], r["iqr_high"]) for c, r in rows.items()],
        "column string, q01 double, q99 double, iqr_low double, iqr_high double",
    )
    return counts.join(known, "column").select(
        "column",
        "n",
        "q01",
        "q99",
        "iqr_low",
        "iqr_high",
        F.col("outliers").alias("outlier_count_1p5_iqr"),
        (F.col("outliers") / F.col("n") * 100.0).alias("outlier_pct_1p5_iqr"),
    )


def target_profile(df: DataFrame, y: str, target: str) -> DataFrame:
    """Skew, kurtosis, zero and negative share, and whether log1p of the target is advised."""
    v = _num(y)
    stats = df.agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.skewness(v).alias("g1"),
        F.kurtosis(v).alias("g2"),
        (F.count_if(v == 0) / F.count(v) * 100.0).alias("zero_pct"),
        (F.count_if(v < 0) / F.count(v) * 100.0).alias("negative_pct"),
    ).withColumns(
        {
            "skew": sample_skew(F.col("g1"), F.col("n")),
            "kurtosis": sample_kurtosis(F.col("g2"), F.col("n")),
        }
    )
    advise = (
        (F.abs("skew") >= C.SKEW_CUTOFF) & F.lit(target != "log_tip") & (F.col("negative_pct") == 0)
    )
    return stats.select(
        F.lit(target).alias("target"),
        "n",
        "mean",
        "skew",
        "kurtosis",
        "zero_pct",
        "negative_pct",
        F.coalesce(advise, F.lit(False)).alias("suggest_log1p_target"),
    )


def ranked_counts(df: DataFrame, columns: Sequence[str], y: str = "y") -> DataFrame:
    """``column_counts`` whose ranks are the centred average ranks of the target.

    Every row with a target has one rank, whatever the feature, so a rank is looked up once per
    row and added up per feature value; no (feature value, target) pair is formed.
    """
    target = df.select(_num(y).alias("_target"))
    ranks = settle(average_ranks(target, [], "_target").select(
        "_target", (F.col("rank") - (F.col("rows") + 1) / F.lit(2.0)).alias("_rank")
    ))
    rows = df.select(*[F.col(f"`{c}`") for c in columns], _num(y).alias("_target"))
    return settle(column_counts(rows.join(broadcast_within(ranks), "_target", "left"), columns, "_rank"))


def counted_shapes(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n, min, max, std, g1)`` from the distinct values of ``column_counts``."""
    chosen = counts.where(F.col("column").isin(list(columns)) & F.col("value").isNotNull())
    ends = chosen.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
    )
    away = F.col("value") - F.col("mean")
    powers = chosen.join(F.broadcast(ends), "column").groupBy("column").agg(
        *[F.first(c).alias(c) for c in ("rows", "min", "max")],
        F.sum(F.col("n") * away * away).alias("m2"),
        F.sum(F.col("n") * away * away * away).alias("m3"),
    )
    n, m2 = F.col("rows"), F.col("m2")
    return powers.select(
        F.col("column").alias("feature"),
        n.alias("n"),
        "min",
        "max",
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"),
        F.try_divide(F.sqrt(n) * F.col("m3"), F.sqrt(m2 * m2 * m2)).alias("g1"),
    )


def skew_profile(
    df: DataFrame,
    columns: Sequence[str],
    cutoff: float = C.SKEW_CUTOFF,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Skew, tails and the suggested transform per column, most skewed first.

    ``counts`` are the columns' ``column_counts``, if there are any.
    """
    counts = settle(column_counts(df, columns)) if counts is None else counts
    basics = counted_shapes(counts, columns).drop("std")
    marks = quantiles_of_columns(
        counts, columns, {"q01": 0.01, "q25": 0.25, "q75": 0.75, "q99": 0.99}
    ).withColumnRenamed("column", "feature")
    # A column with one repeated value has no shape; its skew counts as 0.
    skew = F.when(F.col("min") == F.col("max"), 0.0).otherwise(
        sample_skew(F.col("g1"), F.col("n"))
    )
    iqr = F.col("q75") - F.col("q25")
    strong = F.abs("skew") >= cutoff
    return (
        basics.join(marks, "feature")
        .withColumn("skew", skew)
        .select(
            "feature",
            "skew",
            F.abs("skew").alias("abs_skew"),
            "q01",
            "q99",
            "min",
            "max",
            F.try_divide(F.col("q99") - F.col("q01"), iqr).alias("tail_ratio_99_01_to_iqr"),
            F.when(strong & (F.col("min") >= 0), "log1p")
            .when(strong, "yeo-johnson")
            .otherwise("none")
            .alias("suggested_transform"),
        )
        .orderBy(F.col("abs_skew").desc(), "feature")
    )


def feature_groups(
    df: DataFrame,
    columns: Sequence[str],
    prefixes: Sequence[str] = C.DUMMY_PREFIXES,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(feature, position, distinct_values, kind): dummy, binary, low_card or continuous.

    Distinct values are those of ``column_counts``, given or made here; dummies are recognised by
    name and their values not counted.
    """
    dummies = [c for c in columns if c.startswith(tuple(prefixes))]
    others = [c for c in columns if c not in dummies]
    counts = column_counts(df, others) if counts is None else counts
    counted = (
        counts.where(F.col("column").isin(others))
        .groupBy("column")
        .agg(F.count("value").alias("distinct_values"))
    )
    names = df.sparkSession.createDataFrame(
        [(c, i, c in dummies) for i, c in enumerate(columns)],
        "column string, position int, is_dummy boolean",
    )
    n = F.col("distinct_values")
    return names.join(counted, "column", "left").select(
        F.col("column").alias("feature"),
        "position",
        "distinct_values",
        F.when(F.col("is_dummy"), "dummy")
        .when(n <= 2, "binary")
        .when(n <= 10, "low_card")
        .otherwise("continuous")
        .alias("kind"),
    )


def groups_by_kind(table: DataFrame) -> dict[str, list[str]]:
    """Feature names by kind in column order; the table has one row per feature."""
    out: dict[str, list[str]] = {"dummy": [], "binary": [], "low_card": [], "continuous": []}
    for r in sorted(table.collect(), key=lambda r: r["position"]):
        out[r["kind"]].append(r["feature"])
    return out


def pearson_with_target(
    df: DataFrame, columns: Sequence[str], y: str = "y", moments: DataFrame | None = None
) -> DataFrame:
    """Pearson correlation per feature; constant features and fewer than 3 pairs are skipped.

    ``moments`` is a moment matrix that has the columns and then the target, if there is one.
    """
    table = moment_matrix(df, [*columns, y]) if moments is None else moments
    with_target = table.where(
        (F.col("feature_2") == y) & F.col("feature_1").isin(list(columns)) & (F.col("pairs") >= 3)
    )
    corr = with_target.select(F.col("feature_1").alias("feature"), pearson().alias("pearson_corr"))
    return corr.where("pearson_corr IS NOT NULL")


def spearman_with_target(
    df: DataFrame, columns: Sequence[str], y: str = "y", counts: DataFrame | None = None
) -> DataFrame:
    """Spearman correlation per feature from average ranks.

    Over the rows of a feature without nulls the target's ranks are those of all rows, so the
    products follow from the sum of target ranks per feature value (``counts``, the
    ``ranked_counts`` of the columns). Features with nulls rank the target over their own rows.
    """
    counts = ranked_counts(df, columns, y) if counts is None else counts
    gaps = counts.where(F.col("value").isNull() & (F.col("ranked") > 0)).select("column").distinct()
    partial = [r["column"] for r in gaps.collect()]
    whole = [c for c in columns if c not in partial]
    chosen = counts.where(F.col("column").isin(whole) & F.col("value").isNotNull() & (F.col("ranked") > 0))
    measures = ["n", "rank_sum", "rank_squares"]
    ranked = running_totals(
        chosen.select("column", "value", F.col("ranked").alias("n"), *measures[1:]), ["column"], "value", measures
    )
    n = F.col("n")
    dx = F.col("n_before") + (n + 1) / F.lit(2.0) - (F.col("n_total") + 1) / F.lit(2.0)
    sums = ranked.groupBy(F.col("column").alias("feature")).agg(
        F.sum(n).alias("rows"),
        F.sum(dx * F.col("rank_sum")).alias("xy"),
        F.sum(n * dx * dx).alias("xx"),
        F.sum("rank_squares").alias("yy"),
    )
    found = _spearman(sums)
    return found.union(_spearman(_pair_sums(df, partial, y))) if partial else found


def _spearman(sums: DataFrame) -> DataFrame:
    corr = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    usable = (F.col("rows") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return sums.where(usable).select("feature", corr.alias("spearman_corr"))


def _pair_sums(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Products of ranks per feature where the target is ranked over the feature's own rows.

    Pairs are reduced to distinct (feature, x, y) counts first. Ranks are centred on their known
    mean (rows + 1) / 2, so the sums stay accurate on large tables.
    """
    pairs = settle(
        long_values(df, columns, [y])
        .withColumnRenamed("column", "feature")
        .withColumn("t", _num(y))
        .groupBy("feature", "value", "t")
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("xs"), F.count("t").alias("ys"))
        .where((F.col("xs") > 0) & (F.col("ys") > 0))
        .select("feature", "value", "t", "n")
    )
    ranked_x = weighted_ranks(pairs, "value").withColumnRenamed("rank", "rx")
    ranked_t = weighted_ranks(pairs, "t").withColumnRenamed("rank", "rt").drop("rows")
    joined = pairs.join(ranked_x, ["feature", "value"]).join(ranked_t, ["feature", "t"])
    middle = (F.col("rows") + 1) / F.lit(2.0)
    dx, dt, n = F.col("rx") - middle, F.col("rt") - middle, F.col("n")
    return joined.groupBy("feature").agg(
        F.sum(n).alias("rows"),
        F.sum(n * dx * dt).alias("xy"),
        F.sum(n * dx * dx).alias("xx"),
        F.sum(n * dt * dt).alias("yy"),
    )


def weighted_ranks(pairs: DataFrame, value: str) -> DataFrame:
    """Average ranks of one side of the counted pairs, per feature."""
    return average_ranks(pairs, ["feature"], value, F.sum("n"))


def feature_target_correlations(
    df: DataFrame,
    columns: Sequence[str],
    y: str = "y",
    moments: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Both correlations with their absolute values, strongest first."""
    both = pearson_with_target(df, columns, y, moments).join(
        spearman_with_target(df, columns, y, counts), "feature", "left"
    )
    return both.withColumns(
        {"abs_pearson": F.abs("pearson_corr"), "abs_spearman": F.abs("spearman_corr")}
    ).orderBy(F.col("abs_spearman").desc(), F.col("abs_pearson").desc(), "feature")


def high_correlations(
    df: DataFrame,
    columns: Sequence[str],
    cutoff: float = C.CORR_CUTOFF,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Feature pairs whose absolute Pearson correlation reaches the cutoff, strongest first.

    They are lines of the moment matrix, in the order of *columns*; rows are never paired.
    """
    if not columns:
        schema = "feature_1 string, feature_2 string, abs_corr double"
        return df.sparkSession.createDataFrame([], schema)
    table = moment_matrix(df, columns) if moments is None else moments
    order = F.array(*[F.lit(c) for c in columns])
    one, two = F.col("feature_1"), F.col("feature_2")
    at_one, at_two = F.array_position(order, one), F.array_position(order, two)
    pairs = table.where((at_one > 0) & (at_two > 0) & (at_one != at_two)).select(
        F.when(at_one < at_two, one).otherwise(two).alias("feature_1"),
        F.when(at_one < at_two, two).otherwise(one).alias("feature_2"),
        F.abs(pearson()).alias("abs_corr"),
    )
    return pairs.where(F.col("abs_corr") >= cutoff).orderBy(
        F.col("abs_corr").desc(), "feature_1", "feature_2"
    )


def low_variance(
    df: DataFrame, columns: Sequence[str], moments: DataFrame | None = None
) -> DataFrame:
    """Columns with zero or near-zero sample variance."""
    table = sample_variances(moment_matrix(df, columns) if moments is None else moments)
    v = F.col("variance")
    level = F.when(v <= C.ZERO_VARIANCE, "zero").when(v <= C.NEAR_ZERO_VARIANCE, "near_zero")
    chosen = table.where(F.col("feature").isin(list(columns)))
    return chosen.withColumn("level", level).where("level IS NOT NULL")


def variances(
    df: DataFrame, columns: Sequence[str], moments: DataFrame | None = None
) -> dict[str, float]:
    if not columns:
        return {}
    table = sample_variances(moment_matrix(df, columns) if moments is None else moments)
    chosen = table.where(F.col("feature").isin(list(columns)))
    return {r["feature"]: r["variance"] for r in chosen.collect()}


def column_spreads(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, constant, variance)``: at most one distinct value, null being one; and var_samp."""
    table = column_moments(df, columns)
    same = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    full = (F.col("filled") == F.col("rows")) & same
    constant = F.coalesce(full | (F.col("filled") == 0), F.lit(False))
    return table.select("feature", constant.alias("constant"), "variance")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value, where null counts as a value."""
    return column_spreads(df, columns).where("constant").select("feature")


# The texts of the advice.
_ADVICE = {
    "none": "No continuous features detected.",
    "moderate": "Scale differences are moderate; scaling is optional unless model class "
    "requires it.",
    "heavy": "Large scale differences with heavy skew; standard scaling after log transform is "
    "recommended.",
    "large": "Large scale differences with moderate skew; standard scaling is appropriate.",
}


def scaling_advice(
    df: DataFrame, columns: Sequence[str], skews: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """Whether features need scaling, from the ratio of their spreads and the skew rate."""
    if not columns:
        return df.sparkSession.createDataFrame(
            [(False, "none", None, None, None, _ADVICE["none"])],
            "recommend_scaling boolean, recommended_scaler string, std_ratio double, "
            "range_ratio double, skew_flag_rate_pct double, reason string",
        )
    counts = settle(column_counts(df, columns)) if counts is None else counts
    spreads = counted_shapes(counts, columns).select(
        "feature", "std", (F.col("max") - F.col("min")).alias("span")
    )

    def ratio(name):
        positive = F.when(F.col(name) > 0, F.col(name))
        return F.max(positive) / F.min(positive)

    flagged = F.avg((F.col("suggested_transform") != "none").cast("int")) * 100.0
    both = spreads.join(skews.select("feature", "suggested_transform"), "feature", "left")
    row = both.agg(
        ratio("std").alias("std_ratio"),
        ratio("span").alias("range_ratio"),
        F.coalesce(flagged, F.lit(0.0)).alias("skew_flag_rate_pct"),
    )
    needed = F.coalesce(F.col("std_ratio") >= C.STD_RATIO_CUTOFF, F.lit(False)) | F.coalesce(
        F.col("range_ratio") >= C.RANGE_RATIO_CUTOFF, F.lit(False)
    )
    return row.select(
        needed.alias("recommend_scaling"),
        F.when(needed, "StandardScaler")
        .otherwise("optional_for_linear_models")
        .alias("recommended_scaler"),
        "std_ratio",
        "range_ratio",
        "skew_flag_rate_pct",
        F.when(~needed, _ADVICE["moderate"])
        .when(F.col("skew_flag_rate_pct") >= C.SKEW_RATE_CUTOFF, _ADVICE["heavy"])
        .otherwise(_ADVICE["large"])
        .alias("reason"),
    )


def axis_limits(
    df: DataFrame,
    value: str,
    crop: tuple[float, float] | None = None,
    pad_fraction: float = 0.0,
) -> DataFrame:
    """Axis range from extremes or quantiles with padding; no row when there is no value."""
    v = df.select(_num(value).alias("v"))
    if crop is None:
        ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    else:
        ends = exact_quantiles(v, [], "v", {"low": crop[0], "high": crop[1]})
    span = F.col("high") - F.col("low")
    pad = F.when(span <= 0, F.greatest(F.abs("high") * 0.05, F.lit(1e-6))).otherwise(
        span * max(float(pad_fraction), 0.0)
    )
    return ends.where(F.col("low").isNotNull()).select(
        (F.col("low") - pad).alias("axis_low"), (F.col("high") + pad).alias("axis_high")
    )


def profile_counts(
    groups: DataFrame, pairs: DataFrame, low: DataFrame, advice: DataFrame
) -> DataFrame:
    """One row of counts over the profile tables: kinds, pairs, low variances, advice."""
    kinds = groups.agg(
        *[
            F.count_if(F.col("kind") == k).alias(f"{k}_n")
            for k in ("continuous", "low_card", "binary", "dummy")
        ]
    )
    low_counts = low.agg(
        F.count_if(F.col("level") == "zero").alias("zero_var_n"),
        F.count_if(F.col("level") == "near_zero").alias("near_zero_var_n"),
    ).select(F.struct("*"))
    pair_count = pairs.agg(F.count(F.lit(1)))
    chosen = advice.select(F.struct("recommend_scaling", "recommended_scaler"))
    return kinds.select(
        "*",
        pair_count.scalar().alias("high_corr_pairs_n"),
        low_counts.scalar().alias("low"),
        chosen.scalar().alias("advice"),
    ).select(
        *[f"{k}_n" for k in ("continuous", "low_card", "binary", "dummy")],
        "high_corr_pairs_n",
        "low.*",
        "advice.*",
    )
