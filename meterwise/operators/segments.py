"""Cluster summaries, the k grid, choice of k and ranking helpers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise import constants as C
from meterwise.functions.numeric import round_half_even
from meterwise.operators.features import observed

CLUSTER = "cluster"


def cluster_sizes(df: DataFrame) -> DataFrame:
    sizes = df.groupBy(CLUSTER).agg(F.count(F.lit(1)).alias("n_rows"))
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()) * 100.0
    return sizes.withColumn("pct_rows", share)


def _means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(CLUSTER).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(f"`{c}`").alias(c) for c in columns]
    )


def cluster_means(df: DataFrame, columns: Sequence[str] = C.BEHAVIOR_COLUMNS) -> DataFrame:
    """Means per cluster to four places."""
    means = _means(df, columns)
    return means.select(CLUSTER, *[round_half_even(F.col(c), 4).alias(c) for c in columns])


def cluster_index(df: DataFrame, columns: Sequence[str] = C.BEHAVIOR_COLUMNS) -> DataFrame:
    """Rounded cluster mean over the overall mean, to three places.

    The overall mean comes from the cluster means and sizes, so one scan serves both.
    """
    all_clusters = Window.partitionBy()
    n = F.col("_n")

    def index(c):
        overall = F.sum(F.col(c) * n).over(all_clusters) / F.sum(n).over(all_clusters)
        ratio = F.try_divide(round_half_even(F.col(c), 4), overall)
        return round_half_even(ratio, 3).alias(c)

    return _means(df, columns).select(CLUSTER, *[index(c) for c in columns])


def descriptor_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of each 0/1 descriptor per cluster in percent, to two places."""
    rates = df.groupBy(CLUSTER).agg(*[F.avg(f"`{c}`").alias(c) for c in columns])
    return rates.select(
        CLUSTER, *[round_half_even(F.col(f"`{c}`") * 100.0, 2).alias(c) for c in columns]
    )


def category_mix(
    df: DataFrame, category: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Percent of each category per cluster, one column per category, absent ones 0."""
    values = list(values) if values is not None else observed(df, [category])[category]
    counts = df.groupBy(CLUSTER).pivot(category, values).count().fillna(0)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return counts.select(
        CLUSTER, *[round_half_even(F.col(f"`{v}`") / total * 100.0, 2).alias(v) for v in values]
    )


def top_categories(df: DataFrame, category: str, top_n: int = 10) -> DataFrame:
    """The most frequent categories per cluster with their rank and shares; ties by name.

    Rows are counted per (cluster, category) first, and clusters are summed apart from the
    ranking: each task then passes on only its own first ``top_n`` categories of a cluster.
    """
    counts = df.groupBy(CLUSTER, category).agg(F.count(F.lit(1)).alias("count"))
    by_cluster = Window.partitionBy(CLUSTER)
    order = by_cluster.orderBy(F.col("count").desc(), F.col(category).asc())
    first = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    totals = counts.groupBy(F.col(CLUSTER).alias("_cluster")).agg(F.sum("count").alias("cluster_total"))
    ranked = first.join(totals, F.col(CLUSTER).eqNullSafe(F.col("_cluster"))).select(
        CLUSTER, category, "count", "rank", "cluster_total"
    )
    return ranked.select(
        "*",
        (F.col("count") / F.col("cluster_total") * 100.0).alias("pct_within_cluster"),
        (F.col("count") / F.sum("count").over(by_cluster) * 100.0).alias("pct_top_n_share"),
    ).orderBy(CLUSTER, "rank")


def top_categories_wide(top: DataFrame, category: str, top_n: int = 10) -> DataFrame:
    """One row per cluster with columns ``Top 1`` to ``Top N``."""
    ranks = list(range(1, top_n + 1))
    wide = top.groupBy(CLUSTER).pivot("rank", ranks).agg(F.first(category))
    return wide.select(CLUSTER, *[F.col(f"`{r}`").alias(f"Top {r}") for r in ranks])


def add_group_totals(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Attach each group's total to its rows (many to one)."""
    totals = df.groupBy(group).agg(F.sum(value).alias(name))
    return df.join(totals, group, "left")


def first_categories(top: DataFrame, category: str, n: int = 5) -> DataFrame:
    """The first n categories of every cluster, in rank order, as a list."""
    kept = top.where(F.col("rank") <= n)
    pairs = F.array_sort(F.collect_list(F.struct("rank", category)))
    return kept.groupBy(CLUSTER).agg(
        F.transform(pairs, lambda p: p.getField(category)).alias("categories")
    )


def top_columns(table: DataFrame, columns: Sequence[str], prefix: str, n: int = 3) -> DataFrame:
    """Per row the n largest of some columns as ``label: 12.34%`` texts; ties in column order."""
    pairs = F.array(
        *[
            F.struct(
                (-F.col(f"`{c}`")).alias("key"), F.lit(i).alias("i"), F.lit(c).alias("column")
            )
            for i, c in enumerate(columns)
        ]
    )
    best = F.slice(F.array_sort(pairs), 1, n)

    def text(p):
        label = F.replace(p["column"], F.lit(prefix), F.lit("")) if prefix else p["column"]
        return F.concat(label, F.lit(": "), F.format_string("%.2f%%", -p["key"]))

    return table.select(CLUSTER, F.transform(best, text).alias("lines"))


def dense_tip_rank() -> Column:
    return F.dense_rank().over(Window.orderBy(F.col("tip_rate_pct").desc()))


def inertia_drops(grid: DataFrame) -> DataFrame:
    """Drop of the inertia against the previous k, absolute and relative."""
    previous = F.lag("inertia").over(Window.orderBy("k"))
    return grid.withColumns(
        {
            "inertia_drop": previous - F.col("inertia"),
            "inertia_drop_pct": (previous - F.col("inertia")) / previous,
        }
    )


def min_max(value: Column) -> Column:
    """Scale over all rows to [0, 1]; a flat column is all ones, an empty one all null."""
    everything = Window.partitionBy()
    low, high = F.min(value).over(everything), F.max(value).over(everything)
    flat = F.abs(high - low) < 1e-12
    return F.when(low.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(flat, 1.0).otherwise((value - low) / F.when(~flat, high - low))
    )


def _keep_if_any(grid: DataFrame, condition: Column) -> DataFrame:
    """Filter, unless the filter would leave nothing."""
    ok = F.coalesce(condition, F.lit(False))
    anything = F.max(ok.cast("int")).over(Window.partitionBy()) == 1
    return grid.withColumn("_ok", ok | ~anything).where("_ok").drop("_ok")


def k_candidates(
    grid: DataFrame,
    min_k: int | None = C.AUTO_MIN_K,
    min_cluster_pct: float | None = C.MIN_CLUSTER_PCT,
) -> DataFrame:
    """Candidates after the two soft filters (smallest k, smallest cluster share)."""
    if min_k is not None:
        grid = _keep_if_any(grid, F.col("k") >= min_k)
    if min_cluster_pct is not None and "min_cluster_pct" in grid.columns:
        grid = _keep_if_any(grid, F.col("min_cluster_pct") >= float(min_cluster_pct))
    return grid


def consensus_scores(candidates: DataFrame) -> DataFrame:
    """Weighted mean of min-max scaled silhouette, elbow drop, variance ratio and balance."""
    complete = candidates.dropna(subset=["silhouette", "calinski_harabasz"])
    inputs = {
        "silhouette": F.col("silhouette"),
        "calinski_harabasz": F.col("calinski_harabasz"),
        "elbow_drop_pct": F.coalesce(F.col("inertia_drop_pct"), F.lit(0.0)),
        "cluster_balance": F.col("min_cluster_pct"),
    }
    scored = complete.withColumns(
        {f"score_{n}": F.coalesce(min_max(c), F.lit(0.0)) for n, c in inputs.items()}
    )
    total = F.lit(0.0)
    for name, weight in C.CONSENSUS_WEIGHTS.items():
        total = total + weight * F.col(f"score_{name}")
    return scored.withColumn("consensus_score", total)


def best_row(table: DataFrame, metric: str, tie: str = "k") -> DataFrame:
    """The row with the largest metric; the smallest ``tie`` wins among equals."""
    return table.orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc()).limit(1)


def score_k(
    grid: DataFrame,
    method: str = "consensus",
    min_k: int | None = C.AUTO_MIN_K,
    min_cluster_pct: float | None = C.MIN_CLUSTER_PCT,
) -> tuple[DataFrame, str]:
    """Scored candidates and the name of the deciding metric."""
    if method not in ("silhouette", "calinski_harabasz", "consensus"):
        raise ValueError(f"unknown method: {method}")
    candidates = k_candidates(grid, min_k, min_cluster_pct)
    if method == "consensus":
        return consensus_scores(candidates), "consensus_score"
    return candidates.dropna(subset=[method]), method


def select_k(grid: DataFrame, **options) -> DataFrame:
    """(k, metric, value) of the best candidate; empty when every metric is missing."""
    scored, metric = score_k(grid, **options)
    return best_row(scored, metric).select(
        "k", F.lit(metric).alias("metric"), F.col(metric).alias("value")
    )


def add_scores(grid: DataFrame, scored: DataFrame, metric: str) -> DataFrame:
    """Merge the deciding score back onto the grid, one row per k."""
    if metric in grid.columns:
        return grid
    return grid.join(scored.select("k", metric).dropDuplicates(["k"]), "k", "left")


# --- personas ----------------------------------------------------------------
AIRPORT = "Airport Connector Long-Haul"
GROUP = "Group-Cab City Movers"
LOCAL = "High-Tipping Local Errands"
LOWER = "Lower-Tip Mid-Range Trips"
CORE = "Core Manhattan Mixed Trips"

# Fixed texts per persona: (label, comment suffix, interpretation, advice).
PERSONAS = [
    (
        AIRPORT,
        "airport-driven",
        "Airport-to-city and city-to-airport trips dominate this cluster, with high fares and "
        "long distances driving steady but not top tip percentages",
        "Stage near JFK/LGA corridors and Manhattan gateways, prioritize queue positioning and "
        "clean airport transitions",
    ),
    (
        GROUP,
        "group-passenger segment",
        "Higher passenger counts suggest shared trips, tourism, and social travel patterns with "
        "moderate fare levels and generally solid tipping",
        "Target nightlife, hotel, and entertainment pickup zones where multi-passenger demand is "
        "common",
    ),
    (
        LOCAL,
        "short-hop urban core",
        "Short, dense urban hops with strong tipping norms and high transaction frequency make "
        "this cluster especially attractive despite smaller fares",
        "Prioritize dense Manhattan short-hop zones during daytime and evening windows, "
        "optimizing turnover rate",
    ),
    (
        LOWER,
        "mixed-value longer hauls",
        "Mid-range city hauls show weaker tip behavior relative to fare and time, indicating "
        "lower conversion into generous tipping",
        "Use this cluster for volume fill rather than tip optimization, and focus on service "
        "quality nudges to improve tip conversion",
    ),
    (
        CORE,
        None,
        "Broad city usage profile with mixed trip purposes and balanced tipping behavior",
        "Maintain broad coverage and shift toward higher-tip zones during peak opportunity "
        "windows",
    ),
]


def persona(overall_tip: Column) -> Column:
    """Label from the cluster means; the first rule that holds decides."""
    miles, tip = F.col("trip_distance"), F.col("tip_rate_pct")
    return (
        F.when((F.col("is_airport_trip_num") >= 0.40) & (miles >= 8), AIRPORT)
        .when(F.col("passenger_count") >= 2.5, GROUP)
        .when((miles <= 2.0) & (F.col("duration_min") <= 10) & (tip >= overall_tip), LOCAL)
        .when((tip < overall_tip) & (miles >= 3.0), LOWER)
        .otherwise(CORE)
    )


def add_personas(means: DataFrame) -> DataFrame:
    """Label, dense tip rank and comment; the threshold is the plain mean over clusters."""
    everything = Window.partitionBy()
    rank = F.col("tip_rank")
    message = (
        F.when(rank == 1, "Highest tip propensity")
        .when(rank == F.col("_clusters"), "Lowest tip propensity")
        .otherwise("Mid-tier tip propensity")
    )
    suffix = F.lit(None).cast("string")
    for label, text, _, _ in PERSONAS:
        suffix = F.when(F.col("persona") == label, F.lit(text)).otherwise(suffix)
    return (
        means.withColumns(
            {
                "persona": persona(F.avg("tip_rate_pct").over(everything)),
                "tip_rank": dense_tip_rank(),
                "_clusters": F.count(F.lit(1)).over(everything),
            }
        )
        .withColumn("comment", F.concat_ws(", ", message, suffix))
        .drop("_clusters")
    )


def persona_texts(df: DataFrame) -> DataFrame:
    """Interpretation and advice looked up by label in the five-row text table."""
    texts = df.sparkSession.createDataFrame(
        [(label, meaning, advice) for label, _, meaning, advice in PERSONAS],
        "persona string, interpretation string, advice string",
    )
    return df.join(F.broadcast(texts), "persona", "left")


def persona_overview(means: DataFrame, sizes: DataFrame) -> DataFrame:
    """Persona table with the cluster shares, best tippers first."""
    joined = add_personas(means).join(sizes.select(CLUSTER, "pct_rows"), CLUSTER, "left")
    return joined.select(
        CLUSTER,
        "persona",
        "tip_rate_pct",
        "tip_rank",
        F.col("pct_rows").alias("cluster_share_pct"),
        "comment",
    ).orderBy("tip_rank", CLUSTER)


def cluster_extremes(df: DataFrame, means: DataFrame) -> DataFrame:
    """Cluster count and the highest and lowest mean tip rate."""
    return means.agg(
        F.count_distinct(CLUSTER).alias("cluster_count"),
        F.max("tip_rate_pct").alias("top_cluster_tip_rate_pct"),
        F.min("tip_rate_pct").alias("bottom_cluster_tip_rate_pct"),
    ).withColumn("sample_rows", df.agg(F.count(F.lit(1))).scalar())


def weighted_profile(
    means: DataFrame, sizes: DataFrame, by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Cluster means weighted by cluster size, e.g. per year."""
    joined = means.join(sizes, [*by, CLUSTER])
    n = F.col("n_rows")
    return joined.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        *[(F.sum(F.col(c) * n) / F.sum(n)).alias(c) for c in columns],
    )
