"""Per-zone tip statistics with local winsorising and a reliability rule."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.functions import labels
from meterwise.functions.numeric import clip
from meterwise.functions.sizing import broadcast_within
from meterwise.operators.cleaning import zone_table
from meterwise.operators.quantiles import (
    exact_quantiles,
    long_values,
    quantile_parts,
    quantile_value,
    running_totals,
    value_counts,
)
from meterwise.session import settle


def guarded_rate(tip: Column, fare: Column) -> Column:
    """Tip over fare where the fare is large enough to give a stable rate, else null."""
    tip, fare = tip.cast("double"), fare.cast("double")
    return F.when(fare >= C.RATE_MIN_FARE, tip / fare)


def rate_rows(trips: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per trip outside the excluded zones: zone, tip, fare and guarded rate."""
    return trips.where(~F.col("pickup_location_id").isin(*C.EXCLUDED_ZONES)).select(
        *keep,
        F.col("pickup_location_id").cast("int").alias("zone_id"),
        F.col("tip_amount").cast("double").alias("tip_amount"),
        F.col("fare_amount").cast("double").alias("fare_amount"),
        guarded_rate(F.col("tip_amount"), F.col("fare_amount")).alias("tip_rate"),
    )


def group_bounds(
    df: DataFrame, groups: Sequence[str], value: str, quantiles=C.ZONE_WINSOR
) -> DataFrame:
    """Low and high quantile of a column per group, settled as a small table."""
    probs = {"q_low": quantiles[0], "q_high": quantiles[1]}
    return settle(exact_quantiles(df, groups, value, probs))


def join_bounds(df: DataFrame, bounds: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach per-group bounds to rows; groups without bounds get null.

    The bounds hold one row per group. They are broadcast when a row check allows it, so the rows
    are not shuffled and a hot group stays spread; beyond the check Spark joins by shuffle and
    splits hot groups by adaptive skew handling.
    """
    return df.join(broadcast_within(bounds), list(groups), "left")


def winsorise_by_group(
    df: DataFrame, groups: Sequence[str], value: str, quantiles=C.ZONE_WINSOR
) -> DataFrame:
    """Clip a column to its own group's bounds; null stays null."""
    joined = join_bounds(df, group_bounds(df, groups, value, quantiles), groups)
    clipped = clip(F.col(value), F.col("q_low"), F.col("q_high"))
    return joined.withColumn(f"{value}_w", clipped)


def reliable(n: Column, iqr: Column, median: Column) -> Column:
    """Enough trips, or a small standard error relative to the median with at least 50."""
    error = (iqr / C.IQR_TO_SIGMA) / F.sqrt(n) / F.greatest(median, F.lit(1.0))
    return (n >= 100) | ((error <= 0.15) & (n >= 50))


def zone_aggregates(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means, medians, winsorised rate, revenue rate, trips and interquartile range per zone.

    Tips, fares and rates are reduced together to distinct (zone, measure, value) with counts.
    Every statistic is a weighted computation on that table: the trips are scanned once, a busy
    zone is combined on the map side, and the bounds are joined back to distinct rates only.
    """
    keys = [*by, "zone_id"]
    measures = ["tip_amount", "fare_amount", "tip_rate"]
    counts = value_counts(
        long_values(rate_rows(trips, by), measures, keys), [*keys, "column"], "value"
    )
    ranked = settle(running_totals(counts, [*keys, "column"], "value"))
    is_tip, is_fare, is_rate = (F.col("column") == m for m in measures)
    weighted = F.col("value") * F.col("n")
    picked = ranked.groupBy(*keys).agg(
        *quantile_parts("value", {"med_tip": 0.5, "tip_q25": 0.25, "tip_q75": 0.75}, is_tip),
        *quantile_parts("value", {"q_low": C.ZONE_WINSOR[0], "q_high": C.ZONE_WINSOR[1]}, is_rate),
        F.sum(F.when(is_tip, weighted)).alias("tip_sum"),
        F.sum(F.when(is_fare, weighted)).alias("fare_sum"),
        F.sum(F.when(is_tip, F.col("n"))).alias("num_trips"),
    )
    stats = settle(picked.select(
        *keys,
        *[quantile_value(q) for q in ("med_tip", "tip_q25", "tip_q75", "q_low", "q_high")],
        (F.col("tip_sum") / F.col("num_trips")).alias("avg_tip"),
        (F.col("fare_sum") / F.col("num_trips")).alias("avg_fare"),
        (F.try_divide("tip_sum", "fare_sum") * 100.0).alias("avg_rate_revenue"),
        "num_trips",
    ).withColumn("iqr", F.col("tip_q75") - F.col("tip_q25")))
    clipped = clip(F.col("value"), F.col("q_low"), F.col("q_high"))
    mean_rate = (
        join_bounds(ranked.where(is_rate), stats.select(*keys, "q_low", "q_high"), keys)
        .groupBy(*keys)
        .agg((F.sum(clipped * F.col("n")) / F.sum("n") * 100.0).alias("avg_rate"))
    )
    return stats.join(mean_rate, keys, "left")


STATS = ["avg_tip", "med_tip", "avg_fare", "avg_rate", "avg_rate_revenue", "num_trips"]


def reliable_zones(aggregates: DataFrame) -> DataFrame:
    return aggregates.where(reliable(F.col("num_trips"), F.col("iqr"), F.col("med_tip")))


def keep_all_zones(
    zones: DataFrame, stats: DataFrame, by: Sequence[str] = (), periods: DataFrame | None = None
) -> DataFrame:
    """Every zone appears (once per year when ``by`` has a year); statistics may be null.

    ``periods`` names the years of the table, so that one without any reliable zone keeps its
    rows; without it they are those of ``stats``.
    """
    dimension = zone_table(zones)
    if by:
        # The set of years is tiny and exact; each zone row is repeated once per year.
        known = stats if periods is None else periods
        years = known.agg(F.array_sort(F.collect_set(by[0])).alias("y"))
        dimension = dimension.withColumn(by[0], F.explode(years.scalar()))
    return dimension.join(stats, [*by, "zone_id"], "left").select(
        *by, "zone_id", "borough", "zone_name", "wkt", *STATS
    )


def busiest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("num_trips").desc_nulls_last(), F.col("zone_id").asc())


def zone_tip_stats(trips: DataFrame, zones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The zone statistics table; with ``by=["year"]`` all years come from one job."""
    every = zone_aggregates(trips, by)
    return busiest_first(keep_all_zones(zones, reliable_zones(every), by, every))


def robust_range(stats: DataFrame, metric: str, is_rate: bool = False) -> DataFrame:
    """Colour range of a metric over all rows; (0, 1) when there is no value at all.

    ``stats`` holds one row per zone and year, so a plain percentile is bounded by its input.
    """
    marks = F.percentile(F.col(metric).cast("double"), F.array(*[F.lit(q) for q in C.COLOR_RANGE]))
    out = stats.agg(marks.alias("m")).select(
        F.coalesce(F.get("m", F.lit(0)), F.lit(0.0)).alias("vmin"),
        F.coalesce(F.get("m", F.lit(1)), F.lit(1.0)).alias("vmax"),
        F.col("m").isNotNull().alias("seen"),
    )
    if is_rate:
        floor = F.when(F.col("seen"), F.greatest(F.lit(0.0), F.col("vmin"))).otherwise(F.col("vmin"))
        out = out.withColumn("vmin", floor).withColumn(
            "vmax",
            F.when(F.col("seen"), F.greatest(F.col("vmin") + 1.0, F.col("vmax"))).otherwise(
                F.col("vmax")
            ),
        )
    return out.select(F.lit(metric).alias("metric"), "vmin", "vmax")


def metric_position(stats: DataFrame, metric: str, value_range: DataFrame) -> DataFrame:
    """Where each value sits in the range, clamped to [0, 1]; null stays null."""
    span = value_range.select(F.struct("vmin", "vmax")).scalar()
    position = F.try_divide(F.col(metric) - span["vmin"], span["vmax"] - span["vmin"])
    return stats.withColumn(f"{metric}_position", clip(position, 0.0, 1.0))


def display_texts(stats: DataFrame) -> DataFrame:
    """Money, percent and count strings for the map."""
    return stats.withColumns(
        {
            "avg_tip_s": labels.money_text(F.col("avg_tip")),
            "med_tip_s": labels.money_text(F.col("med_tip")),
            "avg_rate_s": labels.percent_text(F.col("avg_rate")),
            "num_trips_s": labels.count_text(F.col("num_trips")),
        }
    )
