"""Exact ordered statistics without an unbounded buffer anywhere.

Rows are first reduced to distinct values with counts (map-side combine does most of it), then
every distinct value learns how many rows precede it. The order is built in two levels: ranges
of (group, value) whose ends Spark draws from the values themselves, with totals that are carried
from range to range, and the position inside the range. Ranges hold about as many distinct values
each, so a large group spreads over many tasks however its values are distributed.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.session import settle


def value_counts(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Distinct non-null values per group with summed measures (a row count by default).

    Nulls are dropped by their zero count after the aggregation. A plain null filter would be
    pushed below the shuffle and make it differ between branches that could share it.
    """
    measures = measures or {"n": F.count(F.lit(1))}
    counted = df.groupBy(*groups, value).agg(
        F.count(value).alias("_seen"), *[m.alias(name) for name, m in measures.items()]
    )
    return counted.where(F.col("_seen") > 0).drop("_seen")


def running_totals(
    counts: DataFrame, groups: Sequence[str], value: str, measures: Sequence[str] = ("n",)
) -> DataFrame:
    """Add ``<m>_before`` (rows with a smaller value) and ``<m>_total`` to distinct values.

    The ranges are written once: a task that is run again must find the same ends. Values are
    distinct, so no tie lies across an end. The totals form a small table, a row per range and
    one per group more.
    """
    keys = [*groups, "_range"]
    counts = settle(
        counts.select(*groups, value, *measures).repartitionByRange(*groups, value)
        .withColumn("_range", F.spark_partition_id())
    )
    # A struct is never null itself, so window and join share one partitioning by plain equality.
    at = F.struct(*keys).alias("_at")
    ranges = counts.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    over_ranges = Window.partitionBy(*groups).orderBy("_range")
    before = over_ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = ranges.select(
        at,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_o_{m}_before") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy("_at").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("*", at).select(
        "*",
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_i_{m}_before") for m in measures],
    )
    return ranked.join(offsets, "_at").select(
        *groups,
        value,
        *measures,
        *[(F.col(f"_i_{m}_before") + F.col(f"_o_{m}_before")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def quantile_parts(value: str, probs: dict[str, float], where: Column | None = None) -> list[Column]:
    """Aggregates over ``running_totals`` output that pick the two neighbours of each quantile."""
    first, past = F.col("n_before"), F.col("n_before") + F.col("n")
    parts = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (first <= at) & (at < past)
            hit = hit if where is None else where & hit
            parts.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
        shift = position - F.floor(position)
        shift = shift if where is None else F.when(where, shift)
        parts.append(F.max(shift).alias(f"_w_{name}"))
    return parts


def quantile_value(name: str) -> Column:
    """Interpolate between the two neighbours picked by ``quantile_parts``."""
    low, high, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
    mixed = low * (1.0 - weight) + high * weight
    return F.when(weight == 0, low).otherwise(mixed).alias(name)


def quantiles_of_counts(
    counts: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles from distinct values with counts, one column per name."""
    ranked = running_totals(counts, groups, value)
    picked = ranked.groupBy(*groups).agg(*quantile_parts(value, probs))
    return picked.select(*groups, *[quantile_value(name) for name in probs])


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles of a double column per group; groups without values are absent."""
    return quantiles_of_counts(value_counts(df, groups, value), groups, value, probs)


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to (keep..., column, value); nulls are kept."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keep, F.inline(pairs))


def _tallies(values: np.ndarray, ranks: np.ndarray, ranked: np.ndarray) -> list[np.ndarray]:
    """Distinct values with their rows, ranked rows, sum of ranks and of their squares."""
    low, high = values.min(), values.max()
    if ((values == low) | (values == high)).all():  # flags and constants need no sort
        distinct, place = (np.array([low]), None) if low == high else (np.array([low, high]), values == high)
        place = np.zeros(len(values), dtype=int) if place is None else place.astype(int)
    else:
        distinct, place = np.unique(values, return_inverse=True)
    size = len(distinct)
    weights = (None, ranked.astype(float), ranks, ranks * ranks)
    return [distinct, *(np.bincount(place, w, size).astype(float) for w in weights)]


def column_counts(df: DataFrame, columns: Sequence[str], rank: str | None = None) -> DataFrame:
    """``(column, value, n, ranked, rank_sum, rank_squares)``: distinct values of many columns, null being one.

    ``rank`` names a column of the rows; its count, sum and squares are added up per value. Each
    task counts a batch of rows column by column, so that a row becomes neither one row per column
    nor, where values repeat in the batch, one per value. Shuffled are only distinct values.
    """
    columns = list(columns)
    if not columns:
        schema = "column string, value double, n bigint, ranked bigint, rank_sum double, rank_squares double"
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            *cells, ranks = batch.columns
            ranked = ~ranks.is_null().to_numpy(zero_copy_only=False)
            ranks = ranks.fill_null(0.0).to_numpy(zero_copy_only=False)
            for i, cell in enumerate(cells):
                gone = cell.is_null().to_numpy(zero_copy_only=False)
                if gone.any():
                    r, m = ranks[gone], ranked[gone]
                    line = [i], [None], [len(m)], [m.sum()], [r.sum()], [(r * r).sum()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(line, (pa.int32(), *[pa.float64()] * 5), strict=True)], names
                    )
                if not gone.all():
                    values = cell.fill_null(0.0).to_numpy(zero_copy_only=False)
                    part = _tallies(values[~gone], ranks[~gone], ranked[~gone]) if gone.any() else _tallies(values, ranks, ranked)
                    which = np.full(len(part[0]), i, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (which, *part)], names)

    names = ["i", "value", "n", "ranked", "rank_sum", "rank_squares"]
    numbers = df.select(
        *[F.col(f"`{c}`").cast("double").alias(str(k)) for k, c in enumerate(columns)],
        (F.lit(None) if rank is None else F.col(rank)).cast("double").alias("rank"),
    )
    schema = "i int, " + ", ".join(f"{c} double" for c in names[1:])
    total = numbers.mapInArrow(run, schema).groupBy("i", "value").agg(
        F.sum("n").cast("bigint").alias("n"),
        F.sum("ranked").cast("bigint").alias("ranked"),
        F.sum("rank_sum").alias("rank_sum"),
        F.sum("rank_squares").alias("rank_squares"),
    )
    return total.select(F.get(F.array(*[F.lit(c) for c in columns]), "i").alias("column"), *names[1:])


def quantiles_of_columns(counts: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of some columns of ``column_counts``: (column, <prob names>)."""
    chosen = counts.where(F.col("column").isin(list(columns)) & F.col("value").isNotNull())
    return quantiles_of_counts(chosen, ["column"], "value", probs)


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of many columns in one job: (groups..., column, <prob names>)."""
    if not groups:
        return quantiles_of_columns(column_counts(df, columns), columns, probs)
    return exact_quantiles(long_values(df, columns, groups), [*groups, "column"], "value", probs)


def average_ranks(
    df: DataFrame, groups: Sequence[str], value: str, rows: Column | None = None
) -> DataFrame:
    """Distinct values per group with their average rank and the group's row count.

    ``rows`` is the aggregate that counts rows; it defaults to one per input row.
    """
    counts = value_counts(df, groups, value, {"n": rows} if rows is not None else None)
    ranked = running_totals(counts, groups, value)
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    return ranked.select(*groups, value, rank.alias("rank"), F.col("n_total").alias("rows"))
