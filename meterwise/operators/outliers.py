"""Quantile bounds, clipping and dropping, median fill and standard scaling."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.functions.numeric import clip
from meterwise.operators.quantiles import column_quantiles

Bounds = dict[str, tuple[float, float]]


def fit_bounds(
    df: DataFrame,
    columns: Sequence[str],
    lower: float = C.WINSOR_QUANTILES[0],
    upper: float = C.WINSOR_QUANTILES[1],
) -> DataFrame:
    """One row per column with its lower and upper quantile; all columns in one job."""
    if not 0 <= lower < upper <= 1:
        raise ValueError(f"need 0 <= lower < upper <= 1 (got {lower}, {upper})")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    marks = column_quantiles(df, columns, {"lower_bound": lower, "upper_bound": upper})
    return marks.select(
        "column",
        F.lit(float(lower)).alias("lower_quantile"),
        F.lit(float(upper)).alias("upper_quantile"),
        "lower_bound",
        "upper_bound",
    )


def as_bounds(table: DataFrame) -> Bounds:
    """The fitted table (one row per column) as a mapping, like a fitted model's parameters."""
    return {r["column"]: (r["lower_bound"], r["upper_bound"]) for r in table.collect()}


def winsorise(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Clip columns to their bounds; null stays null."""
    return df.withColumns(
        {c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items()}
    )


def _outside(column: str, low: float, high: float):
    value = F.col(column).cast("double")
    return (value < low) | (value > high)


def clip_counts(df: DataFrame, bounds: Bounds) -> DataFrame:
    """(column, cells_clipped) for every bounded column, counted in one pass."""
    names = list(bounds)
    counted = df.agg(*[F.count_if(_outside(c, *bounds[c])).alias(c) for c in names])
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("cells_clipped")) for c in names
    ]
    return counted.select(F.inline(F.array(*pairs)))


def _summary(method: str, before, after, clipped) -> list:
    removed = before - after
    pct = F.when(before > 0, removed / before * 100.0).otherwise(0.0)
    return [
        F.lit(method).alias("method"),
        before.alias("rows_before"),
        after.alias("rows_after"),
        removed.alias("rows_removed"),
        pct.alias("rows_removed_pct"),
        clipped.alias("cells_clipped"),
    ]


def winsor_summary(df: DataFrame, bounds: Bounds) -> DataFrame:
    cells = [F.count_if(_outside(c, *b)) for c, b in bounds.items()]
    rows = F.count(F.lit(1))
    clipped = reduce(lambda a, b: a + b, cells, F.lit(0).cast("bigint"))
    return df.agg(rows.alias("rows"), clipped.alias("cells")).select(
        *_summary("winsor", F.col("rows"), F.col("rows"), F.col("cells"))
    )


def inside_bounds(bounds: Bounds):
    """True when every bounded column is present and inside its bounds, ends included."""
    tests = [F.col(c).cast("double").between(lo, hi) for c, (lo, hi) in bounds.items()]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def drop_outside(df: DataFrame, bounds: Bounds) -> DataFrame:
    return df.where(inside_bounds(bounds))


def drop_summary(df: DataFrame, bounds: Bounds) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(inside_bounds(bounds)).alias("kept")
    )
    return counted.select(
        *_summary("drop", F.col("rows"), F.col("kept"), F.lit(0).cast("bigint"))
    )


def apply_bounds(df: DataFrame, bounds: Bounds, method: str = "winsor") -> DataFrame:
    """Clip or drop on a frame that still carries its target, so both stay aligned."""
    if method not in ("winsor", "drop"):
        raise ValueError(f"method must be winsor or drop (got {method})")
    return winsorise(df, bounds) if method == "winsor" else drop_outside(df, bounds)


def bounds_summary(df: DataFrame, bounds: Bounds, method: str = "winsor") -> DataFrame:
    return winsor_summary(df, bounds) if method == "winsor" else drop_summary(df, bounds)


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    table = column_quantiles(df, columns, {"median": 0.5})
    return {r["column"]: r["median"] for r in table.collect()}


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the column's exact median; a column without nulls is left alone."""
    probe = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    gaps = [c for c in columns if probe[c]]
    medians = fit_medians(df, gaps) if gaps else {}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in medians}
    )


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean_, scale_): mean and population deviation, 1 where the deviation is 0."""
    fitted = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"m_{c}").alias("mean_"),
            F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("scale_"),
        )
        for c in columns
    ]
    return fitted.select(F.inline(F.array(*rows)))


def as_scaler(table: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean_"], r["scale_"]) for r in table.collect()}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]], prefix: str = "") -> DataFrame:
    """Standardise columns with fitted parameters; ``prefix`` keeps the originals."""
    return df.withColumns(
        {
            f"{prefix}{c}": (F.col(c).cast("double") - mean) / dev
            for c, (mean, dev) in scaler.items()
        }
    )


def unscale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Back to raw units."""
    return df.withColumns({c: F.col(c) * dev + mean for c, (mean, dev) in scaler.items()})
