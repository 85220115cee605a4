"""Counts, sums and cross products of all pairs of columns from one scan."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUMS = ["n", "shift_1", "shift_2", "sum_1", "sum_2", "shared", "square_1", "square_2"]
_ROUNDING = 1e-14  # a spread below this part of the sum of squares is rounding


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(str(k)) for k, c in enumerate(columns)])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch as values, 0 for null, and marks of the cells that are not null."""
    for batch in batches:
        if batch.num_rows:
            present = np.stack([~c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            yield values, present


def _first(values: np.ndarray, present: np.ndarray) -> np.ndarray:
    return values[present.argmax(axis=0), np.arange(values.shape[1])]


class _Sums:
    """Pairwise sums of rows around fixed shifts; every pair uses the rows where both are present."""

    def __init__(self, shifts: np.ndarray):
        size = len(shifts)
        self.shifts = shifts
        self.rows, self.sums, self.shared, self.squares = (np.zeros((size, size)) for _ in range(4))

    def add(self, values: np.ndarray, present: np.ndarray) -> None:
        if present.all():
            x = values - self.shifts
            self.rows += len(x)
            self.sums += x.sum(axis=0)[:, None]
            self.shared += x.T @ x
            self.squares += (x * x).sum(axis=0)[:, None]
            return
        x, m = np.where(present, values - self.shifts, 0.0), present.astype(float)
        self.rows += m.T @ m
        self.sums += x.T @ m
        self.shared += x.T @ x
        self.squares += (x * x).T @ m

    def table(self) -> list[np.ndarray]:
        i, j = np.triu_indices(len(self.shifts))
        return [i, j, self.rows[i, j], self.shifts[i], self.shifts[j], self.sums[i, j],
                self.sums[j, i], self.shared[i, j], self.squares[i, j], self.squares[j, i]]


def moment_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature_1, feature_2, pairs, covariance, spread_1, spread_2)``, also for each column alone.

    The last three are sums of products of deviations over the rows where both columns are
    present: divide them by ``pairs`` for population values, by one less for sample values. Each
    task reduces its rows to one line per pair of columns by matrix products around the first
    values that it sees, so large means cost no digits and constants have no spread at all.
    Columns without a row are counted with 0 pairs; a table without rows gives none.
    """
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for values, present in _arrays(batches):
            if sums is None:
                sums = _Sums(_first(values, present))
            sums.add(values, present)
        if sums is not None:
            names = ["i", "j", *_SUMS]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in sums.table()], names)

    numbers = _numbers(df, columns)
    schema = "i bigint, j bigint, " + ", ".join(f"{c} double" for c in _SUMS)
    pair = Window.partitionBy("i", "j")
    d1, d2 = (F.col(f"shift_{k}") - F.min(f"shift_{k}").over(pair) for k in (1, 2))
    moved = numbers.mapInArrow(run, schema).withColumns({"d1": d1, "d2": d2})
    n, s1, s2 = F.col("n"), F.col("sum_1"), F.col("sum_2")
    d1, d2 = F.col("d1"), F.col("d2")
    total = moved.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(s1 + n * d1).alias("s1"),
        F.sum(s2 + n * d2).alias("s2"),
        F.sum(F.col("shared") + d2 * s1 + d1 * s2 + n * d1 * d2).alias("xy"),
        F.sum(F.col("square_1") + 2 * d1 * s1 + n * d1 * d1).alias("xx"),
        F.sum(F.col("square_2") + 2 * d2 * s2 + n * d2 * d2).alias("yy"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(
        F.get(names, F.col("i").cast("int")).alias("feature_1"),
        F.get(names, F.col("j").cast("int")).alias("feature_2"),
        F.col("n").cast("bigint").alias("pairs"),
        (F.col("xy") - F.try_divide(F.col("s1") * F.col("s2"), F.col("n"))).alias("covariance"),
        _spread("xx", "s1").alias("spread_1"),
        _spread("yy", "s2").alias("spread_2"),
    )


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, rows, filled, low, high, variance)`` of each column alone, from one scan.

    Tasks reduce their rows to a line per column as in ``moment_matrix``. NaN counts as a value
    above all others.
    """
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = None
        for values, present in _arrays(batches):
            if shift is None:
                shift = _first(values, present)
                rows, filled, sums, squares = (np.zeros(len(columns)) for _ in range(4))
                low, high = np.full(len(columns), np.nan), np.full(len(columns), -np.inf)
                seen = np.zeros(len(columns), dtype=bool)
            x = np.where(present, values - shift, 0.0)
            rows, filled = rows + len(x), filled + present.sum(axis=0)
            sums, squares = sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
            low = np.fmin(low, np.fmin.reduce(np.where(present, values, np.nan), axis=0))
            high = np.maximum(high, np.where(present, values, -np.inf).max(axis=0))
            seen |= present.any(axis=0)
        if shift is not None:
            cells = [np.arange(len(columns)), rows, filled, shift, sums, squares]
            ends = [pa.array(a, mask=~seen) for a in (low, high)]
            names = ["i", "rows", "filled", "shift", "sum", "square", "low", "high"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cells), *ends], names)

    schema = "i bigint, rows double, filled double, shift double, sum double, square double, low double, high double"
    moved = _numbers(df, columns).mapInArrow(run, schema).withColumn(
        "d", F.col("shift") - F.min("shift").over(Window.partitionBy("i"))
    )
    n, s, d = F.col("filled"), F.col("sum"), F.col("d")
    total = moved.groupBy("i").agg(
        F.sum("rows").cast("bigint").alias("rows"),
        F.sum(n).cast("bigint").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum(s + n * d).alias("s"),
        F.sum(F.col("square") + 2 * d * s + n * d * d).alias("xx"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(
        F.get(names, F.col("i").cast("int")).alias("feature"),
        "rows",
        F.col("n").alias("filled"),
        "low",
        "high",
        F.when(F.col("n") > 1, _spread("xx", "s") / (F.col("n") - 1)).alias("variance"),
    )


def _spread(squares: str, total: str) -> Column:
    q = F.col(squares)
    spread = q - F.try_divide(F.col(total) * F.col(total), F.col("n"))
    return F.when(spread <= q * _ROUNDING, F.lit(0.0)).otherwise(spread)


def pearson() -> Column:
    """Correlation of a line of the matrix; null where a side does not vary."""
    return F.try_divide(F.col("covariance"), F.sqrt("spread_1") * F.sqrt("spread_2"))


def sample_variances(moments: DataFrame) -> DataFrame:
    """``(feature, variance)``; null below two values."""
    own = moments.where(F.col("feature_1") == F.col("feature_2"))
    n = F.col("pairs")
    return own.select(
        F.col("feature_1").alias("feature"),
        F.when(n > 1, F.col("spread_1") / (n - 1)).alias("variance"),
    )
