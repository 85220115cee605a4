"""Bounds, clipping, dropping, imputation and scaling queries."""

from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import clean
from meterwise.catalog.sampling import KEY, TIPPED, split_sql, tipped
from meterwise.catalog.zones import rounded
from meterwise.operators import features, outliers as ops, sampling

COLS = C.MODEL_OUTLIER_COLUMNS
NUMS = "nums AS (SELECT trip_key, tip_amount, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in COLS
) + " FROM clean)"


def bounds_cte(source: str, name: str = "bounds") -> str:
    picks = ", ".join(
        f"quantile_cont({c}, 0.003) AS lo_{c}, quantile_cont({c}, 0.997) AS hi_{c}" for c in COLS
    )
    return f"{name} AS (SELECT {picks} FROM {source})"


def clipped(c: str) -> str:
    return f"least(greatest({c}, lo_{c}), hi_{c})"


CELLS = " + ".join(f"count(*) FILTER ({c} < lo_{c} OR {c} > hi_{c})" for c in COLS)
INSIDE = " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in COLS)


def _fitted(spark, sf):
    rows = clean(spark, sf)
    return rows, ops.as_bounds(ops.fit_bounds(rows, COLS))


@query(
    "d12_quantile_bounds",
    S.from_clean(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", 0.003e0 AS lower_quantile, 0.997e0 AS upper_quantile,
round(lo_{c}, 6) AS lower_bound, round(hi_{c}, 6) AS upper_bound FROM bounds""" for c in COLS
        ),
        NUMS, bounds_cte("nums"),
    ),
)
def quantile_bounds(spark, sf):
    return rounded(ops.fit_bounds(clean(spark, sf), COLS), "lower_bound", "upper_bound")


@query(
    "d13_winsorised_rows",
    S.from_clean(
        "SELECT trip_key, " + ", ".join(f"round({clipped(c)}, 6) AS {c}" for c in COLS)
        + " FROM nums, bounds",
        NUMS, bounds_cte("nums"),
    ),
)
def winsorised_rows(spark, sf):
    rows, bounds = _fitted(spark, sf)
    return rounded(ops.winsorise(rows, bounds).select("trip_key", *COLS), *COLS)


@query(
    "d13_clip_counts",
    S.from_clean(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo_{c} OR {c} > hi_{c})
AS cells_clipped FROM nums, bounds""" for c in COLS
        ),
        NUMS, bounds_cte("nums"),
    ),
)
def clip_counts(spark, sf):
    return ops.clip_counts(*_fitted(spark, sf))


@query(
    "d13_winsor_summary",
    S.from_clean(
        f"""SELECT 'winsor' AS method, count(*) AS rows_before, count(*) AS rows_after,
0 AS rows_removed, 0e0 AS rows_removed_pct, {CELLS} AS cells_clipped FROM nums, bounds""",
        NUMS, bounds_cte("nums"),
    ),
)
def winsor_summary(spark, sf):
    return ops.winsor_summary(*_fitted(spark, sf))


@query(
    "d14_dropped_rows",
    S.from_clean(f"SELECT trip_key FROM nums, bounds WHERE {INSIDE}", NUMS, bounds_cte("nums")),
)
def dropped_rows(spark, sf):
    return ops.drop_outside(*_fitted(spark, sf)).select("trip_key")


@query(
    "d14_drop_summary",
    S.from_clean(
        f"""SELECT 'drop' AS method, count(*) AS rows_before, count(*) FILTER ({INSIDE}) AS rows_after,
count(*) - count(*) FILTER ({INSIDE}) AS rows_removed,
round((count(*) - count(*) FILTER ({INSIDE})) / count(*) * 100, 6) AS rows_removed_pct,
0 AS cells_clipped FROM nums, bounds""",
        NUMS, bounds_cte("nums"),
    ),
)
def drop_summary(spark, sf):
    return rounded(ops.drop_summary(*_fitted(spark, sf)), "rows_removed_pct")


_SPLIT = f"""{TIPPED},
parts AS ({split_sql(42, 'tipped', 'tipped_rows')}),
typed AS (SELECT trip_key, is_valid, CAST(tip_amount AS DOUBLE) AS y, {", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in COLS)} FROM parts),
train_rows AS (SELECT * FROM typed WHERE NOT is_valid)"""


def _split(spark, sf):
    return sampling.split_rows(tipped(clean(spark, sf)), KEY, 0.2, 42, ["tipped"])


@query(
    "d15_bounds_on_features_and_target",
    S.from_clean(
        "SELECT trip_key, is_valid, y, " + ", ".join(f"round({clipped(c)}, 6) AS {c}" for c in COLS)
        + " FROM typed, bounds",
        _SPLIT, bounds_cte("train_rows"),
    ),
)
def bounds_on_features_and_target(spark, sf):
    """Bounds come from the training rows only and are applied to both parts."""
    parts = _split(spark, sf)
    bounds = ops.as_bounds(ops.fit_bounds(parts.where("NOT is_valid"), COLS))
    both = ops.apply_bounds(parts, bounds, "winsor")
    y = F.col("tip_amount").cast("double").alias("y")
    return rounded(both.select("trip_key", "is_valid", y, *COLS), *COLS)


@query(
    "d24_median_fill",
    S.from_clean("""
SELECT trip_key, coalesce(CAST(congestion_surcharge AS DOUBLE),
    (SELECT quantile_cont(CAST(congestion_surcharge AS DOUBLE), 0.5) FROM clean))
    AS congestion_surcharge,
  coalesce(CAST(airport_fee AS DOUBLE),
    (SELECT quantile_cont(CAST(airport_fee AS DOUBLE), 0.5) FROM clean)) AS airport_fee
FROM clean"""),
)
def median_fill(spark, sf):
    names = ["congestion_surcharge", "airport_fee"]
    rows = features.to_numbers(clean(spark, sf).select("trip_key", *names), names)
    return ops.fill_medians(rows, names)


_SCALED = ["trip_distance", "duration_min", "fare_amount"]


@query(
    "d25_standard_scaling",
    S.from_clean(
        "SELECT trip_key, is_valid, " + ", ".join(
            f"""round(({c} - (SELECT avg({c}) FROM train_rows))
  / (SELECT stddev_pop({c}) FROM train_rows), 6) AS {c}""" for c in _SCALED)
        + " FROM typed",
        _SPLIT,
    ),
)
def standard_scaling(spark, sf):
    parts = _split(spark, sf).select("trip_key", "is_valid", *_SCALED)
    scaler = ops.as_scaler(ops.fit_scaler(parts.where("NOT is_valid"), _SCALED))
    return rounded(ops.scale(parts, scaler), *_SCALED)
