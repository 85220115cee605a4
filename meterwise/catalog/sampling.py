"""Sampling and splitting queries; md5 order makes both engines pick the same rows."""

from pyspark.sql import functions as F

from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import clean
from meterwise.operators import sampling as ops

KEY = ["trip_key"]


def hashed(seed: int) -> str:
    return f"md5(concat_ws('|', trip_key, '{seed}'))"


def split_sql(seed: int, strata: str = "", source: str = "clean") -> str:
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""SELECT *, row_number() OVER ({part} ORDER BY {hashed(seed)})
  <= ceil(count(*) OVER ({part}) * 0.2e0) AS is_valid FROM {source}"""


def tipped(df):
    return df.withColumn("tipped", (F.col("tip_amount") > 0).cast("int"))


TIPPED = "tipped_rows AS (SELECT *, CAST(tip_amount > 0 AS INT) AS tipped FROM clean)"


@query(
    "g01_fixed_size_sample",
    S.from_clean(f"SELECT trip_key, year FROM clean ORDER BY {hashed(42)} LIMIT 10000"),
)
def fixed_size_sample(spark, sf):
    return ops.take_rows(clean(spark, sf), 10_000, KEY, 42).select("trip_key", "year")


@query(
    "g01_sampled_percent",
    S.from_clean("SELECT count(*) AS total_rows, least(count(*), 2500) AS sample_rows, "
                 "round(least(count(*), 2500) / count(*) * 100, 6) AS sampled_pct FROM clean"),
)
def sampled_percent(spark, sf):
    total = clean(spark, sf)
    size = ops.take_rows(total, 2_500, KEY, 42).agg(F.count(F.lit(1)))
    return total.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", size.scalar().alias("sample_rows")
    ).withColumn("sampled_pct", F.round(F.col("sample_rows") / F.col("total_rows") * 100, 6))


@query(
    "g02_stratified_split",
    S.from_clean(
        f"SELECT trip_key, tipped, is_valid FROM ({split_sql(42, 'tipped', 'tipped_rows')})", TIPPED
    ),
)
def stratified_split(spark, sf):
    rows = ops.split_rows(tipped(clean(spark, sf)), KEY, 0.2, 42, ["tipped"])
    return rows.select("trip_key", "tipped", "is_valid")


_TRAIN = f"""{TIPPED},
train AS (
  SELECT * EXCLUDE (is_valid) FROM ({split_sql(42, 'tipped', 'tipped_rows')}) WHERE NOT is_valid
)"""


def _train(spark, sf):
    rows = ops.split_rows(tipped(clean(spark, sf)), KEY, 0.2, 42, ["tipped"])
    return rows.where("NOT is_valid").drop("is_valid")


@query(
    "g03_inner_holdout_regression",
    S.from_clean(
        f"SELECT trip_key, is_valid FROM ({split_sql(43, '', 'positive')})",
        _TRAIN + ", positive AS (SELECT * FROM train WHERE tipped = 1)",
    ),
)
def inner_holdout_regression(spark, sf):
    positive = _train(spark, sf).where("tipped = 1")
    return ops.split_rows(positive, KEY, 0.2, 43).select("trip_key", "is_valid")


@query(
    "g03_inner_holdout_classification",
    S.from_clean(
        f"SELECT trip_key, tipped, is_valid FROM ({split_sql(43, 'tipped', 'train')})", _TRAIN
    ),
)
def inner_holdout_classification(spark, sf):
    rows = ops.split_rows(_train(spark, sf), KEY, 0.2, 43, ["tipped"])
    return rows.select("trip_key", "tipped", "is_valid")


@query(
    "g04_stratified_cap",
    S.from_clean(
        f"""SELECT trip_key, tipped FROM (
  SELECT *, row_number() OVER (PARTITION BY tipped ORDER BY {hashed(42)}) AS place FROM tipped_rows
) JOIN quotas USING (tipped) WHERE place <= quota""",
        TIPPED + """,
sizes AS (SELECT tipped, count(*) AS n, sum(count(*)) OVER () AS total FROM tipped_rows GROUP BY 1),
shares AS (
  SELECT tipped, CAST(floor(15000e0 * n / total) AS BIGINT) AS base,
         15000e0 * n / total - floor(15000e0 * n / total) AS rest FROM sizes
),
quotas AS (
  SELECT tipped, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, tipped)
    <= 15000 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares
)""",
    ),
)
def stratified_cap(spark, sf):
    rows = ops.cap_stratified(tipped(clean(spark, sf)), 15_000, KEY, "tipped", 42)
    return rows.select("trip_key", "tipped")


@query(
    "g05_capped_export",
    S.from_clean(f"""SELECT trip_key, CAST(tip_amount AS DOUBLE) AS tip_amount
FROM clean ORDER BY {hashed(42)} LIMIT 20000"""),
)
def capped_export(spark, sf):
    rows = ops.cap_rows(clean(spark, sf), 20_000, KEY, 42)
    return rows.select("trip_key", F.col("tip_amount").cast("double").alias("tip_amount"))


@query(
    "g06_metric_subsample",
    S.from_clean(f"""SELECT trip_key FROM clean ORDER BY {hashed(59)} LIMIT 2000"""),
)
def metric_subsample(spark, sf):
    return ops.cap_rows(clean(spark, sf), 2_000, KEY, 59).select("trip_key")
