"""Feature queries: fills, labels, encodings and the model matrix."""

from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import _declared_once, clean, raw
from meterwise.functions import labels
from meterwise.functions.numeric import clipped_log1p
from meterwise.operators import features as ops

KEY = "trip_key"


def hour_case(column: str = "pickup_hour") -> str:
    return f"""CASE WHEN {column} < 3 THEN 'Late Night' WHEN {column} < 6 THEN 'Airport Rush'
WHEN {column} < 15 THEN 'Daytime' WHEN {column} < 20 THEN 'Evening Commute' ELSE 'Nightlife' END"""


# The sample with fills, as the encoder sees it.
SAMPLE = f"""
sample AS (
  SELECT trip_key, CAST(passenger_count AS INT) AS passenger_count,
    CAST(rate_code AS INT) AS rate_code, coalesce(pickup_borough, 'Unknown') AS pickup_borough,
    {hour_case()} AS hour_bin, monthname(pickup_datetime) AS month_cat,
    dayname(pickup_datetime) AS dow_name,
    CAST(weekend AS INT) AS weekend, CAST(is_airport_trip AS INT) AS is_airport_trip,
    CAST(rush_hour AS INT) AS rush_hour, CAST(night_trip AS INT) AS night_trip,
    CAST(trip_distance AS DOUBLE) AS trip_distance, CAST(duration_min AS DOUBLE) AS duration_min,
    CAST(speed_mph AS DOUBLE) AS speed_mph, CAST(fare_amount AS DOUBLE) AS fare_amount,
    {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in C.SURCHARGE_COLUMNS)},
    CAST(tip_amount AS DOUBLE) AS tip_amount, CAST(tip_rate AS DOUBLE) AS tip_rate,
    CAST(total_amount AS DOUBLE) AS total_amount
  FROM clean
)"""

# At the checked scales all five regions occur, so these are the boroughs beyond the fixed order.
EXTRA_BOROUGHS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NUMERIC = [
    "passenger_count", "rate_code", "weekend", "is_airport_trip", "trip_distance", "duration_min",
    "speed_mph", "fare_amount", "extra", "mta_tax", "improvement_surcharge",
    "congestion_surcharge", "airport_fee", "tolls_amount",
]
DUMMIES = (
    [("hour_" + v, "hour_bin", v) for v in C.HOUR_LABELS[1:]]
    + [("month_" + v, "month_cat", v) for v in C.MONTHS[1:]]
    + [("borough_" + v, "pickup_borough", v) for v in C.BOROUGHS[1:] + EXTRA_BOROUGHS]
)
DUMMY_SQL = ", ".join(f"""CAST({c} = '{v}' AS INT) AS "{n}\"""" for n, c, v in DUMMIES)
MATRIX = SAMPLE + f""",
matrix AS (
  SELECT trip_key, tip_amount AS y, {", ".join(NUMERIC)}, {DUMMY_SQL} FROM sample
)"""
FEATURES = NUMERIC + [n for n, _, _ in DUMMIES]


@_declared_once
def model_sample(spark, sf):
    return ops.model_sample(clean(spark, sf), [KEY])


@_declared_once
def encoded(spark, sf):
    return ops.encode_model_features(model_sample(spark, sf))[0]


@_declared_once
def matrix(spark, sf):
    return ops.build_model_matrix(encoded(spark, sf), "tip_amount", [KEY])


@_declared_once
def segment_rows(spark, sf):
    return ops.segment_frame(ops.segment_sample(clean(spark, sf), [KEY]))[0]


@query(
    "b26_unknown_text",
    S.from_clean("""SELECT trip_key, coalesce(dropoff_borough, 'Unknown') AS dropoff_borough,
coalesce(dropoff_zone_name, 'Unknown') AS dropoff_zone_name FROM clean"""),
)
def unknown_text(spark, sf):
    names = ["dropoff_borough", "dropoff_zone_name"]
    return ops.fill_unknown(clean(spark, sf).select(KEY, *names), names)


@query(
    "b27_zero_surcharges",
    S.from_clean("SELECT trip_key, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in C.SURCHARGE_COLUMNS) + " FROM clean"),
)
def zero_surcharges(spark, sf):
    return ops.fill_zero(clean(spark, sf).select(KEY, *C.SURCHARGE_COLUMNS))


@query(
    "b28_boolean_coercion",
    S.from_clean("""SELECT trip_key, coalesce(dropoff_borough = 'ASIA', false) AS weekend
FROM clean"""),
)
def boolean_coercion(spark, sf):
    """Numeric flags with nulls (an unmatched drop-off zone) become plain booleans."""
    flag = (F.col("dropoff_borough") == "ASIA").cast("int").alias("weekend")
    return ops.fill_false(clean(spark, sf).select(KEY, flag))


@query(
    "b29_numeric_coercion",
    """SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS event_type,
TRY_CAST(substr(props, 7, 2) AS DOUBLE) AS code FROM events""",
)
def numeric_coercion(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = events.select("event_id", "event_type", F.substring("props", 7, 2).alias("code"))
    return ops.to_numbers(text, ["event_type", "code"])


@query(
    "b30_log_target",
    S.from_clean("SELECT trip_key, round(ln(1 + tip_amount), 9) AS log_tip FROM sample", SAMPLE),
)
def log_target(spark, sf):
    return encoded(spark, sf).select(KEY, F.round("log_tip", 9).alias("log_tip"))


@query(
    "b31_hour_bins",
    S.from_clean(f"""SELECT trip_key, CAST(pickup_hour AS INT) AS pickup_hour,
{hour_case()} AS hour_bin FROM clean"""),
)
def hour_bins(spark, sf):
    hour = F.col("pickup_hour").cast("int")
    return clean(spark, sf).select(
        KEY, hour.alias("pickup_hour"), labels.hour_bin(hour).alias("hour_bin")
    )


@query(
    "b32_weekday_name",
    """SELECT event_id, CASE WHEN event_id % 9 BETWEEN 1 AND 7
  THEN list_extract(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'],
                    event_id % 9) ELSE 'Unknown' END AS dow_name FROM events""",
)
def weekday_name(spark, sf):
    """Codes 0 and 8 are outside the week and become Unknown."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", labels.weekday_name(F.col("event_id") % 9).alias("dow_name"))


@query(
    "b33_month_name",
    """SELECT event_id, CASE WHEN event_id % 14 BETWEEN 1 AND 12
  THEN monthname(make_date(2000, CAST(event_id % 14 AS INT), 1)) ELSE 'Unknown' END AS month_name
FROM events""",
)
def month_name(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", labels.month_name(F.col("event_id") % 14).alias("month_name"))


@query(
    "b34_one_hot_fixed_order",
    S.from_clean(f"SELECT trip_key, {DUMMY_SQL} FROM sample", SAMPLE),
)
def one_hot_fixed_order(spark, sf):
    return encoded(spark, sf).select(KEY, *[f"`{n}`" for n, _, _ in DUMMIES])


_OBSERVED = ", ".join(
    [f"""CAST(hour_bin = '{v}' AS INT) AS "hour_{v}\"""" for v in C.HOUR_LABELS]
    + [f"""CAST(dow_name = '{v}' AS INT) AS "day_{v}\"""" for v in C.WEEKDAYS]
    + [f"""CAST(month_cat = '{v}' AS INT) AS "month_{v}\"""" for v in C.MONTHS]
)


@query(
    "b35_one_hot_observed",
    S.from_clean(f"SELECT trip_key, {_OBSERVED} FROM sample", SAMPLE),
)
def one_hot_observed(spark, sf):
    rows = segment_rows(spark, sf)
    names = [c for c in rows.columns if c.startswith(("hour_", "day_", "month_"))]
    return rows.select(KEY, *[f"`{c}`" for c in names if c != "month_num"])


@query(
    "b36_model_encoder",
    S.from_clean(
        f"""SELECT trip_key, {", ".join(n for n in NUMERIC)}, {DUMMY_SQL}, tip_amount,
round(tip_rate, 9) AS tip_rate, total_amount, round(ln(1 + tip_amount), 9) AS log_tip
FROM sample""",
        SAMPLE,
    ),
)
def model_encoder(spark, sf):
    rows = ops.to_numbers(encoded(spark, sf), ["trip_distance", "duration_min", "speed_mph"])
    return rows.withColumns(
        {
            "passenger_count": F.col("passenger_count").cast("int"),
            "rate_code": F.col("rate_code").cast("int"),
            "is_airport_trip": F.col("is_airport_trip").cast("int"),
            "tip_rate": F.round(F.col("tip_rate").cast("double"), 9),
            "log_tip": F.round("log_tip", 9),
        }
    )


@query("b37_model_matrix", S.from_clean("SELECT * FROM matrix", MATRIX))
def model_matrix(spark, sf):
    narrow = ["passenger_count", "rate_code"]
    rows = matrix(spark, sf).withColumns({c: F.col(c).cast("int") for c in narrow})
    return ops.to_numbers(rows, ["trip_distance", "duration_min", "speed_mph"])


@query(
    "b38_rate_percent",
    S.from_clean("SELECT trip_key, CAST(tip_rate AS DOUBLE) * 100 AS tip_rate_pct FROM clean"),
)
def rate_percent(spark, sf):
    return segment_rows(spark, sf).select(KEY, "tip_rate_pct")


@query(
    "b39_behaviour_frame",
    S.from_clean(
        f"""SELECT trip_key, fare_amount, tolls_amount, CAST(passenger_count AS DOUBLE)
  AS passenger_count, trip_distance, duration_min, speed_mph, tip_rate * 100 AS tip_rate_pct,
  is_airport_trip, CAST(is_airport_trip AS DOUBLE) AS is_airport_trip_num, weekend, rush_hour,
  night_trip, {_OBSERVED} FROM sample""",
        SAMPLE,
    ),
)
def behaviour_frame(spark, sf):
    drop = ["tip_rate", "pickup_hour", "dow", "month_num", "pickup_borough", "pickup_zone_name",
            "dropoff_borough", "dropoff_zone_name"]
    return segment_rows(spark, sf).drop(*drop)


@query(
    "b41_plain_names",
    S.from_clean(
        "SELECT trip_key, " + ", ".join(
            f"CAST(hour_bin = '{v}' AS INT) AS hour_{v.replace(' ', '_')}"
            for v in C.HOUR_LABELS[1:]) + " FROM sample",
        SAMPLE,
    ),
)
def plain_names(spark, sf):
    rows = encoded(spark, sf)
    names = [f"`{c}`" for c in rows.columns if c.startswith("hour_")]
    return ops.plain_names(rows.select(KEY, *names))


@query(
    "b42_clipped_log",
    S.from_raw("""
SELECT trip_key, round(ln(1 + greatest(tip_amount - 1, 0)), 9) AS log_tip_over_one,
  round(ln(1 + greatest(trip_distance - 5, 0)), 9) AS log_far_miles FROM raw"""),
)
def clipped_log(spark, sf):
    return raw(spark, sf).select(
        KEY,
        F.round(clipped_log1p(F.col("tip_amount") - 1), 9).alias("log_tip_over_one"),
        F.round(clipped_log1p(F.col("trip_distance") - 5), 9).alias("log_far_miles"),
    )
