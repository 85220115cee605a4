"""Cleaning queries: every step on its own, then the whole cleaner."""

from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import (
    CLEAN_SQL,
    clean,
    gated,
    plain,
    plain_sql,
    rated,
    raw,
    valid,
    zones,
)
from meterwise.operators import cleaning as ops
from meterwise.functions.numeric import rounded_code
from meterwise.sources import driver_tables as dt

KEY = "trip_key"
_RENAMED_TYPES = {
    "pickup_datetime": "timestamp", "dropoff_datetime": "timestamp", "passenger_count": "double",
    "trip_distance": "double", "rate_code": "int", "pickup_location_id": "int",
    "dropoff_location_id": "int", "fare_amount": "double", "extra": "double",
    "mta_tax": "double", "improvement_surcharge": "double", "congestion_surcharge": "double",
    "airport_fee": "double", "tip_amount": "double", "tolls_amount": "double",
    "total_amount": "double", "payment_type": "int",
}


@query(
    "b01_rename_and_cast",
    S.from_raw(f"""
SELECT {plain_sql(_RENAMED_TYPES)}, trip_key FROM (
  SELECT tpep_pickup_datetime AS pickup_datetime, tpep_dropoff_datetime AS dropoff_datetime,
         RatecodeID AS rate_code, PULocationID AS pickup_location_id,
         DOLocationID AS dropoff_location_id, * EXCLUDE (RatecodeID, PULocationID, DOLocationID)
  FROM raw)"""),
)
def rename_and_cast(spark, sf):
    return plain(ops.rename_and_cast(raw(spark, sf), [KEY]))


@query(
    "b02_validity_filter",
    S.from_valid(
        "SELECT trip_key, year, fare_amount, trip_distance, passenger_count, rate_code FROM valid"
    ),
)
def validity_filter(spark, sf):
    return valid(spark, sf).select(
        KEY, "year", "fare_amount", "trip_distance", "passenger_count", "rate_code"
    )


@query(
    "b03_code_through_numeric",
    """SELECT o_orderkey, CAST(CAST(o_totalprice / 7 AS DECIMAL(18,3)) AS INT) AS code
FROM orders""",
)
def code_through_numeric(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", rounded_code(F.col("o_totalprice") / 7).alias("code"))


@query(
    "b04_time_parts",
    """SELECT event_id, CAST(hour(ts) AS INT) AS pickup_hour, CAST(isodow(ts) AS INT) AS dow,
CAST(month(ts) AS INT) AS month_num FROM events""",
)
def time_parts(spark, sf):
    return _timed_events(spark, sf).select("event_id", "pickup_hour", "dow", "month_num")


@query("b05_weekend_flag", "SELECT event_id, isodow(ts) IN (6, 7) AS weekend FROM events")
def weekend_flag(spark, sf):
    return _timed_events(spark, sf).select("event_id", "weekend")


@query(
    "b06_rush_hour_flag",
    f"SELECT event_id, {S.hour_in('hour(ts)', C.RUSH_HOURS)} AS rush_hour FROM events",
)
def rush_hour_flag(spark, sf):
    return _timed_events(spark, sf).select("event_id", "rush_hour")


@query(
    "b07_night_flag",
    f"SELECT event_id, {S.hour_in('hour(ts)', C.NIGHT_HOURS)} AS night_trip FROM events",
)
def night_flag(spark, sf):
    return _timed_events(spark, sf).select("event_id", "night_trip")


def _timed_events(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return ops.add_time_features(events.withColumnRenamed("ts", "pickup_datetime"))


_MOTION = "WITH" + ",".join([S.RAW, S.VALID]) + """,
motion AS (
  SELECT trip_key, trip_distance, date_diff('second', pickup_datetime, dropoff_datetime) AS secs,
         date_diff('minute', pickup_datetime, dropoff_datetime) AS crossed
  FROM valid)
"""


def _moving(spark, sf):
    return ops.add_motion(ops.add_seconds(valid(spark, sf)))


@query(
    "b08_duration_minutes",
    _MOTION + """SELECT trip_key, secs / 60e0 AS duration_min_raw,
round(secs / 60e0, 2) AS duration_min FROM motion""",
)
def duration_minutes(spark, sf):
    return _moving(spark, sf).select(KEY, "duration_min_raw", "duration_min")


@query(
    "b09_speed_mph",
    _MOTION + """SELECT trip_key, trip_distance / nullif(secs / 3600e0, 0) AS speed_mph_raw,
round(trip_distance / nullif(secs / 3600e0, 0), 2) AS speed_mph FROM motion""",
)
def speed_mph(spark, sf):
    return _moving(spark, sf).select(KEY, "speed_mph_raw", "speed_mph")


@query(
    "b10_minute_boundary_gate",
    _MOTION + f"""SELECT trip_key, crossed AS minutes_crossed FROM motion
WHERE crossed BETWEEN {C.MIN_MINUTES_CROSSED} AND {C.MAX_MINUTES}""",
)
def minute_boundary_gate(spark, sf):
    return _moving(spark, sf).where(ops.duration_gate()).select(KEY, "minutes_crossed")


@query(
    "b11_speed_gate",
    _MOTION + f"""SELECT trip_key, trip_distance / nullif(secs / 3600e0, 0) AS speed_mph_raw
FROM motion WHERE speed_mph_raw BETWEEN 0 AND {C.MAX_SPEED_MPH}""",
)
def speed_gate(spark, sf):
    return _moving(spark, sf).where(ops.speed_gate()).select(KEY, "speed_mph_raw")


@query(
    "b12_airport_flag",
    "WITH" + ",".join([S.RAW, S.ZONES, S.VALID]) + """
SELECT trip_key, """ + S.airport_test("p.zone_name", "d.zone_name") + """ AS is_airport_trip
FROM valid LEFT JOIN zones p ON p.zone_id = pickup_location_id
LEFT JOIN zones d ON d.zone_id = dropoff_location_id""",
)
def airport_flag(spark, sf):
    joined = ops.attach_zones(valid(spark, sf), zones(spark, sf))
    return ops.add_trip_flags(joined).select(KEY, "is_airport_trip")


@query(
    "b13_tip_rate",
    S.from_valid("SELECT trip_key, tip_amount / nullif(fare_amount, 0) AS tip_rate FROM valid"),
)
def tip_rate(spark, sf):
    trips = valid(spark, sf).withColumns(
        {"pickup_zone_name": F.lit(""), "dropoff_zone_name": F.lit("")}
    )
    return ops.add_trip_flags(trips).select(KEY, "tip_rate")


@query(
    "b14_tariff_by_date",
    S.from_valid(f""",{S.TARIFFS}
SELECT trip_key, initial_charge, unit_rate, flat_fare FROM valid JOIN tariffs ON {S.IN_FORCE}"""),
)
def tariff_by_date(spark, sf):
    trips = ops.add_tariff(valid(spark, sf), dt.RULES, F.col("year"))
    return trips.select(KEY, "initial_charge", "unit_rate", "flat_fare")


@query(
    "b15_meter_ticks",
    _MOTION + f"""SELECT trip_key, CAST(floor({S.TICKS}) AS INT) AS min_ticks,
CAST(ceil({S.TICKS}) AS INT) AS max_ticks FROM motion""",
)
def meter_ticks(spark, sf):
    return ops.add_ticks(_moving(spark, sf)).select(KEY, "min_ticks", "max_ticks")


@query(
    "b16_capped_addons", S.from_valid(f" SELECT trip_key, {S.ADDONS} AS capped_addons FROM valid"),
)
def capped_addons(spark, sf):
    return ops.add_ticks(_moving(spark, sf)).select(KEY, "capped_addons")


@query(
    "b17_tick_fare_bounds",
    S.from_rated("SELECT trip_key, min_fare_tick, max_fare_tick FROM rated"),
)
def tick_fare_bounds(spark, sf):
    trips = ops.add_ticks(ops.add_tariff(gated(spark, sf), dt.RULES, F.col("year")))
    return ops.add_tick_fares(trips).select(KEY, "min_fare_tick", "max_fare_tick")


@query(
    "b18_flat_fare_override",
    S.from_rated("SELECT trip_key, rate_code, flat_override FROM rated WHERE rate_code = 2"),
)
def flat_fare_override(spark, sf):
    return rated(spark, sf).where("rate_code = 2").select(KEY, "rate_code", "flat_override")


@query("b19_fare_band", S.from_rated("SELECT trip_key, meter_lo, meter_hi FROM rated"))
def fare_band(spark, sf):
    return rated(spark, sf).select(KEY, "meter_lo", "meter_hi")


@query(
    "b20_tolerance_filter",
    S.from_rated(f"""
SELECT trip_key, fare_amount, {S.LOWEST} AS lowest, {S.HIGHEST} AS highest
FROM rated
WHERE fare_amount BETWEEN {S.LOWEST} AND {S.HIGHEST}"""),
)
def tolerance_filter(spark, sf):
    t = dt.RULES.tolerance
    return rated(spark, sf).where(ops.fare_in_band(t)).select(
        KEY,
        "fare_amount",
        (F.col("meter_lo") * (1.0 - t)).alias("lowest"),
        (F.col("meter_hi") * (1.0 + t)).alias("highest"),
    )


@query(
    "b21_narrow_casts",
    S.from_rated("""
SELECT trip_key, CAST(TRY_CAST(passenger_count * 30.5e0 AS TINYINT) AS INT) AS passenger_count,
  CAST(rate_code AS INT) AS rate_code, CAST(CAST(speed_mph AS FLOAT) AS DOUBLE) AS speed_mph,
  CAST(CAST(tip_rate AS FLOAT) AS DOUBLE) AS tip_rate,
  CAST(CAST(fare_amount AS DECIMAL(9,2)) AS DOUBLE) AS fare_amount,
  CAST(CAST(total_amount AS DECIMAL(9,2)) AS DOUBLE) AS total_amount
FROM rated"""),
)
def narrow_casts(spark, sf):
    trips = rated(spark, sf).withColumn("passenger_count", F.col("passenger_count") * 30.5)
    return plain(ops.narrow(trips, [KEY])).select(
        KEY, "passenger_count", "rate_code", "speed_mph", "tip_rate", "fare_amount", "total_amount"
    )


@query(
    "b22_final_guards",
    S.from_rated(f"""
SELECT trip_key, duration_min, speed_mph, trip_distance FROM rated
WHERE {S.within('duration_min', 0, C.MAX_MINUTES)} AND trip_distance < {C.MAX_MILES} AND speed_mph < {C.MAX_SPEED_MPH}"""),
)
def final_guards(spark, sf):
    return rated(spark, sf).where(ops.final_guards()).select(
        KEY, "duration_min", "speed_mph", "trip_distance"
    )


@query("b23_clean_trips", S.from_clean(f"SELECT {CLEAN_SQL} FROM clean"))
def clean_all(spark, sf):
    return plain(clean(spark, sf))


@query(
    "c01_zones_joined_twice",
    "WITH" + ",".join([S.RAW, S.ZONES, S.VALID]) + """
SELECT trip_key, p.borough AS pickup_borough, p.zone_name AS pickup_zone_name,
       d.borough AS dropoff_borough, d.zone_name AS dropoff_zone_name
FROM valid LEFT JOIN zones p ON p.zone_id = pickup_location_id
LEFT JOIN zones d ON d.zone_id = dropoff_location_id""",
)
def zones_joined_twice(spark, sf):
    return ops.attach_zones(valid(spark, sf), zones(spark, sf)).select(
        KEY, "pickup_borough", "pickup_zone_name", "dropoff_borough", "dropoff_zone_name"
    )
