from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise import constants as C
from meterwise.functions import labels, timeparts
from meterwise.functions.fares import FareRules, flat_fare
from meterwise.functions.numeric import round_half_away, rounded_code, to_tinyint
from meterwise.operators import cleaning as ops
from tests.conftest import by

SCHEMA = ", ".join(f"{n} {t}" for n, t in C.RAW_COLUMNS.items()) + ", year int, trip_key string"
BASE = {
    "tpep_pickup_datetime": datetime(2019, 5, 6, 12, 0, 0),
    "tpep_dropoff_datetime": datetime(2019, 5, 6, 12, 10, 0),
    "passenger_count": 1.0, "trip_distance": 2.0, "RatecodeID": 1, "PULocationID": 10,
    "DOLocationID": 20, "fare_amount": 8.0, "extra": 0.0, "mta_tax": 0.5,
    "improvement_surcharge": 0.3, "congestion_surcharge": None, "airport_fee": None,
    "tip_amount": 2.0, "tolls_amount": 0.0, "total_amount": 10.8, "payment_type": 1, "year": 2019,
}
ZONES = [(10, "Manhattan", "Midtown", "P"), (20, "Queens", "Astoria", "P"),
         (132, "Queens", "JFK Airport", "P")]


def raw(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        row = {**BASE, "trip_key": str(i), **change}
        rows.append(tuple(row[n] for n in [*C.RAW_COLUMNS, "year", "trip_key"]))
    return spark.createDataFrame(rows, SCHEMA)


def zones(spark):
    return spark.createDataFrame(ZONES, "zone_id int, borough string, zone_name string, wkt string")


def kept(spark, *changes):
    out = ops.clean_trips(raw(spark, *changes), zones(spark), FareRules(), ["year", "trip_key"])
    return {int(r["trip_key"]) for r in out.select("trip_key").collect()}


def at(*clock):
    return datetime(2019, 5, 6, *clock)


def test_validity_terms_drop_one_row_each(spark):
    bad = [
        {"payment_type": 2}, {"trip_distance": 0.0}, {"trip_distance": 100.0},
        {"fare_amount": 0.0}, {"tip_amount": -0.01}, {"tpep_pickup_datetime": None},
        {"tpep_dropoff_datetime": None}, {"tpep_dropoff_datetime": at(12, 0, 0)},
        {"passenger_count": 0.0}, {"passenger_count": None}, {"RatecodeID": 5},
        {"RatecodeID": None},
    ]
    assert kept(spark, {}, *bad) == {0}


def test_minute_gate_counts_boundaries(spark):
    cases = [
        (at(0, 0, 59), at(0, 1, 1), 1),
        (at(0, 0, 1), at(0, 0, 59), 0),
        (at(0, 0, 0), at(5, 0, 59), 300),
        (at(0, 0, 0), at(5, 1, 0), 301),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, a timestamp_ntz, b timestamp_ntz, want int")
    got = df.select("want", timeparts.minutes_crossed(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == r["want"] for r in got)


def test_second_boundaries_and_old_dates(spark):
    df = spark.createDataFrame(
        [(datetime(1969, 12, 31, 23, 59, 59, 900000), datetime(1970, 1, 1, 0, 0, 0, 100000))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert df.select(timeparts.seconds_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_time_differences_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(
            [(datetime(2019, 3, 10, 1, 30), datetime(2019, 3, 10, 3, 30))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        assert df.select(timeparts.seconds_between(F.col("a"), F.col("b"))).first()[0] == 7200
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sixty_miles_per_hour_passes_the_gate_but_not_the_final_guard(spark):
    trips = ops.add_motion(ops.add_seconds(ops.valid_trips(
        raw(spark, {"trip_distance": 10.0}, {"trip_distance": 9.9994}), ["trip_key"])))
    rows = by(trips.select("trip_key", "speed_mph_raw", "speed_mph",
                           ops.speed_gate().alias("gate"), (F.col("speed_mph") < 60).alias("guard")
                           ).collect(), "trip_key")
    assert rows["0"]["gate"] and not rows["0"]["guard"]
    assert rows["1"]["gate"] and rows["1"]["speed_mph"] == 60.0 and not rows["1"]["guard"]


def test_tariff_switches_at_the_cutover_of_its_year_only(spark):
    trips = ops.valid_trips(raw(
        spark,
        *[
            {"tpep_pickup_datetime": start, "tpep_dropoff_datetime": datetime(2022, 12, 20),
             "year": year}
            for start, year in [
                (datetime(2022, 12, 18, 23, 59, 59), 2022), (datetime(2022, 12, 19), 2022),
                (datetime(2022, 12, 19, 0, 0, 1), 2022), (datetime(2022, 12, 19), 2021),
            ]
        ],
    ), ["year", "trip_key"])
    rows = ops.add_tariff(trips, FareRules(), F.col("year")).orderBy("trip_key").collect()
    assert [r["initial_charge"] for r in rows] == [2.5, 3.0, 3.0, 2.5]
    assert [r["unit_rate"] for r in rows] == [0.5, 0.7, 0.7, 0.5]
    assert [r["flat_fare"] for r in rows] == [52.0, 70.0, 70.0, 52.0]


def test_ticks_by_distance_by_time_and_exact(spark):
    df = spark.createDataFrame([(3.1, 2.0), (0.5, 10.5), (2.0, 10.0)],
                               "trip_distance double, duration_min_raw double")
    for c in C.ADDON_CAPS:
        df = df.withColumn(c, F.lit(None).cast("double"))
    rows = ops.add_ticks(df).collect()
    assert [(r["min_ticks"], r["max_ticks"]) for r in rows] == [(15, 16), (10, 11), (10, 10)]
    assert all(r["capped_addons"] == 0 for r in rows)


def test_addons_are_floored_and_capped(spark):
    names = list(C.ADDON_CAPS)
    values = [[99.0 if n == m else None for n in names] for m in names]
    values += [[-1.0] * 5, [0.25] * 5]
    df = spark.createDataFrame([tuple(v) for v in values], ", ".join(f"{n} double" for n in names))
    df = df.withColumns({"trip_distance": F.lit(1.0), "duration_min_raw": F.lit(1.0)})
    got = [r["capped_addons"] for r in ops.add_ticks(df).collect()]
    assert got == [*C.ADDON_CAPS.values(), 0.0, 1.25]


def test_flat_fare_needs_rate_code_airport_zone_and_borough(spark):
    rows = [(2, 132, 10, "Queens", "Manhattan"), (2, 10, 132, "Manhattan", "Queens"),
            (1, 132, 10, "Queens", "Manhattan"), (2, 132, 9, "Queens", None),
            (2, 10, 20, "Manhattan", "Manhattan")]
    df = spark.createDataFrame(rows, "rate_code int, pickup_location_id int, dropoff_location_id "
                               "int, pickup_borough string, dropoff_borough string")
    got = [r[0] for r in df.select(flat_fare(FareRules(), F.lit(52.0))).collect()]
    assert got == [52.0, 52.0, None, None, None]


def test_fare_band_edges_are_inclusive(spark):
    # 2 miles in 10 minutes: exactly 10 ticks, so the meter says 7.50 and 0.80 of add-ons.
    low, high = 7.5 * (1.0 - 0.2), (7.5 + 0.8) * (1.0 + 0.2)
    fares = [low, low - 0.01, high, high + 0.01]
    assert kept(spark, *[{"fare_amount": f} for f in fares]) == {0, 2}


def test_narrow_types_and_passenger_overflow(spark):
    df = spark.createDataFrame([(2.5,), (2.6,), (300.0,), (None,)], "x double")
    assert [r[0] for r in df.select(to_tinyint(F.col("x"))).collect()] == [2, 3, None, None]
    clean = ops.clean_trips(raw(spark, {}), zones(spark))
    types = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    assert {n: types[n] for n in C.CLEAN_COLUMNS} == C.CLEAN_COLUMNS


def test_codes_round_and_money_rounds_away(spark):
    df = spark.createDataFrame([(1.6, 2.675), (1.4, -0.125), (2.0, 0.125)], "c double, x double")
    rows = df.select(rounded_code(F.col("c")), round_half_away(F.col("x"), 2)).collect()
    assert [r[0] for r in rows] == [2, 1, 2]
    assert [r[1] for r in rows] == [2.68, -0.13, 0.13]


def test_unmatched_zone_is_kept_and_is_no_airport(spark):
    out = ops.clean_trips(raw(spark, {"DOLocationID": 9999}, {"PULocationID": 132}), zones(spark),
                          FareRules(), ["trip_key"]).orderBy("trip_key").collect()
    assert out[0]["dropoff_borough"] is None and out[0]["is_airport_trip"] is False
    assert out[1]["is_airport_trip"] is True


def test_hour_bins_are_left_closed(spark):
    hours = [0, 2, 3, 5, 6, 14, 15, 19, 20, 23, None]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    got = [r[0] for r in df.select(labels.hour_bin(F.col("h"))).collect()]
    late, rush, day, evening, night = C.HOUR_LABELS
    assert got == [late, late, rush, rush, day, day, evening, evening, night, night, None]


def test_simple_terms_reach_the_parquet_scan_and_zones_are_broadcast(spark, tmp_path):
    raw(spark, {}).write.parquet(str(tmp_path / "raw"))
    zones(spark).write.parquet(str(tmp_path / "zones"))
    out = ops.clean_trips(spark.read.parquet(str(tmp_path / "raw")),
                          spark.read.parquet(str(tmp_path / "zones")))
    explain = spark._jvm.PythonSQLUtils.explainString
    plan = explain(out._jdf.queryExecution(), "formatted")
    for term in ("EqualTo(payment_type,1)", "LessThan(trip_distance,100.0)",
                 "In(RatecodeID, [1,2])", "GreaterThanOrEqual(tip_amount,0.0)"):
        assert term in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning" not in plan


def test_large_dimension_is_not_broadcast(spark):
    from meterwise.functions.sizing import broadcast_within

    df = spark.range(50)
    assert broadcast_within(df, 10) is df
    hinted = broadcast_within(df, 50)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted.lower()


def test_float_columns_keep_their_32_bit_values(spark):
    clean = ops.clean_trips(raw(spark, {"trip_distance": 2.1}), zones(spark))
    assert isinstance(clean.schema["trip_distance"].dataType, T.FloatType)
    assert clean.select(F.col("trip_distance").cast("double")).first()[0] == 2.0999999046325684
