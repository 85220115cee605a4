import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.operators import zone_stats as ops
from tests.conftest import by

TRIPS = "pickup_location_id int, tip_amount decimal(9,2), fare_amount decimal(9,2), year int"


def trips(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame(
        [(z, Decimal(str(t)), Decimal(str(f)), y) for z, t, f, y in rows], TRIPS
    )


def zone_rows(spark, ids):
    return spark.createDataFrame([(i, "B", f"Z{i}", "P") for i in ids],
                                 "zone_id int, borough string, zone_name string, wkt string")


def test_reliability_at_its_edges(spark):
    df = spark.createDataFrame(
        [(49, 0.1, 2.0), (50, 0.1, 2.0), (99, 5.0, 2.0), (100, 50.0, 2.0), (50, 1.3, 0.0),
         (50, 1.5, 0.0)],
        "n bigint, iqr double, med double",
    )
    got = [r[0] for r in df.select(ops.reliable(F.col("n"), F.col("iqr"), F.col("med"))).collect()]
    # (1.3 / 1.349) / sqrt(50) = 0.1363 and (1.5 / 1.349) / sqrt(50) = 0.1573, median counts as 1.
    assert got == [False, True, False, True, True, False]


def test_zone_table_matches_a_direct_computation(spark):
    rng = np.random.default_rng(3)
    rows = [(7, round(t, 2), round(f, 2), 2019) for t, f in
            zip(rng.exponential(2, 400), 3 + rng.exponential(9, 400), strict=True)]
    rows += [(8, 1.0, 4.0, 2019)] * 60 + [(264, 1.0, 10.0, 2019)] * 200 + [(9, 1.0, 6.0, 2019)]
    out = ops.zone_tip_stats(trips(spark, rows), zone_rows(spark, [7, 8, 9, 10])).collect()
    assert [r["zone_id"] for r in out] == [7, 8, 9, 10]
    got = by(out, "zone_id")
    tips = np.array([r[1] for r in rows[:400]])
    fares = np.array([r[2] for r in rows[:400]])
    rates = (tips / fares)[fares >= 5]
    clipped = np.clip(rates, *np.quantile(rates, [0.01, 0.99]))
    assert got[7]["avg_tip"] == pytest.approx(tips.mean())
    assert got[7]["med_tip"] == pytest.approx(np.median(tips))
    assert got[7]["avg_rate"] == pytest.approx(clipped.mean() * 100)
    assert got[7]["avg_rate_revenue"] == pytest.approx(tips.sum() / fares.sum() * 100)
    assert got[7]["num_trips"] == 400
    # All fares below the floor: the rate is unknown but the zone has statistics.
    assert got[8]["avg_rate"] is None and got[8]["avg_tip"] == pytest.approx(1.0)
    # One trip is not reliable, and a zone without trips still appears.
    assert got[9]["num_trips"] is None and got[10]["avg_tip"] is None


def test_all_years_in_one_job(spark):
    rows = [(7, 2.0, 10.0, 2019)] * 100 + [(7, 3.0, 10.0, 2020)] * 120
    out = ops.zone_tip_stats(trips(spark, rows), zone_rows(spark, [7, 8]), ["year"]).collect()
    assert {(r["year"], r["zone_id"], r["num_trips"]) for r in out} == {
        (2019, 7, 100), (2020, 7, 120), (2019, 8, None), (2020, 8, None)}


def test_a_year_without_reliable_zones_keeps_its_rows(spark):
    rows = [(7, 2.0, 10.0, 2019)] * 100 + [(7, 3.0, 10.0, 2020)] * 3 + [(40_000, 1.0, 8.0, 2020)]
    out = ops.zone_tip_stats(trips(spark, rows), zone_rows(spark, [7, 40_000]), ["year"]).collect()
    assert {(r["year"], r["zone_id"], r["num_trips"]) for r in out} == {
        (2019, 7, 100), (2019, 40_000, None), (2020, 7, None), (2020, 40_000, None)}


def test_group_winsorise_keeps_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 0.3), (3, 0.0), (3, 1.0)],
                               "zone_id int, r double")
    got = ops.winsorise_by_group(df, ["zone_id"], "r", (0.25, 0.75)).collect()
    assert sorted((r["zone_id"], r["r_w"]) for r in got if r["r_w"] is not None) == [
        (2, 0.3), (3, 0.25), (3, 0.75)]
    assert sum(r["r_w"] is None for r in got) == 2


def test_robust_range_defaults_and_rate_rules(spark):
    empty = spark.createDataFrame([(None,)], "m double")
    assert ops.robust_range(empty, "m").first()[1:] == (0.0, 1.0)
    narrow = spark.createDataFrame([(-3.0,), (-2.9,)], "m double")
    row = ops.robust_range(narrow, "m", is_rate=True).first()
    assert (row["vmin"], row["vmax"]) == (0.0, 1.0)


def test_position_and_texts(spark):
    df = spark.createDataFrame([(1234.5, 2.0, 12.34, 1500), (None, None, None, None)],
                               "avg_tip double, med_tip double, avg_rate double, num_trips bigint")
    span = spark.createDataFrame([("avg_rate", 10.0, 20.0)], "metric string, vmin double, vmax double")
    rows = ops.display_texts(ops.metric_position(df, "avg_rate", span)).collect()
    assert rows[0]["avg_tip_s"] == "$1,234.50" and rows[0]["avg_rate_s"] == "12.3%"
    assert rows[0]["num_trips_s"] == "1,500"
    assert rows[0]["avg_rate_position"] == pytest.approx(0.234)
    assert rows[1]["avg_rate_position"] is None and rows[1]["num_trips_s"] == "—"
