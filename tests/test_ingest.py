from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.sources import results, trips


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        trips.monthly_files(spark, f"{tmp_path}/none-*.parquet")


def test_months_with_different_schemas_combine(spark, tmp_path):
    start = datetime(2019, 1, 1)
    spark.createDataFrame([(start, 1, 2.0)], "tpep_pickup_datetime timestamp_ntz, "
                          "passenger_count bigint, fare_amount double").write.parquet(
        f"{tmp_path}/trips-2019-01.parquet")
    spark.createDataFrame([(start, 2.5, 3.0, 1.25), (start, None, 4.0, None)],
                          "tpep_pickup_datetime timestamp_ntz, passenger_count double, "
                          "fare_amount double, airport_fee double").write.parquet(
        f"{tmp_path}/trips-2019-02.parquet")
    out = trips.combine_year(spark, f"{tmp_path}/trips-2019-*.parquet", 2019)
    types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert types == {**C.RAW_COLUMNS, "year": "int"}
    rows = {r["fare_amount"]: r for r in out.collect()}
    assert rows[2.0]["passenger_count"] == 1.0 and rows[2.0]["airport_fee"] is None
    assert rows[3.0]["airport_fee"] == 1.25 and rows[4.0]["passenger_count"] is None


def test_projection_reads_only_the_wanted_columns(spark, tmp_path):
    spark.range(3).select("id", F.lit(1).alias("fare_amount"), F.lit("x").alias("note")
                          ).write.parquet(f"{tmp_path}/one.parquet")
    out = trips.read_months(spark, [f"{tmp_path}/one.parquet"], {"fare_amount": "double"})
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<fare_amount:int>" in plan


def test_sink_round_trip_prunes_years_and_reconciles(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2019), (2.0, 2019), (3.0, 2020)], "v double, year int")
    trips.write_trips(df, f"{tmp_path}/out")
    one = trips.read_clean(spark, f"{tmp_path}/out", 2019, ["v"])
    assert sorted(r["v"] for r in one.collect()) == [1.0, 2.0]
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "(year#" in plan and "PartitionFilters" in plan
    lost = trips.reconcile(df, trips.read_clean(spark, f"{tmp_path}/out").where("v > 1"))
    assert {(r["year"], r["rows_in"], r["rows_out"], r["rows_lost"]) for r in lost.collect()} == {
        (2019, 2, 1, 1), (2020, 1, 1, 0)}


def test_row_ids_are_unique_among_copies(spark, tmp_path):
    spark.range(100).select(F.lit(7).alias("v")).repartition(3).write.parquet(f"{tmp_path}/copies")
    ids = trips.with_row_id(spark, f"{tmp_path}/copies")
    assert ids.select("row_id").distinct().count() == 100


def test_csv_keeps_commas_quotes_and_nulls(spark, tmp_path):
    rows = [(1, 'say "hi", all'), (2, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    results.write_csv(df, f"{tmp_path}/t")
    back = results.read_csv(spark, f"{tmp_path}/t", "a int, b string").orderBy("a").collect()
    assert [tuple(r) for r in back] == rows


def test_flatten_and_stack(spark):
    nested = spark.sql("select 1 as year, named_struct('b', 2, 'c', named_struct('d', 3)) as a")
    assert results.flatten(nested).columns == ["year", "a_b", "a_c_d"]
    other = spark.sql("select 0 as year, 5 as extra")
    rows = results.stack_years([results.flatten(nested), other]).collect()
    assert [r["year"] for r in rows] == [0, 1] and rows[0]["a_b"] is None and rows[1]["extra"] is None


def test_hand_over_files_go_to_the_configured_folder(spark):
    from meterwise.session import checkpoint_dir

    assert spark.conf.get("spark.checkpoint.dir") in checkpoint_dir(spark)
