"""Source, sink and schema queries. Files they need are written by Spark to the shared folder."""

from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import CLEAN_SQL, RAW_SQL, clean, plain, raw, scratch, zones
from meterwise.operators import cleaning
from meterwise.sources import results, trips


_MONTH_FILES = 4


def cents(c):
    return F.sum(F.round(F.col(c) * 100).cast("bigint"))


def _monthly(spark, sf, label):
    """Raw trips of the table written as one folder per year and month."""
    path = scratch(spark, label)
    tagged = raw(spark, sf).withColumn("month", F.month("tpep_pickup_datetime"))
    # A salt deals each month to several tasks, so a month may hold any share of the rows.
    salt = F.pmod(F.xxhash64("trip_key"), F.lit(_MONTH_FILES))
    months = tagged.repartition(F.col("year"), F.col("month"), salt).drop("trip_key")
    months.write.partitionBy("year", "month").parquet(path)
    return path


@query(
    "a01_multi_file_scan",
    S.from_raw("""
SELECT CAST(count(*) AS BIGINT) AS trips, count(DISTINCT year(tpep_pickup_datetime)) AS years,
CAST(sum(CAST(round(fare_amount * 100) AS BIGINT)) AS BIGINT) AS fare_cents FROM raw"""),
)
def multi_file_scan(spark, sf):
    path = _monthly(spark, sf, "months")
    files = trips.monthly_files(spark, f"{path}/year=*/month=*/*.parquet")
    table = trips.read_months(spark, files)
    return table.agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_distinct(F.year("tpep_pickup_datetime")).alias("years"),
        cents("fare_amount").alias("fare_cents"),
    )


@query(
    "a02_column_projection",
    S.from_raw(f"SELECT {RAW_SQL} FROM raw"),
)
def column_projection(spark, sf):
    path = scratch(spark, "wide")
    wide = raw(spark, sf).withColumn("vendor", F.lit(1)).withColumn("flag", F.lit("N"))
    wide.write.parquet(path)
    return plain(spark.read.parquet(path).select(*C.RAW_COLUMNS))


@query(
    "a03_schema_conform",
    S.from_raw("""
SELECT trip_key, CAST(passenger_count AS DOUBLE) AS passenger_count, RatecodeID,
       CAST(NULL AS DOUBLE) AS airport_fee, payment_type, extra FROM raw"""),
)
def schema_conform(spark, sf):
    loose = raw(spark, sf).drop("airport_fee").withColumns(
        {
            "passenger_count": F.col("passenger_count").cast("bigint"),
            "RatecodeID": F.col("RatecodeID").cast("double"),
            "payment_type": F.col("payment_type").cast("bigint"),
        }
    )
    target = {"trip_key": "string", **C.RAW_COLUMNS}
    return trips.conform(loose, target).select(
        "trip_key", "passenger_count", "RatecodeID", "airport_fee", "payment_type", "extra"
    )


@query(
    "a04_combine_months",
    S.from_raw("""
SELECT CAST(2000 AS INT) AS year, month(tpep_pickup_datetime)::INT AS month, count(*) AS trips,
  count(CASE WHEN month(tpep_pickup_datetime) > 6 THEN airport_fee END) AS with_airport_fee,
  CAST(sum(CAST(passenger_count AS BIGINT)) AS BIGINT) AS passengers,
  CAST(sum(CAST(round(total_amount * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM raw WHERE year = 2000 GROUP BY ALL"""),
)
def combine_months(spark, sf):
    """The first half of the year lacks one column and has another one as an integer."""
    year = raw(spark, sf).where("year = 2000").drop("trip_key", "year")
    year = year.withColumn("month", F.month("tpep_pickup_datetime"))
    path = scratch(spark, "halves")
    older = year.where("month <= 6").drop("airport_fee")
    older = older.withColumn("passenger_count", F.col("passenger_count").cast("bigint"))
    older.write.partitionBy("month").parquet(f"{path}/older")
    year.where("month > 6").write.partitionBy("month").parquet(f"{path}/newer")
    table = trips.combine_year(spark, f"{path}/*/month=*/*.parquet", 2000)
    return table.groupBy("year", F.month("tpep_pickup_datetime").alias("month")).agg(
        F.count(F.lit(1)).alias("trips"),
        F.count("airport_fee").alias("with_airport_fee"),
        F.sum(F.col("passenger_count").cast("bigint")).alias("passengers"),
        cents("total_amount").alias("total_cents"),
    )


@query("a05_parquet_sink", S.from_clean(f"SELECT {CLEAN_SQL} FROM clean"))
def parquet_sink(spark, sf):
    path = scratch(spark, "clean")
    trips.write_trips(clean(spark, sf), path)
    return plain(trips.read_clean(spark, path))


@query(
    "a06_row_reconciliation",
    S.from_clean("""
SELECT r.year, r.n AS rows_in, coalesce(c.n, 0) AS rows_out, r.n - coalesce(c.n, 0) AS rows_lost
FROM (SELECT year, count(*) AS n FROM raw GROUP BY year) r
LEFT JOIN (SELECT year, count(*) AS n FROM clean GROUP BY year) c ON c.year = r.year"""),
)
def row_reconciliation(spark, sf):
    return trips.reconcile(raw(spark, sf), clean(spark, sf))


@query(
    "a07_zone_dimension",
    S.from_zones("SELECT zone_id, borough, zone_name, wkt FROM zones"),
)
def zone_dimension(spark, sf):
    return cleaning.zone_table(zones(spark, sf))


@query(
    "a08_cleaned_scan",
    S.from_clean("""
SELECT trip_key, pickup_borough, CAST(dow AS INT) AS dow, CAST(tip_amount AS DOUBLE) AS tip_amount
FROM clean WHERE year = 1999"""),
)
def cleaned_scan(spark, sf):
    columns = ["trip_key", "pickup_borough", "dow", "tip_amount"]
    return plain(trips.pick(clean(spark, sf), 1999, columns))


@query(
    "a09_csv_sink",
    S.from_zones("SELECT zone_id, borough, zone_name || ', \"' || borough || '\"' AS label FROM zones"),
)
def csv_sink(spark, sf):
    path = scratch(spark, "zones")
    label = F.concat("zone_name", F.lit(', "'), "borough", F.lit('"')).alias("label")
    results.write_csv(zones(spark, sf).select("zone_id", "borough", label), path)
    return results.read_csv(spark, path, "zone_id INT, borough STRING, label STRING")


_YEARLY = """
SELECT year, CAST(pickup_location_id AS INT) AS zone_id, count(*) AS num_trips
FROM clean GROUP BY ALL"""


@query("a10_yearly_csv_source", S.from_clean(_YEARLY))
def yearly_csv_source(spark, sf):
    path = scratch(spark, "yearly")
    counts = clean(spark, sf).groupBy(
        "year", F.col("pickup_location_id").cast("int").alias("zone_id")
    ).agg(F.count(F.lit(1)).alias("num_trips"))
    counts.write.option("header", True).partitionBy("year").csv(path)
    paths = {y: f"{path}/year={y}" for y in range(1995, 2002)}
    return results.read_yearly_csv(spark, paths, "zone_id INT, num_trips BIGINT")


@query(
    "a11_years_stacked",
    S.from_clean("""
SELECT year, count(*) AS trips, CAST(sum(CAST(tip_amount * 100 AS BIGINT)) AS BIGINT) AS tip_cents
FROM clean GROUP BY year"""),
)
def years_stacked(spark, sf):
    """All years in one job: the year is a grouping key, not a loop."""
    return clean(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum((F.col("tip_amount") * 100).cast("bigint")).alias("tip_cents"),
    ).orderBy("year")


@query(
    "a12_flatten_summary",
    S.from_clean("""
SELECT year, count(*) AS train_rows, count(*) FILTER (tip_amount > 0) AS train_tips_given,
  count(*) FILTER (tip_amount = 0) AS train_tips_none, 'none' AS method
FROM clean GROUP BY year"""),
)
def flatten_summary(spark, sf):
    tips = F.struct(
        F.count_if(F.col("tip_amount") > 0).alias("given"),
        F.count_if(F.col("tip_amount") == 0).alias("none"),
    )
    nested = clean(spark, sf).groupBy("year").agg(
        F.lit("none").alias("method"),
        F.struct(F.count(F.lit(1)).alias("rows"), tips.alias("tips")).alias("train"),
    )
    return results.flatten(nested)


@query("d07_row_count", S.from_clean("SELECT count(*) AS n FROM clean"))
def row_count(spark, sf):
    return clean(spark, sf).agg(F.count(F.lit(1)).alias("n"))

