"""Adapter that presents the benchmark's order tables as metered trips and zones.

Every lineitem row becomes one raw trip and every supplier one zone, so any query built on the
adapter grows with the tables it reads.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.functions.fares import FareRules, Revision, Tariff

RULES = FareRules(
    revisions=(Revision(2000, "2000-12-19 00:00:00", Tariff(3.00, 0.70, 70.0)),),
    flat_zone=lambda zone: zone % 10 == 7,
    flat_borough="AMERICA",
)
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _d(x) -> Column:
    return F.lit(float(x))


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table that arrives as one split.

    Only the generated test files are that small; a table of several splits is not moved.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() == 1 and slots > 1 else df


def trips_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """17 raw trip columns plus ``year`` and ``trip_key``."""
    items = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    k = F.col("k")
    base = items.select(
        (F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("l_partkey") * 13).alias("k"),
        F.concat_ws("-", *KEY).alias("trip_key"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.col("l_quantity"),
        F.col("l_discount"),
        F.col("l_tax"),
        F.col("l_returnflag"),
        F.col("l_shipdate"),
        (F.col("l_quantity") * _d(3) / _d(10)).alias("trip_distance"),
    )
    seconds = F.floor(F.col("trip_distance") * _d(3600) / (6 + F.col("l_partkey") % 25))
    money = ["fare_amount", "extra", "mta_tax", "improvement_surcharge", "congestion_surcharge",
             "airport_fee", "tip_amount", "tolls_amount"]
    total = None
    for name in money:
        part = F.coalesce(F.col(name), _d(0))
        total = part if total is None else total + part
    ratio = F.greatest(F.col("trip_distance") / _d(0.2), F.abs(F.col("seconds")) / _d(60))
    metered = _d(2.5) + _d(0.5) * ratio * (
        _d(0.6) + (F.col("l_discount") + F.col("l_tax")) * _d(5)
    )
    return (
        base.withColumns(
            {
                "tpep_pickup_datetime": F.expr("timestampadd(SECOND, (k * 37) % 86400, l_shipdate)"),
                "seconds": F.when(k % 50 == 0, -seconds).otherwise(seconds),
                "RatecodeID": F.when(k % 20 == 0, 2).when(k % 20 == 1, 5).otherwise(1),
            }
        )
        .withColumns(
            {
                "tpep_dropoff_datetime": F.expr(
                    "timestampadd(SECOND, seconds, tpep_pickup_datetime)"
                ),
                "passenger_count": (k % 7).cast("double"),
                "PULocationID": F.col("l_suppkey").cast("int"),
                "DOLocationID": F.when(k % 33 == 0, 9999)
                .otherwise(F.col("l_partkey") % 110)
                .cast("int"),
                "payment_type": F.when(F.col("l_returnflag") == "R", 2).otherwise(1),
                "fare_amount": F.when(
                    F.col("RatecodeID") == 2, _d(44) + F.col("l_quantity") / _d(2)
                ).otherwise(F.floor(metered * _d(100)) / _d(100)),
                "extra": (k % 4) * _d(0.5),
                "mta_tax": _d(0.5),
                "improvement_surcharge": _d(0.3),
                "congestion_surcharge": F.when(F.year("l_shipdate") >= 1998, _d(2.5)),
                "airport_fee": F.when(F.col("l_suppkey") % 10 == 3, _d(1.25)),
                "tolls_amount": F.when(k % 15 == 0, _d(5.54)).otherwise(_d(0)),
            }
        )
        .withColumn(
            "tip_amount",
            F.when(k % 9 == 0, _d(0)).otherwise(
                F.floor(F.col("fare_amount") * _d(100) * F.col("l_discount") * _d(3)) / _d(100)
            ),
        )
        .withColumn("total_amount", total)
        .select(*C.RAW_COLUMNS, F.year("l_shipdate").alias("year"), "trip_key")
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One zone per supplier; the nation and region tables have 25 and 5 rows by definition."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    last = F.col("s_suppkey") % 10
    suffix = F.when(last == 3, " Airport").when(last == 7, " JFK").otherwise("")
    return (
        suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("int").alias("zone_id"),
            F.col("r_name").alias("borough"),
            F.concat("s_name", suffix).alias("zone_name"),
            F.concat(F.lit("POINT("), F.col("s_suppkey").cast("string"), F.lit(" 0)")).alias("wkt"),
        )
    )
