"""Reading monthly trip files, bringing them to one schema, and writing yearly tables."""

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise import constants as C


# Only footers are read to learn the schemas, so the driver waits on storage, not on work.
_FOOTER_READERS = 16


def monthly_files(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob on any Hadoop file system; an empty match is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path) or []
    files = sorted(status.getPath().toString() for status in found)
    if not files:
        raise FileNotFoundError(f"no trip files match {pattern}")
    return files


def conform(df: DataFrame, columns: dict[str, str] = C.RAW_COLUMNS) -> DataFrame:
    """Cast to the target types and add the columns a file lacks as typed nulls."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in columns.items()
        ]
    )


def read_months(
    spark: SparkSession, files: Sequence[str], columns: dict[str, str] = C.RAW_COLUMNS
) -> DataFrame:
    """Scan many monthly files as one table with only the wanted columns.

    Files are grouped by schema, because the same column changes its type from month to month;
    each group is one scan, so the number of scans is the number of distinct schemas.
    """
    by_schema: dict[str, list[str]] = {}
    with ThreadPoolExecutor(max_workers=_FOOTER_READERS) as pool:
        schemas = pool.map(lambda file: spark.read.parquet(file).schema.json(), files)
        for file, schema in zip(files, schemas, strict=True):
            by_schema.setdefault(schema, []).append(file)
    parts = [conform(spark.read.parquet(*group), columns) for group in by_schema.values()]
    return reduce(DataFrame.unionByName, parts)


def combine_year(spark: SparkSession, pattern: str, year: int) -> DataFrame:
    """All months of one year, conformed and tagged with the table year."""
    return read_months(spark, monthly_files(spark, pattern)).withColumn("year", F.lit(year))


def write_trips(df: DataFrame, path: str, row_group_mb: int = 128) -> None:
    """ZSTD parquet partitioned by year, with bounded row groups and column statistics."""
    (
        df.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", row_group_mb * 1024 * 1024)
        .partitionBy("year")
        .parquet(path)
    )


def reconcile(source: DataFrame, written: DataFrame, by: str = "year") -> DataFrame:
    """Row counts on both sides per key, with the difference."""
    rows_in = source.groupBy(by).agg(F.count(F.lit(1)).alias("rows_in"))
    rows_out = written.groupBy(by).agg(F.count(F.lit(1)).alias("rows_out"))
    both = rows_in.join(rows_out, by, "full").fillna(0, ["rows_in", "rows_out"])
    return both.withColumn("rows_lost", F.col("rows_in") - F.col("rows_out"))


def read_clean(
    spark: SparkSession, path: str, year: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Chosen columns of the cleaned table; ``year`` prunes partitions."""
    return pick(spark.read.parquet(path), year, columns)


def pick(clean: DataFrame, year: int | None, columns: Sequence[str] | None = None) -> DataFrame:
    if year is not None:
        clean = clean.where(F.col("year") == year)
    return clean.select(*columns) if columns else clean


def with_row_id(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with ``row_id``: file name and row position.

    Stable whatever the number of tasks, unique even among identical rows, and free of any
    shuffle, so it is the sampling key for trips that carry no id of their own.
    """
    df = spark.read.parquet(path)
    return df.withColumn(
        "row_id", F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    )
