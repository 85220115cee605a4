"""Hand-over tables in the shared checkpoint folder, and the row key used to rejoin results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.session import checkpoint_dir


def hand_over(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later plans start from files that every executor can reach, with known sizes and prunable
    columns; a lost executor costs a re-read instead of the work above it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """A key from id and text: rows that share both are interchangeable, others differ."""
    return F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
        F.lit(":"),
        F.hex(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))),
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened by underscores until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
