"""Helpers shared by the registered queries."""

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise import constants as C
from meterwise.operators import cleaning
from meterwise.session import checkpoint_dir
from meterwise.sources import driver_tables as dt


_FRAMES: dict[tuple, DataFrame] = {}


def _declared_once(build):
    """Reuse the lazily declared frame (not its data) between queries of one session."""

    @wraps(build)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (build.__name__, spark.sparkContext.applicationId, sf)
        if key not in _FRAMES:
            _FRAMES[key] = build(spark, sf)
        return _FRAMES[key]

    return get


@_declared_once
def raw(spark: SparkSession, sf: str) -> DataFrame:
    return dt.trips_raw(spark, sf)


@_declared_once
def zones(spark: SparkSession, sf: str) -> DataFrame:
    return dt.zones(spark, sf)


@_declared_once
def valid(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.valid_trips(raw(spark, sf), ["year", "trip_key"])


@_declared_once
def gated(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.gated_trips(raw(spark, sf), zones(spark, sf), ["year", "trip_key"])


@_declared_once
def rated(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.rated_trips(raw(spark, sf), zones(spark, sf), dt.RULES, ["year", "trip_key"])


@_declared_once
def clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_trips(raw(spark, sf), zones(spark, sf), dt.RULES, ["year", "trip_key"])


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Widen narrow numbers and render timestamps, so both engines return the same types."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = c.cast("double")
            if digits is not None:
                c = F.round(c, digits)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType)):
            c = c.cast("int")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def plain_sql(types: dict[str, str]) -> str:
    """The SQL projection matching ``plain`` for columns with the given Spark types."""
    parts = []
    for name, kind in types.items():
        if kind.startswith("timestamp"):
            parts.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
        elif kind.startswith("decimal") or kind in ("float", "double"):
            parts.append(f'CAST("{name}" AS DOUBLE) AS "{name}"')
        elif kind in ("tinyint", "smallint"):
            parts.append(f'CAST("{name}" AS INT) AS "{name}"')
        else:
            parts.append(f'"{name}"')
    return ", ".join(parts)


CLEAN_SQL = plain_sql(C.CLEAN_COLUMNS) + ", year, trip_key"
RAW_SQL = plain_sql(C.RAW_COLUMNS)
