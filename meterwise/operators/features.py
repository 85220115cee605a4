"""Null fills, labels, one-hot encoding and leakage-safe feature matrices."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise import constants as C
from meterwise.functions import labels


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna("Unknown", present(df, columns))


def fill_zero(df: DataFrame, columns: Sequence[str] = C.SURCHARGE_COLUMNS) -> DataFrame:
    """Surcharges as doubles, null becomes 0."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present(df, columns)}
    )


def fill_false(df: DataFrame, columns: Sequence[str] = C.FLAG_COLUMNS) -> DataFrame:
    """Flags as booleans, null becomes false."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in present(df, columns)}
    )


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles; anything that cannot be read as a number becomes null."""
    return df.withColumns(
        {
            c: F.col(c).try_cast("double")
            if isinstance(df.schema[c].dataType, T.StringType)
            else F.col(c).cast("double")
            for c in present(df, columns)
        }
    )


def model_sample(clean: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The modelling columns of cleaned trips with their null fills."""
    df = clean.select(*keep, *C.MODEL_SAMPLE_COLUMNS)
    df = fill_false(fill_zero(fill_unknown(df, ["pickup_borough"])))
    return to_numbers(df, ["fare_amount", "tip_amount", "total_amount"])


_ZONE_TEXT = ["pickup_borough", "pickup_zone_name", "dropoff_borough", "dropoff_zone_name"]
_SEGMENT_NUMBERS = [
    "fare_amount", "tolls_amount", "passenger_count", "trip_distance", "duration_min",
    "speed_mph", "tip_rate", "pickup_hour", "dow", "month_num",
]


def segment_sample(clean: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The segmentation columns of cleaned trips with their null fills."""
    df = clean.select(*keep, *C.SEGMENT_SAMPLE_COLUMNS)
    return to_numbers(fill_false(fill_unknown(df, _ZONE_TEXT)), _SEGMENT_NUMBERS)


def observed(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct labels of a few label columns, found in one aggregation.

    Meant for label columns (boroughs, weekdays, months) whose domain is a short fixed list.
    """
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


def borough_order(df: DataFrame) -> list[str]:
    """The fixed borough order followed by any other observed borough, sorted."""
    seen = observed(df, ["pickup_borough"])["pickup_borough"]
    return C.BOROUGHS + sorted(set(seen) - set(C.BOROUGHS))


def hour_dummies():
    return labels.one_hot(labels.hour_bin(F.col("pickup_hour")), C.HOUR_LABELS[1:], "hour")


def month_dummies():
    return labels.one_hot(labels.month_name(F.col("month_num")), C.MONTHS[1:], "month")


def borough_dummies(order: Sequence[str]):
    return labels.one_hot(F.col("pickup_borough"), order[1:], "borough")


def encode_model_features(
    df: DataFrame, boroughs: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Log target, one-hot columns without their baseline, and no encoded-away columns.

    Returns the frame and the names of the engineered features.
    """
    order = list(boroughs) if boroughs is not None else borough_order(df)
    dummies = {
        "hour": (hour_dummies(), C.HOUR_LABELS[1:]),
        "month": (month_dummies(), C.MONTHS[1:]),
        "borough": (borough_dummies(order), order[1:]),
    }
    names = [f"{prefix}_{v}" for prefix, (_, values) in dummies.items() for v in values]
    kept = [
        F.col(c).cast("int").alias(c) if c == "weekend" else F.col(c)
        for c in df.columns
        if c not in C.ENCODED_AWAY
    ]
    columns = [c for group, _ in dummies.values() for c in group]
    encoded = df.select(*kept, F.log1p(F.col("tip_amount").cast("double")).alias("log_tip"), *columns)
    return encoded, present(df, ["weekend", "is_airport_trip"]) + names


def build_model_matrix(
    df: DataFrame, target: str = "tip_amount", keys: Sequence[str] = ()
) -> DataFrame:
    """Keys, ``y`` and numeric features; the target family is not among the features."""
    if target not in C.TARGETS:
        raise ValueError(f"target must be one of {C.TARGETS} (got {target})")
    features, bad = [], []
    for f in df.schema.fields:
        if f.name in C.LEAKAGE_COLUMNS or f.name in keys:
            continue
        if isinstance(f.dataType, T.BooleanType):
            features.append(F.col(f"`{f.name}`").cast("int").alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            features.append(F.col(f"`{f.name}`"))
        else:
            bad.append(f.name)
    if bad:
        raise ValueError(f"non-numeric columns in the model matrix: {bad}")
    y = F.col(target).cast("double").alias("y")
    return df.where(F.col(target).isNotNull()).select(*keys, y, *features)


def feature_columns(matrix: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    return [c for c in matrix.columns if c != "y" and c not in keys]


def segment_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Tip percent, one-hot hour bins and observed weekdays and months, 0/1 flags.

    Returns the frame and the names of the descriptive columns.
    """
    named = df.withColumns(
        {
            "tip_rate_pct": F.col("tip_rate").cast("double") * 100.0,
            "_hour": labels.hour_bin(F.col("pickup_hour")),
            "_day": labels.weekday_name(F.col("dow")),
            "_month": labels.month_name(F.col("month_num")),
        }
    )
    seen = observed(named, ["_day", "_month"])
    groups = {"hour": C.HOUR_LABELS, "day": seen["_day"], "month": seen["_month"]}
    dummies = [c for p, values in groups.items() for c in labels.one_hot(F.col(f"_{p}"), values, p)]
    flags = present(named, C.FLAG_COLUMNS)
    kept = [
        F.col(c).cast("int").alias(c) if c in flags else F.col(c)
        for c in named.columns
        if not c.startswith("_")
    ]
    airport = F.col("is_airport_trip").cast("double").alias("is_airport_trip_num")
    names = [f"{p}_{v}" for p, values in groups.items() for v in values]
    descriptive = names + present(named, ["weekend", "rush_hour", "night_trip"])
    return named.select(*kept, *dummies, airport), descriptive


def plain_names(df: DataFrame) -> DataFrame:
    """Column names with underscores instead of spaces."""
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


