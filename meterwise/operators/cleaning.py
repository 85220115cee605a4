"""Trip cleaning: validity filter, enrichment, meter check and the narrow output projection.

Each step is one narrow transformation, so Catalyst collapses the whole cleaner into a single
stage: scan with pushed filters, two zone look-ups, one projection.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise import constants as C
from meterwise.functions import fares, labels, timeparts
from meterwise.functions.numeric import (
    round_half_away,
    rounded_code,
    safe_ratio,
    to_tinyint,
)
from meterwise.functions.sizing import broadcast_within

_PASSENGER = "passenger_count"
_RENAMED = {
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
    "RatecodeID": "rate_code",
    "PULocationID": "pickup_location_id",
    "DOLocationID": "dropoff_location_id",
}


def _rate_code(raw: DataFrame) -> Column:
    integral = isinstance(raw.schema["RatecodeID"].dataType, T.IntegralType)
    code = F.col("RatecodeID")
    return code.cast("int") if integral else rounded_code(code)


def validity(raw: DataFrame) -> Column:
    """Card payment, sane distance and money, ordered times, passengers, metered rate code.

    Written on the raw columns so that every simple term reaches the parquet reader.
    """
    pickup, dropoff = F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")
    return (
        (F.col("payment_type") == C.CARD_PAYMENT)
        & (F.col("trip_distance") > 0)
        & (F.col("trip_distance") < C.MAX_MILES)
        & (F.col("fare_amount") > 0)
        & (F.col("tip_amount") >= 0)
        & pickup.isNotNull()
        & dropoff.isNotNull()
        & (dropoff > pickup)
        & (F.col(_PASSENGER) > 0)
        & _rate_code(raw).isin(*C.METERED_RATE_CODES)
    )


def rename_and_cast(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw names and types to the working names and types."""
    columns = []
    for name, kind in C.RAW_COLUMNS.items():
        value = _rate_code(raw) if name == "RatecodeID" else F.col(name)
        if kind != "timestamp_ntz" and name != "RatecodeID":
            value = value.cast(kind)
        columns.append(value.alias(_RENAMED.get(name, name)))
    return raw.select(*columns, *keep)


def valid_trips(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return rename_and_cast(raw.where(validity(raw)), keep)


def zone_table(zones: DataFrame) -> DataFrame:
    """The zone dimension with its fixed types."""
    return zones.select(*[F.col(n).cast(t).alias(n) for n, t in C.ZONE_COLUMNS.items()])


def attach_zones(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Left join the zone dimension for pickup and for drop-off; unmatched trips stay."""
    small = broadcast_within(zone_table(zones).select("zone_id", "borough", "zone_name"))
    for side in ("pickup", "dropoff"):
        look_up = small.select(
            F.col("zone_id").alias(f"{side}_location_id"),
            F.col("borough").alias(f"{side}_borough"),
            F.col("zone_name").alias(f"{side}_zone_name"),
        )
        trips = trips.join(look_up, f"{side}_location_id", "left")
    return trips


def add_time_features(trips: DataFrame) -> DataFrame:
    pickup = F.col("pickup_datetime")
    return trips.withColumns(
        {
            "pickup_hour": F.hour(pickup),
            "dow": timeparts.iso_weekday(pickup),
            "month_num": F.month(pickup),
            "weekend": timeparts.is_weekend(pickup),
            "rush_hour": timeparts.is_rush_hour(pickup),
            "night_trip": timeparts.is_night(pickup),
        }
    )


def add_seconds(trips: DataFrame) -> DataFrame:
    start, end = F.col("pickup_datetime"), F.col("dropoff_datetime")
    return trips.withColumns(
        {
            "seconds": timeparts.seconds_between(start, end),
            "minutes_crossed": timeparts.minutes_crossed(start, end),
        }
    )


def add_motion(trips: DataFrame) -> DataFrame:
    """Duration in minutes and speed in miles per hour, raw and rounded to two places."""
    seconds = F.col("seconds").cast("double")
    speed = safe_ratio(F.col("trip_distance"), seconds / 3600.0)
    return trips.withColumns(
        {
            "duration_min_raw": seconds / 60.0,
            "duration_min": round_half_away(seconds / 60.0, 2),
            "speed_mph_raw": speed,
            "speed_mph": round_half_away(speed, 2),
        }
    )


def duration_gate() -> Column:
    return F.col("minutes_crossed").between(C.MIN_MINUTES_CROSSED, C.MAX_MINUTES)


def speed_gate() -> Column:
    return F.col("speed_mph_raw").between(0, C.MAX_SPEED_MPH)


def add_trip_flags(trips: DataFrame) -> DataFrame:
    return trips.withColumns(
        {
            "is_airport_trip": labels.mentions_airport(
                F.col("pickup_zone_name"), F.col("dropoff_zone_name")
            ),
            "tip_rate": safe_ratio(F.col("tip_amount"), F.col("fare_amount")),
        }
    )


def add_tariff(trips: DataFrame, rules: fares.FareRules, year: Column) -> DataFrame:
    pickup = F.col("pickup_datetime")
    return trips.withColumns(
        {
            part: fares.tariff_column(rules, part, year, pickup)
            for part in ("initial_charge", "unit_rate", "flat_fare")
        }
    )


def add_ticks(trips: DataFrame) -> DataFrame:
    """Meter ticks rounded down and up, and the capped add-on total."""
    units = fares.meter_units(F.col("trip_distance"), F.col("duration_min_raw") * 60.0)
    return trips.withColumns(
        {
            "min_ticks": F.floor(units).cast("int"),
            "max_ticks": F.ceil(units).cast("int"),
            "capped_addons": fares.capped_addons(),
        }
    )


def add_tick_fares(trips: DataFrame) -> DataFrame:
    return trips.withColumns(
        {
            f"{end}_fare_tick": F.col("initial_charge") + F.col("unit_rate") * F.col(f"{end}_ticks")
            for end in ("min", "max")
        }
    )


def add_flat_override(trips: DataFrame, rules: fares.FareRules) -> DataFrame:
    return trips.withColumn("flat_override", fares.flat_fare(rules, F.col("flat_fare")))


def add_fare_band(trips: DataFrame) -> DataFrame:
    """Lowest and highest plausible fare; add-ons widen the high side only."""
    low, high, flat = F.col("min_fare_tick"), F.col("max_fare_tick"), F.col("flat_override")
    return trips.withColumns(
        {
            "meter_lo": F.coalesce(
                flat, F.greatest(F.col("initial_charge"), F.least(low, high))
            ),
            "meter_hi": F.coalesce(flat, F.greatest(low, high)) + F.col("capped_addons"),
        }
    )


def fare_in_band(tolerance: float) -> Column:
    low = F.col("meter_lo") * (1.0 - tolerance)
    high = F.col("meter_hi") * (1.0 + tolerance)
    return F.col("fare_amount").between(low, high)


def narrow(trips: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cast to the compact output types; only the passenger count may overflow to null."""
    columns = [
        (to_tinyint(F.col(n)) if n == _PASSENGER else F.col(n).cast(t)).alias(n)
        for n, t in C.CLEAN_COLUMNS.items()
    ]
    return trips.select(*columns, *keep)


def final_guards() -> Column:
    """Strict limits on the rounded values."""
    duration = F.col("duration_min")
    return (
        (duration > 0)
        & (duration < C.MAX_MINUTES)
        & (F.col("trip_distance") < C.MAX_MILES)
        & (F.col("speed_mph") < C.MAX_SPEED_MPH)
    )


def gated_trips(raw: DataFrame, zones: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Valid trips inside the duration and speed gates, with zone, time and motion columns."""
    trips = add_motion(add_seconds(valid_trips(raw, keep)))
    trips = trips.where(duration_gate() & speed_gate())
    return add_trip_flags(add_time_features(attach_zones(trips, zones)))


def rated_trips(
    raw: DataFrame,
    zones: DataFrame,
    rules: fares.FareRules | None = None,
    keep: Sequence[str] = ("year",),
) -> DataFrame:
    """Gated trips with tariff, ticks, add-ons, flat override and fare band."""
    rules = rules or fares.FareRules()
    trips = add_ticks(add_tariff(gated_trips(raw, zones, keep), rules, F.col("year")))
    return add_fare_band(add_flat_override(add_tick_fares(trips), rules))


def clean_trips(
    raw: DataFrame,
    zones: DataFrame,
    rules: fares.FareRules | None = None,
    keep: Sequence[str] = ("year",),
) -> DataFrame:
    """The whole cleaner. ``raw`` carries a ``year`` column naming the table year of each row."""
    rules = rules or fares.FareRules()
    keep = list(dict.fromkeys(["year", *keep]))
    rated = rated_trips(raw, zones, rules, keep)
    return narrow(rated.where(fare_in_band(rules.tolerance) & final_guards()), keep)
