"""Meter arithmetic: tariff by date, ticks, add-ons, flat fare and the plausible fare band."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.functions.numeric import capped


@dataclass(frozen=True)
class Tariff:
    initial_charge: float
    unit_rate: float
    flat_fare: float


@dataclass(frozen=True)
class Revision:
    """A tariff that holds from a moment inside one table year."""

    year: int
    starts_at: str
    tariff: Tariff


@dataclass(frozen=True)
class FareRules:
    """Everything the fare check needs; the defaults are the published city tariff."""

    base: Tariff = Tariff(initial_charge=2.50, unit_rate=0.50, flat_fare=52.0)
    revisions: tuple[Revision, ...] = (
        Revision(2022, "2022-12-19 00:00:00", Tariff(3.00, 0.70, 70.0)),
    )
    flat_zone: Callable[[Column], Column] = field(default=lambda zone: zone == 132)
    flat_borough: str = "Manhattan"
    tolerance: float = C.FARE_TOLERANCE


def tariff_column(rules: FareRules, part: str, year: Column, pickup: Column) -> Column:
    """The charge named ``part`` that is in force for a trip."""
    out = F.lit(getattr(rules.base, part))
    for rev in sorted(rules.revisions, key=lambda r: (r.year, r.starts_at)):
        start = F.lit(rev.starts_at).cast("timestamp_ntz")
        in_force = (year == rev.year) & (pickup >= start)
        out = F.when(in_force, getattr(rev.tariff, part)).otherwise(out)
    return out


def meter_units(distance: Column, seconds: Column) -> Column:
    """Ticks before rounding: the larger of distance ticks and time ticks."""
    return F.greatest(distance / C.MILES_PER_TICK, seconds / C.SECONDS_PER_TICK)


def capped_addons() -> Column:
    total = None
    for name, cap in C.ADDON_CAPS.items():
        part = capped(F.col(name), cap)
        total = part if total is None else total + part
    return total


def flat_fare(rules: FareRules, flat: Column) -> Column:
    """The flat fare for a flat-rate trip between the airport zone and the flat borough."""
    out = rules.flat_zone(F.col("pickup_location_id")) & (
        F.col("dropoff_borough") == rules.flat_borough
    )
    back = rules.flat_zone(F.col("dropoff_location_id")) & (
        F.col("pickup_borough") == rules.flat_borough
    )
    return F.when((F.col("rate_code") == C.FLAT_RATE_CODE) & (out | back), flat)
