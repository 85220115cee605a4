"""Wall-clock arithmetic on trip timestamps.

All differences are built from date and clock fields, so the same numbers come out for
``timestamp_ntz`` columns under any session time zone.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise import constants as C

_DAY_ONE = "0001-01-01 00:00:00"


def wall_seconds(ts: Column) -> Column:
    """Whole seconds on the wall clock since 0001-01-01, fractions dropped.

    One reference to ``ts`` keeps the expression small when Catalyst inlines it into filters.
    """
    since = ts.cast("timestamp_ntz") - F.lit(_DAY_ONE).cast("timestamp_ntz")
    return since.cast("interval second").cast("bigint")


def wall_minutes(ts: Column) -> Column:
    """Whole minutes on the wall clock since 0001-01-01."""
    return F.call_function("div", wall_seconds(ts), F.lit(60))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed from start to end."""
    return wall_seconds(end) - wall_seconds(start)


def minutes_crossed(start: Column, end: Column) -> Column:
    """Minute boundaries crossed; 00:00:59 to 00:01:01 is one."""
    return wall_minutes(end) - wall_minutes(start)


def iso_weekday(ts: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(ts) + 1


def is_weekend(ts: Column) -> Column:
    return iso_weekday(ts).isin(*C.WEEKEND_DAYS)


def _hour_in(ts: Column, spans: tuple[tuple[int, int], ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.hour(ts).between(*span) for span in spans])


def is_rush_hour(ts: Column) -> Column:
    return _hour_in(ts, C.RUSH_HOURS)


def is_night(ts: Column) -> Column:
    return _hour_in(ts, C.NIGHT_HOURS)
