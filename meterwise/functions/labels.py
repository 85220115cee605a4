"""Text labels and one-hot columns generated from fixed, ordered category lists."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise import constants as C


def hour_bin(hour: Column) -> Column:
    """Left-closed hour bin label; null outside every bin."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(C.HOUR_BINS):
        out = F.when((hour >= low) & (hour < high), label).otherwise(out)
    return out


def _name_at(index: Column, names: list[str]) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    index = index.cast("int")
    return F.when(index.between(1, len(names)), F.get(table, index - 1)).otherwise("Unknown")


def weekday_name(dow: Column) -> Column:
    return _name_at(dow, C.WEEKDAYS)


def month_name(month: Column) -> Column:
    return _name_at(month, C.MONTHS)


def one_hot(value: Column, categories: Iterable[str], prefix: str) -> list[Column]:
    """One 0/1 column per category; a null value gives 0 everywhere."""
    return [
        F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)).alias(f"{prefix}_{c}")
        for c in categories
    ]


def mentions_airport(*names: Column) -> Column:
    """True when any of the names contains an airport word, whatever its case."""
    pattern = "|".join(C.AIRPORT_WORDS)
    hit = F.lit(False)
    for name in names:
        hit = hit | F.lower(F.coalesce(name, F.lit(""))).rlike(pattern)
    return hit


DASH = "—"


def money_text(v: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(v, 2)), F.lit(DASH))


def percent_text(v: Column) -> Column:
    return F.when(v.isNotNull(), F.format_string("%.1f%%", v)).otherwise(DASH)


def count_text(v: Column) -> Column:
    return F.coalesce(F.format_number(v.cast("bigint"), 0), F.lit(DASH))
