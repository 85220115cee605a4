"""Numeric helpers with the rounding and null rules the results rely on."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, digits: int) -> Column:
    """Round a double with ties away from zero, working on the binary value.

    ``F.round`` goes through a decimal string of the double, which is both slower and
    different on ties such as 1.005.
    """
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def round_half_even(x: Column, digits: int) -> Column:
    """Round a double with ties to the even neighbour, as array libraries do."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def safe_ratio(num: Column, den: Column) -> Column:
    """Double division that gives null on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rounded_code(code: Column) -> Column:
    """Turn a numeric code into an int by rounding (a plain cast would truncate)."""
    return F.round(code.cast("decimal(18,3)"), 0).cast("int")


def to_tinyint(x: Column) -> Column:
    """Double to tinyint, ties to even, null when it does not fit."""
    return F.rint(x).try_cast("tinyint")


def clip(x: Column, low, high) -> Column:
    """Clip to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, _lit(low)), _lit(high)))


def capped(x: Column, cap: float) -> Column:
    """Null becomes 0, then clip to [0, cap]."""
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(cap))


def clipped_log1p(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))


def sample_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population skewness; null below three rows."""
    nd = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; null below four rows."""
    nd = n.cast("double")
    return F.when(n >= 4, (nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6))


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)
