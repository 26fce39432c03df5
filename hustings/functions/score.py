"""Rounding and clamping used by scores and annotations."""

from pyspark.sql import Column, functions as F


def round_half_up(x: Column, digits: int = 2) -> Column:
    """floor(x·10ⁿ + ½)/10ⁿ in binary arithmetic, as scores are published."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def round_hundredths(x: Column) -> Column:
    """Round the exact value of a non-negative double to 2 places, ties to even.

    2.675 is a little less than that in binary and becomes 2.67, where `round` and
    `bround` look at the decimal text and see a tie. The double is split in two halves
    whose products with 200 are exact, and compared with the odd number between the
    two candidates.
    """
    shifted = x * 134217729.0
    high = shifted - (shifted - x)
    low = x - high
    below = F.floor(x * 100.0).cast("double")
    side = (high * 200.0 - (below * 2.0 + 1.0)) + low * 200.0
    even = below % 2.0 == 0.0
    return F.when((side < 0) | ((side == 0) & even), below).otherwise(below + 1.0) / 100.0
