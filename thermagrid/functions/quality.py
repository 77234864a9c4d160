"""Bit masks, scene classes and the coarse-pixel quality cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, finite

# Product flag layout and accepted ranges.
FINE_QA_BITS = (3, 4, 5, 7)
MASKED_SCENE_CLASSES = (3, 8, 9, 10, 11)
COARSE_CLOUD_BIT = 14
COARSE_LST_RANGE_K = (223.0, 360.0)
COARSE_MAX_UNCERTAINTY_K = 5.0
# End of fixed values.


def bits_clear(flags: str | Column, bits: tuple[int, ...]) -> Column:
    mask = reduce(lambda acc, bit: acc | (1 << bit), bits, 0)
    return col(flags).bitwiseAND(F.lit(mask)) == 0


def bit_set(flags: str | Column, bit: int) -> Column:
    return col(flags).bitwiseAND(F.lit(1 << bit)) != 0


def fine_pixel_clear(qa: str | Column) -> Column:
    return bits_clear(qa, FINE_QA_BITS)


def scene_class_kept(scl: str | Column) -> Column:
    return ~col(scl).isin(*MASKED_SCENE_CLASSES)


def rounded_flags(value: str | Column) -> Column:
    """A mean of flags back to an integer; half goes to even, missing is 0."""
    return F.coalesce(F.bround(finite(value), 0), F.lit(0.0)).cast("int")


def coarse_status(lst: str | Column, uncertainty: str | Column, confidence: str | Column,
                  max_uncertainty_k: float = COARSE_MAX_UNCERTAINTY_K) -> Column:
    """``invalid`` / ``cloudy`` / ``valid``; the first failing test names the row."""
    lst, uncertainty = finite(lst), finite(uncertainty)
    low, high = COARSE_LST_RANGE_K
    lst_ok = F.coalesce(lst.between(low, high), F.lit(False))
    unc_ok = F.coalesce(uncertainty.between(0.0, max_uncertainty_k), F.lit(False))
    return (
        F.when(~lst_ok | ~unc_ok, F.lit("invalid"))
        .when(bit_set(rounded_flags(confidence), COARSE_CLOUD_BIT), F.lit("cloudy"))
        .otherwise(F.lit("valid"))
    )
