"""Missing-value and numeric rules shared by every column function.

Missing means SQL NULL everywhere inside the engine: NaN is turned into NULL
once, at the scan, because Spark aggregates skip NULL but not NaN.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def number(c: str | Column) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes NULL."""
    return nan_to_null(col(c).try_cast("double"))


def finite(c: str | Column) -> Column:
    """NULL for NULL, NaN and the infinities."""
    c = col(c).try_cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def clean_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN to NULL on every floating column (or the listed ones), one projection."""
    wanted = set(columns) if columns is not None else None
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))
              and (wanted is None or f.name in wanted)]
    return df.withColumns({name: nan_to_null(name) for name in floats}) if floats else df


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` / ``least`` alone skip NULL)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """A zero denominator counts as one, so the numerator comes through."""
    safe = F.when(denominator == 0, F.lit(1.0)).otherwise(denominator)
    return numerator / safe


def round_half_up(c: Column, digits: int = 6) -> Column:
    """Report rounding; ``+ 0.0`` removes the sign of a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def and_all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def complete_case(columns: Iterable[str]) -> Column:
    return and_all(F.col(c).isNotNull() for c in columns)


def first_present(df: DataFrame, names: Iterable[str]) -> Column:
    """First non-null of those alternative columns that the table has."""
    have = [F.col(n) for n in names if n in df.columns]
    if not have:
        raise ValueError(f"none of the columns {list(names)} is present")
    return F.coalesce(*have)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row. A plain Column used
    inside a lambda would be computed again for every array element."""
    return F.element_at(F.transform(F.array(value), body), 1)
