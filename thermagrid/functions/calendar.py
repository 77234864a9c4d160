"""Time parsing, rounding and calendar features, all under a UTC session."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

MICROS_PER_HOUR = 3_600_000_000
YEAR_PERIOD_DAYS = 365.25


def parse_time(text: str | Column) -> Column:
    """ISO text to timestamp; minute precision needs its own pattern; bad text is NULL."""
    c = col(text).cast("string")
    return F.coalesce(
        F.try_to_timestamp(c),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mmX")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm")),
    )


def parse_day(value: str | Column) -> Column:
    return F.to_date(parse_time(value))


def millis_to_time(ms: str | Column) -> Column:
    return F.timestamp_millis(col(ms).try_cast("long"))


def micros(ts: str | Column) -> Column:
    """Epoch microseconds; zone-less timestamps count as UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def round_to_hour(ts: str | Column) -> Column:
    """Nearest hour; exact half hours go to the even hour."""
    hours = F.bround(micros(ts) / F.lit(float(MICROS_PER_HOUR)), 0).cast("long")
    return F.timestamp_micros(hours * F.lit(MICROS_PER_HOUR))


def floor_to_day(ts: str | Column) -> Column:
    return F.to_date(col(ts).cast("timestamp"))


def interval_end_day(ts: str | Column) -> Column:
    """Day of the interval that ends at ``ts``: midnight closes the day before."""
    return F.to_date(F.timestamp_micros(micros(ts) - F.lit(1)))


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("int")


def decimal_hour(ts: str | Column) -> Column:
    """Hour with minutes and whole seconds as a fraction."""
    ts = col(ts)
    return (F.hour(ts).cast("double") + F.minute(ts) / F.lit(60.0)
            + F.second(ts).cast("double") / F.lit(3600.0))


def minutes_of_day(ts: str | Column) -> Column:
    ts = col(ts)
    return (F.hour(ts) * 60 + F.minute(ts)).cast("double") + F.second(ts) / F.lit(60.0)


def minutes_from_target(ts: str | Column, target_hour: float) -> Column:
    return F.abs(minutes_of_day(ts) - F.lit(float(target_hour) * 60.0))


def within_hours(ts: str | Column, first: int, last: int) -> Column:
    """Whole hours, both ends included."""
    return F.hour(col(ts)).between(first, last)


def season_features(day: str | Column, prefix: str = "") -> dict[str, Column]:
    doy = F.dayofyear(col(day))
    angle = doy * F.lit(2.0 * math.pi) / F.lit(YEAR_PERIOD_DAYS)
    return {
        f"{prefix}day_of_year": doy,
        f"{prefix}sin_doy": F.sin(angle),
        f"{prefix}cos_doy": F.cos(angle),
    }


def hours_between(a: str | Column, b: str | Column) -> Column:
    return F.abs(micros(a) - micros(b)) / F.lit(float(MICROS_PER_HOUR))


def days_between(a: str | Column, b: str | Column) -> Column:
    return F.abs(F.datediff(col(a), col(b)))


def pixel_id(acquired: str | Column, row: str | Column, column: str | Column) -> Column:
    return F.concat_ws("_", F.date_format(col(acquired), "yyyyMMdd'T'HHmm"),
                       col(row).cast("string"), col(column).cast("string"))


def in_windows(day: str | Column, windows: list[tuple[str, str]]) -> Column:
    """OR of inclusive date windows, as half-open ranges that reach the scan."""
    day = col(day)
    condition = F.lit(False)
    for start, end in windows:
        condition = condition | ((day >= F.lit(start).cast("date"))
                                 & (day < F.date_add(F.lit(end).cast("date"), 1)))
    return condition
