"""Landed weather rows to hourly and daily tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import weather as w
from ..operators.contract import require_columns
from ..operators.series import daily_rain, deaccumulate, regional_mean


def weather_tables(raw: DataFrame, *, requested: Iterable[str] = (), running_totals: bool,
                   time: str = "era5_dt_utc", by: Sequence[str] = ()
                   ) -> tuple[DataFrame, DataFrame]:
    """Cell rows to (hourly outputs, daily rain) per region.

    ``running_totals`` tells whether flux fields accumulate over the day and
    must be differenced; server increments must not.
    """
    requested = list(requested)
    fields = w.short_names(requested)
    require_columns(raw, [time, *fields], "weather rows")
    regional = regional_mean(raw, time, fields, by)
    if running_totals:
        regional = deaccumulate(regional, w.accumulated_short_names(requested), time=time, by=by)
    hourly = w.with_weather_outputs(regional).withColumn(
        "era5_dt_utc", F.col(time).cast("timestamp"))
    return hourly, daily_rain(hourly, time=time, by=by)
