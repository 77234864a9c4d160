"""Hourly and daily series: de-accumulation, rolling sums, gaps, calendars."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import MICROS_PER_HOUR, interval_end_day, micros
from ..functions.core import clip, number
from ..functions.weather import NON_NEGATIVE_TOTALS


def regional_mean(df: DataFrame, time: str, values: Sequence[str],
                  by: Sequence[str] = ()) -> DataFrame:
    """Mean over the cells of a region, per time step."""
    return df.where(F.col(time).isNotNull()).groupBy(*by, time).agg(
        *[F.avg(number(v)).alias(v) for v in values])


def with_previous_row(df: DataFrame, by: Sequence[str], time: str,
                      values: Sequence[str], prefix: str = "_prev_") -> DataFrame:
    """The previous row's time and values, if it lies in the same or the
    preceding UTC day.

    The window is one (key, day), so a long series is spread over its days; a
    day's first row takes the preceding day's last row through a join.
    """
    by = list(by)
    days = df.withColumn("_day", F.to_date(F.col(time).cast("timestamp")))
    row = Window.partitionBy(*by, "_day").orderBy(time)
    names = [time, *values]
    last = days.where(F.col(time).isNotNull()).groupBy(*by, "_day").agg(
        F.max_by(F.struct(*names), F.col(time)).alias("_last"))
    last = last.withColumn("_day", F.date_add("_day", 1))
    inside = days.withColumn("_lag", F.lag(F.struct(*names)).over(row))
    joined = inside.join(last, [*by, "_day"], "left")
    before = F.coalesce("_lag", "_last")
    return joined.select(*df.columns, *[before[n].alias(prefix + n) for n in names])


def deaccumulate(df: DataFrame, columns: Iterable[str], *, time: str, by: Sequence[str] = (),
                 non_negative: Sequence[str] = NON_NEGATIVE_TOTALS) -> DataFrame:
    """Running totals that restart after 00 UTC to hourly increments.

    01 UTC is already an increment. Elsewhere the previous row is subtracted if
    it is exactly one hour older; after a gap the increment is unknown (NULL).
    """
    columns = [c for c in dict.fromkeys(columns) if c in df.columns]
    numeric = df.withColumns({c: number(c) for c in columns})
    paired = with_previous_row(numeric, by, time, columns)
    one_hour = micros(time) - micros(f"_prev_{time}") == F.lit(MICROS_PER_HOUR)
    first_step = F.hour(time) == 1

    def increment(c: str) -> Column:
        value = F.when(first_step, F.col(c)).when(one_hour, F.col(c) - F.col(f"_prev_{c}"))
        return clip(value, low=0.0) if c in non_negative else value

    return paired.withColumns({c: increment(c) for c in columns}).select(*df.columns)


def densify_days(daily: DataFrame, day: str, fill: dict[str, float],
                 by: Sequence[str] = ()) -> DataFrame:
    """Every day between a key's first and last one; new days get ``fill``."""
    by = list(by)
    span = daily.where(F.col(day).isNotNull()).groupBy(*by).agg(
        F.min(day).alias("_a"), F.max(day).alias("_b"))
    calendar = span.where(F.col("_a").isNotNull()).select(
        *by, F.explode(F.sequence("_a", "_b")).alias(day))
    joined = calendar.join(daily, [*by, day], "left")
    return joined.select(*by, day, *[F.coalesce(F.col(c), F.lit(v)).alias(c)
                                     for c, v in fill.items()])


def rolling_day_sum(daily: DataFrame, day: str, value: str, days: int, out: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """Sum over the day and the ``days - 1`` before it, on a gap-free series.

    Every day hands its value to the days it counts for; the sums combine
    before the shuffle and need no ordered window over a whole series.
    """
    by = list(by)
    given = daily.select(*by, F.col(value).alias("_v"), F.explode(F.sequence(
        F.col(day), F.date_add(day, days - 1))).alias(day))
    sums = given.groupBy(*by, day).agg(F.sum("_v").alias(out))
    return daily.join(sums, [*by, day], "left")


def daily_rain(hourly: DataFrame, *, time: str, precip_mm: str = "precip_mm",
               by: Sequence[str] = ()) -> DataFrame:
    """Day totals (midnight closes the day before), three-day sum, log and flag."""
    by = list(by)
    totals = (
        hourly.where(F.col(time).isNotNull())
        .groupBy(*by, interval_end_day(time).alias("day"))
        .agg(F.coalesce(F.sum(precip_mm), F.lit(0.0)).alias("rain_1d"))
    )
    dense = densify_days(totals, "day", {"rain_1d": 0.0}, by)
    rolled = rolling_day_sum(dense, "day", "rain_1d", 3, "rain_3d", by)
    return rolled.select(*by, "day", "rain_1d", "rain_3d", *[
        c.alias(n) for n, c in rain_flags("rain_3d").items()])


def rain_flags(rain: str = "rain_3d", suffix: str = "") -> dict[str, Column]:
    value = number(rain)
    return {
        f"rain_3d_log{suffix}": F.log1p(clip(value, low=0.0)),
        f"is_rainy{suffix}": F.when(value.isNotNull(), (value > 0).cast("int")),
    }


def with_rain_features(df: DataFrame) -> DataFrame:
    """Add the log and the flag only where an older table lacks them."""
    if "rain_3d" not in df.columns:
        return df
    return df.withColumns({n: c for n, c in rain_flags().items() if n not in df.columns})


def expand_days(df: DataFrame, day: str, before: int = 2, after: int = 1,
                by: Sequence[str] = ()) -> DataFrame:
    """Distinct days from ``before`` days earlier to ``after`` days later."""
    return df.where(F.col(day).isNotNull()).select(*by, day).distinct().select(
        *by, F.explode(F.sequence(F.date_sub(day, before), F.date_add(day, after))).alias(day)
    ).distinct()


def contiguous_ranges(df: DataFrame, day: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct days to half-open [range_start, range_end) runs.

    After ``distinct`` a key has at most as many rows as the calendar has days.
    """
    by = list(by)
    days = df.where(F.col(day).isNotNull()).select(*by, day).distinct()
    order = Window.partitionBy(*by).orderBy(day)
    islands = days.withColumn("_island", F.date_sub(
        F.col(day), F.row_number().over(order)))
    return islands.groupBy(*by, "_island").agg(
        F.min(day).alias("range_start"), F.date_add(F.max(day), 1).alias("range_end")
    ).drop("_island")


def days_per_request(cells: Column, bands: Column, budget: int = 750_000) -> Column:
    per_day = F.lit(24) * cells * F.greatest(F.lit(1), bands + 4)
    days = F.floor(F.lit(budget) / F.greatest(per_day, F.lit(1))).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(184), days))


def split_ranges(df: DataFrame, max_days: Column, start: str = "range_start",
                 end: str = "range_end") -> DataFrame:
    """Cut every half-open range in pieces of at most ``max_days`` days."""
    pieces = df.withColumn("_n", max_days).withColumn("_offset", F.explode(
        F.sequence(F.lit(0), F.datediff(end, start) - 1, F.col("_n"))))
    return pieces.withColumn("_s", F.date_add(start, F.col("_offset"))).withColumn(
        end, F.least(F.col(end), F.date_add("_s", F.col("_n")))
    ).withColumn(start, F.col("_s")).drop("_n", "_offset", "_s")


def season_windows(years: DataFrame, year: str, start_md: tuple[int, int],
                   end_md: tuple[int, int]) -> DataFrame:
    """One window per distinct year; a season may run over the new year."""
    crosses = end_md < start_md
    distinct = years.where(F.col(year).isNotNull()).select(
        F.col(year).cast("int").alias(year)).distinct()
    last_year = F.col(year) + 1 if crosses else F.col(year)
    return distinct.select(
        year,
        F.make_date(F.col(year), F.lit(start_md[0]), F.lit(start_md[1])).alias("start_date"),
        F.make_date(last_year, F.lit(end_md[0]), F.lit(end_md[1])).alias("end_date"))


def missing_keys(wanted: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(available.select(*keys).distinct(),
                                                list(keys), "left_anti")


def key_coverage(wanted: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct wanted keys, how many are available, how many not."""
    have = available.select(*keys).distinct().withColumn("_have", F.lit(1))
    joined = wanted.select(*keys).distinct().join(have, list(keys), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("target_keys"),
        F.count("_have").alias("complete_keys"),
        (F.count(F.lit(1)) - F.count("_have")).alias("missing_keys"))
