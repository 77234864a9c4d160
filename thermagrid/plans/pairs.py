"""Same-day pairs of fine rows and coarse pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import decimal_hour
from ..functions.core import number
from ..operators.contract import PAIR_COLUMNS, require_columns
from ..operators.near_space import nearest_site


def chosen_acquisitions(fine: DataFrame, coarse: DataFrame, max_hours: float,
                        by: Sequence[str] = ()) -> DataFrame:
    """Per day, the coarse acquisition closest to the day's median fine hour
    (ties to the earlier one); days further apart than ``max_hours`` drop out.

    ``fine`` has (date, hour), ``coarse`` (date, acquired, hour).
    """
    day = [*by, "date"]
    medians = fine.groupBy(*day).agg(F.median("hour").alias("_median"))
    acquisitions = coarse.groupBy(*day, "acquired").agg(F.min("hour").alias("hour"))
    gap = F.abs(F.col("hour") - F.col("_median"))
    best = (acquisitions.join(medians, day, "inner").groupBy(*day)
            .agg(F.min_by(F.struct("acquired", "hour", gap.alias("gap")),
                          F.struct(gap, F.col("acquired"))).alias("b")))
    return best.where(F.col("b.gap") <= F.lit(float(max_hours))).select(
        *day, F.col("b.acquired").alias("acquired"), F.col("b.hour").alias("hour_sentinel"))


def same_day_pairs(fine: DataFrame, coarse: DataFrame, *, max_hours: float = 2.0,
                   by: Sequence[str] = ()) -> DataFrame:
    """Each fine row with the nearest pixel of its day's chosen acquisition.

    fine: node_id, date, acquisition_dt_utc, latitude, longitude, LST_K
    coarse: date, acquisition_dt_utc, latitude, longitude, LST_1km
    The day is gated on the median hour; every row keeps its own hour. With ``by``
    (the area) both tables have it, days and pixels are those of the row's group,
    and its columns come first.
    """
    by = list(by)
    require_columns(fine, ["node_id", "date", "acquisition_dt_utc", "latitude", "longitude",
                           "LST_K"], "fine rows")
    require_columns(coarse, ["date", "acquisition_dt_utc", "latitude", "longitude", "LST_1km"],
                    "coarse rows")
    f = fine.where(F.col("date").isNotNull()).select(
        *by, F.col("node_id").cast("string").alias("node_id"), "date",
        F.col("acquisition_dt_utc").alias("acquired"), "latitude", "longitude",
        number("LST_K").alias("lst"), decimal_hour("acquisition_dt_utc").alias("hour"))
    c = coarse.select(
        *by, "date", F.col("acquisition_dt_utc").alias("acquired"), "latitude", "longitude",
        number("LST_1km").alias("lst_coarse"), decimal_hour("acquisition_dt_utc").alias("hour"),
    ).dropna(subset=["date", "latitude", "longitude", "lst_coarse", "hour"])
    chosen = chosen_acquisitions(f, c, max_hours, by)
    sites = c.drop("hour").join(chosen, [*by, "date", "acquired"], "inner")
    # Fine rows on one spot of a day share their pixel: search places, join back.
    places = f.select(*by, "date", "latitude", "longitude").distinct()
    found = nearest_site(
        places, sites, query_id=["latitude", "longitude"], query_uv=("latitude", "longitude"),
        site_uv=("latitude", "longitude"), payload=["lst_coarse", "hour_sentinel"],
        tie=["latitude", "longitude", "lst_coarse"], by=[*by, "date"], metric="scaled_degrees",
        distance="_d")
    paired = f.join(found, [*by, "date", "latitude", "longitude"], "inner").dropna(
        subset=["lst", "lst_coarse"])
    return paired.select(
        *by, F.col("node_id").alias(PAIR_COLUMNS[0]), F.col("date").alias(PAIR_COLUMNS[1]),
        F.col("lst").alias(PAIR_COLUMNS[2]), F.col("lst_coarse").alias(PAIR_COLUMNS[3]),
        F.col("hour").alias(PAIR_COLUMNS[4]), F.col("hour_sentinel").alias(PAIR_COLUMNS[5]))
