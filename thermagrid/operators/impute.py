"""Fill a missing value from the nearest other acquisition's nearest pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MICROS_PER_HOUR, micros
from .near_space import nearest_site
from .near_time import nearest_time


def fill_from_nearest_time(df: DataFrame, *, row_id: Sequence[str], time: str, value: str,
                           lat: str = "latitude", lon: str = "longitude",
                           by: Sequence[str] = (), flag: str = "filled",
                           bucket_micros: int = 24 * MICROS_PER_HOUR) -> DataFrame:
    """Null values take the nearest pixel of the nearest different acquisition
    that has values. Only original values are donors; when that acquisition
    has no located donor the value stays null. ``flag`` marks filled rows.
    """
    by = list(by)
    rows = df.withColumn("_t", micros(time))
    donors = rows.where(F.col(value).isNotNull() & F.col("_t").isNotNull())
    holes = rows.where(F.col(value).isNull() & F.col("_t").isNotNull())
    times = nearest_time(holes, donors, by=by, time="_t", candidate_time="_t",
                         bucket=bucket_micros, exclude_same=True,
                         match="_donor", gap="_gap").drop("_gap")
    wanted = holes.select(*dict.fromkeys([*by, *row_id]), "_t", lat, lon).join(
        times, [*by, "_t"], "inner")
    sites = donors.select(*by, F.col("_t").alias("_donor"), *dict.fromkeys(row_id),
                          F.col(lat).alias("_slat"), F.col(lon).alias("_slon"),
                          F.col(value).alias("_fill"))
    keys = list(dict.fromkeys([*by, *row_id]))
    found = nearest_site(wanted, sites, query_id=keys, query_uv=(lat, lon),
                         site_uv=("_slat", "_slon"), payload=["_fill"], tie=list(row_id),
                         by=[*by, "_donor"], metric="scaled_degrees", distance="_d")
    fills = found.select(*keys, "_fill")
    return df.join(fills, keys, "left").withColumn(
        flag, (F.col(value).isNull() & F.col("_fill").isNotNull()).cast("int")).withColumn(
        value, F.coalesce(value, "_fill")).drop("_fill")
