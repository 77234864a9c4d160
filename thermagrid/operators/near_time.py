"""Nearest-in-time matching.

Both sides are reduced to distinct (key, time) pairs first. Time is cut into
buckets; inside a bucket a running last / next value finds the neighbours, and
a table of bucket edges supplies the neighbour when the bucket has none. No
pair of rows is enumerated, and a hot key is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_time(
    queries: DataFrame,
    candidates: DataFrame,
    *,
    by: Sequence[str] = (),
    time: str,
    candidate_time: str,
    bucket: int,
    tolerance: int | None = None,
    match: str = "match_time",
    gap: str = "time_gap",
    exclude_same: bool = False,
) -> DataFrame:
    """Distinct (by, time) of ``queries`` with the nearest candidate time.

    Times are long columns (days, microseconds ...). Ties go to the earlier
    candidate. ``tolerance`` drops matches that are further away.
    ``exclude_same`` asks for a candidate at a different time.
    """
    by = list(by)
    q = queries.where(F.col(time).isNotNull()).select(
        *by, F.col(time).cast("long").alias("_t")).distinct()
    c = candidates.where(F.col(candidate_time).isNotNull()).select(
        *by, F.col(candidate_time).cast("long").alias("_t")).distinct()
    slot = F.floor(F.col("_t") / F.lit(float(bucket))).cast("long")
    marked = (
        q.withColumn("_q", F.lit(1)).withColumn("_c", F.lit(0))
        .unionByName(c.withColumn("_q", F.lit(0)).withColumn("_c", F.lit(1)))
        .groupBy(*by, "_t").agg(F.max("_q").alias("_q"), F.max("_c").alias("_c"))
        .withColumn("_slot", slot)
    )
    own = F.when(F.col("_c") == 1, F.col("_t"))
    edges = marked.groupBy(*by, "_slot").agg(F.max(own).alias("_max"), F.min(own).alias("_min"))
    # At most (time span / bucket) rows per key, whatever the number of rows.
    slots_up = Window.partitionBy(*by).orderBy("_slot")
    slots_down = Window.partitionBy(*by).orderBy(F.col("_slot").desc())
    upto = (Window.unboundedPreceding, -1)
    edges = edges.select(
        *by, "_slot",
        F.last("_max", ignorenulls=True).over(slots_up.rowsBetween(*upto)).alias("_edge_prev"),
        F.last("_min", ignorenulls=True).over(slots_down.rowsBetween(*upto)).alias("_edge_next"),
    )
    up = Window.partitionBy(*by, "_slot").orderBy("_t")
    down = Window.partitionBy(*by, "_slot").orderBy(F.col("_t").desc())
    last_row = -1 if exclude_same else Window.currentRow
    inside = (
        marked
        .withColumn("_prev", F.last(own, ignorenulls=True).over(
            up.rowsBetween(Window.unboundedPreceding, last_row)))
        .withColumn("_next", F.last(own, ignorenulls=True).over(
            down.rowsBetween(Window.unboundedPreceding, last_row)))
        .where(F.col("_q") == 1)
    )
    joined = inside.join(edges, [*by, "_slot"], "left")
    previous = F.coalesce("_prev", "_edge_prev")
    following = F.coalesce("_next", "_edge_next")
    gap_before, gap_after = F.col("_t") - previous, following - F.col("_t")
    take_before = gap_after.isNull() | (gap_before <= gap_after)
    best = F.when(gap_before.isNull(), following).when(take_before, previous).otherwise(following)
    out = joined.select(*by, F.col("_t").alias(time), best.alias(match))
    out = out.withColumn(gap, F.abs(F.col(match) - F.col(time))).where(F.col(match).isNotNull())
    return out if tolerance is None else out.where(F.col(gap) <= F.lit(int(tolerance)))


def nearest_day(queries: DataFrame, candidates: DataFrame, *, day: str, candidate_day: str,
                by: Sequence[str] = (), tolerance_days: int, match: str = "match_day",
                gap: str = "day_gap") -> DataFrame:
    """``nearest_time`` on dates; returns dates and a whole-day gap."""
    q = queries.select(*by, F.unix_date(day).alias("_day")).distinct()
    c = candidates.select(*by, F.unix_date(candidate_day).alias("_cand")).distinct()
    found = nearest_time(q, c, by=by, time="_day", candidate_time="_cand",
                         bucket=max(1, tolerance_days), tolerance=tolerance_days)
    return found.select(
        *by, F.date_from_unix_date(F.col("_day").cast("int")).alias(day),
        F.date_from_unix_date(F.col("match_time").cast("int")).alias(match),
        F.col("time_gap").cast("int").alias(gap))


def preferred_day(references: DataFrame, catalogue: DataFrame, *, day: str, candidate_day: str,
                  quality: str, by: Sequence[str] = (), max_days: int = 20,
                  preferred: float = 0.80, match: str = "match_day", gap: str = "gap_days",
                  quality_out: str = "coverage") -> DataFrame:
    """Nearest catalogue day within ``max_days``; days of preferred quality win
    over nearer poor ones; equal gaps go to the better, then earlier day.

    ``catalogue`` has one row per (by, day). A reference day meets at most
    2 * max_days + 1 catalogue days, through an equi-join on the shifted day.
    """
    by = list(by)
    days = references.select(*by, day).where(F.col(day).isNotNull()).distinct()
    shifted = days.withColumn("_cand", F.explode(F.sequence(
        F.date_sub(day, max_days), F.date_add(day, max_days))))
    cat = catalogue.select(*by, F.col(candidate_day).alias("_cand"), F.col(quality).alias("_q"))
    pairs = shifted.join(cat, [*by, "_cand"], "inner").withColumn(
        "_gap", F.abs(F.datediff("_cand", day)))
    order = F.struct((F.coalesce(F.col("_q"), F.lit(0.0)) < F.lit(preferred)).alias("poor"), F.col("_gap"),
                     (-F.col("_q")).alias("q"), F.col("_cand"))
    best = pairs.groupBy(*by, day).agg(
        F.min_by(F.struct("_cand", "_gap", "_q"), order).alias("_best"))
    return days.join(best, [*by, day], "left").select(
        *by, day, F.col("_best._cand").alias(match), F.col("_best._gap").alias(gap),
        F.coalesce(F.col("_best._q"), F.lit(0.0)).alias(quality_out))


def rows_of_nearest(queries: DataFrame, rows: DataFrame, *, time: str, row_time: str,
                    tolerance_micros: int, bucket_micros: int, by: Sequence[str] = (),
                    gap: str = "time_gap") -> DataFrame:
    """For each query time, every row of the nearest row time within tolerance."""
    found = nearest_time(queries, rows, by=by, time=time, candidate_time=row_time,
                         bucket=bucket_micros, tolerance=tolerance_micros, gap=gap)
    joined = rows.withColumnRenamed(row_time, "match_time")
    return found.join(joined, [*by, "match_time"], "inner").withColumnRenamed(
        "match_time", row_time)

