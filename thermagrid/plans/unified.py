"""One harmonised row per node and date from the fine and the coarse tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import MICROS_PER_HOUR, micros, parse_day, parse_time, season_features
from ..functions.core import number
from ..operators.contract import (IDENTITY_COLUMNS, MATCH_COLUMNS, QUALITY_COLUMNS, STATIC_COLUMNS, collision_names,
                                  purpose_columns, require_columns)
from ..operators.groups import first_static_value
from ..operators.lookups import dense_panel, observed_panel, written_side
from ..operators.near_space import nearest_site
from ..operators.near_time import nearest_day
from ..operators.ranking import keep_first
from ..operators.reports import report_of_counts
from ..session import cut_lineage, stored

GEOMETRY = ["latitude", "longitude", "x", "y", "row", "col", "row_norm", "col_norm"]
CALENDAR = ["day_of_year", "sin_doy", "cos_doy"]


@dataclass
class Parts:
    """What the panel of nodes and dates is made of.

    nodes: area, node_id, geometry and static values; first: area, node_id, date and the
    day's first fine values; calendar: area, date, the nearest coarse date with its gap,
    and the layout of its pixels; match: area, layout, node_id and the nearest place
    of the layout; pixels: area, coarse date, place and what the panel takes of it.
    """

    area: str
    nodes: DataFrame
    first: DataFrame
    calendar: DataFrame
    match: DataFrame
    pixels: DataFrame
    statics: list[str]
    names: dict[str, str]


def panel_parts(fine: DataFrame, coarse: DataFrame, nodes: DataFrame, *, area: str = "area_id", tolerance_days: int = 2,
                static_columns: Sequence[str] = STATIC_COLUMNS) -> Parts:
    """The parts of the panel; none of them has a row for every node and date."""
    require_columns(fine, [area, "node_id", "date"], "fine table")
    require_columns(coarse, [area, "node_id", "date", "latitude", "longitude"], "coarse table")
    fine = fine.withColumn("date", parse_day("date")).where(F.col("date").isNotNull())
    # A pixel's place is its position and its rank among the day's places in the order that settles equal
    # distances, so that ids that differ from day to day (a time in the id) do not tell places apart.
    science_of = coarse.columns
    tie_order = [c for c in ("row", "col") if c in coarse.columns]
    known = F.lit(True)
    for c in ("latitude", "longitude"):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    of_day = Window.partitionBy(area, "date", "_known").orderBy(*tie_order, "node_id")  # the pixels of a day
    coarse = cut_lineage(
        coarse.withColumn("date", parse_day("date")).where(F.col("date").isNotNull()).withColumn("_known", F.coalesce(known, F.lit(False)))
        .withColumn("_rank", F.dense_rank().over(of_day))
        .withColumn("_place", F.when(F.col("_known"), F.xxhash64("latitude", "longitude", "_rank"))).drop("_known"))
    order = ["acquisition_dt_utc"] if "acquisition_dt_utc" in fine.columns else []
    values = [c for c in fine.columns if c not in {area, "date", "node_id", *GEOMETRY, *CALENDAR}]
    tie = [c for c in values if c not in order]
    first = stored(keep_first(fine.select(area, "node_id", "date", *values), [area, "node_id", "date"], [*order, *tie] or ["date"]))
    if "acquisition_dt_utc" in values:
        first = first.withColumnRenamed("acquisition_dt_utc", "landsat_datetime_utc")
    statics = [c for c in static_columns if c in first.columns]
    nodes_with = nodes
    if statics:
        static = first_static_value(first.withColumn("_node", F.struct(area, "node_id")), "_node", statics, ["date"])
        static = static.select(F.col(f"_node.{area}").alias(area), F.col("_node.node_id").alias("node_id"), *statics)
        nodes_with = nodes.join(static, [area, "node_id"], "left")
    keep = [c for c in GEOMETRY if c in nodes.columns]
    unique_nodes = cut_lineage(keep_first(nodes_with.select(area, "node_id", *keep, *statics), [area, "node_id"], keep or ["node_id"]))
    days = first.select(area, "date").unionByName(coarse.select(area, "date")).distinct()

    # The nearest coarse date is a property of (area, date): it is settled on
    # the table of dates and rides along in the calendar, so that the panel
    # itself needs no join for it.
    day_match = nearest_day(days, coarse, day="date", candidate_day="date", by=[area],
                            tolerance_days=tolerance_days, match="_coarse_date",
                            gap="s3_day_difference")
    # Dates whose places are the same (by a hash of the set, in any order) share one search, that of their first date.
    located = coarse.where("_place IS NOT NULL").select(
        area, F.col("date").alias("_coarse_date"), "_place", "_rank", "latitude", "longitude").distinct()
    layouts = located.groupBy(area, "_coarse_date").agg(
        F.count(F.lit(1)).alias("_n"), *[F.bit_xor(F.xxhash64("_place", F.lit(k))).alias(f"_h{k}") for k in (1, 2)])
    same = Window.partitionBy(area, "_n", "_h1", "_h2")  # dates only
    layouts = layouts.withColumn("_layout", F.min("_coarse_date").over(same)).select(area, "_coarse_date", "_layout")
    calendar = cut_lineage(days.join(day_match, [area, "date"], "left").join(layouts, [area, "_coarse_date"], "left")
                           .select(area, "date", "_coarse_date", "s3_day_difference", "_layout"))
    used = calendar.where("_layout IS NOT NULL").select(area, "_layout").distinct()
    sites = located.withColumnRenamed("_coarse_date", "_layout").join(used, [area, "_layout"], "left_semi").select(
        area, "_layout", "_place", "_rank", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    searches = dense_panel(unique_nodes.select(area, "node_id", "latitude", "longitude"), used, "_layout", area)
    match = stored(nearest_site(
        searches, sites, query_id=["node_id"], query_uv=("latitude", "longitude"), site_uv=("_lat", "_lon"), payload=["_place"],
        tie=["_rank"], by=[area, "_layout"], metric="haversine", distance="sentinel3_distance_m"))

    skip = {area, "date", "node_id", "latitude", "longitude", "row", "col", "row_norm",
            "col_norm", *CALENDAR, "acquisition_dt_utc"}
    science = [c for c in science_of if c not in skip]
    occupied = [area, "node_id", "date", *keep, *statics, *[c for c in first.columns if c not in statics]]
    names = collision_names(science, occupied)
    acquired = (parse_time("acquisition_dt_utc") if "acquisition_dt_utc" in science_of else F.col("date").cast("timestamp"))
    pixels = coarse.where("_place IS NOT NULL").select(
        area, F.col("date").alias("_coarse_date"), "_place", F.col("node_id").alias("sentinel3_pixel_id"),
        acquired.alias("sentinel3_datetime_utc"), F.col("latitude").alias("sentinel3_latitude"),
        F.col("longitude").alias("sentinel3_longitude"), *[F.col(c).alias("s_" + c) for c in science])
    taken = [c for c in pixels.columns if c not in (area, "_coarse_date", "_place")]
    pixels = keep_first(pixels, [area, "_coarse_date", "_place"], taken)
    return Parts(area, unique_nodes, first.drop(*statics), calendar, match, pixels, statics, names)


def unified_table(fine: DataFrame, coarse: DataFrame, nodes: DataFrame, *,
                  area: str = "area_id", tolerance_days: int = 2,
                  purpose: str = "lst_downscaling", requested: Sequence[str] = (),
                  static_columns: Sequence[str] = STATIC_COLUMNS) -> DataFrame:
    """Panel of all nodes on all dates of either sensor, with the day's fine
    values and the nearest pixel of the nearest coarse date.

    Every table has ``area``; ``date`` is a date or ISO text, rows without a
    readable one go, unreadable times are unknown. Areas never mix: the area is
    part of every key.
    """
    parts = panel_parts(fine, coarse, nodes, area=area, tolerance_days=tolerance_days, static_columns=static_columns)
    # The layouts of an area are numbered, so that a node's nearest places are one array in that order:
    # every layout has places, so a node with a position has one in each of them.
    number_of = F.dense_rank().over(Window.partitionBy(area).orderBy("_layout"))  # dates only
    numbers = written_side(parts.calendar.where("_layout IS NOT NULL").select(area, "_layout").distinct().withColumn("_number", number_of))
    nearest = parts.match.join(numbers, [area, "_layout"]).groupBy(area, "node_id").agg(
        F.sort_array(F.collect_list(F.struct("_number", "_place", "sentinel3_distance_m"))).alias("_nearest"))
    calendar = written_side(parts.calendar.join(numbers, [area, "_layout"], "left").drop("_layout"))
    panel = observed_panel(parts.nodes, parts.calendar, parts.first, nearest, "date", area)
    found = F.when(F.col("_number").isNotNull(), F.try_element_at("_nearest", F.col("_number")))
    matched = (panel.join(calendar, [area, "date"], "left")
               .withColumns({"_place": found["_place"], "sentinel3_distance_m": found["sentinel3_distance_m"]}).drop("_nearest")
               .join(written_side(parts.pixels), [area, "_coarse_date", "_place"], "left")
               .withColumn("s3_day_difference", F.when(
                   F.col("sentinel3_pixel_id").isNotNull(), F.col("s3_day_difference")))
               .drop("_coarse_date", "_number", "_place")
               .withColumnsRenamed({"s_" + c: n for c, n in parts.names.items()}))
    finished = _with_validity(matched, purpose)
    return finished.select(*dict.fromkeys(
        [area, *purpose_columns(finished.columns, purpose, requested)]))


def unified_report(fine: DataFrame, coarse: DataFrame, nodes: DataFrame, *, area: str = "area_id", tolerance_days: int = 2,
                   purpose: str = "lst_downscaling", requested: Sequence[str] = (), static_columns: Sequence[str] = STATIC_COLUMNS,
                   failed_items: int = 0) -> DataFrame:
    """``quality_report`` of the unified table without the table: its counts follow from
    nodes, calendar, observations and places.

    A day adds as many rows as its area has nodes; a fine value is there once for
    each observation; a static value once for each day of its node; a coarse value once
    for each day that takes its date and each node whose nearest place it is.
    """
    parts = panel_parts(fine, coarse, nodes, area=area, tolerance_days=tolerance_days, static_columns=static_columns)
    spark = fine.sparkSession
    days = parts.calendar.groupBy(area).agg(F.count(F.lit(1)).alias("_days"))
    known = {c: F.sum(F.when(F.col(c).isNotNull(), F.col("_days")).otherwise(0)) for c in parts.statics}
    whole = parts.nodes.join(days, area).agg(F.sum("_days").alias("rows"), F.count(F.lit(1)).alias("nodes"),
                                             *[v.alias(f"k_{c}") for c, v in known.items()])
    dates = parts.calendar.join(parts.nodes.select(area).distinct(), area, "left_semi").select("date").distinct().count()
    seen = parts.first.join(parts.nodes.select(area, "node_id"), [area, "node_id"], "left_semi")
    values = [c for c in seen.columns if c not in (area, "node_id", "date")]
    observed = seen.agg(*[F.count(c).alias(f"k_{c}") for c in values])
    # Days by coarse date, nodes by place: every pair of them is that many rows.
    taken = parts.calendar.where("_layout IS NOT NULL").groupBy(area, "_coarse_date", "_layout").agg(F.count(F.lit(1)).alias("_times"))
    around = parts.match.groupBy(area, "_layout", "_place").agg(F.count(F.lit(1)).alias("_many"))
    met = taken.join(around, [area, "_layout"]).join(parts.pixels, [area, "_coarse_date", "_place"])
    weight = F.col("_times") * F.col("_many")
    coarse_known = met.agg(*[F.coalesce(F.sum(F.when(F.col("s_" + c).isNotNull(), weight)), F.lit(0)).alias(f"k_{n}")
                             for c, n in parts.names.items()])
    ready = F.lit(0).cast("long")
    if "LST_K" in values and "LST_1km" in parts.names.values():
        source = next(c for c, n in parts.names.items() if n == "LST_1km")
        pairs = (seen.where(number("LST_K").isNotNull()).select(area, "node_id", "date").join(parts.calendar, [area, "date"])
                 .join(parts.match, [area, "_layout", "node_id"]).join(parts.pixels, [area, "_coarse_date", "_place"])
                 .where(number("s_" + source).isNotNull()))
        ready = F.lit(pairs.count())
    counts = {k: v for row in (whole.first(), observed.first(), coarse_known.first()) for k, v in row.asDict().items()}
    rows = counts["rows"] or 0
    columns = [area, "node_id", "date", *[c for c in GEOMETRY if c in parts.nodes.columns], *parts.statics, *values,
               "s3_day_difference", "sentinel3_distance_m", "sentinel3_pixel_id", "sentinel3_datetime_utc", "sentinel3_latitude",
               "sentinel3_longitude", *parts.names.values(), "dataset_purpose", "timestamp_utc", "lst_time_difference_hours",
               "landsat_valid", "sentinel3_valid", "training_ready", *CALENDAR]
    final = dict.fromkeys([area, *purpose_columns(columns, purpose, requested)])
    science = [c for c in final if c not in {*IDENTITY_COLUMNS, *MATCH_COLUMNS, *QUALITY_COLUMNS}]
    gaps = F.array(*[F.struct(F.lit(k - rows).alias("_order"), F.lit(c).alias("column"), F.lit(rows - k).alias("count"))
                     for c, k in ((c, counts.get(f"k_{c}") or 0) for c in science)])
    row = spark.range(1).select(F.lit(rows).cast("long").alias("rows"), ready.cast("long").alias("training_ready_rows"), gaps.alias("_gaps"),
                                F.lit(counts["nodes"]).cast("long").alias("nodes"), F.lit(dates).cast("long").alias("dates"))
    return report_of_counts(row, len(science), purpose, failed_items)


def _with_validity(df: DataFrame, purpose: str) -> DataFrame:
    """Reference time, time gap, validity flags and calendar features."""
    has_fine = number("LST_K") if "LST_K" in df.columns else F.lit(None).cast("double")
    has_coarse = number("LST_1km") if "LST_1km" in df.columns else F.lit(None).cast("double")
    if "landsat_datetime_utc" in df.columns:
        fine_time = parse_time("landsat_datetime_utc")
    else:
        noon = F.timestamp_micros(micros("date") + F.lit(12 * MICROS_PER_HOUR))
        fine_time = F.when(has_fine.isNotNull(), noon)
    coarse_time = F.col("sentinel3_datetime_utc")
    out = df.withColumns({
        "dataset_purpose": F.lit(purpose),
        "timestamp_utc": F.coalesce(fine_time, coarse_time, F.col("date").cast("timestamp")),
        "lst_time_difference_hours": F.abs(micros(coarse_time) - micros(fine_time))
        / F.lit(float(MICROS_PER_HOUR)),
        "landsat_valid": has_fine.isNotNull(), "sentinel3_valid": has_coarse.isNotNull(),
        "training_ready": has_fine.isNotNull() & has_coarse.isNotNull(),
    })
    return out.withColumns(season_features("date"))
