"""Coarse pixels: product choice, quality filter, fine covariates, final table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import (MICROS_PER_HOUR, micros, minutes_from_target, pixel_id,
                                  within_hours)
from ..functions.quality import coarse_status, rounded_flags
from ..operators.contract import (COARSE_COLUMNS, coarse_renames, ordered, rename_present,
                                  require_and_select)
from ..operators.groups import min_max_axes
from ..operators.impute import fill_from_nearest_time
from ..operators.lookups import dense_panel, maybe_broadcast
from ..operators.near_space import radius_mean
from ..operators.near_time import nearest_time, rows_of_nearest
from ..operators.ranking import first_value_per_column, keep_first
from ..operators.zonal import raster_boxes
from ..session import cut_lineage


def daily_products(products: DataFrame, *, first_hour: int, last_hour: int, target_hour: float,
                   by: Sequence[str] = ()) -> DataFrame:
    """One product per day in the morning window: closest to the target hour,
    then earliest; each column takes its first known value in that order.

    products: Id, acquisition_dt_utc, date and any other columns.
    """
    by = list(by)
    unique = keep_first(products, [*by, "Id"], ["acquisition_dt_utc"])
    morning = unique.where(within_hours("acquisition_dt_utc", first_hour, last_hour)).withColumn(
        "hour_distance", minutes_from_target("acquisition_dt_utc", target_hour))
    return first_value_per_column(morning, ["date", *by],
                                  ["hour_distance", "acquisition_dt_utc", "Id"])


def products_near(daily: DataFrame, references: DataFrame, *, time: str,
                  tolerance_days: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Distinct daily products that are nearest to a reference time of the same
    ``by`` group, among the days within tolerance of the reference day."""
    by = list(by)
    day = F.unix_date(F.to_date(time))
    refs = references.select(*by, time).distinct().withColumn("_t", micros(time))
    cands = daily.withColumn("_c", micros("acquisition_dt_utc"))
    # One product a day, so at most 2 * tolerance + 1 candidates per reference.
    near = refs.withColumn("_day", F.explode(F.sequence(
        day - tolerance_days, day + tolerance_days))).join(
        cands.withColumn("_day", F.unix_date("date")), [*by, "_day"], "inner")
    best = near.groupBy(*by, time).agg(F.min_by(
        F.struct(*daily.columns), F.struct(F.abs(F.col("_c") - F.col("_t")), F.col("_c"))
    ).alias("_p")).select("_p.*")
    return keep_first(best, [*by, "Id"], ["acquisition_dt_utc"])


def nearest_product_times(references: DataFrame, daily: DataFrame, *, time: str,
                          bucket_micros: int, tolerance_micros: int | None = None) -> DataFrame:
    q = references.select(micros(time).alias("_t"))
    c = daily.select(micros("acquisition_dt_utc").alias("_c"))
    return nearest_time(q, c, time="_t", candidate_time="_c", bucket=bucket_micros,
                        tolerance=tolerance_micros)


def with_status(pixels: DataFrame, *, lst: str = "LST", uncertainty: str = "LST_uncertainty",
                confidence: str = "CONFIDENCE", max_uncertainty_k: float = 5.0) -> DataFrame:
    return pixels.withColumn("status", coarse_status(lst, uncertainty, confidence,
                                                     max_uncertainty_k))


def valid_pixels(statistics: DataFrame, products: DataFrame, cells: DataFrame, *,
                 max_uncertainty_k: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Daily cell statistics (row, col, date, bands) to valid coarse pixels.

    The day's product gives time and id; the cell gives position; one row per
    (acquisition, row, col). With ``by`` (the area) all three tables have it and
    groups never meet.
    """
    by = list(by)
    day_product = keep_first(products.select(*by, "date", "Id", "Name", "acquisition_dt_utc"),
                             [*by, "date"], ["acquisition_dt_utc", "Id"])
    rows = (statistics.join(day_product, [*by, "date"], "inner")
            .join(cells.select(*by, "row", "col", "latitude", "longitude"), [*by, "row", "col"], "inner"))
    good = with_status(rows, max_uncertainty_k=max_uncertainty_k).where("status = 'valid'")
    named = good.select(
        *by, pixel_id("acquisition_dt_utc", "row", "col").alias("s3_pixel_id"),
        "latitude", "longitude", F.col("row").alias("s3_row"), F.col("col").alias("s3_col"),
        F.col("Id").alias("s3_product_id"), F.col("Name").alias("s3_product_name"),
        "acquisition_dt_utc", F.col("LST").alias("LST_S3_K"),
        F.col("LST_uncertainty").alias("LST_uncertainty_1km"), F.col("NDVI").alias("NDVI_S3"),
        F.col("CLOUD").alias("s3_cloud"), F.col("BAYES").alias("s3_bayes"),
        F.col("POINTING").alias("s3_pointing"), F.col("CONFIDENCE").alias("s3_confidence"),
        rounded_flags("CONFIDENCE").alias("quality_flag_1km"))
    return keep_first(named, [*by, "acquisition_dt_utc", "s3_row", "s3_col"], ["LST_S3_K"])


def raster_pixels(raster: DataFrame, *, x0: float, y0: float, resolution: float,
                  area_box: tuple[float, float, float, float] | DataFrame,
                  max_uncertainty_k: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Valid pixels of an eight-band pixel table that touch the area's box.

    The box is one (xmin, ymin, xmax, ymax), or a table of ``by`` and these four
    columns, one box for each area of the raster.
    """
    placed = raster_boxes(raster, x0, y0, resolution)
    if isinstance(area_box, DataFrame):
        sides = ["xmin", "ymin", "xmax", "ymax"]
        boxes = area_box.select(*by, F.struct(*sides).alias("_box"))
        placed = placed.join(maybe_broadcast(boxes), list(by), "inner")
        xmin, ymin, xmax, ymax = (F.col(f"_box.{side}") for side in sides)
    else:
        xmin, ymin, xmax, ymax = map(F.lit, area_box)
    boxed = placed.where(
        (F.col("pxmin") <= xmax) & (F.col("pxmax") >= xmin)
        & (F.col("pymin") <= ymax) & (F.col("pymax") >= ymin)
        & (F.col("dataMask") > 0))
    kept = with_status(boxed, max_uncertainty_k=max_uncertainty_k).where("status = 'valid'")
    half = F.lit(resolution / 2)
    return kept.withColumns({
        "x": F.col("pxmin") + half, "y": F.col("pymin") + half,
        "s3_confidence": rounded_flags("CONFIDENCE"),
    }).drop("pxmin", "pymin", "pxmax", "pymax", "status", "_box")


def with_fine_covariates(pixels: DataFrame, scenes: DataFrame, node_static: DataFrame, *,
                         values: Sequence[str], static_values: Sequence[str], radius_m: float,
                         max_days: int, area: str = "area_id") -> DataFrame:
    """Average the nearest scene's node values, and the static node values,
    over a disc around every coarse pixel of the same area.

    pixels: area, s3_pixel_id, acquisition_dt_utc, x, y
    scenes: area, node_id, s2_source_dt_utc, values
    node_static: area, node_id, x, y, statics
    """
    day = 24 * MICROS_PER_HOUR
    keyed = pixels.withColumn("_t", micros("acquisition_dt_utc"))
    wanted = keyed.select(area, "_t").distinct()
    rows = scenes.select(area, "node_id", micros("s2_source_dt_utc").alias("_s"), *values)
    assigned = rows_of_nearest(wanted, rows, time="_t", row_time="_s", by=[area],
                               tolerance_micros=max_days * day, bucket_micros=day)
    # Nodes the scene missed still take part with their static values.
    nodes = dense_panel(node_static, wanted, "_t", area)
    fine = nodes.join(assigned.select(area, "_t", "node_id", *values),
                      [area, "_t", "node_id"], "left")
    means = radius_mean(
        keyed.select(area, "_t", "s3_pixel_id", "x", "y"), fine, target_id=["s3_pixel_id"],
        target_xy=("x", "y"), source_xy=("x", "y"), source_id=["node_id"],
        values=[*values, *static_values], radius=radius_m, by=[area, "_t"],
        suffix="_mean_1km", count="n_nodes_aggregated")
    source = assigned.groupBy(area, "_t").agg(
        F.timestamp_micros(F.min("_s")).alias("s2_source_dt_utc"))
    return (keyed.join(means, [area, "_t", "s3_pixel_id"], "left")
            .join(source, [area, "_t"], "left").drop("_t"))


def coarse_table(pixels: DataFrame, *, indices: Sequence[str] = (), extra: Sequence[str] = (),
                 by: Sequence[str] = ()) -> DataFrame:
    """Contract names, normalised axes, NDVI filled from the nearest time.

    With ``by`` (the area) axes and donors stay inside the group, and its columns
    stand before those of the contract, ready for the unified table.
    """
    by = list(by)
    # Limits, donors, gaps and the result all read this table: write it once.
    named = rename_present(cut_lineage(pixels), coarse_renames(indices or (
        "NDVI", "NDBI", "ALBEDO", "NDWI", "MNDWI", "NDMI", "EVI", "SAVI", "BSI", "urban_index")))
    named = min_max_axes(named, {"row": "row_norm", "col": "col_norm"}, by)
    filled = fill_from_nearest_time(named, row_id=["node_id"], time="acquisition_dt_utc",
                                    value="NDVI", by=by)
    return require_and_select(filled, ordered([*by, *COARSE_COLUMNS, *extra, "filled"]),
                              "coarse table")
