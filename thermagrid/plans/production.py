"""Production: the chosen translation refitted on all pairs, every coarse date translated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.translation import Bundle, fit_bundle, predict_bundle, prediction_rows
from ..operators.fusion import target_summary
from ..operators.grid import grid_edges
from ..operators.lookups import stack_tables, written_side
from ..session import cut_lineage
from ..sources.sinks import write_per_area
from .downscaling import fused_area_rows

# Columns of the translated table.
PRODUCTION_COLUMNS = [
    "area_id", "node_id", "date", "timestamp_utc", "latitude", "longitude", "row", "col",
    "sentinel3_pixel_id", "sentinel3_datetime_utc", "LST_1km", "LST_predicted_K",
    "NDVI_S2_100m", "NDBI_S2_100m", "ALBEDO_S2_100m", "s2_date", "s2_gap_days",
    "DEM", "aspect_ratio", "has_buildings", "Tair_C_1km", "RH_1km", "Rsol_Wm2_1km",
    "wind_speed_1km", "rain_3d_log_1km", "sin_doy", "cos_doy", "target_source", "downscaling_model",
]
TRANSLATED_SOURCE = "sentinel3_to_landsat_model"
# End of fixed values.


def translate_all(unified: DataFrame, scenes: DataFrame | None, pairs: DataFrame, name: str, *,
                  max_days: int = 20, seed: int = 42, trees: int | None = None,
                  by: Sequence[str] = ()) -> tuple[Bundle, DataFrame]:
    """The candidate fitted on every pair, and each row with a coarse value
    translated by it (those of the production columns that are there). Without ``scenes``
    the rows of ``unified`` carry their covariates (``with_scenes``)."""
    bundle = fit_bundle(pairs, name, seed=seed, trees=trees)
    rows = prediction_rows(unified, scenes, max_days=max_days, by=by)
    translated = predict_bundle(bundle, rows).withColumns({
        "target_source": F.lit(TRANSLATED_SOURCE), "downscaling_model": F.lit(name)})
    return bundle, translated.select(*[c for c in PRODUCTION_COLUMNS if c in translated.columns])


def area_production(unified: DataFrame, scenes: DataFrame, pairs: DataFrame, scopes: DataFrame,
                    name: str, *, max_days: int = 20, seed: int = 42,
                    trees: int | None = None, covered: DataFrame | None = None) -> DataFrame:
    """All rows of all areas with their fused target.

    scopes: area_id, scope (general or local), test_mae_k. The general model
    sees all pairs and translates all areas but the local ones; the models of the
    local areas are groups of one fit on their own pairs. Two jobs, whatever
    the number of areas. ``covered``: ``unified`` ``with_scenes``, where it has been
    made for the pairs already.
    """
    scopes = cut_lineage(scopes)
    rows = prediction_rows(unified if covered is None else covered, scenes if covered is None else None, max_days=max_days, by=["area_id"])
    local = written_side(scopes.where("scope = 'local'").select("area_id"))
    general = fit_bundle(pairs, name, seed=seed, trees=trees)
    own = fit_bundle(pairs.join(local, "area_id", "left_semi"), name, by=["area_id"], seed=seed, trees=trees)
    predictions = stack_tables([predict_bundle(general, rows.join(local, "area_id", "left_anti")),
                                predict_bundle(own, rows.join(local, "area_id", "left_semi"))])
    fused = fused_area_rows(unified, predictions, scopes, model=name)
    return fused.join(written_side(scopes.select("area_id", F.col("test_mae_k").alias("downscaling_test_mae_k"))), "area_id", "left")


def write_area_production(fused: DataFrame, path: str) -> None:
    """Dataset, grid edges and summary, one folder for each area."""
    write_per_area(fused, f"{path}/dataset")
    write_per_area(grid_edges(fused.select("area_id", "node_id", "row", "col", "latitude", "longitude"), ["area_id"]), f"{path}/edges")
    labels = fused.groupBy("area_id").agg(F.first("downscaling_model").alias("model"), F.first("downscaling_scope").alias("scope"))
    write_per_area(target_summary(fused).join(labels, "area_id"), f"{path}/summary")
