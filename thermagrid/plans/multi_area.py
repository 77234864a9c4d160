"""Many areas at once: the area is a column, not a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fusion import global_id
from ..operators.lookups import maybe_broadcast
from ..operators.ranking import running_number
from ..operators.reports import area_rollup, run_status


def area_identities(areas: DataFrame, order: str) -> DataFrame:
    """Fallback ids ``area_NN`` by order, and names from place or id."""
    numbered = running_number(areas, [], order, out="_n")
    area_id = F.coalesce("area_id", F.format_string("area_%02d", "_n"))
    return numbered.withColumn("area_id", area_id).withColumn(
        "area_name", F.coalesce("area_name", "place_name", "area_id")).drop("_n")


def combined_rows(rows: DataFrame, areas: DataFrame, node: str = "node_id") -> DataFrame:
    """Lineage columns on the rows of the requested areas."""
    named = rows.join(maybe_broadcast(areas.select("area_id", "area_name")), "area_id", "inner")
    return named.withColumn("global_node_id", global_id("area_id", node))


def combined_report(rows: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    per_area = area_rollup(rows, areas)
    return per_area, run_status(per_area)
