"""Node grids, aligned cells, study-area squares and grid graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.core import col, let
from ..session import dealt_evenly

#: Nodes that one task makes, about.
NODES_AT_ONCE = 500_000


def node_grid(areas: DataFrame, spacing_m: float, zone: int = 30) -> DataFrame:
    """Areas (area_id, center_lat, center_lon, half_side_m, rotation_deg) to
    nodes at cell centres, row 0 in the north, turned about the area's centre."""
    cx, cy = geo.utm_forward("center_lat", "center_lon", zone)
    s = float(spacing_m)
    count = F.ceil((F.col("half_side_m") * 2 - F.lit(s / 2)) / F.lit(s)).cast("int")
    base = areas.withColumn("_cx", cx).withColumn("_cy", cy).withColumn("_n", count).where(F.col("_n") > 0)
    index = F.sequence(F.lit(0), F.col("_n") - 1)
    nodes = areas.select(count.cast("long").alias("_n")).where("_n > 0").agg(F.sum(F.col("_n") * F.col("_n"))).first()[0]
    cells = (dealt_evenly(base, nodes or 0, NODES_AT_ONCE)
             .withColumn("row", F.explode(index)).withColumn("col", F.explode(index)))
    dx = -F.col("half_side_m") + F.lit(s / 2) + F.col("col") * F.lit(s)
    dy = F.col("half_side_m") - F.lit(s / 2) - F.col("row") * F.lit(s)
    c, sn = F.cos(F.radians("rotation_deg")), F.sin(F.radians("rotation_deg"))
    turned = cells.withColumns({
        "x": F.col("_cx") + dx * c - dy * sn, "y": F.col("_cy") + dx * sn + dy * c})
    lat, lon = geo.utm_inverse("x", "y", zone)
    last = F.greatest(F.col("_n") - 1, F.lit(1))
    return turned.select(
        "area_id", F.format_string("r%03d_c%03d", "row", "col").alias("node_id"),
        "row", "col", "x", "y", lat.alias("latitude"), lon.alias("longitude"),
        (F.col("row") / last).alias("row_norm"), (F.col("col") / last).alias("col_norm"))


def aligned_bounds(xmin, ymin, xmax, ymax, resolution: float = 1000.0) -> dict[str, Column]:
    """Bounds grown symmetrically to whole cells, and the cell counts."""
    xmin, ymin, xmax, ymax = map(col, (xmin, ymin, xmax, ymax))
    r = F.lit(float(resolution))
    width = F.greatest(F.lit(1), F.ceil((xmax - xmin) / r).cast("int"))
    height = F.greatest(F.lit(1), F.ceil((ymax - ymin) / r).cast("int"))
    cx, cy = (xmin + xmax) / F.lit(2.0), (ymin + ymax) / F.lit(2.0)
    hx, hy = width * r / F.lit(2.0), height * r / F.lit(2.0)
    return {"gxmin": cx - hx, "gymin": cy - hy, "gxmax": cx + hx, "gymax": cy + hy,
            "width": width, "height": height}


def grid_cells(grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cell, north-up, row by row: bounds and centre."""
    rows = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    cw = (F.col("gxmax") - F.col("gxmin")) / F.col("width")
    ch = (F.col("gymax") - F.col("gymin")) / F.col("height")
    left = F.col("gxmin") + F.col("col") * cw
    top = F.col("gymax") - F.col("row") * ch
    return cells.select(
        *keys, "row", "col", left.alias("left"), (top - ch).alias("bottom"),
        (left + cw).alias("right"), top.alias("top"),
        (left + cw / F.lit(2.0)).alias("x"), (top - ch / F.lit(2.0)).alias("y"))


def cell_boxes(nodes: DataFrame, spacing_m: float) -> DataFrame:
    h = F.lit(float(spacing_m) / 2)
    return nodes.withColumns({"cxmin": F.col("x") - h, "cymin": F.col("y") - h,
                              "cxmax": F.col("x") + h, "cymax": F.col("y") + h})


def area_squares(areas: DataFrame, zone: int = 30) -> DataFrame:
    """Half side (from km2 when absent), rotation folded to [0, 90), rings in
    metres and degrees, size and projected bounds."""
    half = F.col("half_side_m") if "half_side_m" in areas.columns else F.lit(None).cast("double")
    if "area_km2" in areas.columns:
        half = F.coalesce(half, geo.half_side_from_area("area_km2"))
    turn = F.pmod("rotation_deg", F.lit(90.0))
    x, y = geo.utm_forward("center_lat", "center_lon", zone)
    out = areas.withColumns({"half_side_m": half, "rotation_deg": turn, "x": x, "y": y})
    out = out.withColumn("ring", geo.rotated_square("x", "y", "half_side_m", "rotation_deg"))
    return out.withColumns({
        "ring_degrees": geo.ring_to_degrees("ring", zone),
        "size_km2": geo.square_area_km2("half_side_m"), **geo.ring_bounds("ring")})


def move_areas(areas: DataFrame, east_m: Column, north_m: Column, zone: int = 30) -> DataFrame:
    x, y = geo.utm_forward("center_lat", "center_lon", zone)
    placed = areas.withColumns({"_x": x + east_m, "_y": y + north_m})
    lat, lon = geo.utm_inverse("_x", "_y", zone)
    return placed.withColumns({"center_lat": lat, "center_lon": lon}).drop("_x", "_y")


def direction_offsets(direction: str | Column, metres: str | Column) -> tuple[Column, Column]:
    d, m = col(direction), col(metres)
    zero = F.lit(0.0)
    return (F.when(d == "east", m).when(d == "west", -m).when(d.isin("north", "south"), zero),
            F.when(d == "north", m).when(d == "south", -m).when(d.isin("east", "west"), zero))


def resize_areas(areas: DataFrame, factor: Column) -> DataFrame:
    return areas.withColumn("half_side_m", F.col("half_side_m") * factor)


def boundary_coverage(boundary: str | Column, square: str | Column) -> Column:
    """Percent of a boundary polygon that a convex square covers.

    Both rings in metres. In the square's own axes the square is a plain box,
    so the boundary is turned there and measured against the box.
    """
    def share(edge: Column, outline: Column) -> Column:
        o, along = edge["a"], edge["b"]
        side = F.hypot(along["x"] - o["x"], along["y"] - o["y"])
        ux, uy = (along["x"] - o["x"]) / side, (along["y"] - o["y"]) / side

        def into_axes(p: Column) -> Column:
            dx, dy = p["x"] - o["x"], p["y"] - o["y"]
            return geo.point(dx * ux + dy * uy, dy * ux - dx * uy)

        inside = geo.clipped_area(F.transform(outline, into_axes), F.lit(0.0), F.lit(0.0),
                                  side, side)
        return F.try_divide(inside * F.lit(100.0), geo.ring_area(outline))

    first = F.element_at(geo.edges(col(square)), 1)
    return let(first, lambda e: let(col(boundary), lambda v: share(e, v)))


def recover_squares(areas: DataFrame, ring: str, half_side: str, zone: int = 30) -> DataFrame:
    """Centre and rotation of edited squares (ring in degrees); ``valid`` asks
    for at most 15 percent change of area."""
    metres = areas.withColumn("_metres", geo.ring_to_utm(ring, zone))
    x, y = geo.ring_centroid("_metres")
    side = F.col(half_side) * F.lit(2.0)
    drift = F.try_divide(F.abs(geo.ring_area("_metres") - side * side), side * side)
    placed = metres.withColumns({
        "_x": x, "_y": y, "rotation_deg": geo.edge_rotation_deg("_metres"),
        "valid": F.coalesce(drift <= F.lit(0.15), F.lit(False))})
    lat, lon = geo.utm_inverse("_x", "_y", zone)
    return placed.withColumns({"center_lat": lat, "center_lon": lon}).drop("_metres", "_x", "_y")


def grid_edges(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges to the next row and next column, both ways, with length in metres.

    Two equi-joins on the shifted grid index; a node id counts once.
    """
    by = list(by)
    unique = nodes.dropna(subset=["row", "col"]).groupBy(*by, "node_id").agg(*[
        F.min_by(c, F.struct("row", "col")).alias(c)
        for c in ("row", "col", "latitude", "longitude")])
    target = unique.select(
        *by, F.col("row").alias("_r"), F.col("col").alias("_c"),
        F.col("node_id").alias("target_node_id"), F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon"))
    steps = F.array(F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")),
                    F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")))
    source = unique.withColumn("_s", F.explode(steps)).withColumns({
        "_r": F.col("row") + F.col("_s.dr"), "_c": F.col("col") + F.col("_s.dc")})
    one_way = source.join(target, [*by, "_r", "_c"], "inner").select(
        *by, F.col("node_id").alias("source_node_id"), "target_node_id",
        geo.haversine_m("latitude", "longitude", "_lat", "_lon").alias("distance_m"))
    both = F.explode(F.array(
        F.struct(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")),
        F.struct(F.col("target_node_id").alias("a"), F.col("source_node_id").alias("b"))))
    return one_way.withColumn("_e", both).select(
        *by, F.col("_e.a").alias("source_node_id"), F.col("_e.b").alias("target_node_id"),
        "distance_m")
