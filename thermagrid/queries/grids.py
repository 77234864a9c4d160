"""Queries of grids, geometry, rasters and polygons."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid, zonal
from ..operators.ranking import grid_indices
from ..plans.coarse import raster_pixels
from .base import (frac, lat_of, lon_of, long, query, r, s_frac, s_haversine, s_lat, s_lon, s_r,
                   table, SPREAD_A, SPREAD_B)


@query("dense_grid_rank", """
WITH p AS (SELECT c_custkey, floor(c_acctbal / 7)::DOUBLE AS x, floor(c_acctbal * 3) % 997 AS y FROM customer)
SELECT c_custkey, dense_rank() OVER (ORDER BY y DESC) - 1 AS "row", dense_rank() OVER (ORDER BY x) - 1 AS col FROM p
""")
def dense_grid_rank(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal").select(
        "c_custkey", F.floor(F.col("c_acctbal") / 7).cast("double").alias("x"),
        (F.floor(F.col("c_acctbal") * 3) % 997).cast("double").alias("y"))
    out = grid_indices(c)
    return out.select("c_custkey", long("row").alias("row"), long("col").alias("col"))


def lattice_nodes(spark, sf):
    """Customers on a 40-column lattice of about 100 m."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer", "c_custkey").select(
        k.alias("node_id"), F.floor(k / 40).cast("int").alias("row"),
        (k % 40).cast("int").alias("col")).withColumns({
            "latitude": F.lit(37.4) - F.col("row") * 0.0009,
            "longitude": F.lit(-6.0) + F.col("col") * 0.00113})


@query("grid_edges", f"""
WITH n AS (SELECT c_custkey AS id, c_custkey // 40 AS r, c_custkey % 40 AS c, 37.4::DOUBLE - (c_custkey // 40) * 0.0009::DOUBLE AS lat, -6.0::DOUBLE + (c_custkey % 40) * 0.00113::DOUBLE AS lon FROM customer),
e AS (SELECT a.id AS s, b.id AS t, {s_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM n a JOIN n b ON b.r = a.r + 1 AND b.c = a.c
  UNION ALL SELECT a.id, b.id, {s_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} FROM n a JOIN n b ON b.r = a.r AND b.c = a.c + 1)
SELECT s AS source_node_id, t AS target_node_id, {s_r('d', 4)} AS distance_m FROM e UNION ALL SELECT t, s, {s_r('d', 4)} FROM e
""")
def grid_edges(spark, sf):
    out = grid.grid_edges(lattice_nodes(spark, sf))
    return out.withColumn("distance_m", r("distance_m", 4))


def s_utm_forward(lat: str, lon: str) -> tuple[str, str]:
    phi, dl = f"radians({lat})", f"radians(({lon}) - (-3.0::DOUBLE))"
    e = f"{geo.ECC!r}::DOUBLE"
    t = f"sinh(atanh(sin({phi})) - {e} * atanh({e} * sin({phi})))"
    xi = f"atan2({t}, cos({dl}))"
    eta = f"atanh(sin({dl}) / sqrt(1 + pow({t}, 2)))"
    k = f"{geo.UTM_SCALE * geo.RECTIFYING_RADIUS!r}::DOUBLE"
    x = " + ".join([eta] + [f"{a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
                            for j, a in enumerate(geo.ALPHA, 1)])
    y = " + ".join([xi] + [f"{a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
                           for j, a in enumerate(geo.ALPHA, 1)])
    return f"(500000 + {k} * ({x}))", f"({k} * ({y}))"


X_SQL, Y_SQL = s_utm_forward(s_lat("c_custkey"), s_lon("c_custkey"))


@query("utm_roundtrip", f"""
SELECT c_custkey, {s_r(X_SQL, 3)} AS x, {s_r(Y_SQL, 3)} AS y, {s_r(s_lat('c_custkey'), 6)} AS latitude, {s_r(s_lon('c_custkey'), 6)} AS longitude FROM customer
""")
def utm_roundtrip(spark, sf):
    c = table(spark, sf, "customer", "c_custkey").withColumns(
        {"lat": lat_of("c_custkey"), "lon": lon_of("c_custkey")})
    x, y = geo.utm_forward("lat", "lon")
    c = c.withColumns({"x": x, "y": y})
    lat, lon = geo.utm_inverse("x", "y")
    return c.select("c_custkey", r("x", 3).alias("x"), r("y", 3).alias("y"),
                    r(lat, 6).alias("latitude"), r(lon, 6).alias("longitude"))


@query("aligned_cells", f"""
WITH a AS (SELECT n_nationkey AS id, 1000.0::DOUBLE * n_nationkey AS x0, 500.0::DOUBLE * n_regionkey AS y0, 1000.0::DOUBLE * n_nationkey + 1500 + 130 * n_nationkey AS x1, 500.0::DOUBLE * n_regionkey + 900 + 700 * n_regionkey AS y1 FROM nation),
g AS (SELECT *, greatest(1, ceil((x1 - x0) / 1000))::INTEGER AS w, greatest(1, ceil((y1 - y0) / 1000))::INTEGER AS h FROM a),
b AS (SELECT *, (x0 + x1) / 2 - w * 500 AS gx, (y0 + y1) / 2 + h * 500 AS gy FROM g),
c AS (SELECT *, unnest(range(h)) AS r FROM b), d AS (SELECT *, unnest(range(w)) AS k FROM c)
SELECT id::BIGINT AS area, r::BIGINT AS "row", k::BIGINT AS col, {s_r('gx + k * 1000')} AS "left", {s_r('gy - (r + 1) * 1000')} AS bottom, {s_r('gx + (k + 1) * 1000')} AS "right", {s_r('gy - r * 1000')} AS top, {s_r('gx + k * 1000 + 500')} AS x, {s_r('gy - r * 1000 - 500')} AS y FROM d
""")
def aligned_cells(spark, sf):
    n = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    a = n.select(key.cast("long").alias("area"), (key * 1000.0).alias("x0"),
                 (region * 500.0).alias("y0"), (key * 1000.0 + 1500 + key * 130).alias("x1"),
                 (region * 500.0 + 900 + region * 700).alias("y1"))
    g = a.withColumns(grid.aligned_bounds("x0", "y0", "x1", "y1", 1000.0))
    out = grid.grid_cells(g, ["area"])
    return out.select("area", long("row").alias("row"), long("col").alias("col"), *[
        r(c).alias(c) for c in ("left", "bottom", "right", "top", "x", "y")])


def areas(spark, sf):
    """Customers as study areas: km2 from their balance, rotation from the key."""
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("area_id"), lat_of("c_custkey").alias("center_lat"),
        lon_of("c_custkey").alias("center_lon"),
        (F.lit(1.0) + F.abs("c_acctbal") / 1000).alias("area_km2"),
        (F.col("c_custkey") % 180).cast("double").alias("rotation_deg"), "c_mktsegment")


HALF = "(sqrt((1.0::DOUBLE + abs(c_acctbal) / 1000) * 1e6::DOUBLE) / 2)"


@query("roi_square", f"""
WITH a AS (SELECT c_custkey, {X_SQL} AS x, {Y_SQL} AS y, {HALF} AS h, radians((c_custkey % 180) % 90) AS t, (c_custkey % 180) % 90 AS deg FROM customer)
SELECT c_custkey AS area_id, {s_r('h', 6)} AS half_side_m, deg::DOUBLE AS rotation_deg, {s_r('(2 * h) * (2 * h) / 1e6::DOUBLE')} AS size_km2,
 {s_r('x - h * (abs(cos(t)) + abs(sin(t)))', 3)} AS xmin, {s_r('y - h * (abs(cos(t)) + abs(sin(t)))', 3)} AS ymin, {s_r('x + h * (abs(cos(t)) + abs(sin(t)))', 3)} AS xmax,
 {s_r('(2 * h) * (2 * h) / 1e6::DOUBLE', 6)} AS ring_km2, {s_r(s_lat('c_custkey'), 6)} AS centre_lat, {s_r(s_lon('c_custkey'), 6)} AS centre_lon, {s_r('deg', 4)} AS found_rotation, true AS valid
FROM a
""")
def roi_square(spark, sf):
    out = grid.area_squares(areas(spark, sf)).withColumn("turn", F.col("rotation_deg"))
    return grid.recover_squares(out, "ring_degrees", "half_side_m").select(
        "area_id", r("half_side_m").alias("half_side_m"), F.col("turn").alias("rotation_deg"),
        r("size_km2").alias("size_km2"), r("xmin", 3).alias("xmin"), r("ymin", 3).alias("ymin"),
        r("xmax", 3).alias("xmax"), r(geo.ring_area("ring") / 1e6).alias("ring_km2"),
        r("center_lat").alias("centre_lat"), r("center_lon").alias("centre_lon"),
        r(F.pmod(F.round("rotation_deg", 4), F.lit(90.0)), 4).alias("found_rotation"), "valid")


@query("roi_move_resize", f"""
SELECT c_custkey AS area_id, {s_r(X_SQL + " + CASE WHEN c_custkey % 4 = 0 THEN 500 WHEN c_custkey % 4 = 1 THEN -500 ELSE 0 END", 1)} AS x,
 {s_r(Y_SQL + " + CASE WHEN c_custkey % 4 = 2 THEN 500 WHEN c_custkey % 4 = 3 THEN -500 ELSE 0 END", 1)} AS y, {s_r(f"pow(4 * {HALF}, 2) / 1e6::DOUBLE", 6)} AS size_km2 FROM customer
""")
def roi_move_resize(spark, sf):
    k = F.col("area_id") % 4
    a = areas(spark, sf).withColumn("half_side_m", geo.half_side_from_area("area_km2")).withColumn(
        "_d", F.when(k == 0, "east").when(k == 1, "west").when(k == 2, "north").otherwise("south"))
    moved = grid.move_areas(a, *grid.direction_offsets("_d", F.lit(500.0)))
    moved = grid.resize_areas(moved, F.lit(2.0))
    x, y = geo.utm_forward("center_lat", "center_lon")
    return moved.select("area_id", r(x, 1).alias("x"), r(y, 1).alias("y"),
                        r(geo.square_area_km2("half_side_m")).alias("size_km2"))


@query("boundary_coverage", f"""
WITH a AS (SELECT c_custkey, 1000 * {s_frac('c_custkey', SPREAD_A)} AS x, 1000 * {s_frac('c_custkey', SPREAD_B)} AS y, 100 + abs(c_acctbal) / 40 AS h FROM customer)
SELECT c_custkey AS area_id, {s_r('100 * greatest(0, least(x + h, 800) - greatest(x - h, 200)) * greatest(0, least(y + h, 900) - greatest(y - h, 100)) / (600.0::DOUBLE * 800)')} AS coverage FROM a
""")
def boundary_coverage(spark, sf):
    k = "c_custkey"
    c = table(spark, sf, "customer", k, "c_acctbal").select(
        k, (F.lit(1000) * frac(k, SPREAD_A)).alias("x"), (F.lit(1000) * frac(k, SPREAD_B)).alias("y"),
        (F.lit(100) + F.abs("c_acctbal") / 40).alias("h"),
        F.when(F.col(k) % 2 == 0, 0.0).otherwise(90.0).alias("turn"))
    square = geo.rotated_square("x", "y", "h", "turn")
    corners = [(200.0, 100.0), (800.0, 100.0), (800.0, 900.0), (200.0, 900.0)]
    boundary = F.array(*[geo.point(F.lit(a), F.lit(b)) for a, b in corners])
    c = c.withColumns({"square": square, "boundary": boundary})
    return c.select(F.col(k).alias("area_id"),
                    r(grid.boundary_coverage("boundary", "square")).alias("coverage"))


@query("node_grid_counts", f"""
WITH a AS (SELECT s_suppkey AS id, 300 + s_suppkey % 5 * 110 AS h FROM supplier), n AS (SELECT *, ceil((2 * h - 50) / 100.0::DOUBLE)::BIGINT AS n FROM a)
SELECT id AS area_id, n * n AS nodes, n - 1 AS last_row, {s_r('100.0::DOUBLE * (n - 1)', 3)} AS diagonal_step, 1.0::DOUBLE AS top_norm, 'r000_c000' AS first_node FROM n
""")
def node_grid_counts(spark, sf):
    a = table(spark, sf, "supplier", "s_suppkey").select(
        F.col("s_suppkey").alias("area_id"), lat_of("s_suppkey").alias("center_lat"),
        lon_of("s_suppkey").alias("center_lon"),
        (F.lit(300) + F.col("s_suppkey") % 5 * 110).cast("double").alias("half_side_m"),
        (F.col("s_suppkey") % 90).cast("double").alias("rotation_deg"))
    nodes = grid.node_grid(a, 100.0)
    corner = F.struct("x", "y")
    at = nodes.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("row").cast("long").alias("last_row"),
        F.min_by(corner, F.struct("row", "col")).alias("a"),
        F.max_by(corner, F.struct(F.col("row"), (-F.col("col")).alias("c"))).alias("b"),
        F.max("row_norm").alias("top_norm"), F.min("node_id").alias("first_node"))
    step = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return at.select("area_id", "nodes", "last_row", r(step, 3).alias("diagonal_step"),
                     r("top_norm").alias("top_norm"), "first_node")


def cells_of(spark, sf):
    s = table(spark, sf, "supplier", "s_suppkey").select(
        "s_suppkey", (F.lit(1000) * frac("s_suppkey", SPREAD_A)).alias("x"),
        (F.lit(1000) * frac("s_suppkey", SPREAD_B)).alias("y"))
    return grid.cell_boxes(s, 100.0)


CELL_BOX = ["cxmin", "cymin", "cxmax", "cymax"]
CELLS_SQL = f"""
WITH c AS (SELECT s_suppkey, 1000 * {s_frac('s_suppkey', SPREAD_A)} AS x, 1000 * {s_frac('s_suppkey', SPREAD_B)} AS y FROM supplier),
"""


@query("polygon_cell_area", CELLS_SQL + f"""
p AS (SELECT c_custkey, 1000 * {s_frac('c_custkey * 3 + 1', SPREAD_A)} AS x, 1000 * {s_frac('c_custkey * 3 + 1', SPREAD_B)} AS y, 10 + abs(c_acctbal) / 200 AS w FROM customer),
i AS (SELECT s_suppkey,
  greatest(0, least(c.x + 50, p.x + w) - greatest(c.x - 50, p.x)) * greatest(0, least(c.y + 50, p.y + w) - greatest(c.y - 50, p.y))
  - greatest(0, least(c.x + 50, p.x + w) - greatest(c.x - 50, p.x + w / 2)) * greatest(0, least(c.y + 50, p.y + w) - greatest(c.y - 50, p.y + w / 2)) AS a
  FROM c JOIN p ON p.x <= c.x + 50 AND p.x + w >= c.x - 50 AND p.y <= c.y + 50 AND p.y + w >= c.y - 50),
g AS (SELECT s_suppkey, sum(a) AS f, count(*) FILTER (a > 1e-6) AS k FROM i GROUP BY 1)
SELECT c.s_suppkey, {s_r('coalesce(f, 0)', 4)} AS footprint_m2, coalesce(k, 0)::BIGINT AS building_count, (coalesce(k, 0) > 0)::BIGINT AS has_buildings,
  {s_r('CASE WHEN coalesce(k, 0) > 0 AND f < 10000 THEN 9 / sqrt((10000 - f) / k) ELSE 0 END')} AS aspect_ratio FROM c LEFT JOIN g USING (s_suppkey)
""")
def polygon_cell_area(spark, sf):
    k = F.col("c_custkey") * 3 + 1
    p = table(spark, sf, "customer", "c_custkey", "c_acctbal").select(
        (F.lit(1000) * frac(k, SPREAD_A)).alias("x"), (F.lit(1000) * frac(k, SPREAD_B)).alias("y"),
        (F.lit(10) + F.abs("c_acctbal") / 200).alias("w"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    shape = F.array(geo.point(x, y), geo.point(x + w, y), geo.point(x + w, y + w / 2),
                    geo.point(x + w / 2, y + w / 2), geo.point(x + w / 2, y + w), geo.point(x, y + w))
    cells = cells_of(spark, sf)
    found = zonal.footprint_by_cell(p.select(shape.alias("ring")), cells, ring="ring",
                                    cell_id=["s_suppkey"], cell_box=CELL_BOX, size=100.0)
    out = cells.select("s_suppkey").join(found, "s_suppkey", "left").withColumn("h", F.lit(9.0))
    out = out.withColumns(zonal.street_canyon("h", "footprint_m2", "building_count", 10000.0))
    return out.select(
        "s_suppkey", r(F.coalesce("footprint_m2", F.lit(0.0)), 4).alias("footprint_m2"),
        long(F.coalesce("building_count", F.lit(0))).alias("building_count"),
        long("has_buildings").alias("has_buildings"), r("aspect_ratio").alias("aspect_ratio"))


def height_raster(spark, sf):
    """Customers as pixels: 40 columns, height from the balance."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer", "c_custkey", "c_acctbal").select(
        F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"),
        (F.col("c_acctbal") / 500).alias("height"))


@query("zonal_mean", CELLS_SQL + f"""
p AS (SELECT c_custkey % 40 * 25.0::DOUBLE AS x0, 1000 - (c_custkey // 40) * 25.0::DOUBLE AS y1, c_acctbal / 500 AS v FROM customer WHERE c_acctbal / 500 >= 2),
m AS (SELECT s_suppkey, avg(v) AS m FROM c JOIN p ON p.x0 < c.x + 50 AND p.x0 + 25 > c.x - 50 AND p.y1 - 25 < c.y + 50 AND p.y1 > c.y - 50 GROUP BY 1)
SELECT c.s_suppkey, {s_r('coalesce(m, 0)', 8)} AS mean_height FROM c LEFT JOIN m USING (s_suppkey)
""")
def zonal_mean(spark, sf):
    pixels = zonal.raster_boxes(height_raster(spark, sf), 0.0, 1000.0, 25.0)
    out = zonal.zonal_mean(pixels, cells_of(spark, sf), cell_id=["s_suppkey"], cell_box=CELL_BOX,
                           value="height", size=100.0)
    return out.select("s_suppkey", r("mean_height", 8).alias("mean_height"))


@query("raster_sample", f"""
WITH c AS (SELECT s_suppkey, 1000 * {s_frac('s_suppkey', SPREAD_A)} AS x, 1000 * {s_frac('s_suppkey', SPREAD_B)} AS y FROM supplier),
p AS (SELECT c_custkey // 40 AS r, c_custkey % 40 AS k, c_mktsegment, c_acctbal / 500 AS v FROM customer)
SELECT s_suppkey, c_mktsegment AS scene, {s_r('v')} AS height FROM c JOIN p ON p.r = floor((1000 - y) / 25.0::DOUBLE) AND p.k = floor(x / 25.0::DOUBLE)
""")
def raster_sample(spark, sf):
    k = F.col("c_custkey")
    scenes = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment").select(
        F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"),
        F.col("c_mktsegment").alias("scene"), (F.col("c_acctbal") / 500).alias("height"))
    out = zonal.sample_raster(cells_of(spark, sf), scenes, x="x", y="y", x0=0.0, y0=1000.0,
                              resolution=25.0, values=["height"], scene=["scene"])
    return out.select("s_suppkey", "scene", r("height").alias("height"))


@query("sky_view", f"""
WITH c AS (SELECT s_suppkey, 200 * {s_frac('s_suppkey', SPREAD_A)} AS x, 200 * {s_frac('s_suppkey', SPREAD_B)} AS y FROM supplier),
p AS (SELECT c_custkey // 40 AS r, c_custkey % 40 AS k, c_acctbal / 500 AS v FROM customer),
ray AS (SELECT s_suppkey, x, y, unnest(range(36)) AS a FROM c), smp AS (SELECT *, unnest(range(1, 41)) * 5.0::DOUBLE AS d FROM ray),
pt AS (SELECT s_suppkey, a, d, floor((200 - (y + d * cos(a * {2 * 3.141592653589793 / 36!r}::DOUBLE))) / 5.0::DOUBLE) AS r, floor((x + d * sin(a * {2 * 3.141592653589793 / 36!r}::DOUBLE)) / 5.0::DOUBLE) AS k FROM smp),
h AS (SELECT s_suppkey, a, max(atan2(greatest(coalesce(p.v, 0) - 1.5::DOUBLE, 0), d)) AS t FROM pt LEFT JOIN p ON p.r = pt.r AND p.k = pt.k GROUP BY ALL)
SELECT s_suppkey, {s_r('least(1, greatest(0, avg(pow(cos(t), 2))))', 8)} AS sky_view_factor FROM h GROUP BY s_suppkey
""")
def sky_view(spark, sf):
    nodes = table(spark, sf, "supplier", "s_suppkey").select(
        "s_suppkey", (F.lit(200) * frac("s_suppkey", SPREAD_A)).alias("x"),
        (F.lit(200) * frac("s_suppkey", SPREAD_B)).alias("y"))
    out = zonal.sky_view_factor(nodes, height_raster(spark, sf), node_id="s_suppkey", x0=0.0,
                                y0=200.0, resolution=5.0, height="height")
    return out.select("s_suppkey", r("sky_view_factor", 8).alias("sky_view_factor"))


@query("raster_pixels", """
WITH p AS (SELECT c_custkey // 40 AS r, c_custkey % 40 AS c, 230 + abs(c_acctbal) / 60 AS lst, c_nationkey / 4.0::DOUBLE AS unc, CASE WHEN c_mktsegment = 'BUILDING' THEN 16384 ELSE 3 END AS conf FROM customer)
SELECT r AS "row", c AS col, (round(lst, 8) + 0.0::DOUBLE) AS lst, (round(unc, 6) + 0.0::DOUBLE) AS uncertainty, conf::BIGINT AS confidence FROM p
WHERE lst BETWEEN 223 AND 360 AND unc BETWEEN 0 AND 5 AND conf = 3 AND c * 25 <= 700 AND (c + 1) * 25 >= 110 AND 1000 - r * 25 >= 320 AND 1000 - (r + 1) * 25 <= 900
""")
def raster_pixels_query(spark, sf):
    k = F.col("c_custkey")
    raster = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment").select(
        F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"),
        (F.lit(230) + F.abs("c_acctbal") / 60).alias("LST"),
        (F.col("c_nationkey") / F.lit(4.0)).alias("LST_uncertainty"),
        F.when(F.col("c_mktsegment") == "BUILDING", 16384.0).otherwise(3.0).alias("CONFIDENCE"),
        F.lit(1.0).alias("dataMask"))
    out = raster_pixels(raster, x0=0.0, y0=1000.0, resolution=25.0, area_box=(110.0, 320.0, 700.0, 900.0))
    return out.select(long("row").alias("row"), long("col").alias("col"), r("LST", 8).alias("lst"),
                      r("LST_uncertainty").alias("uncertainty"),
                      long("s3_confidence").alias("confidence"))


@query("weather_box_cells", f"""
WITH b AS (SELECT s_suppkey, {s_lon('s_suppkey')} - 0.15::DOUBLE AS w, {s_lat('s_suppkey')} - 0.15::DOUBLE AS s, {s_lon('s_suppkey')} + (s_suppkey % 7) * 0.13::DOUBLE + 0.15::DOUBLE AS e, {s_lat('s_suppkey')} + (s_suppkey % 5) * 0.17::DOUBLE + 0.15::DOUBLE AS n FROM supplier)
SELECT s_suppkey, {s_r('w')} AS west, {s_r('n')} AS north, ((greatest(1, ceil(abs(n - s) / 0.1::DOUBLE)::INTEGER + 1)) * (greatest(1, ceil(abs(e - w) / 0.1::DOUBLE)::INTEGER + 1)))::BIGINT AS cells FROM b
""")
def weather_box_cells(spark, sf):
    k = F.col("s_suppkey")
    b = table(spark, sf, "supplier", "s_suppkey").withColumns({
        "w": lon_of("s_suppkey"), "s": lat_of("s_suppkey"),
        "e": lon_of("s_suppkey") + (k % 7) * F.lit(0.13), "n": lat_of("s_suppkey") + (k % 5) * F.lit(0.17)})
    b = b.withColumns(geo.expanded_box("w", "s", "e", "n"))
    cells = geo.raster_cells(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    return b.select("s_suppkey", r("west").alias("west"), r("north").alias("north"),
                    long(cells).alias("cells"))
