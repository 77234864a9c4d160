"""Queries of whole chains and of the small rules that they are made of."""

from pyspark.sql import functions as F

from ..functions.calendar import micros, parse_day
from ..models.regressors import fit_regressor
from ..models.translation import fit_bundle, load_bundle, predict_bundle, save_bundle
from ..operators import contract, fusion
from ..operators.series import with_rain_features
from ..plans.coarse import coarse_table, nearest_product_times, raster_pixels, valid_pixels
from ..plans.downscaling import ranked_importances, training_rows
from ..plans.unified import unified_table
from ..plans.weather import weather_tables
from ..session import cut_lineage, fresh_path, stored
from .base import day, events, lat_of, lon_of, long, query, r, s_lat, s_lon, s_r, s_scaled, table
from .modelling import (S_ROWS, SPATIAL, line_rows, s_day_sizes, s_pixels, s_translated, translation_rows)
from .panels import UNIFIED_SQL, unified_inputs
from .ridge_sql import ridge_ctes, ridge_value

# Coarse pixels: statistics of five areas, one product a day, quality, axes, gaps filled in time.

COARSE_SQL = f"""
WITH cell AS (SELECT n_regionkey AS area_id, n_nationkey AS k, n_nationkey % 5 AS r, n_nationkey // 5 AS c, {s_lat('n_nationkey + 1000')} AS lat,
  {s_lon('n_nationkey + 1000')} AS lon FROM nation),
st AS (SELECT c_nationkey AS k, o_orderdate::DATE AS d, avg(250 + o_totalprice / 10000) AS base, count(*) AS n, max(o_orderkey) AS m
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
px AS (SELECT area_id, d, d::TIMESTAMP + INTERVAL 10 HOUR + to_minutes((dayofyear(d) % 50)::BIGINT) AS t, r, c, lat, lon, base AS lst,
  CASE WHEN m % 3 <> 0 THEN base / 1000 END AS v FROM st JOIN cell USING (k)
  WHERE CASE WHEN m % 11 = 0 THEN 400.0 ELSE base END BETWEEN 223 AND 360 AND n % 7 <= 5 AND m % 5 <> 0),
dt AS (SELECT DISTINCT area_id, t FROM px WHERE v IS NOT NULL), ht AS (SELECT DISTINCT area_id, t FROM px WHERE v IS NULL),
mt AS (SELECT ht.area_id, ht.t, arg_min(dt.t, (abs(epoch_us(dt.t) - epoch_us(ht.t)), dt.t)) AS dt FROM ht JOIN dt ON dt.area_id = ht.area_id AND dt.t <> ht.t GROUP BY ALL),
fl AS (SELECT h.area_id, h.t, h.r, h.c, arg_min(g.v, ({s_scaled('h.lat', 'h.lon', 'g.lat', 'g.lon')}, g.r, g.c)) AS fill
  FROM px h JOIN mt ON mt.area_id = h.area_id AND mt.t = h.t JOIN px g ON g.area_id = h.area_id AND g.t = mt.dt AND g.v IS NOT NULL WHERE h.v IS NULL GROUP BY ALL),
done AS (SELECT px.*, coalesce(v, fill) AS ndvi, (v IS NULL AND fill IS NOT NULL)::INT AS filled,
  coalesce((r - min(r) OVER w) / nullif(max(r) OVER w - min(r) OVER w, 0)::DOUBLE, 0) AS rn, coalesce((c - min(c) OVER w) / nullif(max(c) OVER w - min(c) OVER w, 0)::DOUBLE, 0) AS cn
  FROM px LEFT JOIN fl USING (area_id, t, r, c) WINDOW w AS (PARTITION BY px.area_id))
"""


def coarse_by_area(spark, sf):
    """Daily cell statistics, products and cells of five areas through the chain to the coarse table."""
    nation = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    cells = nation.select(F.col("n_regionkey").alias("area_id"), (F.col("n_nationkey") % 5).cast("int").alias("row"),
                          F.floor(F.col("n_nationkey") / 5).cast("int").alias("col"), lat_of(F.col("n_nationkey") + 1000).alias("latitude"),
                          lon_of(F.col("n_nationkey") + 1000).alias("longitude"), "n_nationkey")
    stats = (table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
             .join(table(spark, sf, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_nationkey").alias("n_nationkey"), day("o_orderdate").alias("date"))
             .agg(F.avg(F.lit(250) + F.col("o_totalprice") / 10000).alias("base"), F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("m")))
    stats = cut_lineage(stats.join(F.broadcast(cells.select("area_id", "row", "col", "n_nationkey")), "n_nationkey"))
    m = F.col("m")
    statistics = stats.select(
        "area_id", "row", "col", "date", F.when(m % 11 == 0, 400.0).otherwise(F.col("base")).alias("LST"), (F.col("n") % 7).cast("double").alias("LST_uncertainty"),
        F.when(m % 3 != 0, F.col("base") / 1000).alias("NDVI"), *[F.lit(0.0).alias(c) for c in ("CLOUD", "BAYES", "POINTING")],
        F.when(m % 5 == 0, 16387.0).otherwise(3.0).alias("CONFIDENCE"))
    start = F.unix_micros(F.col("date").cast("timestamp")) + 10 * 3_600_000_000 + (F.dayofyear("date") % 50).cast("long") * 60_000_000
    products = stats.select("area_id", "date").distinct().withColumn("late", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "area_id", "date", F.concat_ws("-", F.lit("p"), "area_id", "date", "late").alias("Id"), F.lit("name").alias("Name"),
        F.timestamp_micros(start + F.col("late").cast("long") * 300_000_000).alias("acquisition_dt_utc"))
    pixels = valid_pixels(statistics, products, cells.drop("n_nationkey"), by=["area_id"])
    fixed = {"Tair_C": F.col("LST_S3_K") - 273.15, "RH": F.lit(50.0), "Rsol_Wm2": F.lit(800.0), "wind_speed": F.lit(2.0), "rain_3d": F.lit(0.0),
             "DEM_mean_1km": F.col("s3_row") * F.lit(10.0), "NDVI_S2_mean_1km": F.col("NDVI_S3"), "NDBI_S2_mean_1km": F.lit(0.1),
             "ALBEDO_S2_mean_1km": F.lit(0.2), "aspect_ratio_mean_1km": F.lit(0.5), "has_buildings_mean_1km": F.lit(1.0),
             "day_of_year": F.dayofyear("acquisition_dt_utc"), "sin_doy": F.lit(0.0), "cos_doy": F.lit(1.0), "date": F.to_date("acquisition_dt_utc")}
    return coarse_table(pixels.withColumns(fixed), by=["area_id"])


@query("coarse_table_by_area", COARSE_SQL + f"""
SELECT area_id::BIGINT AS area_id, d AS date, epoch_us(t) AS acquired_us, strftime(t, '%Y%m%dT%H%M') || '_' || r || '_' || c AS node_id, r::BIGINT AS "row", c::BIGINT AS col,
  {s_r('lat')} AS latitude, {s_r('lst', 8)} AS LST_1km, {s_r('ndvi', 10)} AS NDVI, filled::BIGINT AS filled, {s_r('rn', 8)} AS row_norm, {s_r('cn', 8)} AS col_norm,
  {s_r('r * 10')} AS DEM FROM done
""")
def coarse_table_by_area(spark, sf):
    out = coarse_by_area(spark, sf)
    return out.select(long("area_id").alias("area_id"), "date", micros("acquisition_dt_utc").alias("acquired_us"), "node_id", long("row").alias("row"),
                      long("col").alias("col"), r("latitude").alias("latitude"), r("LST_1km", 8).alias("LST_1km"), r("NDVI", 10).alias("NDVI"),
                      long("filled").alias("filled"), r("row_norm", 8).alias("row_norm"), r("col_norm", 8).alias("col_norm"), r("DEM").alias("DEM"))


UNIFY_SQL = COARSE_SQL + f""",
nodes AS (SELECT s_suppkey AS node_id, n_regionkey AS area_id, {s_lat('s_suppkey * 5 + 2')} AS lat, {s_lon('s_suppkey * 5 + 2')} AS lon
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
fine0 AS (SELECT nodes.area_id, nodes.node_id, l_shipdate::DATE AS d, 250 + l_quantity AS lst, l_discount AS ndvi FROM lineitem JOIN nodes ON nodes.node_id = l_suppkey),
fine AS (SELECT * FROM fine0 QUALIFY row_number() OVER (PARTITION BY area_id, node_id, d ORDER BY lst, ndvi) = 1),
days AS (SELECT area_id, d FROM fine0 UNION SELECT area_id, d FROM done),
cdays AS (SELECT DISTINCT area_id, d AS cd FROM done),
dm AS (SELECT days.area_id, days.d, arg_min(cd, (abs(date_diff('day', days.d, cd)), cd)) AS cd
  FROM days JOIN cdays ON cdays.area_id = days.area_id AND abs(date_diff('day', days.d, cd)) <= 2 GROUP BY ALL),
hv AS (SELECT n.area_id, n.node_id, cell.r, cell.c, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(cell.lat - n.lat) / 2), 2)
  + cos(radians(n.lat)) * cos(radians(cell.lat)) * pow(sin(radians(cell.lon - n.lon) / 2), 2))) AS dist FROM nodes n JOIN cell USING (area_id)),
near AS (SELECT hv.area_id, done.d AS cd, hv.node_id, arg_min((done.lst, done.ndvi), (hv.dist, done.r, done.c)) AS px FROM hv JOIN done USING (area_id, r, c) GROUP BY ALL),
panel AS (SELECT days.area_id, n.node_id, days.d, f.lst, f.ndvi, near.px[1] AS lst1, near.px[2] AS ndvi1 FROM days JOIN nodes n ON n.area_id = days.area_id
  LEFT JOIN fine f ON f.area_id = days.area_id AND f.node_id = n.node_id AND f.d = days.d LEFT JOIN dm ON dm.area_id = days.area_id AND dm.d = days.d
  LEFT JOIN near ON near.area_id = dm.area_id AND near.cd = dm.cd AND near.node_id = n.node_id)
"""


@query("unified_from_coarse", UNIFY_SQL.replace("near.px[1]", "struct_extract(near.px, 1)").replace("near.px[2]", "struct_extract(near.px, 2)") + f"""
SELECT area_id::BIGINT AS area_id, count(*) AS rows, count(lst) AS fine, count(lst1) AS coarse, count(*) FILTER (lst IS NOT NULL AND lst1 IS NOT NULL) AS ready,
  {s_r('avg(lst1)', 6)} AS LST_1km, {s_r('avg(ndvi1)', 8)} AS NDVI_1km, {s_r('avg(ndvi)', 8)} AS NDVI FROM panel GROUP BY 1
""")
def unified_from_coarse(spark, sf):
    """The coarse chain's table in the unified panel."""
    fine, _, nodes = unified_inputs(spark, sf)
    coarse = coarse_by_area(spark, sf).select("area_id", "node_id", "date", "acquisition_dt_utc", "latitude", "longitude", "row", "col", "LST_1km", "NDVI")
    out = unified_table(fine.drop("DEM"), coarse, nodes, tolerance_days=2)
    return out.groupBy(long("area_id").alias("area_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("LST_K").alias("fine"), F.count("LST_1km").alias("coarse"), F.count_if("training_ready").alias("ready"),
        r(F.avg("LST_1km"), 6).alias("LST_1km"), r(F.avg("NDVI_1km"), 8).alias("NDVI_1km"), r(F.avg("NDVI"), 8).alias("NDVI"))


@query("general_dataset", UNIFIED_SQL + f"""
SELECT area_id::BIGINT AS area_id, count(*) AS rows, count(ndvi) AS ndvi, {s_r('avg(ndvi1)', 9)} AS ndvi_1km, count(DISTINCT d) AS dates,
  false AS has_targets, false AS has_unrequested FROM panel GROUP BY 1
""")
def general_dataset(spark, sf):
    """A general download that asks for NDVI only: neither temperatures nor other variables come along."""
    fine, coarse, nodes = unified_inputs(spark, sf)
    out = unified_table(fine, coarse, nodes, tolerance_days=2, purpose="general_download", requested=["NDVI"])
    return out.groupBy(long("area_id").alias("area_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("NDVI").alias("ndvi"), r(F.avg("NDVI_1km"), 9).alias("ndvi_1km"), F.count_distinct("date").alias("dates"),
        F.lit(bool({"LST_K", "LST_1km"} & set(out.columns))).alias("has_targets"), F.lit("DEM" in out.columns).alias("has_unrequested"))


@query("raster_pixels_by_area", """
WITH p AS (SELECT c_nationkey % 5 AS area_id, c_custkey // 40 AS r, c_custkey % 40 AS c, 230 + abs(c_acctbal) / 60 AS lst FROM customer)
SELECT area_id::BIGINT AS area_id, r AS "row", c AS col, (round(lst, 8) + 0.0::DOUBLE) AS lst FROM p
WHERE lst BETWEEN 223 AND 360 AND c * 25 <= 500 + area_id * 50 AND (c + 1) * 25 >= 100 + area_id * 20 AND 1000 - r * 25 >= 300 - area_id * 30 AND 1000 - (r + 1) * 25 <= 900
""")
def raster_pixels_by_area(spark, sf):
    """The pixels of each area's raster that touch its own box."""
    k, area = F.col("c_custkey"), F.col("c_nationkey") % 5
    raster = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(
        area.alias("area_id"), F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), (F.lit(230) + F.abs("c_acctbal") / 60).alias("LST"),
        F.lit(1.0).alias("LST_uncertainty"), F.lit(3.0).alias("CONFIDENCE"), F.lit(1.0).alias("dataMask"))
    a = F.col("area_id")
    boxes = raster.select("area_id").distinct().select("area_id", (a * 20 + 100).alias("xmin"), (F.lit(300) - a * 30).alias("ymin"), (a * 50 + 500).alias("xmax"), F.lit(900).alias("ymax"))
    out = raster_pixels(raster, x0=0.0, y0=1000.0, resolution=25.0, area_box=boxes, by=["area_id"])
    return out.select(long("area_id").alias("area_id"), long("row").alias("row"), long("col").alias("col"), r("LST", 8).alias("lst"))


@query("fine_contract", f"""
SELECT l_orderkey || '-' || l_linenumber AS node_id, l_shipdate::DATE AS date, {s_r('290 + l_quantity / 5', 8)} AS LST_K, l_discount AS NDVI, l_tax AS NDBI,
  (l_partkey % 300)::DOUBLE AS DEM, 'node_id,date,acquisition_dt_utc,latitude,longitude,LST_K,NDVI,Tair_C,RH,Rsol_Wm2,wind_speed,rain_3d,DEM,NDBI,ALBEDO,aspect_ratio,has_buildings,row,col,row_norm,col_norm,day_of_year,sin_doy,cos_doy,EVI' AS header
FROM lineitem
""")
def fine_contract(spark, sf):
    """The fine table in the order of its contract with a requested column more and a stray one less."""
    rows = line_rows(spark, sf).select(
        F.lit("stray").alias("stray"), "node_id", "date", F.col("date").cast("timestamp").alias("acquisition_dt_utc"), F.col("base").alias("LST_K"),
        F.col("l_discount").alias("NDVI"), F.col("l_tax").alias("NDBI"), (F.col("l_partkey") % 300).cast("double").alias("DEM"), F.lit(0.4).alias("EVI"))
    rest = [c for c in contract.FINE_COLUMNS if c not in rows.columns]
    out = contract.fine_table(rows.withColumns({c: F.lit(1.0) for c in rest}), ["EVI"])
    return out.select("node_id", "date", r("LST_K", 8).alias("LST_K"), "NDVI", "NDBI", "DEM", F.lit(",".join(out.columns)).alias("header"))


@query("parsed_dates", """
SELECT ts::DATE AS day, count(*) AS rows, count(DISTINCT event_id % 6) AS forms FROM events WHERE event_id % 6 < 3 GROUP BY 1
""")
def parsed_dates(spark, sf):
    """Dates as day, minute and second texts; unreadable, empty and missing ones go."""
    e = events(spark, sf)
    k = F.col("event_id") % 6
    text = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
            .when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.lit("2024-13-77")).when(k == 4, F.lit("")))
    return e.select(parse_day(text).alias("day"), k.alias("k")).where("day IS NOT NULL").groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("k").alias("forms"))


@query("rain_fallback", f"""
SELECT event_id, {s_r("ln(1 + greatest(CASE WHEN event_type <> 'view' THEN value - 50 END, 0))", 8)} AS rain_3d_log_none, 0 AS kept,
  CASE WHEN event_type <> 'view' THEN (value > 50)::BIGINT END AS is_rainy FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, NULL, 0, NULL FROM events WHERE event_type = 'view'
""")
def rain_fallback(spark, sf):
    """Log and flag where a table lacks them; missing rain stays missing; columns that are there are not touched."""
    e = events(spark, sf).select("event_id", F.when(F.col("event_type") != "view", F.col("value") - 50).alias("rain_3d"))
    out = with_rain_features(e)
    again = with_rain_features(out.withColumn("rain_3d_log", F.lit(-1.0)))
    kept = again.where("rain_3d_log <> -1").count()
    return out.select("event_id", r("rain_3d_log", 8).alias("rain_3d_log_none"), F.lit(kept).cast("int").alias("kept"), long("is_rainy").alias("is_rainy"))


@query("morphology_deltas", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {s_r('l_partkey % 300 - 150.5', 6)} AS DEM_delta,
  {s_r("CASE WHEN l_returnflag <> 'R' THEN l_quantity % 2 - 0.5 END", 6)} AS has_buildings_delta FROM lineitem
""")
def morphology_deltas(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").select(
        "l_orderkey", long("l_linenumber").alias("l_linenumber"), (F.col("l_partkey") % 300).alias("DEM"), F.lit(150.5).alias("DEM_1km"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") % 2).alias("has_buildings"), F.lit(0.5).alias("has_buildings_1km"))
    out = fusion.column_deltas(li, fusion.MORPHOLOGY_PAIRS)
    return out.select("l_orderkey", "l_linenumber", r("DEM_delta", 6).alias("DEM_delta"), r("has_buildings_delta", 6).alias("has_buildings_delta"))


@query("scene_per_acquisition", """
WITH q AS (SELECT DISTINCT epoch_us(ts) AS t FROM events WHERE event_type IN ('purchase', 'error')), c AS (SELECT DISTINCT epoch_us(ts) AS c FROM events WHERE event_type = 'view'),
m AS (SELECT t, arg_min(c, (abs(c - t), c)) AS c FROM (SELECT t, unnest([(SELECT max(c) FROM c WHERE c <= t), (SELECT min(c) FROM c WHERE c >= t)]) AS c FROM q) GROUP BY t)
SELECT t AS acquired_us, c AS scene_us, abs(c - t) AS gap_us FROM m WHERE abs(c - t) <= 1800000000
""")
def scene_per_acquisition(spark, sf):
    """The nearest scene of every acquisition, within half an hour."""
    e = events(spark, sf)
    out = nearest_product_times(e.where(F.col("event_type").isin("purchase", "error")), e.where("event_type = 'view'").withColumnRenamed("ts", "acquisition_dt_utc"),
                                time="ts", bucket_micros=3_600_000_000, tolerance_micros=1_800_000_000)
    return out.select(F.col("_t").alias("acquired_us"), F.col("match_time").alias("scene_us"), F.col("time_gap").alias("gap_us"))


@query("training_guard", f"""
SELECT month(l_shipdate)::BIGINT AS month, l_discount <> 0.04 AND l_tax <> 0.02 AS training_ready, count(*) AS rows, {s_r('avg(l_quantity)', 6)} AS quantity
FROM lineitem WHERE month(l_shipdate) BETWEEN 5 AND 10 AND l_linenumber <> 7 GROUP BY ALL
""")
def training_guard(spark, sf):
    """Dated rows of the warm months with both temperatures or not; rows of unreadable dates go."""
    rows = line_rows(spark, sf).select(
        "node_id", F.when(F.col("node_id").endswith("-7"), F.lit("bad")).otherwise(F.col("date").cast("string")).alias("date"),
        F.when(F.col("l_discount") != 0.04, F.col("base")).alias("LST_K"), F.when(F.col("l_tax") != 0.02, F.col("base")).alias("LST_1km"),
        "l_quantity", F.lit("lst_downscaling").alias("dataset_purpose"))
    out = training_rows(rows, [5, 6, 7, 8, 9, 10])
    return out.groupBy(long(F.month("date")).alias("month"), "training_ready").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("l_quantity"), 6).alias("quantity"))


WEATHER_REQUEST = ["runoff", "surface_pressure", "snow_cover", "wind_direction", "skin_reservoir_content"]


@query("weather_request", f"""
WITH h AS (SELECT date_trunc('hour', ts) AS t, avg(value + 250) AS t2m, avg(value / 2 + 230) AS d2m, avg(value * 3600) AS ssrd, avg(value / 20) AS u10,
  avg(1 - value / 30) AS v10, avg(value / 1000) AS tp, avg(value / 500) AS ro, avg(value * 1000) AS sp, avg(value / 100) AS snowc, avg(value / 2000) AS src FROM events GROUP BY 1),
k AS (SELECT *, CASE WHEN hour(t) = 1 THEN 1 WHEN t - lag(t) OVER w = INTERVAL 1 HOUR THEN 2 ELSE 0 END AS step, lag(ssrd) OVER w AS ps, lag(tp) OVER w AS pt, lag(ro) OVER w AS pr FROM h WINDOW w AS (ORDER BY t)),
i AS (SELECT *, greatest(CASE step WHEN 1 THEN ssrd WHEN 2 THEN ssrd - ps END, 0) + CASE WHEN step = 0 THEN NULL ELSE 0 END AS is_, greatest(CASE step WHEN 1 THEN tp WHEN 2 THEN tp - pt END, 0) + CASE WHEN step = 0 THEN NULL ELSE 0 END AS it,
  CASE step WHEN 1 THEN ro WHEN 2 THEN ro - pr END AS ir FROM k),
o AS (SELECT true AS totals, t, t2m, is_ AS s, it AS p, ir AS ro, sp, snowc, u10, v10, src FROM i UNION ALL SELECT false, t, t2m, ssrd, tp, ro, sp, snowc, u10, v10, src FROM h)
SELECT totals, epoch_us(t) AS t_us, {s_r('t2m - 273.15', 8)} AS Tair_C, {s_r('s / 3600', 8)} AS Rsol_Wm2, {s_r('p * 1000', 8)} AS precip_mm, {s_r('ro * 1000', 8)} AS runoff_mm,
  {s_r('sp / 100', 8)} AS surface_pressure_hPa, {s_r('CASE WHEN snowc <= 1 THEN snowc * 100 ELSE snowc END', 8)} AS snow_cover_pct, {s_r('sqrt(u10 * u10 + v10 * v10)', 8)} AS wind_speed, {s_r('src * 1000', 8)} AS skin_reservoir_mm FROM o
""")
def weather_request(spark, sf):
    """The fields that a request needs, from running totals (differenced) and from server increments (not)."""
    v = F.col("value")
    raw = events(spark, sf).select(
        F.date_trunc("hour", "ts").alias("era5_dt_utc"), (v + 250).alias("t2m"), (v / 2 + 230).alias("d2m"), (v * 3600).alias("ssrd"), (v / 20).alias("u10"),
        (F.lit(1) - v / 30).alias("v10"), (v / 1000).alias("tp"), (v / 500).alias("ro"), (v * 1000).alias("sp"), (v / 100).alias("snowc"), (v / 2000).alias("src"),
        F.lit(1.0).alias("not_asked"))
    names = ["Tair_C", "Rsol_Wm2", "precip_mm", "runoff_mm", "surface_pressure_hPa", "snow_cover_pct", "wind_speed", "skin_reservoir_mm"]
    out = None
    for totals in (True, False):
        hourly, _ = weather_tables(raw, requested=WEATHER_REQUEST, running_totals=totals)
        part = hourly.select(F.lit(totals).alias("totals"), micros("era5_dt_utc").alias("t_us"), *[r(n, 8).alias(n) for n in names])
        out = part if out is None else out.unionByName(part)
    return out


@query("bundle_round_trip", f"""
WITH RECURSIVE {S_ROWS}, w AS ({s_day_sizes('x')}), px AS ({s_pixels('x')}), {ridge_ctes('lin', 'px', ['LST_1km'], 'group_mean', 0.01)},
{ridge_ctes('spa', 'w', SPATIAL, 'anomaly', 10.0, balance='day_size')}, {s_translated('done', 'x', ridge_value('c', 'q', ['LST_1km']) + '|lin', 'spa')}
SELECT date, count(*) AS rows, {s_r('avg(p)', 4)} AS predicted, {s_r('max(p)', 4)} AS largest FROM done GROUP BY ALL
""")
def bundle_round_trip(spark, sf):
    """A fitted bundle written, read again and used."""
    rows = stored(translation_rows(spark, sf))
    path = fresh_path(spark)
    save_bundle(fit_bundle(rows, "linear+ridge"), spark, path, purpose="translation")
    out = predict_bundle(load_bundle(spark, path), rows)
    return out.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("LST_predicted_K"), 4).alias("predicted"), r(F.max("LST_predicted_K"), 4).alias("largest"))


@query("ridge_importances", f"""
WITH RECURSIVE {S_ROWS}, {ridge_ctes('spa', 'x', SPATIAL, 'anomaly', 10.0)}
SELECT variable, {s_r('importance', 6)} AS importance FROM (SELECT unnest({SPATIAL!r}) AS variable, unnest([{', '.join(f'b_{i}' for i in range(6))}]) AS importance FROM spa)
UNION ALL SELECT 'gap_ALBEDO_S2_delta', {s_r('b_8', 6)} FROM spa
""")
def ridge_importances(spark, sf):
    """Coefficients of the standardised inputs, largest first."""
    rows = stored(translation_rows(spark, sf))
    model = fit_regressor(rows, SPATIAL, "LST_spatial_anomaly_K", {"kind": "ridge", "alpha": 10.0})
    return ranked_importances(spark, model).withColumn("importance", r("importance", 6))
