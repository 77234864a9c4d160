"""Queries of the spectral, weather and quality functions."""

from pyspark.sql import functions as F

from ..functions import quality, spectral, weather
from ..operators.reports import source_counters
from ..sources.tables import covariate_scenes, gridded_weather, wide_hours
from .base import day, events, long, query, r, s_r, table

# Digital numbers derived from line items: integer-valued band columns.
FINE_DN = {
    "SR_B1": "7000 + l_partkey % 900", "SR_B2": "7500 + l_suppkey % 1000",
    "SR_B3": "8000 + l_quantity * 11", "SR_B4": "8200 + l_discount * 9000",
    "SR_B5": "9000 + l_tax * 60000", "SR_B6": "8500 + l_linenumber * 150",
    "SR_B7": "8100 + l_orderkey % 1300", "ST_B10": "40000 + l_quantity * 100",
    "ST_EMIS": "9500 + l_linenumber", "ST_EMSD": "l_linenumber * 3", "ST_ATRAN": "8000 + l_quantity",
    "ST_CDIST": "l_quantity * 7", "ST_QA": "l_partkey % 400",
}
COVARIATE_DN = {
    "B1": "l_partkey % 900", "B2": "500 + l_suppkey % 1000", "B3": "l_quantity * 30",
    "B4": "l_discount * 20000", "B5": "900 + l_linenumber", "B6": "1000 + l_linenumber",
    "B7": "1100 + l_linenumber", "B8": "l_tax * 30000", "B8A": "1500 + l_linenumber",
    "B11": "l_linenumber * 400", "B12": "l_orderkey % 1500", "AOT": "l_quantity * 3",
    "WVP": "l_partkey % 3000",
}
KEY = ["l_orderkey", "l_linenumber"]
FINE_EXTRA = [*["reflectance_" + b for b in spectral.FINE_BANDS], "NDWI", "MNDWI", "NDMI", "EVI",
              "SAVI", "BSI", "urban_index", "surface_emissivity", "emissivity_uncertainty",
              "atmospheric_transmittance", "cloud_distance", "LST_uncertainty"]
COVARIATE_EXTRA = [*["reflectance_" + b for b in spectral.COVARIATE_BANDS], "NDWI", "MNDWI",
                   "NDMI", "EVI", "SAVI", "BSI", "urban_index", "aerosol_optical_thickness",
                   "water_vapour"]


def band_rows(spark, sf, bands):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_quantity", "l_discount", "l_tax")
    return li.select(
        "l_orderkey", long("l_linenumber").alias("l_linenumber"),
        *[F.expr(f"cast({e} as double)").alias(b) for b, e in bands.items()])


def _index_sql(suffix: str) -> str:
    def g(a: str, b: str) -> str:
        return f"({a}) / (CASE WHEN ({b}) = 0 THEN 1.0 ELSE ({b}) END)"
    items = {
        "NDVI": g("nir - red", "nir + red"), "NDBI": g("swir1 - nir", "swir1 + nir"),
        "ALBEDO": "(blue + green + red + nir) / 4", "NDWI": g("green - nir", "green + nir"),
        "MNDWI": g("green - swir1", "green + swir1"), "NDMI": g("nir - swir1", "nir + swir1"),
        "EVI": "2.5::DOUBLE * (nir - red) / nullif(nir + 6 * red - 7.5::DOUBLE * blue + 1, 0)",
        "SAVI": "1.5::DOUBLE * (nir - red) / nullif(nir + red + 0.5::DOUBLE, 0)",
        "BSI": g("(swir1 + red) - (nir + blue)", "(swir1 + red) + (nir + blue)"),
        "urban_index": g("swir2 - nir", "swir2 + nir"),
    }
    return ", ".join(f"{s_r(v, 11)} AS {k}{suffix}" for k, v in items.items())


def _dn_sql(bands: dict) -> str:
    return ", ".join(f"({e})::DOUBLE AS {b}" for b, e in bands.items())


FINE_SQL = (
    f"WITH dn AS (SELECT l_orderkey, l_linenumber, {_dn_sql(FINE_DN)} FROM lineitem), r AS (SELECT *, "
    + ", ".join(f"{src} * 2.75e-5::DOUBLE - 0.2::DOUBLE AS {b}" for b, src in spectral.FINE_BANDS.items())
    + f" FROM dn) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, "
    f"{s_r('ST_B10 * 0.00341802::DOUBLE + 149.0::DOUBLE', 11)} AS LST_K, {_index_sql('')}, "
    + ", ".join(f"{s_r(b, 11)} AS SR_{b}" for b in spectral.FINE_BANDS)
    + f", {s_r('ST_EMIS * 0.0001::DOUBLE', 11)} AS surface_emissivity, {s_r('ST_EMSD * 0.0001::DOUBLE', 11)} AS emissivity_uncertainty"
    f", {s_r('ST_ATRAN * 0.0001::DOUBLE', 11)} AS atmospheric_transmittance, {s_r('ST_CDIST * 0.01::DOUBLE', 11)} AS cloud_distance_km"
    f", {s_r('ST_QA * 0.01::DOUBLE', 11)} AS LST_uncertainty_K FROM r")

COVARIATE_SQL = (
    f"WITH dn AS (SELECT l_orderkey, l_linenumber, {_dn_sql(COVARIATE_DN)} FROM lineitem), r AS (SELECT *, "
    + ", ".join(f"{src} / 10000.0::DOUBLE AS {b}" for b, src in spectral.COVARIATE_BANDS.items())
    + f" FROM dn) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_index_sql('_S2')}, "
    + ", ".join(f"{s_r(b, 11)} AS SR_{b}_S2" for b in spectral.COVARIATE_BANDS)
    + f", {s_r('AOT * 0.001::DOUBLE', 11)} AS AOT_S2, {s_r('WVP * 0.001::DOUBLE', 11)} AS water_vapour_cm_S2 FROM r")


@query("spectral_indices", FINE_SQL)
def spectral_indices(spark, sf):
    out = spectral.with_fine_variables(band_rows(spark, sf, FINE_DN), FINE_EXTRA)
    return out.select(*KEY, *[r(c, 11).alias(c) for c in spectral.fine_output_names(FINE_EXTRA)])


@query("covariate_indices", COVARIATE_SQL)
def covariate_indices(spark, sf):
    out = spectral.with_covariate_variables(band_rows(spark, sf, COVARIATE_DN), COVARIATE_EXTRA)
    return out.select(*KEY, *[r(c, 11).alias(c)
                              for c in spectral.covariate_output_names(COVARIATE_EXTRA)])


WEATHER_IN = {
    "t2m": "270 + l_quantity", "d2m": "265 + l_quantity * 0.9", "ssrd": "l_extendedprice * 30",
    "strd": "l_extendedprice * 11", "u10": "l_linenumber - 4", "v10": "l_discount * 100 - 5",
    "skt": "271 + l_quantity", "sp": "90000 + l_extendedprice / 10", "snowc": "l_tax * 20",
    "sd": "l_tax", "stl1": "280 + l_linenumber", "stl2": "281 + l_linenumber",
    "stl3": "282 + l_linenumber", "stl4": "283 + l_linenumber", "swvl1": "l_discount",
    "swvl2": "l_tax", "swvl3": "l_discount * 2", "swvl4": "l_tax * 2", "tp": "l_tax / 100",
}


@query("weather_formulas", f"""
WITH w AS (SELECT l_orderkey, l_linenumber, {_dn_sql(WEATHER_IN)} FROM lineitem),
c AS (SELECT *, t2m - 273.15::DOUBLE AS t, d2m - 273.15::DOUBLE AS td FROM w)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {s_r('t')} AS Tair_C, {s_r('td')} AS dewpoint_C,
 {s_r('least(greatest(100 * exp(17.625::DOUBLE * td / (243.04::DOUBLE + td) - 17.625::DOUBLE * t / (243.04::DOUBLE + t)), 0), 100)')} AS RH,
 {s_r('greatest(0.6108::DOUBLE * exp(17.27::DOUBLE * t / (t + 237.3::DOUBLE)) - 0.6108::DOUBLE * exp(17.27::DOUBLE * td / (td + 237.3::DOUBLE)), 0)')} AS VPD_kPa,
 {s_r('ssrd / 3600', 7)} AS Rsol_Wm2, {s_r('strd / 3600', 7)} AS Rthermal_Wm2, {s_r('u10')} AS wind_u10, {s_r('v10')} AS wind_v10,
 {s_r('sqrt(u10 * u10 + v10 * v10)')} AS wind_speed,
 {s_r('(180 + degrees(atan2(u10, v10))) - 360 * floor((180 + degrees(atan2(u10, v10))) / 360)')} AS wind_direction_deg,
 {s_r('skt - 273.15::DOUBLE')} AS skin_temperature_C, {s_r('sp / 100', 7)} AS surface_pressure_hPa,
 {s_r('CASE WHEN snowc <= 1 THEN snowc * 100 ELSE snowc END')} AS snow_cover_pct, {s_r('sd')} AS snow_depth_m,
 {s_r('stl1 - 273.15::DOUBLE')} AS soil_temperature_l1, {s_r('stl4 - 273.15::DOUBLE')} AS soil_temperature_l4,
 {s_r('swvl1')} AS soil_moisture_l1, {s_r('swvl4')} AS soil_moisture_l4, {s_r('tp * 1000')} AS precip_mm FROM c
""")
def weather_formulas(spark, sf):
    li = table(spark, sf, "lineitem", *KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    w = li.select("l_orderkey", long("l_linenumber").alias("l_linenumber"),
                               *[F.expr(f"cast({e} as double)").alias(c) for c, e in WEATHER_IN.items()])
    out = weather.with_weather_outputs(w)
    names = ["Tair_C", "dewpoint_C", "RH", "VPD_kPa", "wind_u10", "wind_v10", "wind_speed",
             "wind_direction_deg", "skin_temperature_C", "snow_cover_pct", "snow_depth_m",
             "soil_temperature_l1", "soil_temperature_l4", "soil_moisture_l1", "soil_moisture_l4",
             "precip_mm"]
    return out.select(*KEY, *[r(c).alias(c) for c in names], *[r(c, 7).alias(c) for c in (
        "Rsol_Wm2", "Rthermal_Wm2", "surface_pressure_hPa")])


EXTRA_FIELDS = [f for f in weather.SINGLE_FIELDS if f[2] not in WEATHER_IN]


def _extra_sql() -> str:
    parts = []
    for i, (_, _, _, out, kind) in enumerate(EXTRA_FIELDS):
        base = f"(l_quantity + {i})"
        value = {"celsius": f"{base} - 273.15::DOUBLE", "depth": f"{base} * 1000",
                 "flux": f"{base} / 3600", "copy": base}[kind]
        parts.append(f"{s_r(value, 8)} AS {out}")
    return "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, " + ", ".join(parts) + " FROM lineitem"


@query("weather_extra_fields", _extra_sql())
def weather_extra_fields(spark, sf):
    li = table(spark, sf, "lineitem", *KEY, "l_quantity")
    w = li.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), *[
        (F.col("l_quantity") + F.lit(i)).alias(f[2]) for i, f in enumerate(EXTRA_FIELDS)])
    out = weather.with_weather_outputs(w)
    return out.select(*KEY, *[r(f[3], 8).alias(f[3]) for f in EXTRA_FIELDS])


QUALITY_SQL = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate::DATE AS d,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN NULL ELSE 200 + l_quantity * 4 END AS lst,
  l_discount * 60 AS unc, CASE WHEN l_linestatus = 'F' THEN 16384 ELSE 0 END + l_linenumber AS conf FROM lineitem),
s AS (SELECT *, CASE WHEN lst IS NULL OR lst NOT BETWEEN 223 AND 360 OR unc NOT BETWEEN 0 AND 5 THEN 'invalid'
  WHEN (conf & 16384) <> 0 THEN 'cloudy' ELSE 'valid' END AS status FROM x)
"""


def cascade_rows(spark, sf):
    li = table(spark, sf, "lineitem", *KEY, "l_suppkey", "l_shipdate", "l_quantity", "l_discount",
               "l_returnflag", "l_linestatus")
    x = li.select(
        "l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_suppkey",
        day("l_shipdate").alias("date"),
        F.when(~((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7)),
               F.lit(200) + F.col("l_quantity") * 4).alias("lst"),
        (F.col("l_discount") * 60).alias("unc"),
        (F.when(F.col("l_linestatus") == "F", 16384).otherwise(0) + F.col("l_linenumber"))
        .cast("double").alias("conf"))
    return x.withColumn("status", quality.coarse_status("lst", "unc", "conf"))


@query("quality_cascade", QUALITY_SQL + "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, status FROM s")
def quality_cascade(spark, sf):
    return cascade_rows(spark, sf).select(*KEY, "status")


@query("quality_counters", QUALITY_SQL + """
, cat AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), k AS (SELECT s.* FROM s WHERE d IN (SELECT d FROM cat)),
t AS (SELECT count(*) AS n FROM cat), c AS (SELECT count(DISTINCT s_suppkey) AS cells FROM supplier)
SELECT t.n AS catalog_dates, count(DISTINCT d) AS returned_dates, count(DISTINCT d) FILTER (status = 'valid') AS valid_dates,
 count(DISTINCT d) FILTER (status = 'cloudy') AS cloudy_dates, t.n - count(DISTINCT d) AS missing_dates, t.n * c.cells AS expected_cell_days,
 count(*) AS returned_cell_days, count(*) FILTER (status = 'valid') AS valid_cell_days, count(*) FILTER (status = 'cloudy') AS cloudy_cell_days,
 count(*) FILTER (status = 'invalid') AS invalid_cell_days, greatest(t.n * c.cells - count(*), 0) AS missing_cell_days
FROM k, t, c GROUP BY t.n, c.cells
""")
def quality_counters(spark, sf):
    catalogue = table(spark, sf, "orders", "o_orderdate").select(day("o_orderdate").alias("date"))
    cells = table(spark, sf, "supplier", "s_suppkey").distinct().count()  # one number
    out = source_counters(cascade_rows(spark, sf), catalogue, day="date", status="status",
                          cells=cells)
    return out.select(*[long(c).alias(c) for c in out.columns])


@query("pixel_masks", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ((l_orderkey % 512) & 184) = 0 AS clear, (l_partkey % 12) NOT IN (3, 8, 9, 10, 11) AS kept,
 ((l_partkey * 8) & 16384) <> 0 AS bit14, round_even(l_quantity / 2, 0)::BIGINT AS rounded FROM lineitem
""")
def pixel_masks(spark, sf):
    li = table(spark, sf, "lineitem", *KEY, "l_partkey", "l_quantity")
    return li.select(
        "l_orderkey", long("l_linenumber").alias("l_linenumber"),
        quality.fine_pixel_clear(F.col("l_orderkey") % 512).alias("clear"),
        quality.scene_class_kept(F.col("l_partkey") % 12).alias("kept"),
        quality.bit_set(F.col("l_partkey") * 8, 14).alias("bit14"),
        long(quality.rounded_flags(F.col("l_quantity") / 2)).alias("rounded"))


@query("wide_to_long_hours", f"""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), h AS (SELECT *, unnest(range(24)) AS h FROM d),
v AS (SELECT user_id, ts::DATE AS day, hour(ts) AS h, sum(CASE WHEN event_type <> 'error' THEN value END) AS t2m,
  max(CASE WHEN event_type <> 'error' THEN value END) AS tp FROM events GROUP BY 1, 2, 3)
SELECT user_id, day, epoch_us(day::TIMESTAMP) + h * 3600000000 AS t_us, {s_r('t2m', 4)} AS t2m, {s_r('tp', 4)} AS tp
FROM h LEFT JOIN v USING (user_id, day, h)
""")
def wide_to_long_hours(spark, sf):
    """All events; values of errors are unknown, so hours without others are gaps."""
    e = events(spark, sf).select("user_id", day("ts").alias("day"), F.hour("ts").alias("h"),
                                 F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    aggs = []
    for h in range(24):
        v = F.when(F.col("h") == h, F.col("value"))
        aggs += [F.sum(v).alias(f"h{h:03d}_t2m"), F.max(v).alias(f"h{h:03d}_tp")]
    wide = e.groupBy("user_id", "day").agg(*aggs)
    out = wide_hours(wide, ["user_id", "day"], ["t2m", "tp"], F.col("day"))
    return out.select(
        "user_id", "day", F.unix_micros("datetime_utc").alias("t_us"), r("t2m", 4).alias("t2m"),
        r("tp", 4).alias("tp"))


@query("gridded_regional_mean", f"""
SELECT epoch_us(date_trunc('hour', ts)) AS t_us, {s_r('avg(value + 273)', 8)} AS t2m, {s_r('avg(value / 1000)', 11)} AS tp FROM events GROUP BY 1
""")
def gridded_regional_mean(spark, sf):
    from ..operators.series import regional_mean
    raw = events(spark, sf).select(
        F.date_trunc("hour", "ts").alias("valid_time"),
        (F.col("user_id") / 10).alias("latitude"), (F.col("user_id") % 10).cast("double").alias("longitude"),
        (F.col("value") + 273).alias("t2m"), (F.col("value") / 1000).alias("tp"))
    out = regional_mean(gridded_weather(raw, ["t2m", "tp"]), "era5_dt_utc", ["t2m", "tp"])
    return out.select(F.unix_micros("era5_dt_utc").alias("t_us"), r("t2m", 8).alias("t2m"),
                      r("tp", 11).alias("tp"))


@query("covariate_scene_means", f"""
SELECT (epoch_ms(date_trunc('hour', ts)) // 86400000)::BIGINT AS day_number, user_id::VARCHAR AS node_id, {s_r('avg(value)', 8)} AS NDVI_S2_100m,
 {s_r('avg(value / 2)', 8)} AS NDBI_S2_100m, {s_r("avg(CASE WHEN event_type = 'view' THEN value END)", 8)} AS ALBEDO_S2_100m FROM events GROUP BY 1, 2
""")
def covariate_scene_means(spark, sf):
    raw = events(spark, sf).select(
        F.col("user_id").alias("node_id"),
        F.unix_millis(F.date_trunc("hour", "ts")).alias("s2_source_time_start"),
        F.col("value").alias("NDVI_S2"), (F.col("value") / 2).alias("NDBI_S2"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("ALBEDO_S2"))
    out = covariate_scenes(raw)
    return out.select(long(F.unix_date("s2_date")).alias("day_number"), "node_id", *[
        r(c, 8).alias(c) for c in ("NDVI_S2_100m", "NDBI_S2_100m", "ALBEDO_S2_100m")])
