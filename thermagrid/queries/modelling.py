"""Queries of the modelling jobs. Linear models have SQL twins by normal equations;
tree models are tested against node-by-node fits."""

from pyspark.sql import functions as F

from ..models.regressors import RESIDUAL_SETTINGS, fit_regressor
from ..models.translation import (CANDIDATES, compare_candidates, fit_bundle, predict_bundle, training_pairs,
                                  translation_features, with_scenes)
from ..operators.contract import numeric_features
from ..operators.groups import with_group_means
from ..operators.ranking import exact_medians
from ..operators.splits import with_temporal_split
from ..plans.downscaling import (area_test_metrics, coincident_rows, feature_set_comparison, holdout_test, ranked_importances,
                                 residual_downscaling, scope_by_area)
from ..plans.production import area_production, translate_all
from ..session import stored
from .base import day, long, query, r, s_r, table
from .ridge_sql import ridge_ctes, ridge_value


def line_rows(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate", "l_returnflag")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("node_id"), day("l_shipdate").alias("date"),
        (F.col("l_suppkey") % 5).alias("area_id"), (F.col("l_suppkey") % 7).alias("sentinel3_pixel_id"),
        (F.lit(290) + F.col("l_quantity") / 5).alias("base"), "l_quantity", "l_discount", "l_tax",
        "l_extendedprice", "l_partkey", "l_returnflag")


@query("linear_calibration", f"""
WITH x AS (SELECT l_quantity AS q, l_extendedprice AS y FROM lineitem), s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(y) AS my, count(*) AS n FROM x),
b AS (SELECT sum((q - mq) / sq * (y - my)) / (any_value(n) + 10.0::DOUBLE) AS b, any_value(mq) AS mq, any_value(sq) AS sq, any_value(my) AS my FROM x, s)
SELECT l_quantity AS quantity, count(*) AS n, {s_r('any_value(my + b * (l_quantity - mq) / sq)', 4)} AS predicted FROM lineitem, b GROUP BY 1
""")
def linear_calibration(spark, sf):
    x = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    model = fit_regressor(x, ["l_quantity"], "l_extendedprice", {"kind": "ridge", "alpha": 10.0})
    return model.predict(x, "p").groupBy(F.col("l_quantity").alias("quantity")).agg(
        F.count(F.lit(1)).alias("n"), r(F.max("p"), 4).alias("predicted"))


@query("exact_medians", """
SELECT median(l_quantity) AS quantity, median(l_extendedprice) AS price, median(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS tax FROM lineitem
""")
def medians(spark, sf):
    x = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_returnflag", "l_tax").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("tax"))
    m = exact_medians(x, ["quantity", "price", "tax"])
    names = ("quantity", "price", "tax")
    return spark.createDataFrame([tuple(m[c][0] for c in names)], ", ".join(f"{c} double" for c in names))


def translation_values(spark, sf):
    rows = line_rows(spark, sf)
    x = rows.select(
        "area_id", "sentinel3_pixel_id", "node_id", "date",
        (F.col("base") + F.col("l_discount") * 20 + F.col("l_tax") * 8).alias("LST_K"),
        F.col("base").alias("LST_1km"), F.lit(0.5).alias("lst_time_difference_hours"),
        (F.col("l_extendedprice") / 4000).alias("Tair_C_1km"), (F.col("l_tax") * 900).alias("RH_1km"),
        F.col("l_discount").alias("NDVI_S2_100m"), F.col("l_tax").alias("NDBI_S2_100m"),
        F.when(F.col("l_returnflag") != "R", F.col("l_discount") / 2).alias("ALBEDO_S2_100m"),
        (F.col("l_partkey") % 300).cast("double").alias("DEM"), F.lit(0.2).alias("aspect_ratio"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("has_buildings"))
    # A pixel has one coarse value: the mean of its rows.
    keys = ["area_id", "date", "sentinel3_pixel_id"]
    return with_group_means(x, keys, {"LST_1km": "_c"}, written=True).withColumn("LST_1km", F.col("_c")).drop("_c")


def translation_rows(spark, sf):
    return translation_features(translation_values(spark, sf), True)


def residual_table(spark, sf):
    """Same-day pairs with fine and coarse indices, building shape and weather."""
    return line_rows(spark, sf).select(
        "node_id", "date", (F.col("base") + F.col("l_discount") * 20 - F.col("l_tax") * 9).alias("LST_K"),
        F.col("base").alias("LST_1km"), F.col("l_discount").alias("NDVI"), F.lit(0.05).alias("NDVI_1km"),
        F.col("l_tax").alias("NDBI"), F.lit(0.04).alias("NDBI_1km"),
        (F.col("l_extendedprice") / 1e5).alias("ALBEDO"), F.lit(0.3).alias("ALBEDO_1km"),
        (F.col("l_partkey") % 10 / 10).alias("aspect_ratio"), F.lit(0.5).alias("aspect_ratio_1km"),
        (F.col("l_partkey") % 300).cast("double").alias("DEM"), F.lit(150.0).alias("DEM_1km"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") % 2).alias("has_buildings"), F.lit(0.5).alias("has_buildings_1km"),
        (F.col("l_extendedprice") / 4000).alias("Tair_C"), (F.col("l_tax") * 900).alias("RH"),
        F.sin(F.dayofyear("date")).alias("sin_doy"))


@query("residual_model")
def residual_model(spark, sf):
    run = residual_downscaling(residual_table(spark, sf))
    return run.metrics.select("model", *[r(c, 4).alias(c) for c in (
        "mae", "rmse", "r2", "bias", "mae_improvement_percent")], "dates", "rows")


@query("residual_importances")
def residual_importances(spark, sf):
    rows = line_rows(spark, sf).withColumn(
        "y", F.col("l_discount") * 20 - F.col("l_tax") * 9)
    model = fit_regressor(rows, ["l_discount", "l_tax", "l_quantity"], "y", RESIDUAL_SETTINGS, ids=["node_id", "date"])
    return ranked_importances(spark, model).withColumn("importance", r("importance", 4))


# The same rows in SQL.

PIXEL = "area_id, date, sentinel3_pixel_id"
SPATIAL = ["NDVI_S2_delta", "NDBI_S2_delta", "ALBEDO_S2_delta", "DEM_delta", "aspect_ratio_delta", "has_buildings_delta"]
FINE = ["NDVI_S2_100m", "NDBI_S2_100m", "ALBEDO_S2_100m", "DEM", "aspect_ratio", "has_buildings"]
COARSE = ["LST_1km", "lst_time_difference_hours", "Tair_C_1km", "RH_1km"]


def s_features(source: str) -> str:
    """Rows of ``source`` with what the models see: deltas, pixel mean and anomaly, day size, calibration input."""
    deltas = ", ".join(f"{a} - avg({a}) OVER (PARTITION BY {PIXEL}) AS {b}" for a, b in zip(FINE, SPATIAL))
    return (f"SELECT *, {deltas}, avg(LST_K) OVER (PARTITION BY {PIXEL}) AS group_mean, LST_K - avg(LST_K) OVER (PARTITION BY {PIXEL}) AS anomaly, "
            f"LST_K - LST_1km AS residual, 1 AS u FROM {source}")


S_ROWS = f"""
li AS (SELECT l_suppkey % 5 AS area_id, (l_suppkey % 7) AS sentinel3_pixel_id, l_orderkey || '-' || l_linenumber AS node_id, l_shipdate::DATE AS date,
  290 + l_quantity / 5 + l_discount * 20 + l_tax * 8 AS LST_K, 290 + l_quantity / 5 AS base, 0.5 AS lst_time_difference_hours,
  l_extendedprice / 4000 AS Tair_C_1km, l_tax * 900 AS RH_1km, l_discount AS NDVI_S2_100m, l_tax AS NDBI_S2_100m,
  CASE WHEN l_returnflag <> 'R' THEN l_discount / 2 END AS ALBEDO_S2_100m, (l_partkey % 300)::DOUBLE AS DEM, 0.2::DOUBLE AS aspect_ratio,
  CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_buildings FROM lineitem),
pix AS (SELECT * EXCLUDE (base), avg(base) OVER (PARTITION BY {PIXEL}) AS LST_1km FROM li),
x AS ({s_features('pix')})"""


def s_pixels(rows: str, extra: str = "") -> str:
    """One row per pixel: means of the coarse inputs and of the target."""
    return (f"SELECT {PIXEL}{extra}, 1 AS u, avg(group_mean) AS group_mean, {', '.join(f'avg({c}) AS {c}' for c in COARSE)} FROM {rows} "
            f"GROUP BY {PIXEL}{extra}")


def s_day_sizes(rows: str, by: str = "") -> str:
    return f"SELECT *, count(*) OVER (PARTITION BY {by}date) AS day_size FROM {rows}"


def s_folds(rows: str, by: str = "", folds: int = 5, seed: int = 42) -> str:
    """Rows with fold and day size, folds of whole dates in the order of a hash (of each ``by`` group)."""
    over = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return (f"SELECT r.*, f.fold, count(*) OVER (PARTITION BY {by}date) AS day_size FROM {rows} r JOIN (SELECT {by}date, "
            f"((row_number() OVER ({over} ORDER BY md5('{seed}:' || date::VARCHAR), date) - 1) % least({folds}, count(*) OVER ({over})) + 1)::INT AS fold "
            f"FROM (SELECT DISTINCT {by}date FROM {rows})) f USING ({by}date)")


def s_metrics(rows: str, by: str) -> str:
    """MAE, date-balanced MAE, RMSE, R2, bias, dates and rows of (o, p, date) by ``by``."""
    return f"""SELECT {by}, avg(e) AS mae, any_value(balanced) AS mae_by_date, sqrt(avg(se)) AS rmse, 1 - sum(se) / sum((o - mo) * (o - mo)) AS r2,
  avg(d) AS bias, count(DISTINCT date) AS dates, count(*) AS rows
FROM (SELECT *, abs(p - o) AS e, (p - o) * (p - o) AS se, p - o AS d, avg(o) OVER (PARTITION BY {by}) AS mo FROM {rows} WHERE p IS NOT NULL AND o IS NOT NULL)
JOIN (SELECT {by}, avg(m) AS balanced FROM (SELECT {by}, date, avg(abs(p - o)) AS m FROM {rows} WHERE p IS NOT NULL AND o IS NOT NULL GROUP BY ALL) GROUP BY ALL)
  USING ({by}) GROUP BY {by}"""


def s_translated(out: str, rows: str, coarse: str, spatial: str, keys: str = "u", extra: str = "") -> str:
    """CTE ``out``: ``rows`` with column p. ``coarse`` is an expression on the pixel alias c and the alias q of a table
    of calibrations (``coarse|table``), ``spatial`` the name of the anomaly model."""
    value, table = coarse.split("|")
    group = f"{PIXEL}{extra}"
    joined = f" JOIN {table} q USING ({keys})" if table else ""
    return f"""{out}_pix AS (SELECT {group}, {value} AS calibrated FROM (SELECT {group}{'' if 'u' in group.split(', ') else ', 1 AS u'},
  {', '.join(f'avg({c}) AS {c}' for c in COARSE)} FROM {rows} GROUP BY {group}) c{joined}),
{out}_raw AS (SELECT r.*, {ridge_value('r', 'q', SPATIAL)} AS shape FROM {rows} r JOIN {spatial} q USING ({keys})),
{out} AS (SELECT *, calibrated + shape - avg(shape) OVER (PARTITION BY {group}) AS p FROM {out}_raw JOIN {out}_pix USING ({group}))"""


BIAS = "c.LST_1km + q.shift|"


def s_bias(name: str, pixels: str, keys: str = "u", fold: bool = False) -> str:
    if not fold:
        return f"{name} AS (SELECT {keys}, avg(group_mean - LST_1km) AS shift FROM {pixels} GROUP BY {keys})"
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", ") if k != "fold")
    return (f"{name} AS (SELECT {', '.join('b.' + k for k in keys.split(', '))}, avg(a.group_mean - a.LST_1km) AS shift FROM {pixels} a JOIN "
            f"(SELECT DISTINCT {keys} FROM {pixels}) b ON {same} AND a.fold <> b.fold GROUP BY ALL)")


@query("translate_model", f"""
WITH RECURSIVE {S_ROWS}, w AS ({s_day_sizes('x')}), px AS ({s_pixels('x')}),
{ridge_ctes('lin', 'px', ['LST_1km'], 'group_mean', 0.01)}, {ridge_ctes('spa', 'w', SPATIAL, 'anomaly', 10.0, balance='day_size')},
{s_translated('done', 'x', ridge_value('c', 'q', ['LST_1km']) + '|lin', 'spa')}
SELECT area_id, sentinel3_pixel_id, count(*) AS rows, {s_r('avg(p)', 4)} AS predicted, {s_r('stddev_pop(p)', 4)} AS spread, {s_r('avg(LST_K)', 4)} AS observed,
  {s_r('avg(abs(p - LST_K))', 4)} AS mae FROM done GROUP BY ALL
""")
def translate_model(spark, sf):
    rows = stored(translation_rows(spark, sf))
    out = predict_bundle(fit_bundle(rows, "linear+ridge"), rows)
    return out.groupBy("area_id", "sentinel3_pixel_id").agg(
        F.count(F.lit(1)).alias("rows"), r(F.avg("LST_predicted_K"), 4).alias("predicted"),
        r(F.stddev_pop("LST_predicted_K"), 4).alias("spread"), r(F.avg("LST_K"), 4).alias("observed"),
        r(F.avg(F.abs(F.col("LST_predicted_K") - F.col("LST_K"))), 4).alias("mae"))


@query("model_compare")
def model_compare(spark, sf):
    """All twelve candidates and the direct ridge, five folds."""
    out = compare_candidates(translation_rows(spark, sf), [*CANDIDATES, "direct_ridge"])
    return out.select("model", *[r(c, 4).alias(c) for c in ("mae", "mae_by_date", "rmse", "r2")],
                      "dates", "rows")


LINEAR_CANDIDATES = ["bias+ridge", "linear+ridge", "ridge+ridge", "direct_ridge"]


@query("model_compare_linear", f"""
WITH RECURSIVE {S_ROWS}, t AS ({s_folds('x')}), px AS ({s_pixels('t', ', fold')}), {s_bias('bia', 'px', 'u, fold', fold=True)},
{ridge_ctes('lin', 'px', ['LST_1km'], 'group_mean', 0.01, fold=True)}, {ridge_ctes('rid', 'px', COARSE, 'group_mean', 10.0, fold=True)},
{ridge_ctes('spa', 't', SPATIAL, 'anomaly', 10.0, fold=True, balance='day_size')},
{ridge_ctes('dir', 't', [*COARSE, *SPATIAL], 'residual', 10.0, fold=True, balance='day_size')},
{s_translated('one', 't', BIAS + 'bia', 'spa', 'u, fold', ', fold')}, {s_translated('two', 't', ridge_value('c', 'q', ['LST_1km']) + '|lin', 'spa', 'u, fold', ', fold')},
{s_translated('three', 't', ridge_value('c', 'q', COARSE) + '|rid', 'spa', 'u, fold', ', fold')},
every AS (SELECT 'bias+ridge' AS model, date, LST_K AS o, p FROM one UNION ALL SELECT 'linear+ridge', date, LST_K, p FROM two
  UNION ALL SELECT 'ridge+ridge', date, LST_K, p FROM three
  UNION ALL SELECT 'direct_ridge', r.date, r.LST_K, r.LST_1km + {ridge_value('r', 'q', [*COARSE, *SPATIAL])} FROM t r JOIN dir q USING (u, fold)),
m AS ({s_metrics('every', 'model')})
SELECT model, {', '.join(f"{s_r(c, 4)} AS {c}" for c in ('mae', 'mae_by_date', 'rmse', 'r2', 'bias'))}, dates, rows FROM m
""")
def model_compare_linear(spark, sf):
    """The candidates that normal equations can check."""
    out = compare_candidates(translation_rows(spark, sf), LINEAR_CANDIDATES)
    return out.select("model", *[r(c, 4).alias(c) for c in ("mae", "mae_by_date", "rmse", "r2", "bias")], "dates", "rows")


S_PRETEST = "pre AS (SELECT * FROM x WHERE year(date) < 2000), tst AS (SELECT * FROM x WHERE year(date) = 2000)"


@query("holdout_year", f"""
WITH RECURSIVE {S_ROWS}, {S_PRETEST}, w AS ({s_day_sizes('pre')}), px AS ({s_pixels('pre')}), {s_bias('bia', 'px')},
{ridge_ctes('spa', 'w', SPATIAL, 'anomaly', 10.0, balance='day_size')}, {s_translated('done', 'tst', BIAS + 'bia', 'spa')},
every AS (SELECT 'coarse_raw' AS model, date, LST_K AS o, LST_1km AS p FROM tst
  UNION ALL SELECT 'mean_bias', date, LST_K, LST_1km + (SELECT avg(LST_K - LST_1km) FROM pre) FROM tst
  UNION ALL SELECT 'bias+ridge', date, LST_K, p FROM done), m AS ({s_metrics('every', 'model')})
SELECT model, {s_r('mae', 4)} AS mae, {s_r('rmse', 4)} AS rmse, {s_r('bias', 4)} AS bias, dates, rows,
  {s_r("((SELECT mae FROM m WHERE model = 'coarse_raw') - mae) * 100.0 / (SELECT mae FROM m WHERE model = 'coarse_raw')", 4)} AS mae_improvement_percent FROM m
""")
def holdout_year(spark, sf):
    out = holdout_test(translation_rows(spark, sf), "bias+ridge", 2000)
    return out.select("model", *[r(c, 4).alias(c) for c in (
        "mae", "rmse", "bias", "mae_improvement_percent")], "dates", "rows")


def s_macro(rows: str, out: str) -> str:
    return (f"SELECT area_id, avg(m) AS {out} FROM (SELECT area_id, date, avg(abs(p - LST_K)) AS m FROM {rows} GROUP BY ALL) GROUP BY ALL")


@query("scope_by_area", f"""
WITH RECURSIVE {S_ROWS}, {S_PRETEST}, t AS ({s_folds('pre')}), px AS ({s_pixels('t', ', fold')}), {s_bias('bia', 'px', 'u, fold', fold=True)},
{ridge_ctes('spa', 't', SPATIAL, 'anomaly', 10.0, fold=True, balance='day_size')}, {s_translated('gen', 't', BIAS + 'bia', 'spa', 'u, fold', ', fold')},
n AS (SELECT area_id, count(DISTINCT date) AS pretest_dates FROM pre GROUP BY ALL),
enough AS (SELECT * FROM pre WHERE area_id IN (SELECT area_id FROM n WHERE pretest_dates >= 12)), tl AS ({s_folds('enough', 'area_id, ')}),
pl AS ({s_pixels('tl', ', fold')}), {s_bias('bil', 'pl', 'area_id, fold', fold=True)},
{ridge_ctes('spl', 'tl', SPATIAL, 'anomaly', 10.0, ['area_id'], fold=True, balance='day_size')},
{s_translated('loc', 'tl', BIAS + 'bil', 'spl', 'area_id, fold', ', fold')},
g AS ({s_macro('gen', 'general_mae')}), l AS ({s_macro('loc', 'local_mae')})
SELECT area_id, pretest_dates, {s_r('general_mae', 5)} AS general_mae, {s_r('local_mae', 5)} AS local_mae,
  CASE WHEN local_mae <= general_mae * 0.98 AND pretest_dates >= 12 THEN 'local' ELSE 'general' END AS scope
FROM n LEFT JOIN g USING (area_id) LEFT JOIN l USING (area_id)
""")
def scope_by_area_query(spark, sf):
    out = scope_by_area(translation_rows(spark, sf), "bias+ridge", 2000)
    return out.select(long("area_id").alias("area_id"), "pretest_dates",
                      r("general_mae", 5).alias("general_mae"), r("local_mae", 5).alias("local_mae"),
                      "scope")


@query("area_test_metrics", f"""
WITH RECURSIVE {S_ROWS}, {S_PRETEST}, w AS ({s_day_sizes('pre')}), px AS ({s_pixels('pre')}), {s_bias('bia', 'px')},
{ridge_ctes('spa', 'w', SPATIAL, 'anomaly', 10.0, balance='day_size')}, {s_translated('gen', 'tst', BIAS + 'bia', 'spa')},
wl AS ({s_day_sizes('pre', 'area_id, ')}), {s_bias('bil', 'px', 'area_id')},
{ridge_ctes('spl', 'wl', SPATIAL, 'anomaly', 10.0, ['area_id'], balance='day_size')}, {s_translated('loc', 'tst', BIAS + 'bil', 'spl', 'area_id')},
every AS (SELECT area_id, 'baseline' AS model_scope, date, LST_K AS o, LST_1km AS p FROM tst UNION ALL SELECT area_id, 'general', date, LST_K, p FROM gen
  UNION ALL SELECT area_id, 'local', date, LST_K, p FROM loc), m AS ({s_metrics('every', 'area_id, model_scope')})
SELECT area_id, model_scope, {', '.join(f"{s_r(c, 4)} AS {c}" for c in ('mae', 'mae_by_date', 'rmse', 'r2', 'bias'))}, dates, rows,
  model_scope = CASE WHEN area_id % 2 = 0 THEN 'local' ELSE 'general' END AS selected FROM m
""")
def area_test_metrics_query(spark, sf):
    rows = translation_rows(spark, sf)
    scopes = rows.select("area_id").distinct().withColumn("scope", F.when(F.col("area_id") % 2 == 0, "local").otherwise("general"))
    out = area_test_metrics(rows, scopes, "bias+ridge", 2000)
    return out.select("area_id", "model_scope", *[r(c, 4).alias(c) for c in ("mae", "mae_by_date", "rmse", "r2", "bias")], "dates", "rows", "selected")


def production_tables(spark, sf):
    """Unified rows of five areas (some without an observed value, some of another
    day) and one fine scene a day of every node."""
    rows = translation_values(spark, sf)
    unified = rows.select(
        "area_id", "node_id", "date", "sentinel3_pixel_id",
        F.when(F.col("NDVI_S2_100m") != 0.04, F.col("LST_K")).alias("LST_K"),
        F.when(F.col("NDVI_S2_100m") != 0.01, F.col("LST_1km")).alias("LST_1km"),
        "lst_time_difference_hours", "Tair_C_1km", "RH_1km", "DEM", "aspect_ratio", "has_buildings")
    scenes = rows.select("area_id", "node_id", F.col("date").alias("s2_date"), "NDVI_S2_100m", "NDBI_S2_100m", "ALBEDO_S2_100m")
    return unified, scenes


S_PRODUCTION = f"""
{S_ROWS}, uni AS (SELECT area_id, node_id, date, sentinel3_pixel_id, CASE WHEN NDVI_S2_100m <> 0.04 THEN LST_K END AS LST_K,
  CASE WHEN NDVI_S2_100m <> 0.01 THEN LST_1km END AS LST_1km, lst_time_difference_hours, Tair_C_1km, RH_1km, DEM, aspect_ratio, has_buildings FROM x),
scn AS (SELECT area_id, node_id, date AS s2_date, NDVI_S2_100m, NDBI_S2_100m, ALBEDO_S2_100m FROM x),
cov AS (SELECT area_id, s2_date, avg((NDVI_S2_100m IS NOT NULL AND NDBI_S2_100m IS NOT NULL AND ALBEDO_S2_100m IS NOT NULL)::INT) AS q FROM scn GROUP BY ALL),
cho AS (SELECT d.area_id, d.date, arg_min(s2_date, (q < 0.8, abs(s2_date - d.date), -q, s2_date)) AS s2_date
  FROM (SELECT DISTINCT area_id, date FROM uni) d JOIN cov ON cov.area_id = d.area_id AND abs(cov.s2_date - d.date) <= 20 GROUP BY ALL),
att AS (SELECT uni.*, s2_date, NDVI_S2_100m, NDBI_S2_100m, ALBEDO_S2_100m FROM uni LEFT JOIN cho USING (area_id, date) LEFT JOIN scn USING (area_id, s2_date, node_id)),
vp AS (SELECT * FROM att WHERE LST_K IS NOT NULL AND LST_1km IS NOT NULL), pairs AS ({s_features('vp')}), w AS ({s_day_sizes('pairs')}), px AS ({s_pixels('pairs')}),
vr AS (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS LST_K) FROM att WHERE LST_1km IS NOT NULL), todo AS ({s_features('vr')})"""


@query("production_translation", f"""
WITH RECURSIVE {S_PRODUCTION}, {ridge_ctes('lin', 'px', ['LST_1km'], 'group_mean', 0.01)},
{ridge_ctes('spa', 'w', SPATIAL, 'anomaly', 10.0, balance='day_size')}, {s_translated('done', 'todo', ridge_value('c', 'q', ['LST_1km']) + '|lin', 'spa')}
SELECT area_id, 'sentinel3_to_landsat_model' AS target_source, count(*) AS rows, count(DISTINCT (node_id, date)) AS nodes, count(DISTINCT date) AS dates,
  {s_r('avg(p)', 4)} AS predicted, {s_r('stddev_pop(p)', 4)} AS spread, count(*) FILTER (p IS NULL) AS unpredicted, count(s2_date) AS with_scene,
  count(NDVI_S2_100m) AS with_covariates FROM done GROUP BY ALL
""")
def production_translation(spark, sf):
    unified, scenes = production_tables(spark, sf)
    rows = with_scenes(unified, scenes, by=["area_id"])
    _, out = translate_all(rows, None, training_pairs(rows, None, by=["area_id"]), "linear+ridge", by=["area_id"])
    return out.groupBy("area_id", "target_source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("node_id", "date").alias("nodes"), F.count_distinct("date").alias("dates"),
        r(F.avg("LST_predicted_K"), 4).alias("predicted"), r(F.stddev_pop("LST_predicted_K"), 4).alias("spread"),
        F.count_if(F.col("LST_predicted_K").isNull()).alias("unpredicted"), F.count("s2_date").alias("with_scene"),
        F.count("NDVI_S2_100m").alias("with_covariates"))


@query("area_production", f"""
WITH RECURSIVE {S_PRODUCTION}, {s_bias('bia', 'px')}, {ridge_ctes('spa', 'w', SPATIAL, 'anomaly', 10.0, balance='day_size')},
tg AS (SELECT * FROM todo WHERE area_id <> 2), tl AS (SELECT * FROM todo WHERE area_id = 2), {s_translated('gen', 'tg', BIAS + 'bia', 'spa')},
pa AS (SELECT * FROM pairs WHERE area_id = 2), wl AS ({s_day_sizes('pa', 'area_id, ')}), pl AS ({s_pixels('pa')}), {s_bias('bil', 'pl', 'area_id')},
{ridge_ctes('spl', 'wl', SPATIAL, 'anomaly', 10.0, ['area_id'], balance='day_size')}, {s_translated('loc', 'tl', BIAS + 'bil', 'spl', 'area_id')},
pred AS (SELECT area_id, node_id, date, min(p) AS p FROM (SELECT area_id, node_id, date, p FROM gen UNION ALL SELECT area_id, node_id, date, p FROM loc) GROUP BY ALL),
fused AS (SELECT area_id, node_id, LST_K, p, coalesce(LST_K, p) AS target FROM uni LEFT JOIN pred USING (area_id, node_id, date))
SELECT area_id, count(*) AS rows, count(LST_K) AS observed, count(*) FILTER (LST_K IS NULL AND p IS NOT NULL) AS synthetic, count(*) FILTER (target IS NULL) AS unavailable,
  CASE WHEN area_id = 2 THEN 'local' ELSE 'general' END AS scope, round(area_id / 10.0, 3) AS test_mae_k, {s_r('avg(target)', 4)} AS target,
  {s_r('avg(CASE WHEN LST_K IS NULL THEN p END)', 4)} AS synthetic_target, {s_r('stddev_pop(CASE WHEN LST_K IS NULL THEN p END)', 4)} AS synthetic_spread
FROM fused GROUP BY ALL
""")
def area_production_query(spark, sf):
    unified, scenes = production_tables(spark, sf)
    rows = with_scenes(unified, scenes, by=["area_id"])
    scopes = unified.select("area_id").distinct().select(
        "area_id", F.when(F.col("area_id") == 2, "local").otherwise("general").alias("scope"), (F.col("area_id") / 10).alias("test_mae_k"))
    out = area_production(unified, scenes, training_pairs(rows, None, by=["area_id"]), scopes, "bias+ridge", covered=rows)
    synthetic = F.when(F.col("target_is_synthetic") == 1, F.col("LST_target_K"))
    return out.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("rows"), long(F.sum("target_is_observed")).alias("observed"),
        long(F.sum("target_is_synthetic")).alias("synthetic"), F.count_if(F.col("LST_target_K").isNull()).alias("unavailable"),
        F.max("downscaling_scope").alias("scope"), r(F.max("downscaling_test_mae_k"), 3).alias("test_mae_k"),
        r(F.avg("LST_target_K"), 4).alias("target"), r(F.avg(synthetic), 4).alias("synthetic_target"),
        r(F.stddev_pop(synthetic), 4).alias("synthetic_spread"))


@query("feature_set_comparison")
def feature_sets_query(spark, sf):
    """Four feature sets of the residual model, 500 trees each, grown side by side."""
    ready = with_temporal_split(coincident_rows(residual_table(spark, sf))).where("training_ready")
    return feature_set_comparison(stored(ready)).select("feature_set", "n_features", r("mae", 4).alias("mae"), r("rmse", 4).alias("rmse"))


@query("numeric_feature_names", """
WITH x AS (SELECT l_quantity, l_discount, l_tax, l_extendedprice, l_quantity AS LST_1km, l_tax AS rain_3d, ln(1 + l_tax) AS rain_3d_log,
  CASE WHEN l_linenumber > 1000 THEN 1.0 END AS empty, CASE WHEN l_returnflag = 'R' THEN l_tax END AS partly FROM lineitem),
c AS (UNPIVOT (SELECT count(l_quantity) AS l_quantity, count(l_discount) AS l_discount, count(l_tax) AS l_tax, count(l_extendedprice) AS l_extendedprice,
  count(LST_1km) AS LST_1km, count(rain_3d) AS rain_3d, count(rain_3d_log) AS rain_3d_log, count(empty) AS empty, count(partly) AS partly FROM x) ON COLUMNS(*) INTO NAME feature VALUE known)
SELECT feature, known FROM c WHERE known > 0 AND NOT (feature = 'rain_3d' AND (SELECT known FROM c WHERE feature = 'rain_3d_log') > 0)
""")
def numeric_feature_names(spark, sf):
    """Predictors of a table: numbers with values, without the target, text, and rain that has its logarithm."""
    li = table(spark, sf, "lineitem", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linenumber").select(
        "l_quantity", "l_discount", "l_tax", "l_extendedprice", F.col("l_quantity").alias("LST_1km"), F.col("l_tax").alias("LST_K"),
        F.col("l_tax").alias("rain_3d"), F.log1p("l_tax").alias("rain_3d_log"), F.when(F.col("l_linenumber") > 1000, 1.0).alias("empty"),
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("partly"), F.lit("text").alias("label"))
    names = sorted(numeric_features(li))
    counts = li.agg(*[F.count(n).alias(n) for n in names])
    return counts.unpivot([], names, "feature", "known")
