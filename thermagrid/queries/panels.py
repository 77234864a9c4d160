"""Queries of the unified table, group features, splits, targets and reports."""

from pyspark.sql import functions as F

from ..functions.calendar import micros
from ..operators import fusion, groups, reports, splits
from ..operators.lookups import (attach_attributes, every_node, map_values, match_indicator,
                                 stack_tables, suffixed_inner)
from ..operators.ranking import numbered_slugs
from ..plans.multi_area import combined_report, combined_rows
from ..plans.unified import unified_report, unified_table
from .base import (day, events, lat_of, lon_of, long, query, r, r_many, s_haversine, s_lat, s_lon, s_r,
                   table)

UNIFIED_SQL = f"""
WITH nodes AS (SELECT s_suppkey AS node_id, n_regionkey AS area_id, {s_lat('s_suppkey * 5 + 2')} AS lat, {s_lon('s_suppkey * 5 + 2')} AS lon
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
fine0 AS (SELECT nodes.area_id, nodes.node_id, l_shipdate::DATE AS d, 250 + l_quantity AS lst, l_discount AS ndvi, l_tax * 1000 AS dem
  FROM lineitem JOIN nodes ON nodes.node_id = l_suppkey),
fine AS (SELECT * FROM fine0 QUALIFY row_number() OVER (PARTITION BY area_id, node_id, d ORDER BY lst, ndvi, dem) = 1),
dem AS (SELECT area_id, node_id, arg_min(dem, d) AS dem FROM fine GROUP BY ALL),
coarse AS (SELECT n_regionkey AS area_id, o_orderdate::DATE AS d, n_nationkey AS pix, avg(250 + o_totalprice / 10000) AS lst1, avg(o_totalprice) / 1000000 AS ndvi1,
   any_value({s_lat('n_nationkey + 1000')}) AS lat, any_value({s_lon('n_nationkey + 1000')}) AS lon
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3),
days AS (SELECT area_id, d FROM fine0 UNION SELECT area_id, d FROM coarse),
cdays AS (SELECT DISTINCT area_id, d AS cd FROM coarse),
dm AS (SELECT days.area_id, days.d, arg_min(cd, (abs(date_diff('day', days.d, cd)), cd)) AS cd
  FROM days JOIN cdays ON cdays.area_id = days.area_id AND abs(date_diff('day', days.d, cd)) <= 2 GROUP BY ALL),
near AS (SELECT n.area_id, c.d AS cd, n.node_id, arg_min(c.pix, ({s_haversine('n.lat', 'n.lon', 'c.lat', 'c.lon')}, c.pix)) AS pix,
   min({s_haversine('n.lat', 'n.lon', 'c.lat', 'c.lon')}) AS dist
  FROM nodes n JOIN coarse c ON c.area_id = n.area_id GROUP BY ALL),
panel AS (SELECT days.area_id, n.node_id, days.d, n.lat, n.lon, f.lst, f.ndvi, dem.dem, near.pix, near.dist, c.lst1, c.ndvi1, dm.cd, c.lat AS plat
  FROM days JOIN nodes n ON n.area_id = days.area_id
  LEFT JOIN fine f ON f.area_id = days.area_id AND f.node_id = n.node_id AND f.d = days.d
  LEFT JOIN dem ON dem.area_id = days.area_id AND dem.node_id = n.node_id
  LEFT JOIN dm ON dm.area_id = days.area_id AND dm.d = days.d
  LEFT JOIN near ON near.area_id = dm.area_id AND near.cd = dm.cd AND near.node_id = n.node_id
  LEFT JOIN coarse c ON c.area_id = near.area_id AND c.d = near.cd AND c.pix = near.pix)
"""


def unified_inputs(spark, sf):
    nation = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    k = F.col("s_suppkey") * 5 + 2
    nodes = table(spark, sf, "supplier", "s_suppkey", "s_nationkey").join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("area_id"), F.col("s_suppkey").alias("node_id"),
        lat_of(k).alias("latitude"), lon_of(k).alias("longitude"))
    fine = table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_quantity", "l_discount",
                 "l_tax").join(nodes.select("area_id", "node_id"),
                               F.col("l_suppkey") == F.col("node_id")).select(
        "area_id", "node_id", day("l_shipdate").alias("date"),
        (F.lit(250) + F.col("l_quantity")).alias("LST_K"), F.col("l_discount").alias("NDVI"),
        (F.col("l_tax") * 1000).alias("DEM"))
    pixel = F.col("n_nationkey") + 1000
    orders = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    coarse = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("n_nationkey"), day("o_orderdate").alias("date"))
        .agg(F.avg(F.lit(250) + F.col("o_totalprice") / 10000).alias("LST_1km"),
             (F.avg("o_totalprice") / 1000000).alias("NDVI"))
        .join(F.broadcast(nation), "n_nationkey")
        .select(F.col("n_regionkey").alias("area_id"), F.col("n_nationkey").alias("node_id"),
                "date", lat_of(pixel).alias("latitude"), lon_of(pixel).alias("longitude"),
                "LST_1km", "NDVI"))
    return fine, coarse, nodes


def unified(spark, sf):
    fine, coarse, nodes = unified_inputs(spark, sf)
    return unified_table(fine, coarse, nodes, tolerance_days=2)


@query("unified_panel", UNIFIED_SQL + f"""
SELECT area_id::BIGINT AS area_id, node_id, d AS date, {s_r('lat')} AS latitude, {s_r('lon')} AS longitude, pix::BIGINT AS sentinel3_pixel_id,
  {s_r('dist', 3)} AS sentinel3_distance_m, {s_r('plat')} AS sentinel3_latitude,
  CASE WHEN pix IS NOT NULL THEN abs(date_diff('day', d, cd)) END::BIGINT AS s3_day_difference, epoch_us(cd::TIMESTAMP) AS sentinel3_us,
  epoch_us(CASE WHEN lst IS NOT NULL THEN d::TIMESTAMP + INTERVAL 12 HOUR ELSE coalesce(cd::TIMESTAMP, d::TIMESTAMP) END) AS timestamp_us,
  {s_r('lst', 9)} AS LST_K, {s_r('lst1', 9)} AS LST_1km, {s_r('ndvi', 9)} AS NDVI, {s_r('ndvi1', 10)} AS NDVI_1km, {s_r('dem')} AS DEM,
  lst IS NOT NULL AS landsat_valid, lst1 IS NOT NULL AS sentinel3_valid, (lst IS NOT NULL AND lst1 IS NOT NULL) AS training_ready,
  {s_r("CASE WHEN lst IS NOT NULL THEN abs(date_diff('hour', d::TIMESTAMP + INTERVAL 12 HOUR, cd::TIMESTAMP)) END")} AS hours_apart,
  dayofyear(d)::BIGINT AS day_of_year, {s_r('sin(2 * pi() * dayofyear(d) / 365.25::DOUBLE)')} AS sin_doy
FROM panel
""")
def unified_panel(spark, sf):
    out = unified(spark, sf)
    return out.select(
        long("area_id").alias("area_id"), "node_id", "date", r_many("latitude").alias("latitude"),
        r_many("longitude").alias("longitude"), long("sentinel3_pixel_id").alias("sentinel3_pixel_id"),
        r_many("sentinel3_distance_m", 3).alias("sentinel3_distance_m"),
        r_many("sentinel3_latitude").alias("sentinel3_latitude"),
        long("s3_day_difference").alias("s3_day_difference"),
        micros("sentinel3_datetime_utc").alias("sentinel3_us"),
        micros("timestamp_utc").alias("timestamp_us"),
        *[r_many(c, 9).alias(c) for c in ("LST_K", "LST_1km", "NDVI")],
        r_many("NDVI_1km", 10).alias("NDVI_1km"), r_many("DEM").alias("DEM"),
        "landsat_valid", "sentinel3_valid", "training_ready",
        r_many("lst_time_difference_hours").alias("hours_apart"),
        long("day_of_year").alias("day_of_year"), r_many("sin_doy").alias("sin_doy"))


@query("panel_quality_report", UNIFIED_SQL + """
, t AS (SELECT count(*) AS n, count(DISTINCT node_id) AS nodes, count(DISTINCT d) AS dates,
   sum((lst IS NOT NULL AND lst1 IS NOT NULL)::INTEGER) AS ready,
   sum((lst IS NULL)::INTEGER) AS m1, sum((lst1 IS NULL)::INTEGER) AS m2, sum((ndvi IS NULL)::INTEGER) AS m3,
   sum((ndvi1 IS NULL)::INTEGER) AS m4, sum((dem IS NULL)::INTEGER) AS m5 FROM panel),
u AS (SELECT unnest(['LST_K', 'LST_1km', 'NDVI', 'NDVI_1km', 'DEM']) AS "column", unnest([m1, m2, m3, m4, m5]) AS missing, t.* FROM t)
SELECT CASE WHEN ready = 0 THEN 'insufficient' WHEN m1 + m2 + m3 + m4 + m5 > 0 THEN 'with_gaps' ELSE 'complete' END AS status,
  n AS rows, nodes, dates, ready::BIGINT AS training_ready_rows, round(100.0::DOUBLE * ready / n, 2) AS ready_percent,
  round(100.0::DOUBLE * (1 - (m1 + m2 + m3 + m4 + m5) / (n * 5.0::DOUBLE)), 2) AS completeness,
  "column", missing::BIGINT AS missing, round(100.0::DOUBLE * missing / n, 2) AS percent
FROM u WHERE missing > 0
""")
def panel_quality_report(spark, sf):
    fine, coarse, nodes = unified_inputs(spark, sf)
    out = unified_report(fine, coarse, nodes, tolerance_days=2)
    return out.withColumn("m", F.explode("missing_by_column")).select(
        "status", "rows", "nodes", "dates", "training_ready_rows",
        F.col("training_ready_percent").alias("ready_percent"),
        F.col("scientific_completeness_percent").alias("completeness"),
        F.col("m.column").alias("column"), F.col("m.count").alias("missing"),
        F.col("m.percent").alias("percent"))


@query("within_group_delta", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate::DATE AS d, l_quantity, l_discount, l_extendedprice FROM lineitem),
m AS (SELECT l_suppkey, d, avg(l_quantity) AS q, avg(l_discount) AS s, avg(l_extendedprice) AS p FROM x GROUP BY ALL)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, d AS day, {s_r('l_quantity - q', 8)} AS quantity_delta, {s_r('l_discount - s', 10)} AS discount_delta,
  {s_r('p', 7)} AS price_mean, {s_r('l_extendedprice - p', 7)} AS price_anomaly
FROM x JOIN m USING (l_suppkey, d)
""")
def within_group_delta(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate",
               "l_quantity", "l_discount", "l_extendedprice").withColumn("day", day("l_shipdate"))
    keys = ["l_suppkey", "day"]
    out = groups.within_group_deltas(li, keys, {"l_quantity": "quantity_delta",
                                                "l_discount": "discount_delta"})
    out = groups.with_group_means(out, keys, {"l_extendedprice": "price_mean"})
    return out.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_suppkey", "day",
                      r("quantity_delta", 8).alias("quantity_delta"),
                      r("discount_delta", 10).alias("discount_delta"),
                      r("price_mean", 7).alias("price_mean"),
                      r(F.col("l_extendedprice") - F.col("price_mean"), 7).alias("price_anomaly"))


@query("date_weights", f"""
WITH c AS (SELECT o_orderdate::DATE AS d, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
m AS (SELECT sum(n * n) / sum(n) AS mean FROM c)
SELECT o_orderkey, o_orderdate::DATE AS day, {s_r('m.mean / c.n')} AS weight
FROM orders JOIN c ON c.d = o_orderdate::DATE, m
""")
def date_weights(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", day("o_orderdate").alias("day"))
    out = groups.with_date_weights(o, "day")
    return out.select("o_orderkey", "day", r("weight").alias("weight"))


@query("recentred_groups", f"""
SELECT o_orderkey, {s_r('o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus)', 7)} AS centred FROM orders
""")
def recentred_groups(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = groups.recentred(o, ["o_custkey", "o_orderstatus"], "o_totalprice", "centred")
    return out.select("o_orderkey", r("centred", 7).alias("centred"))


@query("temporal_split", """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'F'),
y AS (SELECT d, dense_rank() OVER (ORDER BY year(d) DESC) AS rk FROM d)
SELECT coalesce(CASE WHEN rk = 1 THEN 'test' WHEN rk = 2 THEN 'validation' WHEN rk > 2 THEN 'train' END, 'prediction_only') AS split,
  year(o_orderdate)::BIGINT AS year, count(*) AS orders, count(DISTINCT o_orderdate) AS dates
FROM orders LEFT JOIN y ON y.d = o_orderdate::DATE GROUP BY 1, 2
""")
def temporal_split(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_orderstatus").select(
        day("o_orderdate").alias("date"), (F.col("o_orderstatus") == "F").alias("training_ready"))
    out = splits.with_temporal_split(o)
    return out.groupBy("split", F.year("date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("date").alias("dates"))


@query("temporal_split_one_year", """
WITH d AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT ts::DATE AS d FROM events)),
c AS (SELECT d, p, greatest(1, floor(n * 0.6::DOUBLE))::INTEGER AS a, n, floor(n * 0.8::DOUBLE)::INTEGER AS b0 FROM d)
SELECT d AS date, CASE WHEN p < a THEN 'train' WHEN p < least(greatest(a + 1, b0), n - 1) THEN 'validation' ELSE 'test' END AS split FROM c
""")
def temporal_split_one_year(spark, sf):
    return splits.temporal_split_days(events(spark, sf).select(day("ts").alias("date")), "date")


@query("group_folds", """
WITH d AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || d::VARCHAR), d) - 1) % 5 + 1 AS fold FROM d)
SELECT fold::BIGINT AS fold, count(*) AS dates, 0::BIGINT AS shared_dates, sum(n)::BIGINT AS rows, min(d) AS first_date, max(d) AS last_date FROM f GROUP BY 1
""")
def group_folds(spark, sf):
    """Dates and rows of the folds, and the dates that sit in more than one (none)."""
    o = table(spark, sf, "orders", "o_orderdate").select(day("o_orderdate").alias("date"))
    out = splits.with_date_folds(o)
    per_date = out.groupBy("date").agg(F.count_distinct("fold").alias("k"),
                                       F.min("fold").alias("fold"), F.count(F.lit(1)).alias("n"))
    return per_date.groupBy(long("fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("dates"), F.count_if(F.col("k") > 1).alias("shared_dates"), F.sum("n").alias("rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("zscore_train", f"""
WITH x AS (SELECT o_orderkey, o_totalprice, (o_custkey % 100)::DOUBLE AS c, 7.0::DOUBLE AS k, year(o_orderdate) < 1999 AS tr FROM orders),
s AS (SELECT avg(o_totalprice) FILTER (tr) AS m1, stddev_samp(o_totalprice) FILTER (tr) AS s1, avg(c) FILTER (tr) AS m2, stddev_samp(c) FILTER (tr) AS s2 FROM x)
SELECT o_orderkey, {s_r('(o_totalprice - m1) / s1')} AS price, {s_r('(c - m2) / s2')} AS cust, 0.0::DOUBLE AS flat FROM x, s
""")
def zscore_train(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").select(
        "o_orderkey", F.col("o_totalprice").alias("price"),
        (F.col("o_custkey") % 100).cast("double").alias("cust"), F.lit(7.0).alias("flat"),
        (F.year("o_orderdate") < 1999).alias("tr"))
    out = groups.z_scores(o, ["price", "cust", "flat"], F.col("tr"))
    return out.select("o_orderkey", *[r(c).alias(c) for c in ("price", "cust", "flat")])


@query("minmax_axis", f"""
SELECT p_partkey, {s_r('(p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())')} AS price_norm,
  {s_r('p_size / greatest(max(p_size) OVER (), 1)::DOUBLE')} AS size_norm FROM part
""")
def minmax_axis(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_retailprice", "p_size")
    out = groups.index_over_max(groups.min_max_axis(p, "p_retailprice", "price_norm"),
                                "p_size", "size_norm")
    return out.select("p_partkey", r("price_norm").alias("price_norm"),
                      r("size_norm").alias("size_norm"))


TOTALS_SQL = """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderstatus AS st, o_totalprice / 1000 AS obs, p / 1000 AS pred FROM orders JOIN l ON l_orderkey = o_orderkey)
"""


def order_totals(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice").groupBy(
        "l_orderkey").agg(F.sum("l_extendedprice").alias("p"))
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select(
        "o_orderkey", day("o_orderdate").alias("date"), F.col("o_orderstatus").alias("st"),
        (F.col("o_totalprice") / 1000).alias("obs"), (F.col("p") / 1000).alias("pred"))


@query("regression_metrics", TOTALS_SQL + f"""
, dd AS (SELECT st, d, avg(abs(pred - obs)) AS m FROM x GROUP BY ALL)
SELECT x.st AS status, {s_r('avg(abs(pred - obs))')} AS mae, {s_r('any_value(mm.m)')} AS mae_by_date, {s_r('sqrt(avg(pow(pred - obs, 2)))')} AS rmse,
  {s_r('1 - sum(pow(pred - obs, 2)) / (var_pop(obs) * count(*))')} AS r2, {s_r('avg(pred - obs)')} AS bias, count(DISTINCT d) AS dates, count(*) AS rows
FROM x JOIN (SELECT st, avg(m) AS m FROM dd GROUP BY st) mm ON mm.st = x.st GROUP BY x.st
""")
def regression_metrics(spark, sf):
    out = reports.error_metrics(order_totals(spark, sf), "obs", "pred", "date", by=["st"])
    return out.select(F.col("st").alias("status"), *[r(c).alias(c) for c in (
        "mae", "mae_by_date", "rmse", "r2", "bias")], "dates", long("rows").alias("rows"))


@query("improvement_over_baseline", TOTALS_SQL + f"""
, m AS (SELECT 'model' AS model, avg(abs(pred - obs)) AS mae FROM x UNION ALL
        SELECT 'baseline', avg(abs(250 - obs)) FROM x)
SELECT model, {s_r('mae')} AS mae, {s_r("100 * ((SELECT mae FROM m WHERE model = 'baseline') - mae) / (SELECT mae FROM m WHERE model = 'baseline')")} AS improvement FROM m
""")
def improvement_over_baseline(spark, sf):
    x = order_totals(spark, sf).withColumn("base", F.lit(250.0))
    m = stack_tables([
        reports.error_metrics(x, "obs", c, "date").select(F.lit(n).alias("model"), "mae")
        for n, c in (("model", "pred"), ("baseline", "base"))])
    out = reports.improvement_percent(m, "model", "baseline", "mae", "improvement")
    return out.select("model", r("mae").alias("mae"), r("improvement").alias("improvement"))


AGREE_SQL = """
WITH a AS (SELECT date_trunc('hour', ts) AS t, user_id % 10 AS cell, avg(value) AS t2m, max(value) AS tp FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2),
b AS (SELECT date_trunc('hour', ts) AS t, user_id % 10 AS cell, avg(value) + 1 AS t2m, min(value) AS tp FROM events WHERE event_type IN ('view', 'error', 'signup') GROUP BY 1, 2),
j AS (SELECT coalesce(a.t, b.t) AS t, coalesce(a.cell, b.cell) AS cell, a.t2m AS t2m_a, b.t2m AS t2m_b, a.tp AS tp_a, b.tp AS tp_b,
  CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN 'both' WHEN a.t IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge_state
  FROM a FULL JOIN b ON a.t = b.t AND a.cell = b.cell)
"""


def two_sources(spark, sf):
    e = events(spark, sf).withColumn("t", F.date_trunc("hour", "ts")).withColumn(
        "cell", F.col("user_id") % 10)
    a = e.where(F.col("event_type").isin("view", "click", "purchase")).groupBy("t", "cell").agg(
        F.avg("value").alias("t2m"), F.max("value").alias("tp"))
    b = e.where(F.col("event_type").isin("view", "error", "signup")).groupBy("t", "cell").agg(
        (F.avg("value") + 1).alias("t2m"), F.min("value").alias("tp"))
    return a, b


@query("match_indicator", AGREE_SQL + f"""
SELECT epoch_us(t) AS t_us, cell, merge_state, {s_r('t2m_a')} AS t2m_a, {s_r('t2m_b')} AS t2m_b, {s_r('tp_a')} AS tp_a, {s_r('tp_b')} AS tp_b FROM j
""")
def match_indicator_query(spark, sf):
    a, b = two_sources(spark, sf)
    out = match_indicator(a, b, ["t", "cell"], ("_a", "_b"))
    return out.select(micros("t").alias("t_us"), "cell", "merge_state", *[
        r(c).alias(c) for c in ("t2m_a", "t2m_b", "tp_a", "tp_b")])


@query("source_agreement", AGREE_SQL + f"""
, u AS (SELECT 't2m' AS variable, t2m_a AS va, t2m_b AS vb, 400.0::DOUBLE AS tol FROM j UNION ALL SELECT 'tp', tp_a, tp_b, 5.0::DOUBLE FROM j)
SELECT variable, count(*) AS compared, {s_r('avg(abs(vb - va))')} AS mae, {s_r('avg(vb - va)')} AS mean_bias, {s_r('max(abs(vb - va))')} AS max_absolute_error,
  {s_r('corr(va, vb)')} AS correlation, any_value(tol) AS tolerance, max(abs(vb - va)) <= any_value(tol) AS passes
FROM u WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY variable
""")
def source_agreement(spark, sf):
    a, b = two_sources(spark, sf)
    joined = match_indicator(a, b, ["t", "cell"], ("_a", "_b"))
    out = reports.source_agreement(joined, ["t2m", "tp"], ("_a", "_b"), {"t2m": 400.0, "tp": 5.0})
    return out.select("variable", "compared", *[r(c).alias(c) for c in (
        "mae", "mean_bias", "max_absolute_error", "correlation")], "tolerance", "passes")


@query("agreement_verdict", AGREE_SQL + """
SELECT bool_and(merge_state = 'both') AS all_matched, bool_or(merge_state = 'both') AS any_matched,
  bool_and(t2m_a IS NOT NULL AND t2m_b IS NOT NULL) AS all_complete, bool_or(t2m_a IS NOT NULL AND t2m_b IS NOT NULL) AS any_complete,
  bool_and(coalesce(abs(t2m_a - t2m_b) <= 50, false)) AS all_close, bool_or(coalesce(abs(t2m_a - t2m_b) <= 50, false)) AS any_close FROM j
""")
def agreement_verdict(spark, sf):
    a, b = two_sources(spark, sf)
    joined = match_indicator(a, b, ["t", "cell"], ("_a", "_b"))
    return reports.verdicts(joined, {
        "matched": F.col("merge_state") == "both",
        "complete": F.col("t2m_a").isNotNull() & F.col("t2m_b").isNotNull(),
        "close": F.abs(F.col("t2m_a") - F.col("t2m_b")) <= 50})


@query("suffixed_inner_join", AGREE_SQL + f"""
SELECT cell, count(*) AS hours, {s_r('avg(abs(t2m_a - t2m_b))')} AS mae FROM j WHERE merge_state = 'both'
  AND t IN (SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'signup') GROUP BY cell
""")
def suffixed_inner_join(spark, sf):
    a, b = two_sources(spark, sf)
    sample = events(spark, sf).where("event_type = 'signup'").select(
        F.date_trunc("hour", "ts").alias("t")).distinct()
    joined = suffixed_inner(a, b, ["t", "cell"], ("_a", "_b")).join(sample, "t", "left_semi")
    return joined.groupBy("cell").agg(
        F.count(F.lit(1)).alias("hours"),
        r(F.avg(F.abs(F.col("t2m_a") - F.col("t2m_b")))).alias("mae"))


@query("source_rates", """
WITH s AS (SELECT event_type AS source, sum(value) AS sec, count(*) AS n, count(DISTINCT user_id) * 720 AS v FROM events GROUP BY 1)
SELECT source, round(n / greatest(sec, 1e-9), 8) AS rows_per_second, round(sec * 1000 / v, 6) AS seconds_per_1000_values,
  (SELECT arg_min(source, (sec, source)) FROM s) AS fastest, (SELECT arg_min(source, (-sec, source)) FROM s) AS slowest,
  round((SELECT max(sec) / min(sec) FROM s), 6) AS speed_factor FROM s
""")
def source_rates(spark, sf):
    s = events(spark, sf).groupBy(F.col("event_type").alias("source")).agg(
        F.sum("value").alias("sec"), F.count(F.lit(1)).alias("n"),
        (F.count_distinct("user_id") * 720).alias("v"))
    rates = reports.run_rates(s, source="source", seconds="sec", rows="n", values="v")
    verdict = reports.speed_verdict(s, source="source", seconds="sec")
    row = verdict.select(F.struct(*verdict.columns)).scalar()
    return rates.select(
        "source", F.round("rows_per_second", 8).alias("rows_per_second"),
        F.round("seconds_per_1000_values", 6).alias("seconds_per_1000_values"),
        row["fastest"].alias("fastest"), row["slowest"].alias("slowest"),
        F.round(row["speed_factor"], 6).alias("speed_factor"))


@query("feature_screen", f"""
WITH x AS (SELECT l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS disc, l_tax AS tax, l_extendedprice AS y FROM lineitem)
SELECT 'quantity' AS variable, round(100.0::DOUBLE * count(q) / count(*), 2) AS availability_percent, count(DISTINCT q) AS distinct_values, {s_r('abs(corr(q, y))')} AS abs_correlation FROM x
UNION ALL SELECT 'discount', round(100.0::DOUBLE * count(disc) / count(*), 2), count(DISTINCT disc), {s_r('abs(corr(disc, y))')} FROM x
UNION ALL SELECT 'tax', round(100.0::DOUBLE * count(tax) / count(*), 2), count(DISTINCT tax), {s_r('abs(corr(tax, y))')} FROM x
UNION ALL SELECT 'constant', 100.0::DOUBLE, 1, NULL
UNION ALL SELECT 'absent', 0.0::DOUBLE, 0, NULL
""")
def feature_screen(spark, sf):
    x = table(spark, sf, "lineitem", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
              "l_returnflag").select(
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"), F.lit(3.0).alias("constant"),
        F.col("l_extendedprice").alias("y"))
    out = reports.ranked_screen(reports.feature_screen(
        x, ["quantity", "discount", "tax", "constant", "absent"], "y"))
    return out.withColumn("abs_correlation", r("abs_correlation"))


@query("coverage_table", f"""
SELECT l_returnflag AS flag, count(*) AS rows, count(DISTINCT l_shipdate) AS dates, min(year(l_shipdate))::BIGINT AS first_year, max(year(l_shipdate))::BIGINT AS last_year,
  {s_r('median(l_quantity)')} AS median_quantity, {s_r('avg(l_discount)')} AS mean_discount FROM lineitem GROUP BY 1
""")
def coverage_table(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_shipdate", "l_quantity", "l_discount")
    out = reports.group_coverage(li.withColumn("d", day("l_shipdate")), ["l_returnflag"], "d",
                                 ["l_quantity"], ["l_discount"])
    return out.select(F.col("l_returnflag").alias("flag"), "rows", "dates",
                      long("first_year").alias("first_year"), long("last_year").alias("last_year"),
                      r("median_l_quantity").alias("median_quantity"),
                      r("mean_l_discount").alias("mean_discount"))


@query("null_profile", """
WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS a, CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN NULL ELSE l_tax END AS b, l_discount AS c FROM lineitem),
t AS (SELECT count(*) AS n, count(*) - count(a) AS a, count(*) - count(b) AS b, count(*) - count(c) AS c FROM x)
SELECT "column", missing, round(100.0::DOUBLE * missing / n, 2) AS percent FROM (
  SELECT unnest(['a', 'b', 'c']) AS "column", unnest([a, b, c]) AS missing, n FROM t) WHERE missing > 0
""")
def null_profile(spark, sf):
    x = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_tax",
              "l_discount").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("a"),
        F.when(~((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.04)), F.col("l_tax")).alias("b"),
        F.col("l_discount").alias("c"))
    return reports.null_profile(x, ["a", "b", "c"])


@query("validated_table", """
SELECT count(*) AS rows, count(DISTINCT o_orderdate::DATE) AS dates, min(o_orderdate::DATE) AS first_date, max(o_orderdate::DATE) AS last_date,
  0::BIGINT AS nulls_node_id, 0::BIGINT AS nulls_date, count(*) FILTER (o_orderstatus = 'P') AS nulls_value FROM orders
""")
def validated_table(spark, sf):
    from ..operators.contract import require_and_select, validate_table
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
        day("o_orderdate").alias("date"), F.col("o_orderkey").alias("node_id"))
    columns = ["node_id", "date", "value"]
    return validate_table(require_and_select(o, columns, "orders"), columns, "orders")


FUSION_SQL = """
WITH l AS (SELECT l_orderkey, min(260 + l_extendedprice / 1000) AS m, count(*) AS k FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS node_id, c_nationkey AS area, o_orderdate::DATE AS d, CASE WHEN o_orderstatus = 'F' THEN 250 + o_totalprice / 4000 END AS o, l.m
      FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey AND k > 2),
f AS (SELECT *, coalesce(o, m) AS t, (coalesce(o, m) BETWEEN 270 AND 350) IS TRUE AS ok FROM x)
"""


def fused(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
              "o_totalprice")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    base = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("node_id"), F.col("c_nationkey").alias("area_id"),
        day("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.lit(250) + F.col("o_totalprice") / 4000).alias("LST_K"))
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice")
    busy = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")).where("k > 2")
    predictions = lines.join(busy, "l_orderkey", "left_semi").select(
        F.col("l_orderkey").alias("node_id"),
        (F.lit(260) + F.col("l_extendedprice") / 1000).alias("LST_model_K"))
    joined = fusion.join_predictions(base, predictions, ["LST_model_K"], keys=("node_id",))
    return fusion.fuse_targets(joined, scope="local").withColumn(
        "global_node_id", fusion.global_id())


@query("target_fusion", FUSION_SQL + f"""
SELECT node_id, {s_r('t', 9)} AS target, CASE WHEN o IS NOT NULL THEN 'landsat_observed' WHEN m IS NOT NULL THEN 'sentinel3_downscaled_local' ELSE 'unavailable' END AS source,
  (o IS NOT NULL)::BIGINT AS observed, (o IS NULL AND m IS NOT NULL)::BIGINT AS synthetic, ok::BIGINT AS range_ok, ok::BIGINT AS eligible,
  area::VARCHAR || '__' || node_id::VARCHAR AS global_node_id FROM f
""")
def target_fusion(spark, sf):
    return fused(spark, sf).select(
        "node_id", r("LST_target_K", 9).alias("target"), F.col("target_source").alias("source"),
        long("target_is_observed").alias("observed"), long("target_is_synthetic").alias("synthetic"),
        long("target_physical_range_ok").alias("range_ok"),
        long("target_training_eligible").alias("eligible"), "global_node_id")


@query("target_summary", FUSION_SQL + """
SELECT area::BIGINT AS area_id, count(*) AS rows, count(DISTINCT node_id) AS nodes, count(DISTINCT d) AS dates, count(o) AS observed_targets,
  count(*) FILTER (o IS NULL AND m IS NOT NULL) AS synthetic_targets, count(*) FILTER (t IS NULL) AS unavailable_targets,
  count(*) FILTER (t IS NOT NULL AND NOT ok) AS out_of_range_targets, count(*) FILTER (ok) AS training_eligible_targets FROM f GROUP BY area
""")
def target_summary(spark, sf):
    return fusion.target_summary(fused(spark, sf)).withColumn("area_id", long("area_id"))


@query("scope_choice", f"""
WITH x AS (SELECT c_nationkey AS area, o_orderdate::DATE AS d, o_totalprice AS y FROM orders JOIN customer ON c_custkey = o_custkey),
loc AS (SELECT area, median(y) AS m FROM x GROUP BY 1),
e AS (SELECT x.area, d, avg(abs(y - (SELECT median(y) FROM x))) AS g, avg(abs(y - loc.m)) AS l FROM x JOIN loc ON loc.area = x.area GROUP BY ALL),
a AS (SELECT area, avg(g) AS g, avg(l) AS l, count(*) AS n FROM e GROUP BY 1)
SELECT area::BIGINT AS area_id, {s_r('g', 3)} AS general_mae, {s_r('l', 3)} AS local_mae, n AS dates,
  CASE WHEN l <= g * (1.0::DOUBLE - 0.0005::DOUBLE) AND n >= 12 THEN 'local' ELSE 'general' END AS scope FROM a
""")
def scope_choice(spark, sf):
    from ..operators.ranking import exact_medians, median_by
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("area_id"), day("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("y"))
    middle = exact_medians(x, ["y"])["y"][0]
    scored = x.join(median_by(x, ["area_id"], "y", "lm"), "area_id").withColumn("gm", F.lit(middle))
    g = reports.macro_mae(scored, "y", "gm", "date", by=["area_id"], out="general_mae")
    m = reports.macro_mae(scored, "y", "lm", "date", by=["area_id"], out="local_mae")
    n = x.groupBy("area_id").agg(F.count_distinct("date").alias("dates"))
    joined = g.join(m, "area_id").join(n, "area_id").withColumn("scope", fusion.model_scope(
        "general_mae", "local_mae", "dates", minimum_improvement=0.0005))
    return joined.select(long("area_id").alias("area_id"), r("general_mae", 3).alias("general_mae"),
                         r("local_mae", 3).alias("local_mae"), "dates", "scope")


@query("area_rollup", """
WITH x AS (SELECT c_nationkey AS a, c_custkey AS n, o_orderdate::DATE AS d FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT a, count(*) AS rows, count(DISTINCT n) AS nodes, count(DISTINCT d) AS dates FROM x GROUP BY 1),
req AS (SELECT n_nationkey AS a FROM nation UNION ALL SELECT 1000 + r_regionkey FROM region),
j AS (SELECT req.a, coalesce(rows, 0) AS rows, coalesce(nodes, 0) AS nodes, coalesce(dates, 0) AS dates, CASE WHEN rows IS NULL THEN 'error' ELSE 'complete' END AS state FROM req LEFT JOIN r ON r.a = req.a)
SELECT a::BIGINT AS area_id, rows, nodes, dates, state, (SELECT CASE WHEN bool_or(state <> 'complete') THEN 'partial' ELSE 'complete' END FROM j) AS run_status FROM j
""")
def area_rollup(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("long").alias("area_id"), F.col("c_custkey").alias("node_id"),
        day("o_orderdate").alias("date"))
    nations = table(spark, sf, "nation", "n_nationkey").select(
        F.col("n_nationkey").cast("long").alias("area_id"))
    regions = table(spark, sf, "region", "r_regionkey").select(
        (F.col("r_regionkey").cast("long") + 1000).alias("area_id"))
    per_area, run = combined_report(rows, stack_tables([nations, regions]))
    status = run.select("status").scalar()
    return per_area.withColumn("run_status", status)


@query("lineage_rows", """
SELECT n_nationkey::BIGINT AS area_id, n_name AS area_name, c_custkey AS node_id, n_nationkey::VARCHAR || '__' || c_custkey::VARCHAR AS global_node_id
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def lineage_rows(spark, sf):
    rows = table(spark, sf, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_nationkey").cast("long").alias("area_id"), F.col("c_custkey").alias("node_id"))
    areas = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"),
                                              F.col("n_name").alias("area_name"))
    return combined_rows(rows, areas).select("area_id", "area_name", "node_id", "global_node_id")


@query("row_fingerprint", r"""
SELECT sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, coalesce(priority, '\N'), round(o_totalprice * 100)::BIGINT,
    strftime(o_orderdate, '%Y-%m-%d'))), 1, 15))::BIGINT)::VARCHAR AS fingerprint, count(*) AS rows
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders)
""")
def row_fingerprint(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return reports.fingerprint(o)


@query("union_align", f"""
SELECT kind, count(*) AS rows, count(price) AS prices, count(quantity) AS quantities, {s_r('coalesce(sum(price), 0)', 2)} AS price, {s_r('coalesce(sum(quantity), 0)', 2)} AS quantity FROM (
  SELECT 'order' AS kind, o_totalprice AS price, NULL::DOUBLE AS quantity FROM orders UNION ALL SELECT 'line', NULL, l_quantity FROM lineitem) GROUP BY kind
""")
def union_align(spark, sf):
    o = table(spark, sf, "orders", "o_totalprice").select(
        F.lit("order").alias("kind"), F.col("o_totalprice").alias("price"))
    li = table(spark, sf, "lineitem", "l_quantity").select(
        F.lit("line").alias("kind"), F.col("l_quantity").alias("quantity"))
    return stack_tables([o, li]).groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count("price").alias("prices"),
        F.count("quantity").alias("quantities"),
        r(F.coalesce(F.sum("price"), F.lit(0.0)), 2).alias("price"),
        r(F.coalesce(F.sum("quantity"), F.lit(0.0)), 2).alias("quantity"))


@query("node_attributes", f"""
SELECT c.c_custkey, n_name AS nation, coalesce(r_name, 'none') AS region, {s_r('coalesce(s.total, 0)', 2)} AS total, (s.total IS NOT NULL) AS sampled
FROM customer c JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 4
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) s ON o_custkey = c_custkey
""")
def node_attributes(spark, sf):
    nodes = table(spark, sf, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_custkey").alias("node_id"), "c_nationkey")
    samples = table(spark, sf, "orders", "o_custkey", "o_totalprice", "o_orderstatus").where(
        "o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("node_id")).agg(
        F.sum("o_totalprice").alias("total"))
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    region = table(spark, sf, "region").where("r_regionkey < 4")
    full = attach_attributes(every_node(samples, nodes), nation, ["c_nationkey"])
    named = map_values(full, "n_regionkey", region, "r_regionkey", "r_name", "region",
                       F.lit("none"))
    return named.select(
        F.col("node_id").cast("long").alias("c_custkey"), "nation", "region",
        r(F.coalesce("total", F.lit(0.0)), 2).alias("total"),
        F.col("total").isNotNull().alias("sampled"))


@query("slug_suffix", """
WITH s AS (SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'area') AS slug FROM part)
SELECT p_partkey, slug, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY p_partkey) = 1 THEN slug
  ELSE slug || '_' || (row_number() OVER (PARTITION BY slug ORDER BY p_partkey))::VARCHAR END AS slug_id FROM s
""")
def slug_suffix(spark, sf):
    from ..functions.text import slug
    p = table(spark, sf, "part", "p_partkey", "p_name").select("p_partkey", slug("p_name").alias("slug"))
    return numbered_slugs(p, "slug", "p_partkey").select("p_partkey", "slug", "slug_id")


@query("top_rows", """
SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def top_rows(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return o.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(10).select(
        "o_orderkey", F.round("o_totalprice", 2).alias("total"))


@query("best_by_metric", TOTALS_SQL + f"""
, m AS (SELECT st, avg(abs(pred - obs)) AS mae, sqrt(avg(pow(pred - obs, 2))) AS rmse FROM x GROUP BY 1)
SELECT st AS status, {s_r('mae')} AS mae, {s_r('rmse')} AS rmse FROM m ORDER BY mae, rmse, st LIMIT 1
""")
def best_by_metric(spark, sf):
    m = reports.error_metrics(order_totals(spark, sf), "obs", "pred", "date", by=["st"])
    best = fusion.best_row(m, ["mae", "rmse", "st"])
    return best.select(F.col("st").alias("status"), r("mae").alias("mae"), r("rmse").alias("rmse"))


@query("residual_columns", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {s_r('l_discount - l_tax')} AS ndvi_delta, {s_r('l_quantity / 50 - l_tax')} AS ndbi_delta,
  {s_r('l_extendedprice / 1000 - l_quantity')} AS residual,
  (l_returnflag <> 'R' AND l_linestatus = 'O') AS training_ready FROM lineitem
""")
def residual_columns(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax",
               "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    x = li.select(
        "l_orderkey", long("l_linenumber").alias("l_linenumber"),
        (F.col("l_extendedprice") / 1000).alias("LST_K"), F.col("l_quantity").alias("LST_1km"),
        F.col("l_discount").alias("NDVI"), F.col("l_tax").alias("NDVI_1km"),
        (F.col("l_quantity") / 50).alias("NDBI"), F.col("l_tax").alias("NDBI_1km"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("ALBEDO"),
        F.col("l_discount").alias("ALBEDO_1km"), F.lit(1.0).alias("aspect_ratio"),
        F.lit(0.5).alias("aspect_ratio_1km"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("s3_day_difference"))
    x = fusion.residual_columns(x)
    return x.withColumn("training_ready", fusion.training_ready(x)).select(
        "l_orderkey", "l_linenumber", r("NDVI_delta").alias("ndvi_delta"),
        r("NDBI_delta").alias("ndbi_delta"), r("Delta_LST").alias("residual"), "training_ready")
