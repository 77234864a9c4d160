"""Queries of the nearest-in-time and nearest-in-space operators."""

from pyspark.sql import functions as F

from ..functions.calendar import micros
from ..operators.impute import fill_from_nearest_time
from ..operators.near_space import nearest_site, radius_mean
from ..operators.near_time import nearest_day, preferred_day, rows_of_nearest
from ..operators.reports import day_coverage
from ..plans.coarse import daily_products, products_near
from ..plans.pairs import same_day_pairs
from .base import (day, events, frac, lat_of, lon_of, long, query, r, s_frac, s_haversine, s_lat,
                   s_lon, s_r, s_scaled, table, SPREAD_A, SPREAD_B)

DAY = 86_400_000_000

PAIR_SQL = f"""
WITH fine AS (
  SELECT user_id::VARCHAR AS node_id, ts::DATE AS d, ts,
         {s_lat('user_id')} AS lat, {s_lon('user_id')} AS lon, 280 + value AS lst,
         hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE AS h
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
coarse AS (
  SELECT ts::DATE AS d, date_trunc('hour', ts) AS acq,
         {s_lat('user_id * 3 + 1')} AS lat, {s_lon('user_id * 3 + 1')} AS lon, 275 + value AS lst,
         hour(ts)::DOUBLE AS h
  FROM events WHERE event_type IN ('signup', 'error')),
med AS (SELECT d, median(h) AS m FROM fine GROUP BY d),
acq AS (SELECT d, acq, min(h) AS h FROM coarse GROUP BY d, acq),
best AS (
  SELECT a.d, a.acq, a.h, abs(a.h - m.m) AS gap,
         row_number() OVER (PARTITION BY a.d ORDER BY abs(a.h - m.m), a.acq) AS rn
  FROM acq a JOIN med m USING (d)),
chosen AS (SELECT * FROM best WHERE rn = 1 AND gap <= 2.0),
near AS (
  SELECT f.d, f.lat, f.lon, arg_min(c.lst, ({s_scaled('f.lat', 'f.lon', 'c.lat', 'c.lon')}, c.lat, c.lon, c.lst)) AS lst_c,
         any_value(ch.h) AS h_c
  FROM (SELECT DISTINCT d, lat, lon FROM fine) f
  JOIN chosen ch ON ch.d = f.d JOIN coarse c ON c.d = ch.d AND c.acq = ch.acq
  GROUP BY f.d, f.lat, f.lon)
SELECT f.node_id AS nodo_id, f.d AS date, {s_r('f.lst')} AS lst_landsat,
       {s_r('n.lst_c')} AS lst_sentinel_3, {s_r('f.h')} AS hour_landsat, {s_r('n.h_c')} AS hour_sentinel
FROM fine f JOIN near n ON n.d = f.d AND n.lat = f.lat AND n.lon = f.lon
"""


def pair_inputs(spark, sf):
    e = events(spark, sf)
    fine = e.where(F.col("event_type").isin("view", "click", "purchase")).select(
        F.col("user_id").cast("string").alias("node_id"), day("ts").alias("date"),
        F.col("ts").alias("acquisition_dt_utc"), lat_of("user_id").alias("latitude"),
        lon_of("user_id").alias("longitude"), (F.lit(280) + F.col("value")).alias("LST_K"))
    pixel = F.col("user_id") * 3 + 1
    coarse = e.where(F.col("event_type").isin("signup", "error")).select(
        day("ts").alias("date"), F.date_trunc("hour", "ts").alias("acquisition_dt_utc"),
        lat_of(pixel).alias("latitude"), lon_of(pixel).alias("longitude"),
        (F.lit(275) + F.col("value")).alias("LST_1km"))
    return fine, coarse


@query("pair_same_day", PAIR_SQL)
def pair_same_day(spark, sf):
    fine, coarse = pair_inputs(spark, sf)
    out = same_day_pairs(fine, coarse, max_hours=2.0)
    return out.select("nodo_id", "date", *[r(c).alias(c) for c in (
        "lst_landsat", "lst_sentinel_3", "hour_landsat", "hour_sentinel")])


@query("nearest_date_tolerance", """
WITH q AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE AS d FROM orders),
c AS (SELECT DISTINCT o.o_custkey AS k, l.l_shipdate::DATE AS d
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT q.k AS custkey, q.d AS order_day, arg_min(c.d, (abs(date_diff('day', q.d, c.d)), c.d)) AS ship_day,
       min(abs(date_diff('day', q.d, c.d)))::BIGINT AS gap
FROM q JOIN c ON c.k = q.k AND abs(date_diff('day', q.d, c.d)) <= 5
GROUP BY q.k, q.d
""")
def nearest_date_tolerance(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate")
    q = o.select(F.col("o_custkey").alias("custkey"), day("o_orderdate").alias("order_day"))
    c = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("custkey"), day("l_shipdate").alias("ship"))
    out = nearest_day(q, c, by=["custkey"], day="order_day", candidate_day="ship",
                      tolerance_days=5, match="ship_day", gap="gap")
    return out.withColumn("gap", long("gap"))


def places(spark, sf, name, key, id_name, *extra):
    return table(spark, sf, name, key, *extra).select(
        F.col(key).alias(id_name), *extra, lat_of(key).alias("lat"), lon_of(key).alias("lon"))


def site_positions(spark, sf):
    s = table(spark, sf, "supplier", "s_suppkey", "s_acctbal")
    k = F.col("s_suppkey") * 5 + 2
    return s.select("s_suppkey", "s_acctbal", lat_of(k).alias("slat"), lon_of(k).alias("slon"))


@query("nearest_pixel_haversine", f"""
WITH c AS (SELECT c_custkey, {s_lat('c_custkey')} AS lat, {s_lon('c_custkey')} AS lon FROM customer),
s AS (SELECT s_suppkey, {s_lat('s_suppkey * 5 + 2')} AS lat, {s_lon('s_suppkey * 5 + 2')} AS lon FROM supplier),
p AS (SELECT c_custkey, s_suppkey, {s_haversine('c.lat', 'c.lon', 's.lat', 's.lon')} AS d FROM c, s)
SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, {s_r('min(d)', 3)} AS distance_m
FROM p GROUP BY c_custkey
""")
def nearest_pixel_haversine(spark, sf):
    c = places(spark, sf, "customer", "c_custkey", "c_custkey")
    out = nearest_site(c, site_positions(spark, sf), query_id=["c_custkey"],
                       query_uv=("lat", "lon"), site_uv=("slat", "slon"), payload=["s_suppkey"],
                       tie=["s_suppkey"], metric="haversine", distance="distance_m")
    return out.select("c_custkey", "s_suppkey", r("distance_m", 3).alias("distance_m"))


@query("nearest_outside_extent", f"""
WITH c AS (SELECT c_custkey, {s_lat('c_custkey')} + 3 AS lat, {s_lon('c_custkey')} - 2 AS lon FROM customer),
s AS (SELECT s_suppkey, {s_lat('s_suppkey * 5 + 2')} AS lat, {s_lon('s_suppkey * 5 + 2')} AS lon FROM supplier),
p AS (SELECT c_custkey, s_suppkey, {s_haversine('c.lat', 'c.lon', 's.lat', 's.lon')} AS d FROM c, s)
SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, {s_r('min(d)', 3)} AS distance_m
FROM p GROUP BY c_custkey
""")
def nearest_outside_extent(spark, sf):
    c = places(spark, sf, "customer", "c_custkey", "c_custkey").withColumns(
        {"lat": F.col("lat") + 3, "lon": F.col("lon") - 2})
    out = nearest_site(c, site_positions(spark, sf), query_id=["c_custkey"],
                       query_uv=("lat", "lon"), site_uv=("slat", "slon"), payload=["s_suppkey"],
                       tie=["s_suppkey"], metric="haversine", distance="distance_m")
    return out.select("c_custkey", "s_suppkey", r("distance_m", 3).alias("distance_m"))


@query("nearest_pixel_by_nation", f"""
WITH c AS (SELECT c_custkey, c_nationkey AS n, {s_lat('c_custkey')} AS lat, {s_lon('c_custkey')} AS lon FROM customer),
s AS (SELECT s_suppkey, s_nationkey AS n, {s_lat('s_suppkey * 5 + 2')} AS lat, {s_lon('s_suppkey * 5 + 2')} AS lon FROM supplier),
p AS (SELECT c_custkey, c.n, s_suppkey, {s_scaled('c.lat', 'c.lon', 's.lat', 's.lon')} AS d FROM c JOIN s ON s.n = c.n)
SELECT n::BIGINT AS nation, c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, {s_r('min(d)', 9)} AS degrees_sq
FROM p GROUP BY n, c_custkey
""")
def nearest_pixel_by_nation(spark, sf):
    c = places(spark, sf, "customer", "c_custkey", "c_custkey", "c_nationkey").withColumnRenamed(
        "c_nationkey", "nation")
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey").select(
        "s_suppkey", F.col("s_nationkey").alias("nation"),
        lat_of(F.col("s_suppkey") * 5 + 2).alias("slat"),
        lon_of(F.col("s_suppkey") * 5 + 2).alias("slon"))
    out = nearest_site(c, s, query_id=["c_custkey"], query_uv=("lat", "lon"),
                       site_uv=("slat", "slon"), payload=["s_suppkey"], tie=["s_suppkey"],
                       by=["nation"], metric="scaled_degrees", distance="degrees_sq")
    return out.select(long("nation").alias("nation"), "c_custkey", "s_suppkey",
                      r("degrees_sq", 9).alias("degrees_sq"))


@query("asof_nearest_rows", """
WITH q AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'),
t AS (SELECT DISTINCT user_id, ts FROM v),
m AS (SELECT q.user_id, q.ts, arg_min(t.ts, (abs(epoch_us(t.ts) - epoch_us(q.ts)), t.ts)) AS vt
      FROM q JOIN t USING (user_id) GROUP BY q.user_id, q.ts)
SELECT m.user_id, epoch_us(m.ts) AS purchase_us, epoch_us(m.vt) AS view_us,
       abs(epoch_us(m.vt) - epoch_us(m.ts)) AS gap_us, v.event_id AS view_event, round(v.value, 6) AS value
FROM m JOIN v ON v.user_id = m.user_id AND v.ts = m.vt
WHERE abs(epoch_us(m.vt) - epoch_us(m.ts)) <= 172800000000
""".replace("AS gap_us", "AS gap_us"))
def asof_nearest_rows(spark, sf):
    e = events(spark, sf)
    q = e.where("event_type = 'purchase'").select("user_id", micros("ts").alias("purchase_us"))
    v = e.where("event_type = 'view'").select(
        "user_id", micros("ts").alias("view_us"), F.col("event_id").alias("view_event"), "value")
    out = rows_of_nearest(q, v, by=["user_id"], time="purchase_us", row_time="view_us",
                          tolerance_micros=2 * DAY, bucket_micros=DAY, gap="gap_us")
    return out.select("user_id", "purchase_us", "view_us", "gap_us", "view_event",
                      F.round("value", 6).alias("value"))


@query("quality_preferred_date", f"""
WITH cat AS (SELECT l_shipdate::DATE AS d, avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0 END) AS q
             FROM lineitem GROUP BY 1),
ref AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders),
p AS (SELECT ref.d, cat.d AS cd, cat.q, abs(date_diff('day', ref.d, cat.d)) AS gap,
             row_number() OVER (PARTITION BY ref.d ORDER BY CASE WHEN cat.q >= 0.5 THEN 0 ELSE 1 END,
               abs(date_diff('day', ref.d, cat.d)), cat.q DESC, cat.d) AS rn
      FROM ref JOIN cat ON abs(date_diff('day', ref.d, cat.d)) <= 20)
SELECT ref.d AS date, p.cd AS s2_date, p.gap::BIGINT AS gap_days, {s_r('coalesce(p.q, 0)')} AS coverage
FROM ref LEFT JOIN p ON p.d = ref.d AND p.rn = 1
""")
def quality_preferred_date(spark, sf):
    li = table(spark, sf, "lineitem", "l_shipdate", "l_returnflag").select(
        day("l_shipdate").alias("s2_date"),
        F.when(F.col("l_returnflag") == "A", F.lit(1.0)).alias("flag"))
    catalogue = day_coverage(li, "s2_date", ["flag"])
    refs = table(spark, sf, "orders", "o_orderdate").select(day("o_orderdate").alias("date"))
    out = preferred_day(refs, catalogue, day="date", candidate_day="s2_date", quality="coverage",
                        max_days=20, preferred=0.5, match="s2_date")
    return out.select("date", "s2_date", long("gap_days").alias("gap_days"),
                      r("coverage").alias("coverage"))


@query("radius_mean_fallback", f"""
WITH s AS (SELECT s_suppkey, 1000 * {s_frac('s_suppkey * 5 + 2', SPREAD_A)} AS x, 1000 * {s_frac('s_suppkey * 5 + 2', SPREAD_B)} AS y FROM supplier),
c AS (SELECT c_custkey, c_acctbal, c_nationkey, 700 * {s_frac('c_custkey', SPREAD_A)} AS x, 700 * {s_frac('c_custkey', SPREAD_B)} AS y FROM customer),
p AS (SELECT s_suppkey, c_custkey, c_acctbal, c_nationkey, sqrt(pow(s.x - c.x, 2) + pow(s.y - c.y, 2)) AS d FROM s, c),
inside AS (SELECT s_suppkey, avg(c_acctbal) AS a, avg(c_nationkey) AS n, count(*) AS k FROM p WHERE d <= 40 GROUP BY 1),
near AS (SELECT s_suppkey, arg_min(c_acctbal, (d, c_custkey)) AS a, arg_min(c_nationkey, (d, c_custkey))::DOUBLE AS n FROM p GROUP BY 1)
SELECT near.s_suppkey, {s_r('coalesce(inside.a, near.a)')} AS c_acctbal_mean,
       {s_r('coalesce(inside.n, near.n)')} AS nation_mean, coalesce(inside.k, 1)::BIGINT AS n_sources
FROM near LEFT JOIN inside USING (s_suppkey)
""")
def radius_mean_fallback(spark, sf):
    k = F.col("s_suppkey") * 5 + 2
    s = table(spark, sf, "supplier", "s_suppkey").select(
        "s_suppkey", (F.lit(1000) * frac(k, SPREAD_A)).alias("x"),
        (F.lit(1000) * frac(k, SPREAD_B)).alias("y"))
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"),
        (F.lit(700) * frac("c_custkey", SPREAD_A)).alias("x"),
        (F.lit(700) * frac("c_custkey", SPREAD_B)).alias("y"))
    out = radius_mean(s, c, target_id=["s_suppkey"], target_xy=("x", "y"), source_xy=("x", "y"),
                      source_id=["c_custkey"], values=["c_acctbal", "nation"], radius=40.0)
    return out.select("s_suppkey", r("c_acctbal_mean").alias("c_acctbal_mean"),
                      r("nation_mean").alias("nation_mean"), long("n_sources").alias("n_sources"))


PRODUCT_SQL = """
WITH p AS (SELECT event_id AS id, ts, ts::DATE AS d, user_id,
           CASE WHEN event_type IN ('view', 'click') THEN value END AS cloud,
           abs(hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0::DOUBLE - 10.2 * 60) AS dist
           FROM events WHERE hour(ts) BETWEEN 7 AND 13),
daily AS (SELECT d, arg_min(id, (dist, ts, id)) AS id, arg_min(ts, (dist, ts, id)) AS ts,
                 arg_min(user_id, (dist, ts, id)) AS user_id, min(dist) AS dist FROM p GROUP BY d),
cloud AS (SELECT d, arg_min(cloud, (dist, ts, id)) AS cloud FROM p WHERE cloud IS NOT NULL GROUP BY d)
"""


def products(spark, sf):
    return events(spark, sf).select(
        F.col("event_id").alias("Id"), F.col("ts").alias("acquisition_dt_utc"),
        day("ts").alias("date"), "user_id",
        F.when(F.col("event_type").isin("view", "click"), F.col("value")).alias("cloud"))


@query("best_product_per_day", PRODUCT_SQL + f"""
SELECT daily.d AS date, daily.id AS product, epoch_us(daily.ts) AS acquired_us, daily.user_id,
       {s_r('cloud.cloud')} AS cloud, {s_r('daily.dist')} AS hour_distance
FROM daily LEFT JOIN cloud ON cloud.d = daily.d
""")
def best_product_per_day(spark, sf):
    out = daily_products(products(spark, sf), first_hour=7, last_hour=13, target_hour=10.2)
    return out.select("date", F.col("Id").alias("product"),
                      micros("acquisition_dt_utc").alias("acquired_us"), "user_id",
                      r("cloud").alias("cloud"), r("hour_distance").alias("hour_distance"))


@query("products_near_references", PRODUCT_SQL + """
, refs AS (SELECT DISTINCT ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT refs.ts, arg_min(daily.id, (abs(epoch_us(daily.ts) - epoch_us(refs.ts)), daily.ts)) AS id
      FROM refs JOIN daily ON abs(date_diff('day', refs.ts::DATE, daily.d)) <= 3 GROUP BY refs.ts)
SELECT DISTINCT daily.id AS product, daily.d AS date, epoch_us(daily.ts) AS acquired_us
FROM m JOIN daily ON daily.id = m.id
""")
def products_near_references(spark, sf):
    daily = daily_products(products(spark, sf), first_hour=7, last_hour=13, target_hour=10.2)
    refs = events(spark, sf).where("event_type = 'purchase'").select("ts")
    out = products_near(daily, refs, time="ts", tolerance_days=3)
    return out.select(F.col("Id").alias("product"), "date",
                      micros("acquisition_dt_utc").alias("acquired_us"))


@query("impute_nearest_time", f"""
WITH e AS (SELECT event_id, date_trunc('hour', ts) AS t, {s_lat('user_id')} AS lat, {s_lon('user_id')} AS lon,
                  CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS v FROM events),
dt AS (SELECT DISTINCT t FROM e WHERE v IS NOT NULL),
ht AS (SELECT DISTINCT t FROM e WHERE v IS NULL),
m AS (SELECT ht.t, arg_min(dt.t, (abs(epoch_us(dt.t) - epoch_us(ht.t)), dt.t)) AS dt
      FROM ht JOIN dt ON dt.t <> ht.t GROUP BY ht.t),
f AS (SELECT h.event_id, arg_min(d.v, ({s_scaled('h.lat', 'h.lon', 'd.lat', 'd.lon')}, d.event_id)) AS fill
      FROM e h JOIN m ON m.t = h.t JOIN e d ON d.t = m.dt AND d.v IS NOT NULL
      WHERE h.v IS NULL GROUP BY h.event_id)
SELECT e.event_id, epoch_us(e.t) AS t_us, {s_r('coalesce(e.v, f.fill)')} AS value,
       (CASE WHEN e.v IS NULL AND f.fill IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS filled
FROM e LEFT JOIN f USING (event_id)
""")
def impute_nearest_time(spark, sf):
    e = events(spark, sf).select(
        "event_id", F.date_trunc("hour", "ts").alias("t"), lat_of("user_id").alias("latitude"),
        lon_of("user_id").alias("longitude"),
        F.when(~F.col("event_type").isin("error", "signup"), F.col("value")).alias("value"))
    out = fill_from_nearest_time(e, row_id=["event_id"], time="t", value="value")
    return out.select("event_id", micros("t").alias("t_us"), r("value").alias("value"),
                      long("filled").alias("filled"))
