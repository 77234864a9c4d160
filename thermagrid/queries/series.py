"""Queries of the hourly and daily series operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import (decimal_hour, floor_to_day, hours_between, in_windows,
                                  interval_end_day, micros, minutes_of_day, round_to_hour,
                                  season_features)
from ..operators import series as ops
from ..operators.lookups import (attach_weather, distinct_union, same_key_sets)
from ..operators.ranking import keep_first
from ..operators.reports import median_hour
from .base import day, events, long, query, r, s_r, table


@query("deaccumulate_hourly", f"""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2),
c AS (SELECT event_type, t, sum(v) OVER (PARTITION BY event_type, t::DATE ORDER BY t) AS tp,
             sum(v) OVER (PARTITION BY event_type, t::DATE ORDER BY t) - 5 * hour(t) AS ro FROM h),
g AS (SELECT *, lag(t) OVER w AS pt, lag(tp) OVER w AS ptp, lag(ro) OVER w AS pro FROM c
      WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, epoch_us(t) AS t_us,
       {s_r("CASE WHEN hour(t) = 1 THEN greatest(tp, 0) WHEN t - pt = INTERVAL 1 HOUR THEN greatest(tp - ptp, 0) END", 5)} AS tp,
       {s_r("CASE WHEN hour(t) = 1 THEN ro WHEN t - pt = INTERVAL 1 HOUR THEN ro - pro END", 5)} AS ro
FROM g
""")
def deaccumulate_hourly(spark, sf):
    h = events(spark, sf).groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(
        F.sum("value").alias("v"))
    w = Window.partitionBy("event_type", F.to_date("t")).orderBy("t")
    c = h.select("event_type", "t", F.sum("v").over(w).alias("tp"),
                 (F.sum("v").over(w) - F.lit(5) * F.hour("t")).alias("ro"))
    out = ops.deaccumulate(c, ["tp", "ro"], time="t", by=["event_type"])
    return out.select("event_type", micros("t").alias("t_us"), r("tp", 5).alias("tp"),
                      r("ro", 5).alias("ro"))


RAIN_SQL = """
WITH e AS (SELECT event_type, (ts - INTERVAL 1 MICROSECOND)::DATE AS d, 
             coalesce(sum(CASE WHEN event_type IN ('error', 'view') OR hour(ts) < 6 THEN value END), 0) AS v FROM events GROUP BY 1, 2),
cal AS (SELECT event_type, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM e GROUP BY 1),
dense AS (SELECT cal.event_type, cal.d, coalesce(e.v, 0) AS v FROM cal LEFT JOIN e USING (event_type, d)),
roll AS (SELECT event_type, d, v, sum(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v3 FROM dense)
"""


@query("daily_rain_rolling", RAIN_SQL + f"""
SELECT event_type, d AS day, {s_r('v', 4)} AS rain_1d, {s_r('v3', 4)} AS rain_3d,
       {s_r('ln(1 + greatest(v3, 0))')} AS rain_3d_log, (v3 > 0)::BIGINT AS is_rainy FROM roll
""")
def daily_rain_rolling(spark, sf):
    known = F.col("event_type").isin("error", "view") | (F.hour("ts") < 6)
    e = events(spark, sf).withColumn("precip_mm", F.when(known, F.col("value")))
    out = ops.daily_rain(e, time="ts", by=["event_type"])
    return out.select("event_type", "day", r("rain_1d", 4).alias("rain_1d"),
                      r("rain_3d", 4).alias("rain_3d"), r("rain_3d_log").alias("rain_3d_log"),
                      long("is_rainy").alias("is_rainy"))


@query("hour_round_lookup", f"""
WITH hourly AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS tair FROM events WHERE event_type <> 'click' GROUP BY 1),
daily AS (SELECT ts::DATE AS d, sum(value) AS rain_1d FROM events WHERE event_type = 'click' GROUP BY 1),
e AS (SELECT event_id, ts, make_timestamp((round_even(epoch_us(ts) / 3600000000.0::DOUBLE, 0) * 3600000000)::BIGINT) AS t FROM events)
SELECT event_id, epoch_us(e.t) AS hour_us, {s_r('hourly.tair')} AS tair, {s_r('daily.rain_1d', 4)} AS rain_1d
FROM e LEFT JOIN hourly ON hourly.t = e.t LEFT JOIN daily ON daily.d = e.ts::DATE
""")
def hour_round_lookup(spark, sf):
    e = events(spark, sf)
    hourly = e.where("event_type <> 'click'").groupBy(
        F.date_trunc("hour", "ts").alias("era5_dt_utc")).agg(F.avg("value").alias("tair"))
    daily = e.where("event_type = 'click'").groupBy(day("ts").alias("day")).agg(
        F.sum("value").alias("rain_1d"))
    out = attach_weather(e.select("event_id", "ts"), "ts", hourly, daily, ["tair"], ["rain_1d"])
    return out.select("event_id", micros("era5_dt_utc").alias("hour_us"), r("tair").alias("tair"),
                      r("rain_1d", 4).alias("rain_1d"))


ISLANDS_SQL = """
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events),
g AS (SELECT user_id, d, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INTEGER AS grp FROM d),
rng AS (SELECT user_id, min(d) AS s, max(d) + 1 AS e FROM g GROUP BY user_id, grp)
"""


@query("gaps_islands", ISLANDS_SQL + """
SELECT user_id, s AS range_start, e AS range_end FROM rng
""")
def gaps_islands(spark, sf):
    e = events(spark, sf).select("user_id", day("ts").alias("day"))
    return ops.contiguous_ranges(e, "day", ["user_id"])


@query("split_ranges", ISLANDS_SQL + """
, n AS (SELECT user_id, s, e, greatest(1, least(184, 750000 // greatest(24 * (200 + user_id * 10) * greatest(1, 30 + 4), 1)))::INTEGER AS n FROM rng),
x AS (SELECT user_id, n, s, e, unnest(generate_series(0, (e - s)::INTEGER - 1, n)) AS o FROM n)
SELECT user_id, n::BIGINT AS max_days, (s + o::INTEGER) AS range_start, least(e, s + o::INTEGER + n) AS range_end FROM x
""")
def split_ranges(spark, sf):
    e = events(spark, sf).select("user_id", day("ts").alias("day"))
    ranges = ops.contiguous_ranges(e, "day", ["user_id"]).withColumn(
        "max_days", ops.days_per_request(F.lit(200) + F.col("user_id") * 10, F.lit(30)))
    out = ops.split_ranges(ranges, F.col("max_days"))
    return out.select("user_id", long("max_days").alias("max_days"), "range_start", "range_end")


@query("expand_days", """
SELECT DISTINCT event_type, (ts::DATE + o::INTEGER) AS day
FROM events, (SELECT unnest([-2, -1, 0, 1]) AS o)
""")
def expand_days(spark, sf):
    e = events(spark, sf).select("event_type", day("ts").alias("day"))
    return ops.expand_days(e, "day", by=["event_type"])


@query("season_windows", """
WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
w AS (SELECT y, make_date(y, 11, 1) AS s, make_date(y + 1, 2, 28) AS e FROM y)
SELECT w.y::BIGINT AS season, w.s AS start_date, w.e AS end_date, count(o.o_orderkey) AS orders,
       round(coalesce(sum(o.o_totalprice), 0), 2) AS total
FROM w LEFT JOIN orders o ON o.o_orderdate::DATE >= w.s AND o.o_orderdate::DATE < w.e + 1
GROUP BY ALL
""")
def season_windows(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice").withColumn(
        "d", day("o_orderdate"))
    windows = ops.season_windows(o.select(F.year("d").alias("season")), "season", (11, 1), (2, 28))
    # A window covers at most two calendar years: equi-join on the year.
    spread = windows.withColumn("_y", F.explode(F.sequence(F.year("start_date"), F.year("end_date"))))
    daily = o.groupBy("d").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("t"))
    hits = spread.join(daily.withColumn("_y", F.year("d")), "_y").where(
        (F.col("d") >= F.col("start_date")) & (F.col("d") < F.date_add("end_date", 1)))
    sums = hits.groupBy("season").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    return windows.join(sums, "season", "left").select(
        long("season").alias("season"), "start_date", "end_date",
        F.coalesce("n", F.lit(0)).cast("long").alias("orders"),
        F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("window_filter", """
SELECT month(o_orderdate)::BIGINT AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders
WHERE ((o_orderdate >= DATE '1996-05-01' AND o_orderdate < DATE '1996-11-01')
    OR (o_orderdate >= DATE '1998-11-15' AND o_orderdate < DATE '1999-03-01'))
  AND month(o_orderdate) IN (5, 6, 9, 12, 1) AND o_totalprice <= 400000
GROUP BY 1
""")
def window_filter(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_totalprice")
    kept = o.where(
        in_windows("o_orderdate", [("1996-05-01", "1996-10-31"), ("1998-11-15", "1999-02-28")])
        & F.month("o_orderdate").isin(5, 6, 9, 12, 1) & (F.col("o_totalprice") <= 400000))
    return kept.groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("densify_series", """
WITH d AS (SELECT user_id, ts::DATE AS d, sum(value) AS v FROM events GROUP BY 1, 2),
cal AS (SELECT user_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM d GROUP BY 1)
SELECT user_id, cal.d AS day, round(coalesce(d.v, 0), 4) AS value FROM cal LEFT JOIN d USING (user_id, d)
""")
def densify_series(spark, sf):
    daily = events(spark, sf).groupBy("user_id", day("ts").alias("day")).agg(
        F.sum("value").alias("value"))
    out = ops.densify_days(daily, "day", {"value": 0.0}, by=["user_id"])
    return out.withColumn("value", F.round("value", 4))


@query("keep_first_dedupe", """
SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, round(o_totalprice, 2) AS total FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_totalprice, o_orderkey) = 1
""")
def keep_first_dedupe(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").select(
        "o_orderkey", "o_custkey", day("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("total"))
    out = keep_first(o, ["o_custkey", "day"], ["total", "o_orderkey"])
    return out.withColumn("total", F.round("total", 2))


@query("calendar_features", f"""
SELECT event_id, dayofyear(ts)::BIGINT AS day_of_year,
       {s_r('sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE)')} AS sin_doy,
       {s_r('cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE)')} AS cos_doy,
       {s_r('hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE')} AS decimal_hour,
       epoch_us(make_timestamp((round_even(epoch_us(ts) / 3600000000.0::DOUBLE, 0) * 3600000000)::BIGINT)) AS rounded_us,
       (ts - INTERVAL 1 MICROSECOND)::DATE AS end_day, ts::DATE AS day,
       {s_r("abs(epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3600000000.0::DOUBLE")} AS hours_into_day,
       strftime(ts, '%Y%m%dT%H%M') || '_' || (user_id // 40)::VARCHAR || '_' || (user_id % 40)::VARCHAR AS pixel
FROM events
""")
def calendar_features(spark, sf):
    from ..functions.calendar import pixel_id
    e = events(spark, sf)
    f = season_features("ts")
    midnight = F.date_trunc("day", "ts")
    return e.withColumn("_m", midnight).select(
        "event_id", long(f["day_of_year"]).alias("day_of_year"), r(f["sin_doy"]).alias("sin_doy"),
        r(f["cos_doy"]).alias("cos_doy"), r(decimal_hour("ts")).alias("decimal_hour"),
        micros(round_to_hour("ts")).alias("rounded_us"), interval_end_day("ts").alias("end_day"),
        floor_to_day("ts").alias("day"), r(hours_between("ts", "_m")).alias("hours_into_day"),
        pixel_id("ts", F.floor(F.col("user_id") / 40), F.col("user_id") % 40).alias("pixel"))


@query("median_hour", f"""
SELECT event_type, {s_r("coalesce(median(CASE WHEN value > 20 THEN hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0::DOUBLE END) / 60, 10.0)")} AS median_hour
FROM events GROUP BY event_type
""")
def median_hour_by_type(spark, sf):
    e = events(spark, sf)
    out = median_hour(e, F.when(F.col("value") > 20, minutes_of_day("ts")), by=["event_type"])
    return out.select("event_type", r("median_hour").alias("median_hour"))


@query("date_set_ops", """
WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders),
l AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem),
u AS (SELECT d FROM o UNION SELECT d FROM l)
SELECT u.d AS day, (l.d IS NULL)::BIGINT AS missing_in_lineitem, (o.d IS NULL)::BIGINT AS missing_in_orders
FROM u LEFT JOIN o ON o.d = u.d LEFT JOIN l ON l.d = u.d
""")
def date_set_ops(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate").select(day("o_orderdate").alias("day"))
    li = table(spark, sf, "lineitem", "l_shipdate").select(day("l_shipdate").alias("day"))
    every = distinct_union([o, li])
    only_o = ops.missing_keys(o, li, ["day"]).withColumn("a", F.lit(1))
    only_l = ops.missing_keys(li, o, ["day"]).withColumn("b", F.lit(1))
    return every.join(only_o, "day", "left").join(only_l, "day", "left").select(
        "day", F.coalesce("a", F.lit(0)).cast("long").alias("missing_in_lineitem"),
        F.coalesce("b", F.lit(0)).cast("long").alias("missing_in_orders"))


@query("key_set_check", """
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer)
SELECT (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM c)) AS only_left,
       (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM o)) AS only_right,
       (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM o)) + (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM c)) = 0 AS equal
""")
def key_set_check(spark, sf):
    o = table(spark, sf, "orders", "o_custkey").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("k"))
    return same_key_sets(o, c, ["k"])


@query("target_hour_coverage", """
WITH w AS (SELECT DISTINCT make_timestamp((round_even(epoch_us(ts) / 3600000000.0::DOUBLE, 0) * 3600000000)::BIGINT) AS t FROM events WHERE event_type = 'view'),
a AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events WHERE event_type = 'click')
SELECT count(*) AS target_keys, count(a.t) AS complete_keys, count(*) - count(a.t) AS missing_keys
FROM w LEFT JOIN a ON a.t = w.t
""")
def target_hour_coverage(spark, sf):
    e = events(spark, sf)
    wanted = e.where("event_type = 'view'").select(round_to_hour("ts").alias("t"))
    have = e.where("event_type = 'click'").select(F.date_trunc("hour", "ts").alias("t"))
    return ops.key_coverage(wanted, have, ["t"])
