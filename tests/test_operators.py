import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from thermagrid.functions import geo
from thermagrid.operators import contract, fusion, grid, groups, reports, series, splits, zonal
from thermagrid.operators.catalogue import alias_table, canonical_names, variable_cards
from thermagrid.operators.impute import fill_from_nearest_time
from thermagrid.operators.near_space import _disc_cells, nearest_site, radius_mean
from thermagrid.operators.near_time import nearest_time, preferred_day
from thermagrid.operators.ranking import (exact_medians, first_value_per_column, median_by,
                                          running_number)
from thermagrid.plans.coarse import daily_products, products_near
from thermagrid.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day(df, *names):
    return df.withColumns({n: F.to_date(n) for n in names})


# Nearest joins against brute force.

def brute_nearest(metric, q, sites):
    best = None
    for sid, a, b in sites:
        la, lo = q
        if metric == "planar":
            d = (la - a) ** 2 + (lo - b) ** 2
        elif metric == "scaled_degrees":
            d = (la - a) ** 2 + ((lo - b) * math.cos(math.radians(la))) ** 2
        else:
            p, r = math.radians(la), math.radians(a)
            d = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin(math.radians(b - lo) / 2) ** 2
        if best is None or (d, sid) < best:
            best = (d, sid)
    return best[1]


@pytest.mark.parametrize("metric", ["haversine", "scaled_degrees", "planar"])
def test_nearest_site_equals_brute_force(spark, metric):
    rng = random.Random(7)
    queries = [(i, rng.uniform(36, 38), rng.uniform(-7, -5)) for i in range(60)]
    # A third of the sites crowd in one spot.
    sites = [(i, 36.9 + rng.uniform(0, 1e-4), -6 + rng.uniform(0, 1e-4)) if i % 3 == 0
             else (i, rng.uniform(36.2, 37.6), rng.uniform(-6.6, -5.4)) for i in range(240)]
    q = spark.createDataFrame(queries, "qid int, la double, lo double")
    s = spark.createDataFrame(sites, "sid int, sla double, slo double")
    out = nearest_site(q, s, query_id=["qid"], query_uv=("la", "lo"), site_uv=("sla", "slo"),
                       payload=["sid"], tie=["sid"], metric=metric, leaf=16)
    got = {r.qid: r.sid for r in out.collect()}
    assert got == {i: brute_nearest(metric, (a, b), sites) for i, a, b in queries}
    assert "CartesianProduct" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def test_nearest_site_ties_groups_and_gaps(spark):
    q = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 0.0, 0.0), (3, "a", None, 0.0)],
                              "qid int, g string, x double, y double")
    s = spark.createDataFrame([(9, "a", 1.0, 0.0), (4, "a", -1.0, 0.0), (5, "a", None, 0.0)],
                              "sid int, g string, sx double, sy double")
    out = nearest_site(q, s, query_id=["qid"], query_uv=("x", "y"), site_uv=("sx", "sy"),
                       payload=["sid"], tie=["sid"], by=["g"], metric="planar").collect()
    assert [(r.qid, r.sid, r.distance) for r in out] == [(1, 4, 1.0)]


@pytest.mark.parametrize("leaf,shift", [(1, 0.0), (16, -300.0), (64, 4.2e6)])
def test_radius_mean_equals_brute_force(spark, leaf, shift):
    rng = random.Random(3)
    targets = [(i, shift + rng.uniform(0, 600), shift + rng.uniform(0, 600)) for i in range(25)]
    targets += [(25, shift + 100.0, shift + 100.0)]
    nodes = [(i, shift + (rng.uniform(0, 400) if i % 3 else 200 + rng.uniform(0, 9)),
              shift + (rng.uniform(0, 400) if i % 3 else 200 + rng.uniform(0, 9)),
              float(i % 11) if i % 5 else None) for i in range(300)]
    # On the circle, twice at one place, and in the middle.
    nodes += [(300, shift + 160.0, shift + 100.0, 1.0), (301, shift + 100.0, shift + 40.0, 2.0),
              (302, shift + 100.0, shift + 40.0, None), (303, shift + 100.0, shift + 100.0, 3.0)]
    t = spark.createDataFrame([*targets, (99, None, 1.0)], "t int, x double, y double")
    n = spark.createDataFrame([*nodes, (999, None, 0.0, 1.0)], "n int, x double, y double, v double")
    out = radius_mean(t, n, target_id=["t"], target_xy=("x", "y"), source_xy=("x", "y"),
                      source_id=["n"], values=["v"], radius=60.0, leaf=leaf)
    got = {r.t: (r.v_mean, r.n_sources) for r in out.collect()}
    assert set(got) == {i for i, _, _ in targets}
    for i, x, y in targets:
        near = sorted((math.hypot(x - a, y - b), k, v) for k, a, b, v in nodes)
        inside = [v for d, _, v in near if d <= 60]
        known = [v for v in inside if v is not None]
        want = ((sum(known) / len(known) if known else None, len(inside)) if inside
                else (near[0][2], 1))
        assert got[i][1] == want[1]
        assert got[i][0] == (pytest.approx(want[0]) if want[0] is not None else None)


def test_disc_cells_cover_each_point_once(spark):
    rng = random.Random(8)
    radius, base, deepest = 10.0, 10.01, 5
    middles = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50), i % (deepest + 1)) for i in range(36)]
    t = spark.createDataFrame(middles, "t int, _tx double, _ty double, _depth int")
    cells = _disc_cells(t, ["t", "_tx", "_ty"], radius, base).collect()
    of = {}
    for c in cells:
        of.setdefault(c.t, []).append(c)
    for i, x, y, depth in middles:
        for _ in range(400):
            a, b = x + rng.uniform(-11, 11), y + rng.uniform(-11, 11)
            d = math.hypot(a - x, b - y)
            held = [c for c in of[i] if (math.floor(a / (base / 2 ** c._level)), math.floor(b / (base / 2 ** c._level))) == (c._cx, c._cy)]
            if d <= radius:
                assert len(held) == 1
            else:
                assert len(held) <= 1 and all(c._edge for c in held)
            assert all(c._level == depth for c in held if c._edge)
        assert len(of[i]) <= 60 * 2 ** depth  # the edge of the disc, not its area


def test_radius_mean_without_sources_or_targets(spark):
    t = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 1, 0.0, 0.0)], "g string, t int, x double, y double")
    n = spark.createDataFrame([("a", 1, 500.0, 0.0, 7.0)], "g string, n int, x double, y double, v double")
    how = dict(target_id=["t"], target_xy=("x", "y"), source_xy=("x", "y"), source_id=["n"],
               values=["v"], radius=60.0, by=["g"])
    assert [(r.g, r.v_mean, r.n_sources) for r in radius_mean(t, n, **how).collect()] == [("a", 7.0, 1)]
    assert radius_mean(t, n.limit(0), **how).count() == 0
    assert radius_mean(t.limit(0), n, **how).count() == 0


@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_time_equals_brute_force(spark, exclude):
    rng = random.Random(5)
    qs = {(rng.randrange(2), rng.randrange(900)) for _ in range(120)}
    cs = {(rng.randrange(2), rng.randrange(900)) for _ in range(40)}
    q = spark.createDataFrame(sorted(qs), "k int, t long")
    c = spark.createDataFrame(sorted(cs), "k int, c long")
    out = nearest_time(q, c, by=["k"], time="t", candidate_time="c", bucket=50, tolerance=30,
                       exclude_same=exclude)
    got = {(r.k, r.t): r.match_time for r in out.collect()}
    for k, t in qs:
        near = [x for g, x in cs if g == k and not (exclude and x == t)]
        best = min(near, key=lambda x: (abs(x - t), x))
        assert got.get((k, t)) == (best if abs(best - t) <= 30 else None)


def test_preferred_day(spark):
    refs = day(spark.createDataFrame([("2024-01-10",), ("2024-06-01",)], "date string"), "date")
    cat = day(spark.createDataFrame([("2024-01-09", 0.5), ("2024-01-15", 0.9), ("2024-01-05", 0.95)],
                                    "d string, q double"), "d")
    got = {str(r.date): (str(r.match_day), r.gap_days, r.coverage) for r in preferred_day(
        refs, cat, day="date", candidate_day="d", quality="q").collect()}
    assert got["2024-01-10"] == ("2024-01-05", 5, 0.95)
    assert got["2024-06-01"] == ("None", None, 0.0)


# Series.

def test_deaccumulate_known_values(spark):
    rows = [("2024-01-01 22:00", 10.0), ("2024-01-01 23:00", 15.0), ("2024-01-02 00:00", 20.0),
            ("2024-01-02 01:00", 2.0), ("2024-01-02 02:00", 5.0), ("2024-01-02 04:00", 9.0)]
    df = spark.createDataFrame(rows, "t string, ssrd double").withColumn("t", F.to_timestamp("t"))
    got = [r.ssrd for r in series.deaccumulate(df, ["ssrd"], time="t").orderBy("t").collect()]
    assert got == [None, 5.0, 5.0, 2.0, 3.0, None]


def test_accumulate_then_deaccumulate_is_identity(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 9) for _ in range(72)]
    rows, total = [], 0.0
    for h, v in enumerate(values):
        total = v if h % 24 == 1 else total + v
        rows.append((h, total))
    df = spark.createDataFrame(rows, "h int, tp double").withColumn(
        "t", F.timestamp_seconds(F.col("h") * 3600))
    out = series.deaccumulate(df, ["tp"], time="t").orderBy("t").collect()
    assert [r.tp for r in out][1:] == pytest.approx(values[1:])


def test_daily_rain(spark):
    rows = [("2024-01-01 23:00", 1.0), ("2024-01-02 00:00", 2.0), ("2024-01-02 01:00", 4.0),
            ("2024-01-05 05:00", 1.0)]
    df = spark.createDataFrame(rows, "t string, precip_mm double").withColumn("t", F.to_timestamp("t"))
    got = [(str(r.day), r.rain_1d, r.rain_3d, r.is_rainy) for r in
           series.daily_rain(df, time="t").orderBy("day").collect()]
    assert got == [("2024-01-01", 3.0, 3.0, 1), ("2024-01-02", 4.0, 7.0, 1), ("2024-01-03", 0.0, 7.0, 1),
                   ("2024-01-04", 0.0, 4.0, 1), ("2024-01-05", 1.0, 1.0, 1)]


def test_rain_features_keep_nulls(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (None,)], "rain_3d double")
    got = [(r.is_rainy, r.rain_3d_log) for r in series.with_rain_features(df).collect()]
    assert got[0] == (0, 0.0) and got[1] == (1, pytest.approx(math.log(5))) and got[2] == (None, None)


def test_day_ranges(spark):
    df = day(spark.createDataFrame([("2020-05-01",), ("2020-05-02",), ("2021-05-01",)], "d string"), "d")
    ranges = series.contiguous_ranges(series.expand_days(df, "d"), "d")
    got = sorted((str(r.range_start), str(r.range_end)) for r in ranges.collect())
    assert got == [("2020-04-29", "2020-05-04"), ("2021-04-29", "2021-05-03")]
    half_year = day(spark.createDataFrame([("2024-01-01", "2024-07-01")], "range_start string, range_end string"),
                    "range_start", "range_end")
    n = series.days_per_request(geo.raster_cells(F.lit(0.3), F.lit(0.3)), F.lit(30))
    parts = sorted((r.range_start, r.range_end) for r in series.split_ranges(half_year, n).collect())
    assert len(parts) > 1 and str(parts[0][0]) == "2024-01-01" and str(parts[-1][1]) == "2024-07-01"
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    years = spark.createDataFrame([(2022,), (2022,)], "y int")
    w = series.season_windows(years, "y", (11, 1), (2, 28)).collect()
    assert [(str(r.start_date), str(r.end_date)) for r in w] == [("2022-11-01", "2023-02-28")]


# Ranking, groups, splits.

def test_running_number_and_first_values(spark):
    df = spark.createDataFrame([("a", i % 7, i) for i in range(40)] + [("b", 3, 99)], "g string, v int, i int")
    got = {r.i: r.n for r in running_number(df, ["g"], "v", ties=["i"], out="n").collect()}
    want = {i: k + 1 for k, (_, i) in enumerate(sorted((i % 7, i) for i in range(40)))}
    assert got == {**want, 99: 1}
    rows = spark.createDataFrame([("d", 2, None, "y"), ("d", 1, None, "x"), ("d", 3, 5, None)],
                                 "k string, o int, a int, b string")
    r = first_value_per_column(rows, ["k"], ["o"]).first()
    assert (r.a, r.b) == (5, "x")


def test_exact_medians(spark):
    df = spark.createDataFrame([(float(i), float(i % 4) if i % 3 else None) for i in range(101)],
                               "a double, b double")
    m = exact_medians(df, ["a", "b"], ranges=8)
    known = sorted(float(i % 4) for i in range(101) if i % 3)
    assert m["a"] == (50.0, 101)
    assert m["b"] == ((known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2, len(known))


def test_median_by_key(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else "k%d" % (i % 5), rng.randrange(40) / 3) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in median_by(df, ["k"], "v", "m", ranges=8).collect()}
    for k in {k for k, _ in rows}:
        assert got[k] == pytest.approx(statistics.median(v for g, v in rows if g == k))


def test_group_deltas_never_mix_areas(spark):
    rows = [("a", "p", 300.0), ("a", "p", 302.0), ("b", "p", 400.0), ("b", "p", 410.0)]
    df = spark.createDataFrame(rows, "area string, pixel string, t double")
    out = groups.within_group_deltas(df, ["area", "pixel"], {"t": "d"}).collect()
    assert sorted(r.d for r in out) == [-5.0, -1.0, 1.0, 5.0]


@pytest.mark.parametrize("days, want", [
    (["2024-05-%02d" % d for d in range(1, 7)], "TTTVEE"),
    (["2022-05-01", "2023-05-01", "2023-06-01", "2024-05-01", "2024-06-01"], "TVVEE"),
    (["2023-05-0%d" % d for d in range(1, 6)] + ["2024-01-01"], "TTTTVE")])
def test_temporal_split(spark, days, want):
    df = day(spark.createDataFrame([(d, True) for d in days for _ in range(2)] + [("2030-01-01", False)],
                                   "date string, training_ready boolean"), "date")
    out = splits.with_temporal_split(df).select("date", "split").distinct().orderBy("date").collect()
    letters = {"train": "T", "validation": "V", "test": "E", "prediction_only": "-"}
    assert "".join(letters[r.split] for r in out) == want + "-"


def test_splits_refuse_too_few_dates(spark):
    df = day(spark.createDataFrame([("2024-05-01", True), ("2024-05-02", True)],
                                   "date string, training_ready boolean"), "date")
    with pytest.raises(ValueError):
        splits.with_temporal_split(df)
    with pytest.raises(ValueError):
        splits.with_date_folds(df)


def test_folds_keep_dates_whole(spark):
    df = spark.range(200).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 17).cast("int")).alias("date"))
    out = splits.with_date_folds(df, folds=5)
    assert out.groupBy("date").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0
    sizes = [r["count"] for r in out.select("date", "fold").distinct().groupBy("fold").count().collect()]
    assert sum(sizes) == 17 and max(sizes) - min(sizes) <= 1


# Impute, fusion, reports.

def test_impute_from_nearest_time(spark):
    rows = [("a", "2024-07-10 10:00", 37.0, -6.0, 0.25), ("b", "2024-07-15 10:00", 37.0, -6.0, None),
            ("c", "2024-07-25 10:00", 37.0, -6.0, 0.80)]
    df = spark.createDataFrame(rows, "id string, t string, latitude double, longitude double, v double").withColumn(
        "t", F.to_timestamp("t"))
    out = {r.id: (r.v, r.filled) for r in fill_from_nearest_time(df, row_id=["id"], time="t", value="v").collect()}
    assert out == {"a": (0.25, 0), "b": (0.25, 1), "c": (0.80, 0)}
    lone = df.where("id = 'b'")
    assert [(r.v, r.filled) for r in fill_from_nearest_time(lone, row_id=["id"], time="t", value="v").collect()] == [(None, 0)]


def test_target_fusion_and_scope(spark):
    df = spark.createDataFrame([("n0", 305.0, 300.0), ("n1", None, 306.0), ("n2", None, None), ("n3", 500.0, None)],
                               "node_id string, LST_K double, LST_model_K double").withColumn("area_id", F.lit("zona"))
    out = fusion.fuse_targets(df, scope="local").withColumn("g", fusion.global_id()).orderBy("node_id").collect()
    assert [r.LST_target_K for r in out] == [305.0, 306.0, None, 500.0]
    assert [r.target_source for r in out] == ["landsat_observed", "sentinel3_downscaled_local", "unavailable", "landsat_observed"]
    assert [r.target_training_eligible for r in out] == [1, 1, 0, 0] and out[0].g == "zona__n0"
    maes = spark.createDataFrame([(2.0, None), (2.0, 1.99), (2.0, 1.90)], "g double, l double")
    assert [r[0] for r in maes.select(fusion.model_scope("g", "l")).collect()] == ["general", "general", "local"]
    ids = spark.createDataFrame([("a b!", 1.0), ("", 1.0), (None, 2.0), ("!!", 1.0)], "id string, x double")
    got = [r[0] for r in ids.select(fusion.stable_area_id("id", ["x"])).collect()]
    assert got[0] == "a_b" and got[1].startswith("roi_") and len(got[2]) == 14 and got[3] == "roi_unknown"


def test_residual_columns_and_readiness(spark):
    cols = ("LST_K double, LST_1km double, NDVI double, NDVI_1km double, NDBI double, NDBI_1km double, ALBEDO double, "
            "ALBEDO_1km double, aspect_ratio double, aspect_ratio_1km double, s3_day_difference int")
    base = [302.0, 300.0, 0.5, 0.4, 0.5, 0.2, 0.2, 0.2, 1.0, 1.0]
    df = spark.createDataFrame([tuple(base + [0]), tuple(base + [1]), tuple(base[:4] + [None] + base[5:] + [0])], cols)
    out = fusion.residual_columns(df)
    rows = out.withColumn("ok", fusion.training_ready(out)).collect()
    assert rows[0].Delta_LST == 2.0 and rows[0].NDVI_delta == pytest.approx(0.1) and rows[0].NDBI_delta == pytest.approx(0.3)
    assert [r.ok for r in rows] == [True, False, False]
    with pytest.raises(ValueError):
        fusion.residual_columns(df.drop("NDBI"))


def test_error_metrics_match_direct_formulas(spark):
    rng = random.Random(2)
    rows = [("2024-01-%02d" % (1 + i % 5), rng.uniform(280, 320), rng.uniform(280, 320)) for i in range(60)]
    df = spark.createDataFrame(rows, "date string, o double, p double")
    r = reports.error_metrics(df, "o", "p", "date").first()
    e = [p - o for _, o, p in rows]
    mean = sum(o for _, o, _ in rows) / 60
    assert r.mae == pytest.approx(sum(map(abs, e)) / 60) and r.bias == pytest.approx(sum(e) / 60)
    assert r.r2 == pytest.approx(1 - sum(x * x for x in e) / sum((o - mean) ** 2 for _, o, _ in rows))


def test_quality_report_status(spark):
    df = spark.createDataFrame([("n1", "d1", 1.0, True), ("n2", "d1", None, False)],
                               "node_id string, date string, NDVI double, training_ready boolean")
    r = reports.quality_report(df).first()
    assert (r.status, r.rows, r.nodes, r.dates, r.training_ready_rows) == ("with_gaps", 2, 2, 1, 1)
    assert r.missing_by_column == [Row(column="NDVI", count=1, percent=50.0)]
    assert reports.quality_report(df.where("NDVI is null")).first().status == "insufficient"
    assert reports.quality_report(df.where("NDVI is not null")).first().status == "complete"
    assert reports.quality_report(df.where("NDVI is not null"), failed_items=2).first().status == "with_gaps"


# Products, grid, raster.

def test_product_choice(spark):
    rows = [("a", "2024-07-01 09:00"), ("b", "2024-07-01 10:20"), ("c", "2024-07-02 10:00"), ("d", "2024-07-02 20:00"),
            ("e", "2024-07-09 10:00")]
    df = spark.createDataFrame(rows, "Id string, t string").select(
        "Id", F.to_timestamp("t").alias("acquisition_dt_utc"), F.to_date("t").alias("date"))
    daily = daily_products(df, first_hour=7, last_hour=13, target_hour=10.2)
    assert sorted(r.Id for r in daily.collect()) == ["b", "c", "e"]
    refs = spark.createDataFrame([("2024-07-03 10:00",), ("2024-07-05 23:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert sorted(r.Id for r in products_near(daily, refs, time="t").collect()) == ["c"]


def test_grid_operators(spark):
    a = spark.createDataFrame([(0.0, 0.0, 1500.0, 1600.0)], "a double, b double, c double, d double")
    g = a.withColumns(grid.aligned_bounds("a", "b", "c", "d")).withColumn("k", F.lit(1))
    cells = grid.grid_cells(g, ["k"]).orderBy("row", "col").collect()
    assert len(cells) == 4 and (cells[0].right - cells[0].left, cells[0].top - cells[0].bottom) == (1000.0, 1000.0)
    area = spark.createDataFrame([("z", 37.4, -5.98, 750.0, 27.0)], "area_id string, center_lat double, center_lon double, half_side_m double, rotation_deg double")
    nodes = grid.node_grid(area, 100.0)
    assert nodes.count() == 225
    edges = grid.grid_edges(nodes)
    assert edges.count() == 2 * 2 * 15 * 14
    assert all(abs(r.distance_m - 100) < 1 for r in edges.limit(20).collect())
    squares = grid.area_squares(area)
    back = grid.recover_squares(squares, "ring_degrees", "half_side_m").first()
    assert back.valid and back.rotation_deg == pytest.approx(27, abs=1e-4)
    assert back.center_lat == pytest.approx(37.4, abs=1e-7)
    moved = grid.move_areas(area, *grid.direction_offsets(F.lit("west"), F.lit(500.0))).first()
    assert moved.center_lon < -5.98
    boundary = grid.area_squares(area).select(F.col("ring").alias("b"))
    far = grid.area_squares(grid.move_areas(area, F.lit(5000.0), F.lit(0.0))).select(F.col("ring").alias("s"))
    row = boundary.crossJoin(far).select(grid.boundary_coverage("b", "s").alias("far"),
                                         grid.boundary_coverage("b", "b").alias("same")).first()
    assert row.far == pytest.approx(0, abs=1e-6) and row.same == pytest.approx(100)


def test_sky_view_of_tiles_equals_every_ray(spark):
    """Nodes in and at the edges of several tiles; missing pixels, pixels that are there twice, one nodata value."""
    rng = np.random.default_rng(3)
    high = np.round(rng.uniform(0, 30, (300, 290)) * (rng.random((300, 290)) < 0.2), 3)
    cells = [(i, j, float(high[i, j])) for i in range(300) for j in range(290) if (i * 7 + j) % 11]
    cells += [(5, 5, 25.0), (5, 5, 3.0), (6, 6, -99.0), (7, 7, None)]
    raster = spark.createDataFrame(cells, "row int, col int, h double")
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-20, 620, (60, 2)))] + [(60, 127.9, 60.0), (61, 128.0, 472.0)]
    nodes = spark.createDataFrame(points, "k int, x double, y double")
    got = {r.k: r.svf for r in zonal.sky_view_factor(nodes, raster, node_id="k", x0=0.0, y0=600.0, resolution=2.0, height="h", max_radius=30.0,
                                                     step=3.0, azimuths=12, nodata=-99.0, out="svf").collect()}
    tall = {}
    for i, j, h in cells:
        if h is not None and h != -99.0:
            tall[i, j] = max(h - 1.5, tall.get((i, j), 0.0))
    for k, x, y in points:
        total = 0.0
        for a in range(12):
            turn = a * 2 * math.pi / 12
            top = max(math.atan2(max(tall.get((math.floor((600 - (y + d * math.cos(turn))) / 2), math.floor((x + d * math.sin(turn)) / 2)), 0.0), 0.0), d)
                      for d in (3.0 * s for s in range(1, 11)))
            total += math.cos(top) ** 2
        assert got[k] == pytest.approx(total / 12, abs=1e-12)


def test_boxes_of_all_sizes_meet_once_in_few_rows(spark):
    rng = np.random.default_rng(2)
    sizes = [0.0, 0.5, 1.0, 3.0, 40.0, 1000.0]
    def boxes(n, seed):
        g = np.random.default_rng(seed)
        w = g.choice(sizes, (n, 2))
        low = np.round(g.uniform(-500, 500, (n, 2)), 1)
        return [(k, "g" if k % 3 else "h", float(a), float(b), float(a + u), float(b + v)) for k, ((a, b), (u, v)) in enumerate(zip(low, w))]
    left, right = boxes(120, 1), boxes(150, 2)
    schema = "{0} int, by string, {0}x0 double, {0}y0 double, {0}x1 double, {0}y1 double"
    l, r = (spark.createDataFrame(rows, schema.format(c)) for rows, c in ((left, "l"), (right, "r")))
    side = [[f"{c}{e}" for e in ("x0", "y0", "x1", "y1")] for c in "lr"]
    got = sorted((p.l, p.r) for p in zonal.overlapping_boxes(l, r, *side, 1.0, ["by"]).select("l", "r").collect())
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert got == want
    # A polygon over a million tiles is four rows for each level of the other side.
    huge = spark.createDataFrame([(0, 0.0, 0.0, 1000.0, 1000.0)], "l int, lx0 double, ly0 double, lx1 double, ly1 double")
    own = huge.withColumn("_own", zonal._level(side[0], 1.0))
    assert zonal._covered(own, side[0], 1.0, F.array(F.lit(0), F.lit(3))).count() <= 4
    small = spark.createDataFrame([(0, 5.0, 5.0, 6.0, 6.0)], "l int, lx0 double, ly0 double, lx1 double, ly1 double")
    assert zonal._covered(small.withColumn("_own", zonal._level(side[0], 1.0)), side[0], 1.0, F.array(F.lit(0), F.lit(10))).count() <= 8


def test_a_batch_that_breaks_off_neither_repeats_nor_loses_rows(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("v"), (F.col("id") % 10).alias("k"), F.when(F.col("id") == 99, None).otherwise(F.col("id") % 10).alias("key"))
    to = sinks.Landing(spark, str(tmp_path / "t"), ["key"])
    assert to.batches() == [] and to.missing(rows).count() == 99  # a null key never lands
    with pytest.raises(ValueError):
        to.read()
    to.land(rows.where("k < 3"), "a")
    to.write_rows(rows.where("k < 7"), "b")  # rows without keys: as if the run had died here
    assert to.read().count() == 30 and to.missing(rows).where("k < 3").count() == 0
    to.land(rows.where("k < 6"), "b")
    to.land(rows, "c")
    to.land(rows, "c")
    assert sorted(r.v for r in to.read().collect()) == [v for v in range(99)]
    assert to.batches() == ["a", "b", "c"] and to.missing(rows).isEmpty()
    with pytest.raises(ValueError):
        to.write_rows(rows, "a")


def test_sky_view_flat_and_walled(spark):
    nodes = spark.createDataFrame([(1, 50.0, 50.0)], "n int, x double, y double")
    flat = spark.range(10000).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"), F.lit(0.0).alias("h"))
    kw = dict(node_id="n", x0=0.0, y0=100.0, resolution=1.0, height="h")
    assert zonal.sky_view_factor(nodes, flat, **kw).first().sky_view_factor == 1.0
    wall = flat.withColumn("h", F.when(F.col("col") > 55, 30.0).otherwise(0.0))
    assert 0.3 < zonal.sky_view_factor(nodes, wall, **kw).first().sky_view_factor < 0.9


# Contract and catalogue.

def test_contract(spark):
    df = spark.range(1).select(F.lit(1).alias("b"), F.lit(2).alias("a"))
    assert contract.require_and_select(df, ["a", "b"], "t").columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing"):
        contract.require_and_select(df, ["a", "z"], "t")
    assert contract.collision_names(["NDVI", "LST_1km", "x"], ["NDVI", "LST_1km"]) == {"NDVI": "NDVI_1km", "LST_1km": "LST_1km", "x": "x"}
    have = ["node_id", "date", "LST_K", "LST_1km", "NDVI", "NDVI_1km", "DEM", "scene_id", "training_ready"]
    assert contract.purpose_columns(have, "general_download", ["NDVI"]) == ["node_id", "date", "training_ready", "NDVI", "NDVI_1km"]
    assert contract.purpose_columns(have, "lst_downscaling")[:6] == ["node_id", "date", "LST_K", "LST_1km", "training_ready", "NDVI"]
    wide = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, None, "x")], "LST_1km double, LST_K double, rain_3d double, rain_3d_log double, e double, s string")
    assert contract.numeric_features(wide) == ["LST_1km", "rain_3d_log"]


def test_catalogue_lookup(spark):
    cards = variable_cards()
    assert contract.stream_columns(cards, ["LST", "NDVI", "LST"], "sentinel3") == ["LST_1km", "NDVI"]
    df = spark.createDataFrame([("Presión Superficial",), ("nada",)], "v string")
    got = canonical_names(df, "v", alias_table(spark, cards)).orderBy(F.col("v").desc()).collect()
    assert [r.canonical for r in got] == [None, "surface_pressure"] or {r.v: r.canonical for r in got} == {
        "Presión Superficial": "surface_pressure", "nada": None}


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_nearest_site_prunes_queries_outside_the_sites(spark, metric):
    """Queries far outside the sites' extent cost a small part of all pairs."""
    from thermagrid.operators.near_space import nearest_work
    s = spark.range(2500).selectExpr("id AS sid", "37 + (id % 50) / 1000 AS sla", "-6 + floor(id / 50) / 1000 AS slo")
    q = spark.range(1000).selectExpr("id AS qid", "38 + (id % 40) / 100 AS la", "-4 + floor(id / 40) / 100 AS lo")
    how = dict(query_id=["qid"], query_uv=("la", "lo"), site_uv=("sla", "slo"), payload=["sid"], tie=["sid"], metric=metric)
    assert nearest_work(q, s, **how).first().evaluations < 2500 * 1000 / 8
    got = {r.qid: r.sid for r in nearest_site(q, s, **how).collect()}
    assert got == dict.fromkeys(range(1000), 49 + 50 * 49)


def test_footprints_are_summed_in_blocks(spark, monkeypatch):
    """Polygons meet cells as blocks of arrays: no row a pair, same sums as pair by pair."""
    monkeypatch.setattr(zonal, "TILE_POLYGONS", 7)
    monkeypatch.setattr(zonal, "TILE_CELLS", 3)
    monkeypatch.setattr(zonal, "PAIRS_AT_ONCE", 16)
    rng = random.Random(5)
    shapes = []
    for k in range(60):
        x, y, w = rng.uniform(0, 40), rng.uniform(0, 40), rng.choice([1.0, 4.0, 30.0])
        ring = [(x, y), (x + w, y + w / 3), (x + w / 2, y + w / 2), (x + w / 3, y + w)][:rng.choice([3, 4])]
        shapes.append(([Row(x=a, y=b) for a, b in (ring + ring[:1] if k % 2 else ring)],))
    polygons = spark.createDataFrame(shapes, "ring array<struct<x: double, y: double>>")
    cells = spark.createDataFrame([(k, float(k % 5 * 10), float(k // 5 * 10), float(k % 5 * 10 + 10), float(k // 5 * 10 + 10)) for k in range(25)]
                                  + [(99, 900.0, 900.0, 910.0, 910.0)], "cell int, x0 double, y0 double, x1 double, y1 double")
    box = ["x0", "y0", "x1", "y1"]
    found = zonal.footprint_by_cell(polygons, cells, ring="ring", cell_id=["cell"], cell_box=box, size=10.0)
    got = {r.cell: (r.footprint_m2, r.building_count) for r in found.collect()}
    bounds = geo.ring_bounds("ring")
    touch = (bounds["xmin"] <= F.col("x1")) & (bounds["xmax"] >= F.col("x0")) & (bounds["ymin"] <= F.col("y1")) & (bounds["ymax"] >= F.col("y0"))
    pairs = polygons.crossJoin(cells).where(touch).withColumn("a", geo.clipped_area("ring", *box)).where("a > 0")
    want = {r.cell: (r.s, r.n) for r in pairs.groupBy("cell").agg(F.sum("a").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    assert {k for k, v in got.items() if v[1]} == set(want) and 99 not in got
    for k, (area, count) in want.items():
        assert got[k][1] == count and got[k][0] == pytest.approx(area, rel=1e-9)
    assert "FlatMapCoGroupsInArrow" in plan_of(found)


def test_clipped_areas_equal_the_column_function(spark):
    """Sloped, upright and level edges, corners without number, boxes beside, across and around the polygon."""
    rng, nan = random.Random(3), float("nan")
    shapes = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (2.0, 5.0), (1.0, 3.0), (0.5, 2.0)],
              [(0.0, 0.0), (1.0, nan), (2.0, 2.0), (1.0, 3.0), (0.0, 3.0), (0.0, 1.0)]]
    boxes = [(-9.0, -9.0, 9.0, 9.0), (2.0, 2.0, 4.0, 4.0), (5.0, 0.0, 6.0, 1.0)] + [
        (x := rng.uniform(-3, 4), y := rng.uniform(-3, 4), x + rng.uniform(0.5, 5), y + rng.uniform(0.5, 5)) for _ in range(40)]
    pairs = [(i, j) for i in range(len(shapes)) for j in range(len(boxes))]
    got = zonal.clipped_areas(np.array(shapes).transpose(1, 2, 0), np.array([i for i, _ in pairs]), list(np.array(boxes).T), np.array([j for _, j in pairs]))
    table = spark.createDataFrame([(k, [Row(x=a, y=b) for a, b in shapes[i]], *boxes[j]) for k, (i, j) in enumerate(pairs)],
                                  "k int, ring array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double")
    want = {r.k: r.a for r in table.select("k", geo.clipped_area("ring", "x0", "y0", "x1", "y1").alias("a")).collect()}
    for k, (i, _) in enumerate(pairs):
        assert np.isnan(got[k]) if i == 2 else got[k] == pytest.approx(want[k], abs=1e-12)


def test_many_pairs_of_few_bytes_are_dealt_to_many_tasks(spark, monkeypatch):
    """800 polygons and 200 cells on 16 tiles are some kB, which would be put together in one task."""
    monkeypatch.setattr(zonal, "TASK_PAIRS", 100)
    i = F.col("id")
    x, y = (i * 37 % 40).cast("double"), (i * 11 % 40).cast("double")
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    polygons = spark.range(800).select(ring.alias("ring"))
    cells = spark.range(200).select(F.col("id").alias("cell"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
    found = zonal.footprint_by_cell(polygons, cells, ring="ring", cell_id=["cell"], cell_box=["x0", "y0", "x1", "y1"], size=10.0)
    assert found.collect() and "REPARTITION_BY_NUM" in plan_of(found)


def test_areas_are_dealt_out_before_their_nodes_are_made(spark, monkeypatch):
    areas = spark.range(60).coalesce(1).select(
        F.col("id").alias("area_id"), F.lit(37.0).alias("center_lat"), F.lit(-6.0).alias("center_lon"),
        F.when(F.col("id") != 7, 300.0).otherwise(10.0).alias("half_side_m"), F.lit(20.0).alias("rotation_deg"))
    monkeypatch.setattr(grid, "NODES_AT_ONCE", 500)
    nodes = grid.node_grid(areas, 100.0)
    tasks = nodes.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(t.n for t in tasks) == 59 * 36 and max(t.n for t in tasks) <= 20 * 36 and len(tasks) >= 4
    assert grid.node_grid(areas.where("area_id = 7"), 100.0).count() == 0


def test_rings_project_like_points_and_bind_each_step_once(spark):
    row = spark.range(1).select(F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ((-6.1, 37.2), (-2.9, -41.0), (0.5, 0.0))]).alias("ring"))
    row = row.withColumn("metres", geo.ring_to_utm("ring")).withColumn("back", geo.ring_to_degrees("metres"))
    got = row.select(F.inline(F.arrays_zip("ring", "metres", "back")))
    x, y = geo.utm_forward("ring.y", "ring.x")
    lat, lon = geo.utm_inverse("metres.x", "metres.y")
    for r in got.select("metres", "back", x.alias("x"), y.alias("y"), lat.alias("lat"), lon.alias("lon")).collect():
        assert tuple(r.metres) == (r.x, r.y) and tuple(r.back) == (r.lon, r.lat)
    assert str(geo.ring_to_utm("ring")).lower().count("sinh(") < 30 and str(geo.ring_to_degrees("ring")).lower().count("sinh(") < 30
