import json
import os
import time

import pytest
from pyspark.sql import functions as F

from thermagrid import schemas
from thermagrid.models.regressors import fit_regressor
from thermagrid.models.translation import (fit_bundle, load_bundle, out_of_fold, predict_bundle,
                                           prediction_rows, save_bundle, training_pairs)
from thermagrid.operators.contract import COARSE_COLUMNS
from thermagrid.operators.reports import quality_report
from thermagrid.plans import coarse as coarse_plan
from thermagrid.operators.splits import with_temporal_split
from thermagrid.plans.downscaling import (coincident_rows, feature_set_comparison, fused_area_rows,
                                          ranked_importances, residual_downscaling, training_rows)
from thermagrid.plans.multi_area import area_identities, combined_report, combined_rows
from thermagrid.plans.pairs import same_day_pairs
from thermagrid.plans.unified import panel_parts, unified_report, unified_table
from thermagrid.plans.weather import weather_tables
from thermagrid.sources import payloads, runs, sinks, tables


def frame(spark, rows, schema, days=(), times=()):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({**{d: F.to_date(d) for d in days},
                           **{t: F.to_timestamp(t) for t in times}})


def test_same_day_pairs(spark):
    fine = frame(spark, [
        ("n1", "2024-07-01", "2024-07-01 10:15:00", 37.40, -5.98, 300.0),
        ("n2", "2024-07-02", "2024-07-02 10:15:00", 37.41, -5.97, 301.0),
        ("n3", "2024-07-03", "2024-07-03 10:15:00", 37.40, -5.98, 302.0),
    ], "node_id string, date string, acquisition_dt_utc string, latitude double, longitude double, LST_K double",
        ["date"], ["acquisition_dt_utc"])
    coarse = frame(spark, [
        ("2024-07-01", "2024-07-01 10:15:00", 37.401, -5.981, 305.0),
        ("2024-07-01", "2024-07-01 10:15:00", 37.450, -5.900, 309.0),
        ("2024-07-01", "2024-07-01 20:00:00", 37.400, -5.980, 290.0),
        ("2024-07-02", "2024-07-02 10:15:00", 37.411, -5.971, 306.0),
        ("2024-07-03", "2024-07-03 13:00:00", 37.400, -5.980, 307.0),
    ], "date string, acquisition_dt_utc string, latitude double, longitude double, LST_1km double",
        ["date"], ["acquisition_dt_utc"])
    out = same_day_pairs(fine, coarse).orderBy("nodo_id").collect()
    assert [(r.nodo_id, r.lst_sentinel_3, r.hour_landsat, r.hour_sentinel) for r in out] == [
        ("n1", 305.0, 10.25, 10.25), ("n2", 306.0, 10.25, 10.25)]


@pytest.fixture(scope="module")
def unified_inputs(spark):
    nodes = spark.createDataFrame([
        ("z", "n1", 37.40, -5.98, 0.0, 0.0, 0, 0, 0.0, 0.0), ("z", "n2", 37.41, -5.97, 100.0, 0.0, 0, 1, 0.0, 1.0),
    ], "area_id string, node_id string, latitude double, longitude double, x double, y double, row int, col int, row_norm double, col_norm double")
    fine = frame(spark, [
        ("z", "n1", "2024-07-01", "2024-07-01 10:15:00", 300.0, 0.2, None),
        ("z", "n2", "2024-07-01", "2024-07-01 10:15:00", 301.0, None, 12.0),
    ], "area_id string, node_id string, date string, acquisition_dt_utc string, LST_K double, NDVI double, DEM double",
        ["date"], ["acquisition_dt_utc"])
    coarse = frame(spark, [
        ("z", "p1", "2024-07-02", "2024-07-02 10:30:00", 37.401, -5.981, 305.0, 0.30),
        ("z", "p2", "2024-07-02", "2024-07-02 10:30:00", 37.412, -5.968, 306.0, 0.40),
        ("y", "p9", "2024-07-01", "2024-07-01 10:30:00", 37.400, -5.980, 250.0, 0.90),
    ], "area_id string, node_id string, date string, acquisition_dt_utc string, latitude double, longitude double, LST_1km double, NDVI double",
        ["date"], ["acquisition_dt_utc"])
    return fine, coarse, nodes


def test_unified_table(unified_inputs):
    out = unified_table(*unified_inputs, tolerance_days=2)
    rows = {(r.node_id, str(r.date)): r for r in out.collect()}
    assert len(rows) == 4 and "NDVI_1km" in out.columns
    assert sum(r.training_ready for r in rows.values()) == 2
    a = rows["n1", "2024-07-01"]
    assert (a.sentinel3_pixel_id, a.s3_day_difference, a.LST_1km, a.NDVI_1km) == ("p1", 1, 305.0, 0.30)
    assert a.lst_time_difference_hours == pytest.approx(24.25)
    b = rows["n2", "2024-07-02"]
    assert (b.sentinel3_pixel_id, b.s3_day_difference, b.LST_K, b.DEM) == ("p2", 0, None, 12.0)
    assert rows["n2", "2024-07-01"].DEM == 12.0 and rows["n1", "2024-07-02"].DEM is None
    report = quality_report(out).first()
    assert report.status == "with_gaps" and report.training_ready_rows == 2
    assert "NDVI" in [m.column for m in report.missing_by_column]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_unified_general_purpose_and_tolerance(unified_inputs):
    out = unified_table(*unified_inputs, tolerance_days=0, purpose="general_download", requested=["NDVI"])
    assert {"NDVI", "NDVI_1km"} <= set(out.columns) and not {"LST_K", "LST_1km"} & set(out.columns)
    rows = out.where("date = '2024-07-01'").collect()
    assert len(rows) == 2 and all(r.sentinel3_pixel_id is None and r.s3_day_difference is None for r in rows)


def test_report_from_factors_equals_the_report_of_the_panel(unified_inputs):
    fine, coarse, nodes = unified_inputs
    gappy = coarse.withColumn("LST_1km", F.when(F.col("node_id") != "p2", F.col("LST_1km"))).unionByName(
        coarse.withColumn("date", F.date_add("date", 9)).withColumn("NDVI", F.lit(None).cast("double")))
    for how in ({}, {"tolerance_days": 0}, {"purpose": "general_download", "requested": ["NDVI"]}):
        want = quality_report(unified_table(fine, gappy, nodes, **how), purpose=how.get("purpose", "lst_downscaling")).first()
        assert unified_report(fine, gappy, nodes, **how).first() == want


def test_equal_layouts_are_searched_once(spark, unified_inputs):
    """Dates with the same places in another order share a search; another place is another layout."""
    fine, coarse, nodes = unified_inputs
    near = coarse.where("area_id = 'z'")
    many = near
    for k in range(1, 20):
        many = many.unionByName(near.withColumn("date", F.date_add("date", 10 * k)).orderBy(F.desc("node_id")))
    moved = near.withColumn("date", F.date_add("date", 300)).withColumn("latitude", F.col("latitude") + 0.01)
    parts = panel_parts(fine, many.unionByName(moved), nodes)
    assert parts.match.select("_layout").distinct().count() == 2 and parts.match.count() == 4
    out = unified_table(fine, many.unionByName(moved), nodes).where("sentinel3_pixel_id IS NOT NULL")
    assert out.groupBy("date").agg(F.collect_set("sentinel3_pixel_id").alias("p")).where("size(p) = 2").count() == 21


def test_weather_tables(spark):
    rows = [(h, c, 300.0 + c, 290.0, float(h), 0.001 * h, 1.0, 2.0) for h in range(1, 5) for c in (0, 2)]
    raw = spark.createDataFrame(rows, "h int, c int, t2m double, d2m double, ssrd double, tp double, u10 double, v10 double").withColumn(
        "era5_dt_utc", F.timestamp_seconds(F.col("h") * 3600))
    hourly, daily = weather_tables(raw, running_totals=True)
    got = hourly.orderBy("era5_dt_utc").collect()
    assert [r.t2m for r in got] == [301.0] * 4 and [r.ssrd for r in got] == [1.0] * 4
    assert daily.first().rain_1d == pytest.approx(4.0)
    _, increments = weather_tables(raw, running_totals=False)
    assert increments.first().rain_1d == pytest.approx(10.0)


def test_coarse_chain(spark):
    doc = {"data": [{"interval": {"from": "2024-07-01T00:00:00Z"}, "outputs": {"data": {"bands": {
        n: {"stats": {"mean": v}} for n, v in zip(payloads.COARSE_BANDS, (305.0, 2.0, 0.4, 0, 0, 0, 7.0))}}}},
        {"interval": {"from": "2024-07-02T00:00:00Z"}, "outputs": {"data": {"bands": {"LST": {"stats": {"mean": "NaN"}}}}}}]}
    docs = spark.createDataFrame([(0, 0, json.dumps(doc)), (0, 1, json.dumps(doc))], "row int, col int, doc string")
    stats = payloads.statistics_rows(docs, "doc", ["row", "col"])
    assert stats.count() == 2 and stats.first().LST == 305.0 and stats.first().CONFIDENCE == 7.0
    products = frame(spark, [("P1", "name", "2024-07-01", "2024-07-01 10:20:00")],
                     "Id string, Name string, date string, acquisition_dt_utc string", ["date"], ["acquisition_dt_utc"])
    cells = spark.createDataFrame([(0, 0, 37.4, -5.98), (0, 1, 37.4, -5.97)], "row int, col int, latitude double, longitude double")
    pixels = coarse_plan.valid_pixels(stats, products, cells)
    assert sorted(r.s3_pixel_id for r in pixels.collect()) == ["20240701T1020_0_0", "20240701T1020_0_1"]

    placed = pixels.withColumns({"area_id": F.lit("z"), "x": F.col("s3_col") * 1000.0, "y": F.lit(0.0)})
    nodes = spark.createDataFrame([("z", "a", 100.0, 0.0, 10.0), ("z", "b", 200.0, 0.0, 30.0), ("z", "c", 5000.0, 0.0, 50.0)],
                                  "area_id string, node_id string, x double, y double, DEM double")
    scenes = frame(spark, [("z", "a", "2024-06-29 11:00:00", 0.2), ("z", "b", "2024-06-29 11:00:00", 0.4),
                           ("z", "a", "2024-05-01 11:00:00", 0.9)],
                   "area_id string, node_id string, s2_source_dt_utc string, NDVI_S2 double", times=["s2_source_dt_utc"])
    out = coarse_plan.with_fine_covariates(placed, scenes, nodes, values=["NDVI_S2"], static_values=["DEM"],
                                           radius_m=750.0, max_days=20)
    got = {r.s3_col: (r.NDVI_S2_mean_1km, r.DEM_mean_1km, r.n_nodes_aggregated) for r in out.collect()}
    assert got[0] == (pytest.approx(0.3), 20.0, 2) and got[1] == (0.4, 30.0, 1)

    extra = {c: F.lit(1.0) for c in COARSE_COLUMNS if c not in (
        "node_id", "LST_1km", "row", "col", "NDVI", "DEM", "date", "acquisition_dt_utc", "latitude", "longitude", "row_norm", "col_norm")}
    final = coarse_plan.coarse_table(out.withColumns({**extra, "date": F.lit("2024-07-01")}))
    assert final.columns == [*COARSE_COLUMNS, "filled"]
    assert sorted((r.col, r.col_norm, r.row_norm) for r in final.collect()) == [(0, 0.0, 0.0), (1, 1.0, 0.0)]


def test_areas_never_mix_in_the_coarse_chain(spark):
    stats = spark.createDataFrame([(a, 0, 0, "2024-07-01", 300.0 + k, 1.0, None if a == "A" and k == 0 else 0.5, 0.0, 0.0, 0.0, 1.0)
                                   for k, a in enumerate("AB")],
                                  "area_id string, row int, col int, date string, LST double, LST_uncertainty double, NDVI double, "
                                  "CLOUD double, BAYES double, POINTING double, CONFIDENCE double").withColumn("date", F.to_date("date"))
    products = frame(spark, [(a, "P" + a, "n", "2024-07-01", f"2024-07-01 10:2{k}:00") for k, a in enumerate("AB")],
                     "area_id string, Id string, Name string, date string, acquisition_dt_utc string", ["date"], ["acquisition_dt_utc"])
    cells = spark.createDataFrame([("A", 0, 0, 37.0, -6.0), ("B", 0, 0, 40.0, -3.0)],
                                  "area_id string, row int, col int, latitude double, longitude double")
    got = {r.area_id: (r.LST_S3_K, r.s3_product_id) for r in coarse_plan.valid_pixels(stats, products, cells, by=["area_id"]).collect()}
    assert got == {"A": (300.0, "PA"), "B": (301.0, "PB")}

    rows = [("A", "1", "2024-07-01 10:00:00", 0, None), ("A", "2", "2024-07-09 10:00:00", 4, 0.9),
            ("B", "3", "2024-07-01 10:05:00", 8, 0.1), ("B", "4", "2024-07-02 10:05:00", 9, 0.2)]
    pixels = frame(spark, rows, "area_id string, node_id string, acquisition_dt_utc string, row int, NDVI double", times=["acquisition_dt_utc"])
    pixels = pixels.withColumns({c: F.lit(1.0) for c in COARSE_COLUMNS if c not in pixels.columns}).withColumns(
        {"date": F.to_date("acquisition_dt_utc"), "col": F.lit(0), "latitude": F.lit(37.0), "longitude": F.lit(-6.0)})
    final = coarse_plan.coarse_table(pixels, by=["area_id"])
    assert final.columns == ["area_id", *COARSE_COLUMNS, "filled"]
    got = {r.node_id: (r.NDVI, r.row_norm, r.filled) for r in final.collect()}
    assert got == {"1": (0.9, 0.0, 1), "2": (0.9, 1.0, 0), "3": (0.1, 0.0, 0), "4": (0.2, 1.0, 0)}
    nodes = spark.createDataFrame([("A", "n", 37.0, -6.0), ("B", "n", 37.0, -6.0)], "area_id string, node_id string, latitude double, longitude double")
    fine = spark.createDataFrame([("A", "n", "2024-07-01", "2024-07-01T10:00:00Z", 300.0), ("B", "n", "2024-07-01", "not a time", 301.0),
                                  ("B", "n", "not a day", None, 9.0)],
                                 "area_id string, node_id string, date string, acquisition_dt_utc string, LST_K double")
    out = unified_table(fine, final.drop("filled"), nodes)
    joined = {(r.area_id, str(r.date)): (r.LST_K, r.sentinel3_pixel_id) for r in out.collect()}
    assert joined[("A", "2024-07-01")] == (300.0, "1") and joined[("B", "2024-07-01")] == (301.0, "3")
    assert quality_report(out).first().nodes == 2


def test_payload_readers(spark):
    region = json.dumps([["id", "longitude", "latitude", "time", "t2m", "tp"], ["a", 0, 0, 1704067200000, 300, 0.001],
                         ["b", 0, 1, 1704067200000, 302, 0.003]])
    rows = payloads.headed_rows(spark.createDataFrame([(region,)], "doc string"), "doc", ["t2m", "tp"])
    mean = rows.groupBy("era5_dt_utc").agg(F.avg("t2m").alias("t"), F.avg("tp").alias("p")).collect()
    assert len(mean) == 1 and mean[0].t == 301.0 and mean[0].p == pytest.approx(0.002)
    answer = json.dumps([{"display_name": "Heliópolis, Sevilla", "lat": "37.3", "lon": "-5.9", "osm_id": 123, "type": "suburb",
                          "importance": None, "boundingbox": ["1", "2", "3", "4"], "geojson": {"type": "Polygon"}}])
    c = payloads.geocoder_candidates(spark.createDataFrame([(1, "heliopolis", answer)], "k int, q string, doc string"), "doc", ["k", "q"])
    best = payloads.best_candidate(c, "q", ["k"]).first()
    assert best.osm_id == 123 and best.bounding_box == [3.0, 1.0, 4.0, 2.0] and best.importance == 0.0
    ring = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]})
    got = spark.createDataFrame([(ring,)], "doc string").select(payloads.polygon_ring("doc").alias("r")).first().r
    assert len(got) == 5 and (got[2].x, got[2].y) == (2.0, 2.0)


def test_table_readers(spark, tmp_path):
    path = str(tmp_path / "nodes")
    spark.createDataFrame([("1", "37.4", "-5.98"), ("2", "37.41", "-5.97"), ("2", "37.41", "-5.97")],
                          "node_id string, lat string, lon string").write.option("header", True).option(
        "compression", "gzip").csv(path)
    nodes = tables.node_table(tables.read_csv(spark, path)).orderBy("node_id").collect()
    assert [(r.row, r.col, r.row_norm) for r in nodes] == [(1, 0, 1.0), (0, 1, 0.0)]
    typed = str(tmp_path / "typed")
    spark.createDataFrame([("7", "x", "2024-07-01T10:45Z")], "t2m string, tp string, era5_dt_utc string").write.option("header", True).csv(typed)
    r = tables.read_csv(spark, typed, schemas.HOURLY_WEATHER).first()
    assert r.t2m == 7.0 and r.tp is None and str(r.era5_dt_utc) == "2024-07-01 10:45:00"
    (tmp_path / "bad.csv").write_text("batch,error\na,b\nc,d\n")
    files = {"fine": str(tmp_path / "bad.csv"), "coarse": str(tmp_path / "absent.csv")}
    got = {r.source: r.errors for r in tables.error_rows(spark, files).collect()}
    assert got == {"fine": 2, "coarse": 0}
    for area in ("a1", "a2"):
        os.makedirs(tmp_path / "areas" / area)
        (tmp_path / "areas" / area / "part.csv").write_text("node_id,v\nn0,1\n")
    areas = spark.createDataFrame([("a1", "One"), ("a2", "Two")], "area_id string, area_name string")
    rows = tables.lineage_rows(spark, str(tmp_path / "areas"), areas)
    assert sorted((r.area_id, r.area_name, r.node_id) for r in rows.collect()) == [("a1", "One", "n0"), ("a2", "Two", "n0")]


def test_csv_columns_go_by_each_files_header(spark, tmp_path):
    (tmp_path / "a1").mkdir()
    (tmp_path / "a2").mkdir()
    (tmp_path / "a1" / "x.csv").write_text("LST_K,NDVI\n300.0,0.5\n")
    (tmp_path / "a2" / "x.csv").write_text("NDVI,LST_K,extra\n0.25,310.0,z\n")
    rows = tables.read_csv(spark, [str(tmp_path / "a1"), str(tmp_path / "a2")]).collect()
    assert {(r.LST_K, r.NDVI, r.extra) for r in rows} == {("300.0", "0.5", None), ("310.0", "0.25", "z")}
    areas = spark.createDataFrame([("a1", "One"), ("a2", "Two")], "area_id string, area_name string")
    got = {(r.area_name, r.LST_K) for r in tables.lineage_rows(spark, str(tmp_path), areas).collect()}
    assert got == {("One", "300.0"), ("Two", "310.0")}


def test_error_rows_are_csv_rows_of_the_full_path(spark, tmp_path):
    for name, text in (("p", 'm\n"two\nlines"\n'), ("q", "m\na\nb\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "errors.csv").write_text(text)
    (tmp_path / "bare.csv").write_text("")
    files = {"p": f"{tmp_path}/p/errors.csv", "q": f"{tmp_path}/q/errors.csv", "bare": f"{tmp_path}/bare.csv", "none": f"{tmp_path}/none.csv"}
    assert {r.source: r.errors for r in tables.error_rows(spark, files).collect()} == {"p": 1, "q": 2, "bare": 1, "none": 0}


def test_run_discovery(spark, tmp_path):
    def run(name, purpose, quality=True):
        folder = tmp_path / "runs" / name / "data_downloads"
        folder.mkdir(parents=True)
        (folder / "dataset_unificado.csv").write_text("a\n1\n")
        (folder / "metadata.json").write_text(json.dumps({"request": {"dataset_purpose": purpose}}))
        if quality:
            (folder / "informe_calidad.json").write_text("{}")
        time.sleep(0.02)
    run("r1", "lst_downscaling")
    run("r2", "lst_downscaling")
    run("r3", "general_download")
    run("r4", "lst_downscaling", quality=False)
    found = runs.latest_dataset(spark, str(tmp_path)).collect()
    assert len(found) == 1 and "/r2/" in found[0].path
    combined = tmp_path / "runs" / "m1" / "combined"
    combined.mkdir(parents=True)
    (combined / "metadata_multizona.json").write_text("{}")
    (combined / "dataset_multizona.csv").write_text("a\n")
    (combined / "informe_calidad_multizona.json").write_text(json.dumps({"status": "partial", "areas_completed": 1}))
    assert runs.latest_area_run(spark, str(tmp_path)).first().path.endswith("/m1")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "train"), ("b", 2, "test"), ("b", 3, "prediction_only")], "area_id string, v int, split string")
    p = lambda n: str(tmp_path / n)
    sinks.write_csv(df, p("csv"), ["v", "area_id"], order=["v"], gzip=True)
    assert spark.read.option("header", True).csv(p("csv")).columns == ["v", "area_id"]
    sinks.write_table(df, p("tab"), ["area_id"], ["v"])
    assert spark.read.parquet(p("tab")).count() == 3
    sinks.write_splits(df, p("split"), ["area_id", "v"])
    assert sorted(os.listdir(p("split")))[-2:] == ["split=test", "split=train"]
    sinks.write_per_area(df, p("area"))
    sinks.append_table(df, p("tab2"))
    sinks.append_table(df, p("tab2"))
    assert spark.read.parquet(p("tab2")).count() == 6
    sinks.write_report(df.agg(F.struct(F.count("*").alias("n")).alias("r")), p("rep"))
    assert json.loads(spark.read.text(p("rep")).first()[0]) == {"r": {"n": 3}}
    assert sinks.normalise_output(spark, p("csv"), p("backup"), lambda d: d.select("area_id")) == 1
    assert spark.read.option("header", True).csv(p("csv")).columns == ["area_id"]
    assert spark.read.option("header", True).csv(p("backup")).columns == ["v", "area_id"]
    wanted = spark.createDataFrame([("a",), ("c",)], "area_id string")
    assert [r.area_id for r in sinks.missing_partitions(spark, wanted, p("tab"), "area_id").collect()] == ["c"]


def test_multi_area(spark):
    areas = spark.createDataFrame([(1, "x", None, "Place"), (2, None, None, None)], "o int, area_id string, area_name string, place_name string")
    named = area_identities(areas, "o").orderBy("o").collect()
    assert [(r.area_id, r.area_name) for r in named] == [("x", "Place"), ("area_02", "area_02")]
    rows = spark.createDataFrame([("x", "n0", "d")], "area_id string, node_id string, date string")
    ids = area_identities(areas, "o")
    assert combined_rows(rows, ids).first().global_node_id == "x__n0"
    per_area, status = combined_report(rows, ids)
    assert status.first().status == "partial" and {r.area_id: r.rows for r in per_area.collect()} == {"x": 1, "area_02": 0}


# Models.

def residual_rows(spark):
    df = spark.range(600)
    i = F.col("id")
    return df.select(
        F.concat(F.lit("n"), (i % 20).cast("string")).alias("node_id"),
        F.date_add(F.lit("2022-06-01").cast("date"), ((i / 20).cast("int") * 37).cast("int")).alias("date"),
        (F.lit(300) + (i % 13)).cast("double").alias("LST_1km"), ((i * 7) % 11 / 10).alias("NDVI"), F.lit(0.4).alias("NDVI_1km"),
        ((i * 5) % 9 / 10).alias("NDBI"), F.lit(0.1).alias("NDBI_1km"), ((i * 3) % 7 / 10).alias("ALBEDO"), F.lit(0.2).alias("ALBEDO_1km"),
        F.lit(1.0).alias("aspect_ratio"), F.lit(0.5).alias("aspect_ratio_1km"), F.lit("lst_downscaling").alias("dataset_purpose"),
    ).withColumn("LST_K", F.col("LST_1km") + F.col("NDVI") * -4 + F.col("NDBI") * 3)


def test_residual_job(spark):
    rows = residual_rows(spark)
    run = residual_downscaling(rows, trees=15)
    m = {r.model: r for r in run.metrics.collect()}
    assert m["downscaled"].mae < 0.7 * m["coarse_baseline"].mae
    assert m["downscaled"].mae_improvement_percent > 0 and m["coarse_baseline"].mae_improvement_percent == 0
    with pytest.raises(ValueError):
        training_rows(rows.withColumn("dataset_purpose", F.lit("general_download")))
    with pytest.raises(ValueError):
        coincident_rows(rows.withColumn("s3_day_difference", F.lit(2)))


def test_residual_predictions_are_written_once(spark):
    run = residual_downscaling(residual_rows(spark), trees=2)
    assert run.predictions.inputFiles() and run.model.table.inputFiles()  # a row checkpoint has no files and computes its last stage twice
    assert run.predictions.count() == 600


def test_feature_sets_and_importances(spark):
    rows = residual_rows(spark).withColumn("Tair_C", F.lit(20.0))
    ready = with_temporal_split(coincident_rows(rows)).where("training_ready")
    table = feature_set_comparison(ready, trees=2).collect()
    assert {r.feature_set: r.n_features for r in table} == {
        "original": 6, "original_morphology": 6, "original_weather_calendar": 7, "original_all_context": 7}
    model = fit_regressor(ready, ["NDVI", "NDBI"], "Delta_LST", {"kind": "forest", "trees": 3, "depth": 4, "leaf": 2, "share": 1.0})
    ranked = ranked_importances(spark, model).collect()
    assert sum(r.importance for r in ranked) == pytest.approx(1.0) and ranked[0].importance >= ranked[1].importance


def test_weighted_ridge_equals_closed_form(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2)) * [3, 0.2] + [5, 1]
    y = x @ [1.5, -2.0] + rng.normal(size=80)
    w = rng.uniform(0.5, 2, 80)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w)], "a double, b double, y double, w double")
    fit = fit_regressor(df, ["a", "b"], "y", {"kind": "ridge", "alpha": 10.0}, weight="w")
    z = (x - x.mean(0)) / x.std(0)
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    beta = np.linalg.solve((zc * w[:, None]).T @ zc + 10.0 * np.eye(2), (zc * w[:, None]).T @ yc)
    assert list(fit.importances().values()) == pytest.approx(beta, abs=1e-9)


def translation_frame(spark):
    i = F.col("id")
    unified = spark.range(480).select(
        F.when(i % 2 == 0, "a").otherwise("b").alias("area_id"),
        F.concat(F.lit("n"), (i % 24).cast("string")).alias("node_id"),
        F.date_add(F.lit("2023-06-01").cast("date"), ((i / 24).cast("int") * 5).cast("int")).alias("date"),
        F.concat(F.lit("p"), (i % 4).cast("string")).alias("sentinel3_pixel_id"),
        (F.lit(300) + (i / 24).cast("int") % 6).cast("double").alias("LST_1km"),
        F.lit(0).alias("s3_day_difference"), F.lit(0.3).alias("lst_time_difference_hours"),
        (i % 9).cast("double").alias("DEM"), F.lit(0.1).alias("aspect_ratio"), F.lit(0).alias("has_buildings"),
        (i % 24).cast("int").alias("row"), F.lit(0).alias("col"))
    unified = unified.withColumn("LST_K", F.when(F.col("row") != 5, F.col("LST_1km") + 2 + F.col("DEM") * 0.5))
    scenes = unified.select(F.col("date").alias("s2_date"), "node_id", (F.col("row") / 30).alias("NDVI_S2_100m"),
                            F.lit(0.2).alias("NDBI_S2_100m"), F.lit(0.3).alias("ALBEDO_S2_100m")).dropDuplicates(["s2_date", "node_id"])
    return unified, scenes


def test_translation_bundle_keeps_pixel_means(spark, tmp_path):
    unified, scenes = translation_frame(spark)
    pairs = training_pairs(unified, scenes)
    assert pairs.agg(F.max(F.abs("DEM_delta"))).first()[0] > 0
    bundle = fit_bundle(pairs, "linear+ridge")
    out = predict_bundle(bundle, pairs)
    spread = out.groupBy("area_id", "date", "sentinel3_pixel_id").agg(
        F.avg(F.col("LST_predicted_K")).alias("m"), F.first("LST_1km").alias("c"))
    # One calibrated value per coarse value: the anomalies add nothing on average.
    assert spread.groupBy("c").agg((F.max("m") - F.min("m")).alias("d")).agg(F.max("d")).first()[0] < 1e-6
    save_bundle(bundle, spark, str(tmp_path / "m"), note="x")
    again = predict_bundle(load_bundle(spark, str(tmp_path / "m")), pairs)
    joined = out.join(again.select("area_id", "node_id", "date", F.col("LST_predicted_K").alias("q")), ["area_id", "node_id", "date"])
    assert joined.agg(F.max(F.abs(F.col("LST_predicted_K") - F.col("q")))).first()[0] < 1e-9

    predicted = predict_bundle(bundle, prediction_rows(unified, scenes))
    scopes = spark.createDataFrame([("a", "local")], "area_id string, scope string")
    fused = fused_area_rows(unified, predicted, scopes, model="linear+ridge")
    assert fused.count() == 480
    kinds = {r.target_source for r in fused.select("target_source").distinct().collect()}
    assert kinds == {"landsat_observed", "sentinel3_downscaled_local", "sentinel3_downscaled_general"} - (
        {"sentinel3_downscaled_local"} if fused.where("area_id = 'a' and LST_K is null").count() == 0 else set())


def test_out_of_fold_covers_every_row(spark):
    unified, scenes = translation_frame(spark)
    pairs = training_pairs(unified, scenes)
    out = out_of_fold(pairs, "bias+ridge", folds=3)
    assert out.count() == pairs.count() and out.where("LST_predicted_K is null").count() == 0


def test_geocoder_answers_are_dealt_out_before_they_unfold(spark, monkeypatch):
    docs = spark.range(40).coalesce(1).select("id", F.lit('[{"display_name": "a"}, {"display_name": "b"}]').alias("doc"))
    monkeypatch.setattr(payloads, "ANSWERS_AT_ONCE", 10)
    found = payloads.geocoder_candidates(docs, "doc", ["id"])
    tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(t.n for t in tasks) == 80 and len(tasks) == 4 and max(t.n for t in tasks) <= 26


def test_pixel_ids_of_a_day_do_not_part_equal_layouts(spark):
    """Ids that hold the time of the day (as the coarse chain makes them) made every date a layout and a search of its own.
    Rows and columns still settle equal distances, and the panel is never joined as a whole with what was observed."""
    fine = spark.createDataFrame([("z", "n1", "2024-07-04", 300.0), ("z", "n1", "2024-07-09", 301.0), ("z", "gone", "2024-07-05", 302.0)],
                                 "area_id string, node_id string, date string, LST_K double")
    rows = [("z", f"2024070{d}_{r}", f"2024-07-0{d}", -0.01 if r else 0.01, 0.0, 1 - r, 0, 300.0 + 10 * d + r) for d in range(1, 8) for r in (0, 1)]
    rows += [("z", "lost", "2024-07-03", None, -5.98, 9, 9, 1.0), ("z", "nan", "2024-07-04", float("nan"), -5.98, 9, 9, 2.0)]
    coarse = spark.createDataFrame(rows, "area_id string, node_id string, date string, latitude double, longitude double, row int, col int, LST_1km double")
    middle = spark.createDataFrame([("z", "mid", 0.0, 0.0), ("z", "nowhere", None, None), ("z", "n1", 0.002, 0.0)],
                                   "area_id string, node_id string, latitude double, longitude double")
    parts = panel_parts(fine, coarse, middle)
    assert parts.match.select("_layout").distinct().count() == 1 and parts.match.count() == 2
    out = unified_table(fine, coarse, middle, tolerance_days=1)
    found = {(r.node_id, r.date.day): r for r in out.collect()}
    assert len(found) == out.count() == 3 * 8
    for d in range(1, 8):
        assert found["mid", d].sentinel3_pixel_id == f"2024070{d}_1" and found["n1", d].sentinel3_pixel_id == f"2024070{d}_0"
        assert found["nowhere", d].sentinel3_pixel_id is None and found["nowhere", d].LST_K is None
    assert found["mid", 9].sentinel3_pixel_id is None
    assert {k: r.LST_K for k, r in found.items() if r.LST_K is not None} == {("n1", 4): 300.0, ("n1", 9): 301.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan.split("Exchange")[0]
