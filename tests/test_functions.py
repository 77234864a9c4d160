import math

import pytest
from pyspark.sql import functions as F

from thermagrid.functions import calendar, core, geo, quality, spectral, text, weather


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_missing_and_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(core.number("v")).collect()] == [1.5, None, None, None]
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert core.clean_missing(df).agg(F.avg("v")).first()[0] == 1.0
    row = one(spark, a=core.clip(F.lit(None).cast("double"), 0.0), b=core.clip(F.lit(-3.0), 0.0))
    assert row.a is None and row.b == 0.0


def test_spectral_guards(spark):
    row = one(spark, a=spectral.normalized_difference(F.lit(0.5), F.lit(-0.5)),
              b=spectral.soil_adjusted_vegetation(F.lit(0.0), F.lit(-0.5)),
              c=spectral.surface_temperature(F.lit(40000)))
    assert row.a == 1.0 and row.b is None
    assert row.c == pytest.approx(285.7208)
    names = spectral.fine_output_names(["reflectance_red", "EVI", "cloud_distance", "reflectance_red_edge_1"])
    assert names == ["LST_K", "NDVI", "NDBI", "ALBEDO", "SR_red", "EVI", "cloud_distance_km"]
    assert spectral.covariate_output_names(["water_vapour", "surface_emissivity"]) == [
        "NDVI_S2", "NDBI_S2", "ALBEDO_S2", "water_vapour_cm_S2"]


def test_quality_cascade_order(spark):
    rows = [(300.0, 1.0, 0.0), (None, 1.0, 16384.0), (400.0, 1.0, 0.0), (300.0, 9.0, 16384.0),
            (300.0, 1.0, 16384.0), (300.0, 5.0, None), (float("inf"), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "l double, u double, c double")
    got = [r[0] for r in df.select(quality.coarse_status("l", "u", "c")).collect()]
    assert got == ["valid", "invalid", "invalid", "invalid", "cloudy", "valid", "invalid"]
    row = one(spark, a=quality.fine_pixel_clear(F.lit(8)), b=quality.fine_pixel_clear(F.lit(64)),
              c=quality.rounded_flags(F.lit(2.5)), d=quality.scene_class_kept(F.lit(9)))
    assert (row.a, row.b, row.c, row.d) == (False, True, 2, False)


def test_calendar(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    row = one(
        spark, a=calendar.round_to_hour(ts("2024-07-01 10:30:00")).cast("string"),
        b=calendar.round_to_hour(ts("2024-07-01 11:30:00")).cast("string"),
        c=calendar.interval_end_day(ts("2024-07-02 00:00:00")).cast("string"),
        d=calendar.decimal_hour(ts("2024-07-01 10:15:00")),
        e=calendar.parse_time(F.lit("2024-07-01T10:45Z")).cast("string"),
        f=calendar.parse_time(F.lit("nonsense")),
        g=calendar.pixel_id(ts("2024-07-01 10:05:00"), F.lit(3), F.lit(12)),
        h=calendar.season_features(F.lit("2024-12-31").cast("date"))["day_of_year"])
    assert (row.a, row.b) == ("2024-07-01 10:00:00", "2024-07-01 12:00:00")
    assert row.c == "2024-07-01" and row.d == 10.25 and row.e == "2024-07-01 10:45:00"
    assert row.f is None and row.g == "20240701T1005_3_12" and row.h == 366


def test_weather_formulas(spark):
    df = spark.createDataFrame([(303.15, 293.15, 3.0, 4.0, 3.6e6, 101325.0, 0.002, 0.3)],
                               "t2m double, d2m double, u10 double, v10 double, ssrd double, sp double, tp double, swvl2 double")
    r = weather.with_weather_outputs(df).first()
    assert r.Tair_C == pytest.approx(30) and r.wind_speed == 5 and r.Rsol_Wm2 == 1000
    assert r.surface_pressure_hPa == 1013.25 and r.precip_mm == 2 and r.soil_moisture_l2 == 0.3
    assert 0 < r.RH < 100 and r.VPD_kPa > 0
    assert r.wind_direction_deg == pytest.approx((180 + math.degrees(math.atan2(3, 4))) % 360)
    assert len(weather.ACCUMULATED) == 19
    assert weather.accumulated_short_names() == ["ssrd", "tp"]
    assert "temperature_2m" in weather.server_band_names()
    assert "total_precipitation_hourly" in weather.server_band_names()
    assert weather.weather_output_names(["surface_pressure"])[-1] == "surface_pressure_hPa"


def test_projection_and_areas(spark):
    df = spark.createDataFrame([(37.4035, -5.981)], "lat double, lon double")
    x, y = geo.utm_forward("lat", "lon")
    placed = df.withColumns({"x": x, "y": y})
    lat, lon = geo.utm_inverse("x", "y")
    r = placed.select("x", "y", lat.alias("a"), lon.alias("b")).first()
    assert r.a == pytest.approx(37.4035, abs=1e-9) and r.b == pytest.approx(-5.981, abs=1e-9)
    # On the central meridian easting is the false easting, scale 0.9996.
    m = one(spark, x=geo.utm_forward(F.lit(0.0), F.lit(-3.0))[0], n=geo.utm_forward(F.lit(0.0), F.lit(-3.0))[1])
    assert m.x == pytest.approx(500000) and m.n == pytest.approx(0, abs=1e-6)
    q = one(spark, h=geo.half_side_from_area(F.lit(2.0)),
            a=geo.ring_area(geo.rotated_square(F.lit(0.0), F.lit(0.0), F.lit(750.0), F.lit(32.0))))
    assert q.h == pytest.approx(707.10678, rel=1e-6) and q.a == pytest.approx(1500 ** 2)


def test_clipped_area_cases(spark):
    def ring(*points):
        return F.array(*[geo.point(F.lit(float(a)), F.lit(float(b))) for a, b in points])
    triangle = ring((0, 0), (10, 0), (0, 10))
    row = one(spark, whole=geo.clipped_area(triangle, 0.0, 0.0, 10.0, 10.0),
              part=geo.clipped_area(triangle, 0.0, 0.0, 5.0, 5.0),
              corner=geo.clipped_area(triangle, 4.0, 4.0, 8.0, 8.0),
              out=geo.clipped_area(triangle, 20.0, 20.0, 30.0, 30.0),
              reverse=geo.clipped_area(ring((0, 0), (0, 10), (10, 0)), 0.0, 0.0, 5.0, 5.0))
    assert row.whole == pytest.approx(50) and row.part == pytest.approx(25)
    assert row.corner == pytest.approx(2) and row.out == 0 and row.reverse == pytest.approx(25)


def test_text_operators(spark):
    row = one(
        spark, n=text.normalize_text(F.lit("  Índice\tde  VEGETACIÓN ½ ")), s=text.slug(F.lit("¡Heliópolis, Sevilla!")),
        e=text.slug(F.lit("¿?")), q=text.place_query(F.lit("barrio de Heliópolis, en sevilla")),
        t=text.tag_terms(F.lit("Quiero presión superficial y NDMI; no presionador ndmis"),
                         {"ndmi": "NDMI", "presion superficial": "surface_pressure", "presion": "p"}))
    assert row.n == "indice de vegetacion 12" and row.s == "heliopolis_sevilla" and row.e == "area"
    assert row.q == "Heliópolis, sevilla"
    assert row.t == ["p", "surface_pressure", "NDMI"]
    slots = text.request_slots(F.lit("Quiero LST y NDVI de Sevilla entre mayo y octubre de 2024 a 100 m"))
    got = one(spark, **slots)
    assert (got.start_date, got.end_date, got.resolution_m) == ("2024-05-01", "2024-10-31", 100.0)
    got = one(spark, **text.request_slots(F.lit("2 km² y mueve 1,5 km desde 2021-01-02 hasta 2021-03-04")))
    assert (got.area_km2, got.start_date, got.end_date) == (2.0, "2021-01-02", "2021-03-04")


@pytest.mark.parametrize("message, code", [
    ("Completa SH_CLIENT_ID y SH_CLIENT_SECRET en CREDENTIALS", "MISSING_SENTINEL_HUB_CREDENTIALS"),
    ("Completa cds_api_key", "MISSING_CDS_CREDENTIAL"), ("401 Unauthorized", "AUTHENTICATION_REJECTED"),
    ("403 Forbidden", "PERMISSION_DENIED"), ("429 Too Many Requests", "RATE_LIMIT"),
    ("ConnectionError: timed out", "NETWORK_ERROR"), ("No se encontraron adquisiciones", "NO_PRODUCTS"),
    ("ModuleNotFoundError: No module named rasterio", "MISSING_DEPENDENCY"), ("Kernel died", "KERNEL_DIED"),
    ("MemoryError: cannot allocate memory", "OUT_OF_MEMORY"), ("No space left on device", "DISK_FULL"),
    ("FileNotFoundError: nodos.csv", "FILE_NOT_FOUND"), ("EmptyDataError: no columns", "INVALID_OUTPUT"),
    ("something else", "UNCLASSIFIED_ERROR")])
def test_failure_classes(spark, message, code):
    assert one(spark, c=text.failure_class(F.lit(message))).c == code


def test_folding_knows_every_compatibility_form(spark):
    """Hard-coded forms, not the engine's own tables."""
    cases = {"𝐀①㎡x": "a1m2x", "ﬁn Ⅷ": "fin viii", "Ｆｕｌｌ": "full", "Ñandú": "nandu", "Ŀ½": "l12", "日本": "", "plain": "plain", "e\u0301t": "et"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", text.normalize_text("t").alias("n")).collect()} == cases


def test_aliases_of_any_edge_are_found(spark):
    df = spark.createDataFrame([("hay agua (mm) y lluvia",), ("agua mm",)], "t string")
    tags = text.tag_terms("t", {"agua (mm)": "water", "lluvia": "rain"})
    assert [r.g for r in df.select(tags.alias("g")).collect()] == [["water", "rain"], []]
