"""Explicit schemas of the landed tables (no inference at the scans)."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(),
             "l": T.LongType(), "t": T.TimestampType(), "D": T.DateType(), "b": T.BooleanType()}
    fields = [part.split(":") for part in spec.split()]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


NODES = _struct("node_id:s row:i col:i x:d y:d latitude:d longitude:d row_norm:d col_norm:d")
HOURLY_WEATHER = _struct("era5_dt_utc:t latitude:d longitude:d t2m:d d2m:d u10:d v10:d ssrd:d tp:d")
DAILY_WEATHER = _struct("day:D rain_1d:d rain_3d:d rain_3d_log:d is_rainy:i")
FINE_SCENES = _struct("node_id:s scene_id:s time_start:l date:s LST_K:d NDVI:d NDBI:d ALBEDO:d")
COVARIATE_SCENES = _struct("node_id:s s2_source_time_start:l NDVI_S2:d NDBI_S2:d ALBEDO_S2:d")
EDGES = _struct("source_node_id:s target_node_id:s distance_m:d")
PAIRS = _struct("nodo_id:s date:s lst_landsat:d lst_sentinel_3:d hour_landsat:d hour_sentinel:d")
AREAS = _struct("area_id:s center_lat:d center_lon:d half_side_m:d rotation_deg:d")
PRODUCTS = _struct("Id:s Name:s acquisition_dt_utc:t date:D hour:i cloud_cover:d")
PIXELS = _struct("row:i col:i LST:d LST_uncertainty:d NDVI:d CLOUD:d BAYES:d POINTING:d "
                 "CONFIDENCE:d dataMask:d")

# Nested payloads.
CATALOGUE_JSON = ("struct<features:array<struct<id:string,properties:map<string,string>>>>")
STATISTICS_JSON = (
    "struct<data:array<struct<interval:struct<`from`:string>,outputs:struct<data:struct<"
    "bands:map<string,struct<stats:struct<mean:string>>>>>>>>")
GEOCODER_JSON = (
    "array<struct<display_name:string,lat:string,lon:string,osm_type:string,osm_id:string,"
    "category:string,type:string,importance:string,boundingbox:array<string>,"
    "geojson:struct<type:string>>>")
FEATURES_JSON = (
    "struct<features:array<struct<properties:map<string,string>,"
    "geometry:struct<type:string,coordinates:array<double>>>>>")
HEADED_ROWS_JSON = "array<array<string>>"
EDITED_SQUARE_JSON = "struct<type:string,coordinates:array<array<array<double>>>>"
