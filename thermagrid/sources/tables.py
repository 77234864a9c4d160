"""Readers of landed tables (CSV, gzip CSV, Parquet) with explicit types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import millis_to_time, parse_time
from ..functions.core import clean_missing, first_present, number
from ..functions.geo import utm_forward
from ..operators.contract import drop_present, require_columns
from ..operators.groups import index_over_max
from ..operators.ranking import grid_indices, keep_first


def _files_by_header(spark: SparkSession, paths: list[str], nested: bool) -> dict[str, list[str]]:
    """Header line -> its files. Only one line of each file reaches the driver."""
    lines = (spark.read.option("recursiveFileLookup", nested).text(paths)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("place")).where("start = 0"))
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    files: dict[str, list[str]] = {}
    for row in first.collect():
        files.setdefault(row.header, []).append(row.file)
    return files


def read_by_name(spark: SparkSession, path: str | Sequence[str], *, nested: bool = False,
                 file: str | None = None) -> DataFrame:
    """CSV as text columns, matched by the names in each file's own header.

    The CSV reader takes the header of one file for all files it is given, so
    files are read by header and united by name; a column that a file lacks is
    unknown there. ``file`` names a column for the path of the row's file. Gzip
    files are read directly, one split per file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    groups = _files_by_header(spark, paths, nested)
    if not groups:
        return spark.read.option("header", True).option("recursiveFileLookup", nested).csv(paths)
    out = None
    for _, files in sorted(groups.items()):
        rows = spark.read.option("header", True).csv(sorted(files))
        if file:
            rows = rows.withColumn(file, F.col("_metadata.file_path"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str | Sequence[str],
             schema: T.StructType | None = None) -> DataFrame:
    """CSV with headers (``read_by_name``). With a schema a file may order or omit
    columns and texts are cast, what cannot be cast is unknown; without one every
    column stays text."""
    text = read_by_name(spark, path)
    if schema is None:
        return text
    casts = []
    for field in schema.fields:
        if field.name not in text.columns:
            continue
        if isinstance(field.dataType, T.TimestampType):
            c = parse_time(field.name)
        elif isinstance(field.dataType, T.DoubleType):
            c = number(field.name)
        else:
            c = F.col(field.name).try_cast(field.dataType)
        casts.append(c.alias(field.name))
    return text.select(*casts)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet with NaN turned into NULL."""
    paths = [path] if isinstance(path, str) else list(path)
    return clean_missing(spark.read.parquet(*paths))


def node_table(raw: DataFrame, zone: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Nodes from ``node_id`` and either name of the coordinates; projected
    position and, when absent, row and column by coordinate rank."""
    require_columns(raw, ["node_id"], "node table")
    order = [c for c in ("row", "col") if c in raw.columns]
    base = raw.select(
        *by, F.col("node_id").cast("string").alias("node_id"),
        number(first_present(raw, ["lat", "latitude"])).alias("latitude"),
        number(first_present(raw, ["lon", "longitude"])).alias("longitude"),
        *[F.col(c).try_cast("int").alias(c) for c in order])
    unique = keep_first(base, [*by, "node_id"], [*order, "latitude", "longitude"])
    x, y = utm_forward("latitude", "longitude", zone)
    placed = unique.withColumns({"x": x, "y": y})
    if len(order) < 2:
        placed = grid_indices(placed.drop(*order), by=by)
    return index_over_max(index_over_max(placed, "row", "row_norm", by), "col", "col_norm", by)


def covariate_scenes(raw: DataFrame, values: Sequence[str] = ("NDVI_S2", "NDBI_S2", "ALBEDO_S2"),
                     suffix: str = "_100m", by: Sequence[str] = ()) -> DataFrame:
    """Scene rows to one row per (date, node): overlapping scenes averaged."""
    rows = raw.select(
        *by, F.col("node_id").cast("string").alias("node_id"),
        F.to_date(millis_to_time("s2_source_time_start")).alias("s2_date"),
        *[number(v).alias(v + suffix) for v in values])
    return rows.where("s2_date is not null").groupBy(*by, "s2_date", "node_id").agg(
        *[F.avg(v + suffix).alias(v + suffix) for v in values])


def fine_scenes(raw: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Fine scene samples: required columns, ids as text, epoch to time."""
    require_columns(raw, ["node_id", "scene_id", "time_start", "date", *bands], "fine scenes")
    return drop_present(raw, ["geo", ".geo"]).withColumns({
        "node_id": F.col("node_id").cast("string"),
        "acquisition_dt_utc": millis_to_time("time_start")})


def gridded_weather(raw: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Long (time, lat, lon, fields) rows, whatever the time column is called."""
    time = first_present(raw, ["valid_time", "time", "datetime", "date"])
    place = [c for c in ("latitude", "longitude") if c in raw.columns]
    require_columns(raw, fields, "gridded weather")
    return raw.select(parse_time(time).alias("era5_dt_utc"), *place,
                      *[number(f).alias(f) for f in fields])


def wide_hours(raw: DataFrame, keys: Sequence[str], fields: Sequence[str],
               start: Column, pattern: str = r"^h(\d+)_(.+)$") -> DataFrame:
    """Columns ``hNNN_field`` to one row per key and hour after ``start``."""
    wide = [c for c in raw.columns if c.startswith("h") and "_" in c and c[1:c.index("_")].isdigit()]
    long = raw.select(*keys, start.cast("timestamp").alias("_start"), *wide).unpivot(
        [*keys, "_start"], wide, "_name", "_value")
    hour = F.regexp_extract("_name", pattern, 1).cast("int")
    field = F.regexp_extract("_name", pattern, 2)
    rows = long.withColumns({"_hour": hour, "_field": field})
    return rows.groupBy(*keys, "_start", "_hour").agg(*[
        F.max(F.when(F.col("_field") == f, F.col("_value"))).alias(f) for f in fields
    ]).withColumn("datetime_utc", F.timestamp_micros(
        F.unix_micros("_start") + F.col("_hour") * F.lit(3_600_000_000))).drop("_start", "_hour")


def lineage_rows(spark: SparkSession, folder: str, areas: DataFrame) -> DataFrame:
    """Rows of ``folder/<area_id>/*.csv`` with their area's id and name: scans by
    header whose splits stand in for chunked reading."""
    rows = read_by_name(spark, folder, nested=True, file="_file")
    tagged = rows.withColumn("area_id", F.element_at(F.split("_file", "/"), -2)).drop("_file")
    return tagged.join(areas.select("area_id", "area_name"), "area_id", "left")


def error_rows(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """CSV rows per source in the error files, by their full path; an absent file
    counts 0, one without a header 1."""
    conf = spark._jsc.hadoopConfiguration()
    listed = []
    for source, path in files.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        there = fs.exists(target)
        bare = there and fs.getFileStatus(target).getLen() == 0
        listed.append((source, fs.makeQualified(target).toString() if there else None, int(bare)))
    sources = spark.createDataFrame(listed, "source string, file string, bare int")
    present = [file for _, file, bare in listed if file and not bare]
    if not present:
        return sources.select("source", F.col("bare").cast("long").alias("errors"))
    rows = spark.read.option("header", True).option("multiLine", True).csv(present)
    counts = rows.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    plain = F.regexp_replace("path", "^file:/+", "file:/")  # one or three slashes, as readers differ
    return (sources.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
            .join(counts.withColumn("file", plain), "file", "left")
            .select("source", F.coalesce("n", "bare").cast("long").alias("errors")))
