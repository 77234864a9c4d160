"""Find the newest finished run by the JSON files its tables sit next to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File names a finished run leaves behind.
DATASET_FILES = {"table": "dataset_unificado.csv", "metadata": "metadata.json",
                 "quality": "informe_calidad.json"}
AREA_FILES = {"table": "dataset_multizona.csv", "metadata": "metadata_multizona.json",
              "quality": "informe_calidad_multizona.json"}
# End of fixed values.


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    """(folder, name, modified) of files under a glob, without their content.
    A ``binaryFile`` listing with only metadata columns reads no bytes."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.select(
        F.regexp_replace("path", "/[^/]+$", "").alias("folder"), "path",
        F.col("modificationTime").alias("modified"))


def _documents(spark: SparkSession, pattern: str) -> DataFrame:
    rows = spark.read.option("wholetext", True).text(pattern)
    return rows.select(
        F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "").alias("folder"),
        F.col("_metadata.file_modification_time").alias("modified"), "value")


def latest_dataset(spark: SparkSession, root: str, *, files: dict[str, str] = DATASET_FILES,
                   purpose: str = "lst_downscaling") -> DataFrame:
    """The newest table whose metadata names the purpose and whose quality
    report exists: one row (path, modified), none when there is no such run."""
    at = f"{root}/runs/*/data_downloads/"
    wanted = F.get_json_object("value", "$.request.dataset_purpose") == purpose
    meta = _documents(spark, at + files["metadata"]).where(wanted).select("folder")
    done = _files(spark, at + files["quality"]).select("folder")
    found = (_files(spark, at + files["table"]).join(meta, "folder", "left_semi")
             .join(done, "folder", "left_semi"))
    return _newest(found, F.col("path"))


def latest_area_run(spark: SparkSession, root: str, *,
                    files: dict[str, str] = AREA_FILES) -> DataFrame:
    """The newest combined run that finished, fully or partly, some area."""
    at = f"{root}/runs/*/combined/"
    status = F.get_json_object("value", "$.status").isin("complete", "partial")
    areas = F.get_json_object("value", "$.areas_completed").try_cast("int") > 0
    done = _documents(spark, at + files["quality"]).where(status & areas).select("folder")
    tables = _files(spark, at + files["table"]).select("folder")
    found = (_files(spark, at + files["metadata"]).join(done, "folder", "left_semi")
             .join(tables, "folder", "left_semi"))
    return _newest(found, F.regexp_replace("folder", "/[^/]+$", ""))


def _newest(found: DataFrame, path: Column) -> DataFrame:
    order = F.struct("modified", "path")
    return found.agg(F.max_by(path, order).alias("path"),
                     F.max("modified").alias("modified")).where("path is not null")
