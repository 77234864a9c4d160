"""Writers: contract-checked CSV and Parquet, JSON reports, per-key outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import require_and_select


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, *,
              label: str = "output", order: Sequence[str | Column] = (), gzip: bool = False,
              mode: str = "overwrite") -> None:
    """CSV with header; the committer renames finished parts into place. A
    global order is applied only here, at the very end."""
    out = require_and_select(df, list(columns), label) if columns else df
    if order:
        out = out.orderBy(*order)
    writer = out.write.mode(mode).option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


#: Rows of a partition value that go to one writing task, about.
ROWS_PER_FILE = 1_000_000


def clustered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one key value together, in as many tasks as the fullest one needs.

    Adaptive execution splits a hot value (the rebalance hint), so neither every
    task writes every value nor one task a value that holds most rows.
    """
    return df.hint("rebalance", *[F.col(k) for k in keys])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                sort_within: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet between stages: clustered by partition values so that every
    partition folder gets few files, sorted inside them."""
    out = clustered(df, partition_by) if partition_by else df
    if sort_within:
        out = out.sortWithinPartitions(*partition_by, *sort_within)
    out.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*partition_by).parquet(path)


def write_report(row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A nested one-row table as JSON."""
    row.coalesce(1).write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, columns: Sequence[str], split: str = "split") -> None:
    """One folder per split; rows kept only for prediction are left out."""
    kept = df.where(F.col(split).isin("train", "validation", "test"))
    kept.select(*dict.fromkeys([*columns, split])).write.mode("overwrite").partitionBy(
        split).option("header", True).csv(path)


def write_per_area(df: DataFrame, path: str, area: str = "area_id", as_csv: bool = True) -> None:
    """One folder per area, few files in each."""
    writer = (clustered(df, [area]).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
              .partitionBy(area))
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def normalise_output(spark: SparkSession, path: str, backup: str, transform) -> int:
    """Rewrite an existing CSV output through ``transform``; the first original
    is kept under ``backup``.

    The new files are complete before the old ones move aside, and those go only
    when the new ones are in place; if that move fails the old ones come back.
    Returns the number of columns written.
    """
    current = spark.read.option("header", True).csv(path)
    if not _exists(spark, backup):
        current.write.option("header", True).csv(backup)
    result = transform(current)
    part, aside = path.rstrip("/") + ".part", path.rstrip("/") + ".old"
    result.write.mode("overwrite").option("header", True).csv(part)
    here, new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, part, aside))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):  # of an earlier run that broke off after the swap
        fs.delete(old, True)
    if not fs.rename(here, old):
        raise RuntimeError(f"could not move {path} aside")
    if not fs.rename(new, here):
        fs.rename(old, here)
        raise RuntimeError(f"could not move {part} to {path}")
    fs.delete(old, True)
    return len(result.columns)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none where it is absent."""
    if not _exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


class Landing:
    """A table that grows by batches and can be run again after any break.

    A batch is written in two phases: its rows to a folder of their own, then its
    keys to a manifest entry that appears under its name all at once (a rename).
    Rows count only when their manifest entry is there, so a run that breaks off
    between the two leaves nothing that is read, and its keys are still missing for
    the next run. What has landed is known from the manifest alone: looking for
    missing keys reads no data.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def batches(self) -> list[str]:
        """Names of the finished batches."""
        return [n for n in _listed(self.spark, f"{self.path}/manifest") if not n.startswith(("_", "."))]

    def landed_keys(self) -> DataFrame | None:
        """Distinct keys of the finished batches (None before the first)."""
        names = self.batches()
        if not names:
            return None
        return self.spark.read.parquet(*[f"{self.path}/manifest/{n}" for n in names]).select(*self.keys).distinct()

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose keys have not landed; rows with a null key never land."""
        wanted = wanted.dropna(subset=self.keys)
        landed = self.landed_keys()
        return wanted if landed is None else wanted.join(landed, self.keys, "left_anti")

    def write_rows(self, rows: DataFrame, batch: str) -> None:
        """Phase one; an unfinished attempt at the batch is replaced."""
        if batch in self.batches():
            raise ValueError(f"batch {batch!r} has landed already")
        clustered(rows, self.keys).write.mode("overwrite").parquet(f"{self.path}/data/{batch}")

    def finish(self, batch: str) -> None:
        """Phase two: the keys of the rows as they were written become visible at once."""
        rows = self.spark.read.parquet(f"{self.path}/data/{batch}")
        part = f"{self.path}/manifest/.{batch}.part"
        rows.select(*self.keys).distinct().write.mode("overwrite").parquet(part)
        here, there = (self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in (part, f"{self.path}/manifest/{batch}"))
        if not here.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(here, there):
            raise RuntimeError(f"could not finish batch {batch!r}")

    def land(self, rows: DataFrame, batch: str) -> None:
        """Both phases for the rows whose keys are missing; a batch that has landed is left alone."""
        if batch not in self.batches():
            self.write_rows(self.missing(rows), batch)
            self.finish(batch)

    def read(self) -> DataFrame:
        """Rows of all finished batches."""
        names = self.batches()
        if not names:
            raise ValueError(f"nothing has landed under {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in names])


def missing_partitions(spark: SparkSession, wanted: DataFrame, path: str, key: str) -> DataFrame:
    """Keys of ``wanted`` that have not been landed under ``path`` yet."""
    if not _exists(spark, path):
        return wanted
    return wanted.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
