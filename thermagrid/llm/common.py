"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermagrid.session import cut_lineage

# Words and their separators: the six ASCII white-space characters only.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


#: Folders of intermediate tables, by the ``scratch`` blocks that are open.
_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Columnar and compressed, so cheaper than a row checkpoint for wide tables.
    Readers survive lost executors: the files are in the folder all share. Inside
    a ``scratch`` block the files go when the block ends, unless ``keep``.
    """
    spark = df.sparkSession
    cut_lineage(spark.range(0))  # makes sure a checkpoint folder is set
    folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside go at the end: nothing that leaves the block may still
    read them (what leaves is kept, or a checkpoint)."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows to Python in the jobs that run inside: their
    size in bytes bounds what a task and its worker hold of wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over whole arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
