"""Session settings the operators rely on, and the one lineage-cutting helper."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType


def local_session(app: str = "thermagrid", cores: str = "*", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A laptop / test session. On a cluster use the session it provides."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, set up if needed.

    The folder is the one in ``spark.checkpoint.dir``; a folder of our own is set
    only for a local master, where driver and executors are one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            context.setCheckpointDir(shared)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="thermagrid-ckpt-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def dealt_evenly(df: DataFrame, size: int, most: int) -> DataFrame:
    """``df`` over so many tasks that each unfolds about ``most`` of ``size`` rows. A step that
    unfolds rows keeps its input's partitions, whatever it makes of them."""
    return df.repartition(max(1, -(-size // most)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably in the shared folder so that later loop rounds
    neither recompute it nor depend on executors staying alive."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there: ``cut_lineage`` for tables
    of many rows. A row checkpoint computes its last stage twice, is not compressed and is
    always read with all its columns. The files stay as long as the folder does."""
    if any(isinstance(f.dataType, NullType) for f in df.schema.fields):  # Parquet has no such column
        return cut_lineage(df)
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
