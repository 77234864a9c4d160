"""One verdict per batch of service calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diagnose_batches(calls: DataFrame, keys: Sequence[str], status: str = "status",
                     excerpt: str = "error_excerpt") -> DataFrame:
    """Flags over the whole batch, then the first that holds names it."""
    s = F.col(status).cast("string")

    def some(condition):
        return F.bool_or(F.coalesce(condition, F.lit(False)))

    flags = calls.groupBy(*keys).agg(
        some(F.contains(F.col(excerpt), F.lit("Invalid envelope CRS"))).alias("configuration"),
        some(s == "429").alias("rate_limit"), some(s == "TIMEOUT").alias("timeout"),
        some(s.isin("401", "403")).alias("authorization"),
        some(s.startswith("5")).alias("server"),
        F.bool_and(F.coalesce(s == "200", F.lit(False))).alias("operational"),
        F.count(F.lit(1)).alias("calls"))
    order = ["configuration", "rate_limit", "timeout", "authorization", "server", "operational"]
    verdict = F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in order], F.lit("mixed"))
    return flags.select(*keys, verdict.alias("diagnosis"), "calls")
