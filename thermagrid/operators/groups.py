"""Group-relative quantities, by aggregate and join back.

The aggregate combines partial results before the shuffle, and the join back
is split by adaptive execution when one group is huge; a window would collect
that group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import number
from .lookups import written_side


def with_group_means(df: DataFrame, keys: Sequence[str], columns: dict[str, str], written: bool = False) -> DataFrame:
    """Add the group mean of each column under its new name; rows with a null
    key get NULL. ``written``: the means are taken at once and written, so that few
    of them join without a shuffle of the rows."""
    means = df.groupBy(*keys).agg(*[F.avg(number(c)).alias(n) for c, n in columns.items()])
    return df.join(written_side(means) if written else means, list(keys), "left")


def within_group_deltas(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """column -> value minus its group mean, under the given new name."""
    helper = {c: f"_mean_{i}" for i, c in enumerate(columns)}
    joined = with_group_means(df, keys, helper)
    return joined.withColumns(
        {new: number(c) - F.col(helper[c]) for c, new in columns.items()}
    ).drop(*helper.values())


def recentred(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Zero mean per group."""
    return within_group_deltas(df, keys, {column: out})


def with_date_sizes(df: DataFrame, day: str = "date", out: str = "date_rows", by: Sequence[str] = ()) -> DataFrame:
    """Number of rows of the row's day (in its ``by`` group)."""
    sizes = df.groupBy(*by, day).agg(F.count(F.lit(1)).cast("double").alias(out))
    return df.join(written_side(sizes), [*by, day], "left")


def with_date_weights(df: DataFrame, day: str = "date", out: str = "weight",
                      size: str | None = None) -> DataFrame:
    """Weight of a row = mean over rows of their day's size / size of its day,
    so that a day with many rows does not dominate a fit. ``size`` names a
    column that already holds the day sizes."""
    sized = df if size else with_date_sizes(df, day, "_size")
    n = F.col(size or "_size")
    mean_size = sized.agg(F.avg(n)).scalar()
    return sized.withColumn(out, mean_size / n).drop("_size")


def first_static_value(df: DataFrame, key: str, columns: Sequence[str],
                       order: Sequence[str]) -> DataFrame:
    """Per key, the first non-null value of each static column."""
    order_key = F.struct(*order)
    return df.groupBy(key).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order_key)).alias(c) for c in columns])


def _beside_groups(df: DataFrame, values: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """``df`` with the aggregates ``values`` of its ``by`` group (of the whole table
    without one) in a struct column ``_group``; a null group has its own."""
    if not by:
        return df.withColumn("_group", df.agg(F.struct(*[v.alias(n) for n, v in values.items()])).scalar())
    keys = {f"_key{i}": F.col(c) for i, c in enumerate(by)}
    found = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.struct(*[v.alias(n) for n, v in values.items()]).alias("_group"))
    same = [F.col(k).eqNullSafe(c) for k, c in keys.items()]
    return df.join(found, reduce(lambda a, b: a & b, same)).drop(*keys)


def min_max_axes(df: DataFrame, columns: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """column -> (value - min) / (max - min) over the rows of its ``by`` group, under
    the new name; 0 when degenerate. One pass finds all the limits."""
    limits = _beside_groups(df, {f"{side}_{c}": fn(number(c)) for c in columns
                                 for side, fn in (("lo", F.min), ("hi", F.max))}, by)

    def axis(c: str) -> Column:
        lo, hi = F.col(f"_group.lo_{c}"), F.col(f"_group.hi_{c}")
        return F.when(lo.isNull() | (lo == hi), F.lit(0.0)).otherwise(
            (number(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))

    return limits.withColumns({out: axis(c) for c, out in columns.items()}).drop("_group")


def min_max_axis(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    return min_max_axes(df, {column: out}, by)


def index_over_max(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """index / max(index, 1) of its ``by`` group."""
    top = _beside_groups(df, {"top": F.greatest(F.max(column), F.lit(1))}, by)
    return top.withColumn(out, F.col(column) / F.col("_group.top")).drop("_group")


def train_statistics(df: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """One row: mean and sample deviation of every feature over the training
    rows; an unknown or zero deviation counts as one."""
    aggs = []
    for f in features:
        scale = F.stddev_samp(F.when(train, F.col(f)))
        aggs += [F.avg(F.when(train, F.col(f))).alias(f"mean_{f}"),
                 F.when(scale.isNull() | (scale == 0), F.lit(1.0)).otherwise(scale).alias(f"std_{f}")]
    return df.agg(*aggs)


def z_scores(df: DataFrame, features: Sequence[str], train: Column) -> DataFrame:
    """Standardise every row with statistics of the training rows only."""
    stats = train_statistics(df, features, train)
    row = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumns({f: (F.col(f) - row[f"mean_{f}"]) / row[f"std_{f}"] for f in features})
