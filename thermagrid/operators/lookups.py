"""Equi-joins: node attributes, weather look-ups, panels, set operations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import floor_to_day, round_to_hour
from ..operators.contract import drop_present
from ..session import stored

SIZE_LIMIT_BYTES = 64 * 1024 * 1024
#: Bytes in memory for a byte of a compressed file, at most about.
GROWTH = 8


def small_enough(df: DataFrame, limit: int = SIZE_LIMIT_BYTES) -> bool:
    """Whether ``df`` surely stays under ``limit`` in memory.

    The optimizer's estimate starts from the bytes of the files, which grow
    several times when they are decoded (GROWTH covers that), and knows nothing
    of rows that an explode makes, so a plan with one never passes.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(step in plan.toString() for step in ("Generate ", "Expand ")):
        return False
    return int(str(plan.stats().sizeInBytes())) * GROWTH <= limit


def maybe_broadcast(df: DataFrame, limit: int = SIZE_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint for a table of checked size; a larger one joins by shuffle."""
    return F.broadcast(df) if small_enough(df, limit) else df


def fits(side: DataFrame, row_bytes: int | None = None, limit: int = SIZE_LIMIT_BYTES) -> bool:
    """Whether the counted rows of a table that is cheap to count stay under ``limit``.
    ``row_bytes`` is needed where rows hold arrays."""
    return side.count() * (row_bytes or side._jdf.schema().defaultSize()) <= limit


def counted_side(side: DataFrame, row_bytes: int | None = None, limit: int = SIZE_LIMIT_BYTES) -> DataFrame:
    """A broadcast hint for a table that is cheap to count, when its rows fit ``limit``: the many rows of
    the other side of a join then need no shuffle. A larger one joins by shuffle."""
    return F.broadcast(side) if fits(side, row_bytes, limit) else side


def written_side(df: DataFrame, row_bytes: int | None = None, limit: int = SIZE_LIMIT_BYTES) -> DataFrame:
    """A join side (means by group, day sizes) written once, then like ``counted_side``."""
    return counted_side(stored(df), row_bytes, limit)


def string_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def attach_attributes(df: DataFrame, attributes: DataFrame, keys: Sequence[str],
                      how: str = "left", drop: Iterable[str] = ()) -> DataFrame:
    """Static attributes per key; attribute columns win over stale copies."""
    keys = list(keys)
    side = drop_present(attributes, drop)
    stale = [c for c in df.columns if c in side.columns and c not in keys]
    return df.drop(*stale).join(maybe_broadcast(side) if how == "left" else side, keys, how)


def every_node(samples: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Right join: each node survives, with nulls when it was never sampled."""
    stale = [c for c in samples.columns if c in nodes.columns and c != key]
    return string_key(samples.drop(*stale), key).join(string_key(nodes, key), key, "right")


def attach_weather(df: DataFrame, time: str, hourly: DataFrame, daily: DataFrame,
                   hourly_columns: Sequence[str], daily_columns: Sequence[str] = (
                       "rain_1d", "rain_3d", "rain_3d_log", "is_rainy"),
                   by: Sequence[str] = ()) -> DataFrame:
    """Weather of the half-even rounded hour, and of the calendar day."""
    by = list(by)
    hour_side = hourly.select(*by, "era5_dt_utc", *[c for c in hourly_columns if c in hourly.columns])
    day_side = daily.select(*by, "day", *[c for c in daily_columns if c in daily.columns])
    return (
        df.withColumn("era5_dt_utc", round_to_hour(time))
        .join(maybe_broadcast(hour_side), [*by, "era5_dt_utc"], "left")
        .withColumn("day", floor_to_day(time))
        .join(maybe_broadcast(day_side), [*by, "day"], "left").drop("day")
    )


def days_beside(nodes: DataFrame, days: DataFrame, day: str, area: str, key: str = "node_id", spread: int | None = None) -> DataFrame:
    """``nodes`` with the days of their area as a sorted array ``_days`` (its length is bounded
    by the calendar). An area's nodes are spread over ``spread`` salts, as many as there are
    shuffle partitions unless given, so a huge area fills the cluster; the partition count is
    fixed because rows multiply when the days unfold."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread or partitions
    salted = nodes.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(spread)).cast("int"))
    copies = _day_arrays(days, day, area).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.repartition(partitions, area, "_salt").join(copies, [area, "_salt"], "inner").drop("_salt")


def _day_arrays(days: DataFrame, day: str, area: str) -> DataFrame:
    return (days.where(F.col(day).isNotNull()).groupBy(area)
            .agg(F.sort_array(F.collect_set(day)).alias("_days")))


def dense_panel(nodes: DataFrame, days: DataFrame, day: str, area: str,
                key: str = "node_id", spread: int | None = None) -> DataFrame:
    """Every node of an area on every reference day of that area: no cross join, no shuffle of
    the panel, as the days are unfolded beside the nodes."""
    return days_beside(nodes, days, day, area, key, spread).withColumn(day, F.explode("_days")).drop("_days")


def observed_panel(nodes: DataFrame, calendar: DataFrame, observed: DataFrame, carried: DataFrame, day: str, area: str,
                   key: str = "node_id", rows_a_task: int = 1_000_000) -> DataFrame:
    """Every node on every day of its area with the values ``observed`` there, and the columns
    of ``carried`` (one row a node).

    ``calendar`` has one row for each (area, day), among them all days of ``observed``, which has one row at
    most for each (area, key, day). Observations are gathered by node, at most the calendar's
    length of them; the days without one come from the difference of two arrays. Only
    observations are shuffled, the panel never is: its rows come out of the rows of nodes,
    about ``rows_a_task`` in a task.
    """
    values = [c for c in observed.columns if c not in (area, key, day)]
    type_of = {f.name: f.dataType for f in observed.schema.fields}
    size = nodes.groupBy(area).agg(F.count(F.lit(1)).alias("_n")).join(
        calendar.groupBy(area).agg(F.count(F.lit(1)).alias("_d")), area).agg(F.sum(F.col("_n") * F.col("_d"))).first()[0] or 0
    tasks = max(1, -(-size // rows_a_task))

    def by_node(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, area, key)

    def entry(date: Column, known: bool) -> Column:
        return F.struct(date.alias(day), *[(F.col(c) if known else F.lit(None).cast(type_of[c])).alias(c) for c in values])

    seen = by_node(observed).groupBy(area, key).agg(F.collect_list(entry(F.col(day), True)).alias("_seen"))
    beside = (by_node(nodes).join(seen.hint("merge"), [area, key], "left")
              .join(by_node(carried).hint("merge"), [area, key], "left"))
    if fits(calendar, 16):
        beside = beside.join(F.broadcast(_day_arrays(calendar, day, area)), area, "inner")
    else:
        beside = days_beside(beside, calendar, day, area, key)
    known = F.coalesce("_seen", F.array().cast(seen.schema["_seen"].dataType))
    gaps = F.array_except("_days", F.transform(known, lambda e: e[day]))
    rows = F.concat(known, F.transform(gaps, lambda d: entry(d, False)))
    # The array is a column of its own before it unfolds: what computes it would keep the unfolding out of compiled code.
    return (beside.withColumn("_rows", rows).drop("_seen", "_days").withColumn("_row", F.explode("_rows"))
            .drop("_rows").select("*", "_row.*").drop("_row"))


def match_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    suffixes: tuple[str, str]) -> DataFrame:
    """Full outer join; shared columns get suffixes; ``merge_state`` names the side."""
    keys = list(keys)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared}).withColumn("_l", F.lit(1))
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared}).withColumn("_r", F.lit(1))
    state = (F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("both"))
             .when(F.col("_l").isNotNull(), F.lit("left_only")).otherwise(F.lit("right_only")))
    return a.join(b, keys, "full").withColumn("merge_state", state).drop("_l", "_r")


def suffixed_inner(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   suffixes: tuple[str, str]) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    return left.withColumnsRenamed({c: c + suffixes[0] for c in shared}).join(
        right.withColumnsRenamed({c: c + suffixes[1] for c in shared}), list(keys), "inner")


def map_values(df: DataFrame, column: str, table: DataFrame, key: str, value: str, out: str,
               default: Column | None = None) -> DataFrame:
    """Dictionary look-up through a join, with a default for unknown keys."""
    side = table.select(F.col(key).alias(column), F.col(value).alias(out)).dropDuplicates([column])
    joined = df.join(maybe_broadcast(side), column, "left")
    return joined if default is None else joined.withColumn(out, F.coalesce(out, default))


def stack_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a table without a column gives NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def same_key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys only on the left, only on the right, and whether equal."""
    both = match_indicator(left.select(*keys).distinct(), right.select(*keys).distinct(),
                           keys, ("_l", "_r"))
    return both.agg(
        F.count_if(F.col("merge_state") == "left_only").alias("only_left"),
        F.count_if(F.col("merge_state") == "right_only").alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
