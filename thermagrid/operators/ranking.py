"""Ranking and keep-first without pulling a hot key into one task.

A window over a key that holds a third of the rows would sort them in one
task. Keep-first is therefore an aggregate (partial results are combined
before the shuffle), and running numbers are split into value ranges: number
inside (key, range), then add the sizes of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.core import and_all, number
from ..session import cut_lineage, stored
from .lookups import written_side


def nulls_last(order: Sequence[str | Column]) -> Column:
    """``order`` as one comparable value in which unknown values come last."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    return F.struct(*[part for c in columns for part in (c.isNull(), c)])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key: the first by ``order``, unknown values last. Null
    keys are one key."""
    order_key = nulls_last(order)
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(*keys).agg(F.min_by(row, order_key).alias("_row"))
        .select(*[F.col("_row")[c].alias(c) for c in df.columns])
    )


def first_value_per_column(df: DataFrame, keys: Sequence[str],
                           order: Sequence[str | Column]) -> DataFrame:
    """Per key and per column, the first non-null value by ``order`` (unknown order
    values last)."""
    order_key = nulls_last(order)
    values = [c for c in df.columns if c not in keys]
    return df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order_key)).alias(c) for c in values
    ]).select(*df.columns)


def _range_bounds(df: DataFrame, value: str, ranges: int) -> Column:
    """At most ``ranges - 1`` split points as a scalar subquery (approximate
    quantiles; they only balance the work, results do not depend on them)."""
    points = [i / ranges for i in range(1, ranges)]
    return df.agg(F.array_distinct(F.percentile_approx(
        value, F.array(*[F.lit(p) for p in points]), F.lit(10_000)))).scalar()


def running_number(df: DataFrame, keys: Sequence[str], value: str, *, ties: Sequence[str] = (),
                   out: str = "number", dense: bool = False, descending: bool = False,
                   ranges: int | None = None) -> DataFrame:
    """1-based row number (or dense rank) of numeric ``value`` within ``keys``.

    ``ranges`` (as many as shuffle partitions, 16 at least, unless given) splits
    every key into that many value ranges, so no window
    partition holds more than about 1/ranges of the distinct values. The
    range-size table has at most ``ranges`` rows per key.
    """
    ranges = ranges or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tagged = (df.withColumn("_bounds", _range_bounds(df, value, ranges))
              .withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(value))))
              .drop("_bounds"))
    direction = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*keys, "_range").orderBy(direction, *ties)
    number = F.dense_rank() if dense else F.row_number()
    numbered = tagged.withColumn("_inside", number.over(inside))
    size = F.count_distinct(value) if dense else F.count(F.lit(1))
    sizes = tagged.groupBy(*keys, "_range").agg(size.alias("_size"))
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*keys).orderBy(range_order).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return (
        numbered.join(offsets.drop("_size"), [*keys, "_range"], "inner")
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("int"))
        .drop("_range", "_inside", "_before")
    )


def axis_index(df: DataFrame, value: str, out: str, by: Sequence[str] = (),
               descending: bool = False) -> DataFrame:
    """Zero-based dense rank of a coordinate; ranks distinct values, joins back."""
    distinct = df.select(*by, value).where(F.col(value).isNotNull()).distinct()
    ranked = running_number(distinct, list(by), value, out=out, dense=True,
                            descending=descending)
    ranked = ranked.withColumn(out, F.col(out) - 1)
    return df.join(ranked, [*by, value], "left")


def grid_indices(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Row (north to south) and column (west to east) of lattice points."""
    return axis_index(axis_index(df, y, "row", by, descending=True), x, "col", by)


def numbered_slugs(df: DataFrame, slug: str, order: str, out: str = "slug_id") -> DataFrame:
    """``name``, ``name_2``, ``name_3`` ... in ``order``."""
    numbered = running_number(df, [slug], order, out="_n")
    return numbered.withColumn(out, F.when(F.col("_n") == 1, F.col(slug)).otherwise(
        F.concat_ws("_", F.col(slug), F.col("_n").cast("string")))).drop("_n")


def exact_medians(df: DataFrame, columns: Sequence[str], ranges: int = 256
                  ) -> dict[str, tuple[float, int]]:
    """(interpolated exact median, number of known values) of every column that
    has values, read back as a dictionary.

    Values are counted (partial counts combine before the shuffle), the counts
    are split into value ranges, and running totals are taken per range: no
    task sees all values of a column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
                                for c in columns]))
    counts = (df.select(pairs.alias("p")).select("p.*").where("v is not null")
              .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = counts.groupBy("c").agg(
        F.array_distinct(F.percentile_approx("v", points, F.lit(10_000))).alias("b"))
    tagged = counts.join(F.broadcast(bounds), "c").withColumn(  # one row per column
        "r", F.size(F.filter("b", lambda b: b <= F.col("v")))).drop("b")
    sizes = tagged.groupBy("c", "r").agg(F.sum("n").alias("s"))
    by_range = Window.partitionBy("c").orderBy("r")
    sizes = sizes.withColumn("before", F.sum("s").over(by_range) - F.col("s")).withColumn(
        "total", F.sum("s").over(Window.partitionBy("c")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    # Only the ranges that hold a middle rank are opened.
    middle = sizes.where((F.col("before") < high) & (F.col("before") + F.col("s") >= low))
    inside = Window.partitionBy("c", "r").orderBy("v")
    ranked = tagged.join(F.broadcast(middle), ["c", "r"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(inside))
    rows = ranked.groupBy("c").agg(
        F.min(F.when(F.col("upto") >= low, F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") >= high, F.col("v"))).alias("b"),
        F.max("total").alias("n")).collect()  # one row per column
    return {r["c"]: ((r["a"] + r["b"]) / 2.0, r["n"]) for r in rows}


def median_by(df: DataFrame, keys: Sequence[str], value: str, out: str,
              ranges: int = 256) -> DataFrame:
    """Interpolated exact median of ``value`` per key, as a table.

    Like ``exact_medians``: counted values, value ranges with running totals,
    and only the range that holds the middle is opened, so even a key with a
    third of all rows is spread over many tasks.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    tagged = (counts.withColumn("_b", _range_bounds(counts, "_v", ranges))
              .withColumn("_r", F.size(F.filter("_b", lambda b: b <= F.col("_v")))).drop("_b"))
    in_order = Window.partitionBy(*keys).orderBy("_r")
    sizes = tagged.groupBy(*keys, "_r").agg(F.sum("_n").alias("_s"))  # <= ranges rows per key
    sizes = (sizes.withColumn("_before", F.sum("_s").over(in_order) - F.col("_s"))
             .withColumn("_total", F.sum("_s").over(Window.partitionBy(*keys))))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    middle = sizes.where((F.col("_before") < high) & (F.col("_before") + F.col("_s") >= low))
    ranked = tagged.join(middle, [*keys, "_r"]).withColumn("_upto", F.col("_before") + F.sum(
        "_n").over(Window.partitionBy(*keys, "_r").orderBy("_v")))
    return ranked.groupBy(*keys).agg(((
        F.min(F.when(F.col("_upto") >= low, F.col("_v")))
        + F.min(F.when(F.col("_upto") >= high, F.col("_v")))) / 2.0).alias(out))


def _counted_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str], fold: str | None, ranges: int) -> DataFrame:
    """How often column ``_c`` has the value ``_v`` in each group, with its value range ``_r`` and its
    counts by fold (a map). Split points come from approximate quantiles of each column and
    only balance the work."""
    by = list(by)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).try_cast("double").alias("_v")) for i, c in enumerate(columns)]))
    fold_of = (F.col(fold) if fold else F.lit(0)).cast("int").alias("_f")
    counts = (df.select(*by, fold_of, pairs.alias("_p")).select(*by, "_f", "_p.*").where("_v IS NOT NULL AND NOT isnan(_v)")
              .groupBy(*by, "_c", "_v", "_f").agg(F.count(F.lit(1)).alias("_n"))
              .groupBy(*by, "_c", "_v").agg(F.sum("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_f", "_n"))).alias("_folds")))
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = counts.groupBy("_c").agg(F.array_distinct(F.percentile_approx("_v", points, F.lit(10_000))).alias("_b"))
    return counts.join(F.broadcast(bounds), "_c").withColumn(  # one row per column
        "_r", F.size(F.filter("_b", lambda b: b <= F.col("_v")))).drop("_b")


def bin_edges(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower edge (inside) and upper edge (outside) of the bin of every value. A bin is what doubles share
    in sign, exponent and ``bits`` of the mantissa; the last upper edge is NaN, which Spark orders above all."""
    drop, top = np.uint64(52 - bits), np.uint64(1 << 63)
    raw = (values + 0.0).view(np.uint64)  # one zero only
    key = np.where(raw & top, ~raw, raw | top) >> drop  # ascending with the value

    def edge(k: np.ndarray, beyond: float) -> np.ndarray:
        whole = k << drop
        x = np.where(whole & top, whole & ~top, ~whole).view(np.float64)
        return np.where(np.isnan(x), beyond, x)

    return edge(key, -np.inf), edge(key + np.uint64(1), np.nan)


def group_codes(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """(number of the row's group, the groups' keys) of a batch; null is a key like others."""
    code, groups = np.zeros(batch.num_rows, np.int64), [()]
    for k in keys:
        own = pc.dictionary_encode(batch.column(k), null_encoding="encode")
        values = own.dictionary.to_pylist()
        found, code = np.unique(code * len(values) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        groups = [(*groups[f // len(values)], values[f % len(values)]) for f in found.tolist()]
    return code, groups


def _same_bins(c: np.ndarray, g: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts ``n`` of equal (column, group, bin) added up."""
    order = np.lexsort((lo, c, g))
    c, g, lo, hi, n = c[order], g[order], lo[order], hi[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]))))
    return c[at], g[at], lo[at], hi[at], np.add.reduceat(n, at)


def _binned(df: DataFrame, keys: Sequence[str], columns: int, bits: int, most: int = 400_000) -> DataFrame:
    """(keys, ``_c``, ``_lo``, ``_hi``, ``_n``): known values of ``_d0``, ``_d1``, ... by bin, counted in
    each task first. A task holds about ``most`` counts, then it passes them on."""
    keys = list(keys)
    schema = StructType([*[df.schema[k] for k in keys], StructField("_c", IntegerType()), StructField("_lo", DoubleType()),
                         StructField("_hi", DoubleType()), StructField("_n", LongType())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}  # groups and their numbers
        parts: list[tuple] = []
        size, kinds = 0, []

        def out() -> pa.RecordBatch:
            c, g, lo, hi, n = _same_bins(*[np.concatenate(x) for x in zip(*parts)])
            names = list(held)
            found = [pa.array([names[i][k] for i in g.tolist()], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*found, pa.array(c, pa.int32()), pa.array(lo), pa.array(hi), pa.array(n)],
                                              names=[f.name for f in schema])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            code, groups = group_codes(batch, keys)
            numbers = np.array([held.setdefault(g, len(held)) for g in groups], np.int64)[code]
            for c in range(columns):
                d = batch.column(f"_d{c}").to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(d)
                if known.any():
                    lo, hi = bin_edges(d[known], bits)
                    parts.append(_same_bins(np.full(len(lo), c), numbers[known], lo, hi, np.ones(len(lo), np.int64)))
                    size += len(parts[-1][0])
            if size > 2 * most:
                parts = [_same_bins(*[np.concatenate(x) for x in zip(*parts)])]
                size = len(parts[0][0])
                if size > most:
                    yield out()
                    held, parts, size = {}, [], 0
        if parts:
            yield out()

    return (df.mapInArrow(counts, schema).groupBy(*keys, "_c", "_lo")
            .agg(F.max("_hi").alias("_hi"), F.sum("_n").alias("_n")))


def fold_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), fold: str | None = None,
                 ranges: int = 64) -> DataFrame:
    """Per group (``_all`` without ``by``): an array ``medians`` of (fold, medians of the columns over
    the rows outside that fold), NULL for a column without values there; one entry with a
    NULL fold where no fold column is given.

    Values less the mean of their group are counted by bin (``ranges`` for each power of two, or
    somewhat more) in the tasks that read them; running totals say which bins hold a middle rank, and only values of those are shuffled and ranked.
    All folds of a group are read off the same counts: a count outside a fold is the group's
    count less the fold's. The bins only bound the work; the medians are exact.
    """
    keys, every = list(by) or ["_all"], range(len(columns))
    df = (df if by else df.withColumn("_all", F.lit(0))).where(and_all(F.col(k).isNotNull() for k in by))
    plain = df.select(*keys, (F.col(fold) if fold else F.lit(None)).cast("int").alias("_f"), *[number(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    means = plain.groupBy(*keys).agg(*[F.avg(f"_v{i}").alias(f"_m{i}") for i in every])
    # A mean that is no finite number shifts nothing.
    shift = [F.when(F.abs(f"_m{i}") < F.lit(float("inf")), F.col(f"_m{i}")).otherwise(F.lit(0.0)).alias(f"_m{i}") for i in every]
    centred = plain.join(written_side(means.select(*keys, *shift)), keys).select(
        *keys, "_f", *[f"_v{i}" for i in every], *[(F.col(f"_v{i}") - F.col(f"_m{i}")).alias(f"_d{i}") for i in every])
    bins = stored(_binned(centred.select(*keys, "_f", *[f"_d{i}" for i in every]), [*keys, "_f"], len(columns), (ranges - 1).bit_length()))
    folds = stored(plain.select(*keys, "_f").distinct())  # a few a group
    # Rows outside each fold by bin: this decides which bins hold a middle rank.
    sizes = bins.groupBy(*keys, "_c", "_lo").agg(F.max("_hi").alias("_hi"), F.sum("_n").alias("_s")).join(folds, keys)
    if fold:
        own = bins.select(*keys, "_c", "_lo", "_f", F.col("_n").alias("_k"))
        sizes = sizes.join(own, [*keys, "_c", "_lo", "_f"], "left").withColumn("_s", F.col("_s") - F.coalesce("_k", F.lit(0))).drop("_k")
    in_order = Window.partitionBy(*keys, "_c", "_f").orderBy("_lo")
    ranged = (sizes.withColumn("_before", F.sum("_s").over(in_order) - F.col("_s"))
              .withColumn("_total", F.sum("_s").over(Window.partitionBy(*keys, "_c", "_f"))).where("_total > 0"))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    middle = stored(ranged.where((F.col("_before") < high) & (F.col("_before") + F.col("_s") >= low)).drop("_s"))
    # Values between the outermost open bins of their group and column, counted by fold.
    spans = middle.groupBy(*keys).agg(*[f(F.when(F.col("_c") == i, F.col(side))).alias(f"{side}{i}")
                                        for i in every for f, side in ((F.min, "_lo"), (F.max, "_hi"))])

    def inside(d: Column, lo: Column, hi: Column) -> Column:
        return (d >= lo) & (d < hi)

    open_ = [inside(F.col(f"_d{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in every]
    spread = centred.join(written_side(spans), keys).where(reduce(or_, open_)).select(*keys, "_f", F.explode(F.array(*[
        F.when(o, F.struct(F.lit(i).alias("_c"), F.col(f"_v{i}").alias("_v"), F.col(f"_d{i}").alias("_d"))) for i, o in enumerate(open_)])).alias("_p"))
    counts = (spread.where("_p IS NOT NULL").select(*keys, "_f", "_p.*").groupBy(*keys, "_c", "_v", "_d", "_f").agg(F.count(F.lit(1)).alias("_n"))
              .groupBy(*keys, "_c", "_v", "_d").agg(F.sum("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct(
                  F.coalesce("_f", F.lit(-1)).alias("_f"), "_n"))).alias("_folds")))
    own_count = F.when(F.col("_f").isNull(), 0).otherwise(F.coalesce(F.try_element_at("_folds", F.coalesce("_f", F.lit(-1))), F.lit(0)))
    met = counts.join(written_side(middle), [*keys, "_c"]).where(inside(F.col("_d"), F.col("_lo"), F.col("_hi"))).withColumn("_k", F.col("_n") - own_count)
    ranked = met.where("_k > 0").withColumn("_upto", F.col("_before") + F.sum("_k").over(
        Window.partitionBy(*keys, "_c", "_f", "_lo").orderBy("_v")))
    found = ranked.groupBy(*keys, "_c", "_f").agg(((
        F.min(F.when(F.col("_upto") >= low, F.col("_v"))) + F.min(F.when(F.col("_upto") >= high, F.col("_v")))) / 2.0).alias("_m"))
    by_fold = found.groupBy(*keys, "_f").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_m"))).alias("_m"))
    other = {k: f"_{k}_" for k in [*keys, "_f"]}
    same = and_all([F.col(k) == F.col(other[k]) for k in keys] + [F.col("_f").eqNullSafe(F.col(other["_f"]))])
    whole = folds.join(by_fold.withColumnsRenamed(other), same, "left")
    values = F.array(*[F.try_element_at("_m", F.lit(i)) for i in every])
    return whole.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_f").alias("fold"), values.alias("medians"))).alias("medians"))


def quantile_cuts(df: DataFrame, columns: Sequence[str], bins: int, ranges: int = 256) -> list[list[float]]:
    """For every column at most ``bins`` - 1 cuts: all its values but the largest if it has no more
    than ``bins``, else the exact values at equal shares of its known rows. Bounded by ``bins``
    values a column; no task sees all values of one."""
    tagged = cut_lineage(_counted_ranges(df, columns, [], None, ranges).select(*[F.col(f"_{c}").alias(c) for c in "cvnr"]))
    sizes = tagged.groupBy("c", "r").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("d"))
    by_range = Window.partitionBy("c").orderBy("r")
    sizes = (sizes.withColumn("before", F.sum("s").over(by_range) - F.col("s"))
             .withColumn("total", F.sum("s").over(Window.partitionBy("c"))).withColumn("d", F.sum("d").over(Window.partitionBy("c"))))
    sizes = cut_lineage(sizes)
    few = tagged.join(F.broadcast(sizes.where(F.col("d") <= bins).select("c").distinct()), "c").select("c", "v")
    ranks = F.explode(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.ceil(k * F.col("total") / F.lit(float(bins)))))
    wanted = (sizes.where(F.col("d") > bins).select("c", "r", "before", "s", ranks.alias("rank"))
              .where("before < rank AND rank <= before + s"))  # at most bins rows a column
    upto = F.sum("n").over(Window.partitionBy("c", "r").orderBy("v"))
    many = (tagged.withColumn("upto", upto).join(F.broadcast(wanted), ["c", "r"])
            .where("before + upto >= rank AND before + upto - n < rank").select("c", "v"))
    got: dict[int, set[float]] = {i: set() for i in range(len(columns))}
    for row in few.unionByName(many).distinct().collect():
        got[row["c"]].add(row["v"])
    top = {r["c"]: r["m"] for r in tagged.groupBy("c").agg(F.max("v").alias("m")).collect()}
    return [sorted(v for v in got[i] if v < top[i]) for i in range(len(columns))]
