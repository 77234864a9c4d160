"""One-pass reports: counters, null profiles, agreement and error metrics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import complete_case, number
from .contract import IDENTITY_COLUMNS, MATCH_COLUMNS, QUALITY_COLUMNS
from .ranking import median_by


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows that have both; NULL when either is
    constant (the built-in aggregate raises there in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def group_coverage(df: DataFrame, keys: Sequence[str], day: str, medians: Sequence[str] = (),
                   means: Sequence[str] = ()) -> DataFrame:
    """Size, distinct dates, first and last year, medians and means per group."""
    keys = list(keys)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(day).alias("dates"),
        F.min(F.year(day)).alias("first_year"), F.max(F.year(day)).alias("last_year"),
        *[F.avg(c).alias(f"mean_{c}") for c in means])
    for c in medians:
        out = out.join(median_by(df, keys, c, f"median_{c}"), keys, "left")
    return out


def day_coverage(df: DataFrame, day: str, values: Sequence[str], out: str = "coverage",
                 by: Sequence[str] = ()) -> DataFrame:
    """Share of complete rows per day."""
    return df.where(F.col(day).isNotNull()).groupBy(*by, day).agg(
        F.avg(complete_case(values).cast("double")).alias(out))


def source_counters(df: DataFrame, catalogue: DataFrame, *, day: str, status: str,
                    cells: int) -> DataFrame:
    """Counters of a coarse source: dates and cell-days by quality status.

    ``catalogue`` lists the expected dates; rows on other dates do not count.
    """
    dates = catalogue.select(day).distinct().withColumn("_expected", F.lit(True))
    rows = df.join(dates.select(day), day, "left_semi")
    c = F.col(status)
    counted = rows.agg(
        F.count_distinct(day).alias("returned_dates"),
        F.count_distinct(F.when(c == "valid", F.col(day))).alias("valid_dates"),
        F.count_distinct(F.when(c == "cloudy", F.col(day))).alias("cloudy_dates"),
        F.count(F.lit(1)).alias("returned_cell_days"),
        F.count_if(c == "valid").alias("valid_cell_days"),
        F.count_if(c == "cloudy").alias("cloudy_cell_days"),
        F.count_if(c == "invalid").alias("invalid_cell_days"))
    total = dates.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        total.alias("catalog_dates"), "*",
        (total - F.col("returned_dates")).alias("missing_dates"),
        (total * F.lit(cells)).alias("expected_cell_days"),
        F.greatest(total * F.lit(cells) - F.col("returned_cell_days"), F.lit(0))
        .alias("missing_cell_days"))


def science_columns(df: DataFrame) -> list[str]:
    ignored = {*IDENTITY_COLUMNS, *MATCH_COLUMNS, *QUALITY_COLUMNS}
    return [c for c in df.columns if c not in ignored]


def null_profile(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, missing, percent) of the columns with gaps; one scan."""
    columns = list(columns)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot("_rows", columns, "column", "missing")
    return long.where(F.col("missing") > 0).select(
        "column", "missing",
        F.round(F.col("missing") * F.lit(100.0) / F.col("_rows"), 2).alias("percent"))


def quality_report(df: DataFrame, *, purpose: str = "lst_downscaling",
                   failed_items: int = 0, node: str = "node_id", day: str = "date",
                   ready: str = "training_ready", area: str = "area_id") -> DataFrame:
    """One nested row: sizes, completeness, gaps by column, overall status. Nodes of
    different areas are different nodes.

    Nodes and dates are counted on their distinct values, the gaps in one scan of
    plain sums; one aggregate with both would multiply every row.
    """
    keys = [c for c in (area, node) if c in df.columns]
    science = science_columns(df)
    missing = {c: F.count_if(F.col(c).isNull()) for c in science}
    ready_rows = F.count_if(F.col(ready)) if ready in df.columns else F.lit(0)
    gaps = F.array(*[F.struct((-m).alias("_order"), F.lit(c).alias("column"), m.alias("count"))
                     for c, m in missing.items()])
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), ready_rows.alias("training_ready_rows"),
        gaps.alias("_gaps"))
    row = row.withColumns({
        "nodes": df.where(F.col(node).isNotNull()).select(*keys).distinct().agg(F.count(F.lit(1))).scalar(),
        "dates": df.where(F.col(day).isNotNull()).select(day).distinct().agg(F.count(F.lit(1))).scalar()})
    return report_of_counts(row, len(science), purpose, failed_items)


def report_of_counts(row: DataFrame, columns: int, purpose: str, failed_items: int) -> DataFrame:
    """The report from one row of rows, nodes, dates, training_ready_rows and ``_gaps``:
    (order, column, count) of the missing values of ``columns`` columns."""
    gaps = F.array_sort(F.filter("_gaps", lambda g: g["count"] > 0))
    total = F.aggregate("_gaps", F.lit(0).cast("long"), lambda acc, g: acc + g["count"])
    cells = F.col("rows") * F.lit(columns)
    share = F.try_divide(total.cast("double"), cells.cast("double"))
    status = F.when(F.lit(purpose == "lst_downscaling") & (F.col("training_ready_rows") == 0),
                    F.lit("insufficient"))
    status = status.when((total > 0) | F.lit(failed_items > 0), F.lit("with_gaps")).otherwise(
        F.lit("complete"))
    return row.select(
        status.alias("status"), "rows", "nodes", "dates",
        F.coalesce(F.round((F.lit(1.0) - share) * F.lit(100.0), 2), F.lit(100.0))
        .alias("scientific_completeness_percent"),
        "training_ready_rows",
        F.coalesce(F.round(F.try_divide(F.col("training_ready_rows") * F.lit(100.0),
                                        F.col("rows").cast("double")), 2), F.lit(0.0))
        .alias("training_ready_percent"),
        F.transform(gaps, lambda g: F.struct(
            g["column"].alias("column"), g["count"].alias("count"),
            F.round(g["count"] * F.lit(100.0) / F.col("rows"), 2).alias("percent")))
        .alias("missing_by_column"),
        F.lit(failed_items).alias("failed_items"))


def error_metrics(df: DataFrame, observed: str, predicted: str, day: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """MAE, date-balanced MAE, RMSE, R2, bias, sizes. Sums per day first, so
    the balanced mean needs no second pass over the rows."""
    by = list(by)
    e = F.col(predicted) - F.col(observed)
    o = F.col(observed)
    daily = df.where(e.isNotNull()).groupBy(*by, day).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("abs"), F.sum(e).alias("err"),
        F.sum(e * e).alias("sq"), F.var_pop(o).alias("var"), F.avg(o).alias("mean"))
    # Pooled variance from per-day parts: within-day plus between-day spread.
    pooled = daily.groupBy(*by).agg(
        (F.sum("abs") / F.sum("n")).alias("mae"),
        F.avg(F.col("abs") / F.col("n")).alias("mae_by_date"),
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse"),
        F.sum("sq").alias("_sq"), F.sum(F.col("n") * F.col("var")).alias("_within"),
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("mean")).alias("_sum"),
        F.collect_list(F.struct("n", "mean")).alias("_days"),  # bounded by the calendar
        (F.sum("err") / F.sum("n")).alias("bias"), F.count(F.lit(1)).alias("dates"))
    centre = F.col("_sum") / F.col("_n")
    between = F.aggregate("_days", F.lit(0.0), lambda acc, d: acc + d["n"] * (
        d["mean"] - centre) * (d["mean"] - centre))
    r2 = F.lit(1.0) - F.try_divide(F.col("_sq"), F.col("_within") + between)
    return pooled.select(*by, "mae", "mae_by_date", "rmse", r2.alias("r2"), "bias", "dates",
                         F.col("_n").alias("rows"))


def improvement_percent(metrics: DataFrame, name: str, baseline: str, metric: str,
                        out: str) -> DataFrame:
    base = metrics.where(F.col(name) == baseline).agg(F.first(metric)).scalar()
    return metrics.withColumn(out, F.try_divide((base - F.col(metric)) * F.lit(100.0), base))


def source_agreement(joined: DataFrame, variables: Sequence[str], suffixes: tuple[str, str],
                     tolerances: dict[str, float]) -> DataFrame:
    """Per variable: compared pairs, errors of b - a, correlation, verdict."""
    a, b = suffixes
    pairs = F.explode(F.array(*[F.struct(
        F.lit(v).alias("variable"), F.col(v + a).cast("double").alias("va"),
        F.col(v + b).cast("double").alias("vb"),
        F.lit(tolerances.get(v)).cast("double").alias("tolerance")) for v in variables]))
    long = joined.select(pairs.alias("p")).select("p.*").where(
        F.col("va").isNotNull() & F.col("vb").isNotNull())
    d = F.col("vb") - F.col("va")
    out = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("compared"), F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("mean_bias"), F.max(F.abs(d)).alias("max_absolute_error"),
        correlation(F.col("va"), F.col("vb")).alias("correlation"), F.max("tolerance").alias("tolerance"))
    return out.withColumn("passes", F.col("max_absolute_error") <= F.col("tolerance"))


def feature_screen(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Availability, distinct values and |correlation| with the target, one
    row per candidate, absent columns included."""
    have = [f for f in features if f in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for f in have:
        value = number(f)
        both = value.isNotNull() & F.col(target).isNotNull()
        n, distinct = F.count(value), F.count_distinct(value)
        paired = F.when(both, value)
        enough = (F.count_if(both) > 2) & (F.min(paired) < F.max(paired))
        aggs.append(F.struct(
            n.alias("n"), distinct.alias("distinct"),
            F.when(enough, F.abs(correlation(value, F.col(target)))).alias("corr")).alias(f"c_{f}"))
    row = df.agg(*aggs)
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("distinct"),
                     F.lit(None).cast("double").alias("corr"))
    parts = F.array(*[F.struct(F.lit(f).alias("variable"), (
        F.col(f"c_{f}") if f in have else empty).alias("s")) for f in features])
    return row.select("_rows", F.explode(parts).alias("p")).select(
        F.col("p.variable").alias("variable"),
        F.coalesce(F.round(F.try_divide(F.col("p.s.n") * F.lit(100.0),
                                        F.col("_rows").cast("double")), 2), F.lit(0.0))
        .alias("availability_percent"),
        F.col("p.s.distinct").alias("distinct_values"),
        F.col("p.s.corr").alias("abs_correlation"))


def ranked_screen(screen: DataFrame) -> DataFrame:
    return screen.orderBy(F.col("availability_percent").desc_nulls_last(),
                          F.col("abs_correlation").desc_nulls_last(), "variable")


def area_rollup(rows: DataFrame, requested: DataFrame, *, area: str = "area_id",
                node: str = "node_id", day: str = "date") -> DataFrame:
    """Rows, nodes and dates of every requested area; absent areas show zero."""
    per_area = rows.groupBy(area).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(node).alias("nodes"),
        F.count_distinct(day).alias("dates"))
    joined = requested.select(area).distinct().join(per_area, area, "left")
    return joined.select(
        area, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "nodes", "dates")],
        F.when(F.col("rows").isNull(), F.lit("error")).otherwise(F.lit("complete")).alias("state"))


def run_status(rollup: DataFrame) -> DataFrame:
    done = F.count_if(F.col("state") == "complete")
    return rollup.agg(
        F.when(F.count_if(F.col("state") != "complete") > 0, F.lit("partial"))
        .otherwise(F.lit("complete")).alias("status"),
        F.count(F.lit(1)).alias("areas_requested"), done.alias("areas_completed"),
        F.sum("rows").alias("rows"))


def run_rates(runs: DataFrame, *, source: str, seconds: str, rows: str, values: str) -> DataFrame:
    """Rows per second and seconds per 1000 values."""
    return runs.withColumns({
        "rows_per_second": F.col(rows) / F.greatest(F.col(seconds), F.lit(1e-9)),
        "seconds_per_1000_values": F.try_divide(F.col(seconds) * F.lit(1000.0),
                                                F.col(values).cast("double")),
    })


def speed_verdict(runs: DataFrame, *, source: str, seconds: str) -> DataFrame:
    """Fastest and slowest source; equal times go to the smaller name."""
    fast = F.min_by(source, F.struct(seconds, source))
    slow = F.min_by(source, F.struct((-F.col(seconds)).alias("s"), F.col(source)))
    return runs.agg(fast.alias("fastest"), slow.alias("slowest"), (
        F.max(seconds) / F.greatest(F.min(seconds), F.lit(1e-9))).alias("speed_factor"))


def verdicts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """All-true and any-true per condition, NULL counted as false."""
    aggs = []
    for name, condition in conditions.items():
        c = F.coalesce(condition, F.lit(False))
        aggs += [F.bool_and(c).alias(f"all_{name}"), F.bool_or(c).alias(f"any_{name}")]
    return df.agg(*aggs)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-independent table hash: the sum of the first 60 bits of every row's MD5.

    Values are written as text between bars, null as ``\\N``, so that any engine
    can repeat it."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (columns or df.columns)]
    digest = F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15)
    return df.agg(F.coalesce(F.sum(F.conv(digest, 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"),
                  F.count(F.lit(1)).alias("rows"))


def median_hour(df: DataFrame, minutes: Column, fallback: float = 10.0,
                by: Sequence[str] = ()) -> DataFrame:
    """Median decimal hour; whole seconds give at most 86 400 distinct values."""
    return df.groupBy(*by).agg(
        F.coalesce(F.median(minutes) / F.lit(60.0), F.lit(float(fallback))).alias("median_hour"))


def macro_mae(df: DataFrame, observed: str, predicted: str, day: str,
              by: Sequence[str] = (), out: str = "mae_by_date") -> DataFrame:
    daily = df.groupBy(*by, day).agg(
        F.avg(F.abs(F.col(predicted) - F.col(observed))).alias("_m"))
    return daily.groupBy(*by).agg(F.avg("_m").alias(out))
