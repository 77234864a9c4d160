"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermagrid.session import cut_lineage

from .common import WORD

ROWS_PER_SLICE = 8192


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """Target words of each source from (mix_source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``repeats`` times its source's size and the
    excess is shared again by weight. That fixed point is a water level: with
    sources sorted by limit / weight, those whose limit lies under the level
    get their limit, all others get level * weight. One row per source, so the
    windows without a key are as small as the list of sources.
    """
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = F.row_number().over(Window.orderBy("mix_source")) - 1
    weighed = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    full = (sizes.withColumn("total", total).withColumn("weight", weighed)
            .withColumn("limit", F.lit(float(repeats)) * F.col("source_size"))
            .withColumn("ratio", F.col("limit") / F.col("weight")))
    up = Window.orderBy("ratio", "mix_source")
    before = F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = (full.withColumn("level", (F.col("total") - before) / rest)
              .withColumn("step", F.row_number().over(up)))
    open_level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("step", "level"))).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    level = F.coalesce(open_level, F.lit(float("inf")))
    return levels.withColumn("target", F.least(F.col("limit"), level * F.col("weight"))).select(
        "mix_source", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "mix",
        carry_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``taken``,
    ``copies`` and ``virtual_finish``, in the order of the mix.

    Inside a source the documents are shuffled by md5(seed, doc_id). A document's
    virtual finish time is the words of its source up to and with it, over the
    source's target; a source that must repeat starts again with its first
    document. All documents advance by the same virtual clock, so cutting the
    range-sorted mix at the total budget is stopping the clock at 1: ``taken``
    counts the words before that moment (at most ``repeats`` passes; the one
    document that crosses it is cut), ``copies`` rounds that to whole documents.

    A hot source is no hot task: its shuffle order is cut into slices of about
    8192 rows, sums of slices give each slice its start, running sums stay
    inside a slice. Null text has size 0 and is taken 0 times; null sources are
    one source, last; repeated rows count each (ties by size and text); extra
    columns stay, columns named like the results are replaced; an empty table
    gives no rows. ``carry_text=False`` leaves the text out of the result, and
    so out of the shuffles.
    """
    made = ("size", "source_size", "target", "taken", "copies", "virtual_finish", "mix_source", "mix_key", "mix_tie", "mix_slice")
    kept = [c for c in docs.columns if c not in made and (carry_text or c != "text")]
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        *kept, n_words(F.col("text")).alias("size"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("mix_source"),
        key.alias("mix_key"), F.coalesce(F.md5("text"), F.lit("")).alias("mix_tie"))
    if not carry_text:
        sized = cut_lineage(sized)
    rows, digits = docs.count(), 0
    while rows > ROWS_PER_SLICE * 16 ** digits:
        digits += 1
    sized = sized.withColumn("mix_slice", F.substring("mix_key", 1, digits) if digits else F.lit("all"))
    slices = cut_lineage(sized.groupBy("mix_source", "mix_slice").agg(F.sum("size").alias("words")))
    start = F.sum("words").over(Window.partitionBy("mix_source").orderBy("mix_slice")) - F.col("words")
    sizes = slices.groupBy("mix_source").agg(F.sum("words").alias("source_size"))
    plan = (slices.withColumn("slice_start", start).drop("words")
            .join(sizes.join(source_targets(sizes, weights, repeats), "mix_source"), "mix_source"))
    inside = Window.partitionBy("mix_source", "mix_slice").orderBy("mix_key", "size", "mix_tie")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (sized.withColumn("upto", upto).join(plan, ["mix_source", "mix_slice"])
              .withColumn("mix_start", F.col("slice_start") + F.col("upto") - F.col("size")))
    budget = F.floor(F.col("target") + 0.5)
    taken = F.lit(0).cast("long")
    for lap in range(repeats):
        left = budget - F.col("mix_start") - F.lit(lap) * F.col("source_size")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return (placed.withColumn("taken", taken)
            .withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int"))
            .withColumn("virtual_finish", F.when(F.col("target") > 0, (F.col("mix_start") + F.col("size")) / F.col("target")))
            .select(*kept, "size", "source_size", "target", "taken", "copies", "virtual_finish")
            .orderBy("virtual_finish", "doc_id"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """The mix as documents: each row as many times as it is taken (rounded to
    whole documents), in the order of the mix, with the columns of ``docs``."""
    columns = docs.columns
    return (mix(docs, weights, repeats)
            .withColumn("mix_lap", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
            .select(*columns))
