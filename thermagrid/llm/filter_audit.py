"""What each of several filters removes, alone, in every order and on average over orders.

A table of all coalitions of filters (how many documents each set of filters would
remove together) says everything: steps of an order are differences of two
coalitions, and Shapley values are the exact solution of a small least-squares
problem on them. Only the coalition table grows with the number of parts; the
documents are read once and aggregated before they are shuffled by part.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Filters by letter; a filter's bit in a mask is its place in this order.
LETTERS = "ABCDE"
DUPLICATE = "E"
#: Per part, coalition: documents removed, those of good quality, those that are toxic.
MEASURES = ("removed", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone (null text: empty).

    A: under 50 words; B: under 65 % distinct words; C: over 5 % of the code
    points are ``A-Z``; D: holds any of ``#$%&*|``. An empty text fails A only.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(failures: dict[str, Column]) -> Column:
    bits = [F.when(failed, 1 << LETTERS.index(letter)).otherwise(0) for letter, failed in failures.items()]
    return reduce(Column.bitwiseOR, bits).cast("int")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the exact set of filters that they fail.

    Filter E fails a document whose text is that of any smaller doc_id, table-wide.
    The other filters follow from the text, so rows are first summed by (text,
    part, doc_id), then by (text, part): a text that a third of all rows share is a
    few rows per part by the time texts are compared. Texts are compared by
    SHA-256 and length.

    Rows without a doc_id have no place in the order: they never fail E and no row
    fails because of them; they have no label. Repeated rows count each; a
    document is good or toxic when any of its label rows says so.
    """
    source = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    text = F.coalesce("text", F.lit(""))
    rows = source.select("doc_id", "part", F.sha2(text.cast("binary"), 256).alias("digest"), F.length(text).alias("size"),
                         _mask(text_failures(F.col("text"))).alias("mask"))
    rows = rows.groupBy("digest", "size", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # Ids meet their labels by a text key: rows without an id spread over the keys of their texts.
    rows = rows.withColumn("label_key", F.when(F.col("doc_id").isNull(), F.concat(F.lit("-"), "digest"))
                           .otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string"))))
    marks = (labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
             .groupBy(F.concat(F.lit("="), F.col("doc_id").cast("string")).alias("label_key"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")))
    rows = rows.join(marks, "label_key", "left").fillna(0, ["good", "toxic"])
    groups = rows.groupBy("digest", "size", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless"))
    first = groups.groupBy("digest", "size").agg(F.min("least.doc_id").alias("first_id"))
    groups = groups.join(first, ["digest", "size"])
    # All rows of a text but those that hold its smallest id fail E.
    spared = F.col("n_nameless") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    duplicate = 1 << LETTERS.index(DUPLICATE)
    split = groups.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), spared.alias("n")),
        F.struct((F.col("mask") + duplicate).alias("mask"), (F.col("n") - spared).alias("n")))))
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"),
        F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def coalition_table(counts: DataFrame, players: int = len(LETTERS)) -> DataFrame:
    """(part, coalitions): for each part an array with one entry per set of filters
    (index: its mask, 0 the empty set) of documents that the set removes together."""
    masks = F.explode(F.sequence(F.lit(0), F.lit((1 << players) - 1)))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    rows = counts.select("*", masks.alias("coalition")).groupBy("part", "coalition").agg(*[
        F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(m) for c, m in zip(("n", "n_good", "n_toxic"), MEASURES)],
        F.sum("n").alias("documents"))
    return rows.groupBy("part").agg(
        F.max("documents").alias("documents"),
        F.sort_array(F.collect_list(F.struct("coalition", *MEASURES))).alias("coalitions"))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with matrix X = right, by Gauss-Jordan elimination in rationals."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    size = len(rows)
    for k in range(size):
        pivot = next(r for r in range(k, size) if rows[r][k] != 0)
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(size):
            if r != k and rows[r][k] != 0:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [row[size:] for row in rows]


def shapley_weights(players: int = len(LETTERS)) -> list[list[Fraction]]:
    """One row per player: coefficients of the coalition values (index: mask).

    Minimises sum over proper coalitions S of k(S) (v(S) - sum of phi in S)^2 with
    k(S) = (p - 1) / (C(p, |S|) |S| (p - |S|)), subject to sum of phi = v(all):
    the Lagrange conditions are p + 1 linear equations with the coalition values on
    the right, solved once, exactly, for every coalition as a unit value. The
    empty coalition removes nothing.
    """
    full = (1 << players) - 1
    inside = [[mask >> i & 1 for i in range(players)] for mask in range(full + 1)]
    kernel = [Fraction(0)] * (full + 1)
    for mask in range(1, full):
        s = sum(inside[mask])
        kernel[mask] = Fraction(players - 1, comb(players, s) * s * (players - s))
    normal = [[sum(kernel[m] * inside[m][i] * inside[m][j] for m in range(full + 1)) for j in range(players)] + [Fraction(1)]
              for i in range(players)] + [[Fraction(1)] * players + [Fraction(0)]]
    right = [[kernel[m] * inside[m][i] for m in range(full + 1)] for i in range(players)]
    right.append([Fraction(int(m == full)) for m in range(full + 1)])
    return solve(normal, right)[:players]


def shapley_totals(players: int = len(LETTERS)) -> list[list[int]]:
    """The weights times the number of orders: whole numbers, so totals over all
    orders stay exact in long arithmetic."""
    scaled = [[w * factorial(players) for w in row] for row in shapley_weights(players)]
    assert all(w.denominator == 1 for row in scaled for w in row)
    return [[int(w) for w in row] for row in scaled]


def order_steps(table: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for every order of the filters, from the coalition table.

    With v(S) what the filters of S remove together: a step removes v(up to it) -
    v(before it); documents that fail its filter but went earlier are v(filter) less
    that; those that fail no other filter are v(all) - v(all others).
    """
    players, full = len(letters), (1 << len(letters)) - 1
    orders = ",".join("".join(p) for p in permutations(letters))
    steps = (table.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(players))).alias("step"))
             .withColumn("own", _letters_mask("substring(filter_order, step, 1)", letters))
             .withColumn("before", _letters_mask("substring(filter_order, 1, step - 1)", letters)))

    def value(mask: Column, measure: str = "removed") -> Column:
        return F.get(F.col("coalitions"), mask)[measure]

    own, before = F.col("own"), F.col("before")
    gain = {m: value(before + own, m) - value(before, m) for m in MEASURES}
    totals = F.lit(0).cast("long")
    for player, coefficients in enumerate(shapley_totals(players)):
        total = reduce(lambda a, b: a + b, (value(F.lit(mask)) * c for mask, c in enumerate(coefficients) if c))
        totals = F.when(own == 1 << player, total).otherwise(totals)
    return steps.select(
        "part", "filter_order", "step", (F.col("documents") - value(before + own)).alias("kept"),
        gain["removed"].alias("removed"), (value(own) - gain["removed"]).alias("redundant"),
        (value(F.lit(full)) - value(F.lit(full) - own)).alias("unique_fails"),
        gain["good"].alias("good_lost"), gain["toxic"].alias("toxic_lost"), totals.alias("shapley"))


def _letters_mask(text: str, letters: str) -> Column:
    return F.expr(" + ".join(f"IF(instr({text}, '{x}') > 0, {1 << k}, 0)" for k, x in enumerate(letters)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order and step of the five filters in every part (a source; null: '').

    One part of an empty table is no part: no rows. Extra columns of either table
    play no part; see ``failure_counts`` for nulls, repeated rows and labels.
    """
    return order_steps(coalition_table(failure_counts(docs, labels)))
