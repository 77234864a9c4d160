"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermagrid.session import cut_lineage

from .common import SPACE, WORD

WINDOW = 8
#: Rule -> cutoffs, from lenient to strict; a document breaks a rule when the value exceeds the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04),
    "shout_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05),
    "repeat_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "run_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
}
#: Strata are bands of length in words, so their number is fixed.
BANDS = (150, 600)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus the counts of each whole text (null text: no words).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_shouts (``!`` and ``?``), n_capitals and n_runs (words equal to the word before). Everything is computed inside the
    row: word windows are compared by 64-bit hashes in one array of the row, so
    nothing is exploded or shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *keep, text.alias("q_text"),
        F.expr(f"regexp_extract_all(coalesce(text, ''), '{_sql(WORD)}', 0)").alias("q_words"),
        F.expr(f"filter(split(coalesce(text, ''), '\\n', -1), l -> l rlike '{_sql(WORD)}')").alias("q_lines"))
    counted = split.select(
        *keep, F.size("q_words").cast("long").alias("n_words"),
        (F.length("q_text") - F.regexp_count("q_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("q_text", F.lit(r"[!?]")).cast("long").alias("n_shouts"),
        F.regexp_count("q_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("q_words", lambda w: F.xxhash64(w)).alias("q_hashes"))
    counted = counted.withColumn("n_runs", F.expr(
        "size(filter(q_hashes, (h, i) -> get(q_hashes, i - 1) <=> h))").cast("long"))
    members = ", ".join(f"q_hashes[i + {k}]" if k else "q_hashes[i]" for k in range(WINDOW))
    windows = counted.withColumn("q_windows", F.expr(
        f"CASE WHEN n_words > {WINDOW} THEN transform(sequence(0, size(q_hashes) - {WINDOW}), i -> xxhash64({members})) END"))
    # Only texts with a window found twice go on; windows in order of their hash stand beside their equals.
    ordered = windows.withColumn("q_sorted", F.expr(
        "CASE WHEN size(array_distinct(q_windows)) < size(q_windows) "
        "THEN sort_array(transform(q_windows, (h, i) -> struct(h AS h, i AS i))) END")).drop("q_windows", "q_hashes")
    starts = ordered.withColumn("q_starts", F.expr(
        "sort_array(transform(filter(q_sorted, (x, j) -> get(q_sorted, j - 1).h <=> x.h OR get(q_sorted, j + 1).h <=> x.h), "
        "x -> x.i))")).drop("q_sorted")
    covered = F.expr(
        f"coalesce(aggregate(transform(q_starts, (p, j) -> least({WINDOW}, coalesce(get(q_starts, j + 1) - p, {WINDOW}))), "
        "0, (a, x) -> a + x), 0)").cast("long")
    # A row number times 0 keeps later filters above this step: pushed below it, they would repeat all of the above.
    return starts.withColumn("n_repeat_words", covered + F.monotonically_increasing_id() * 0).drop("q_starts")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def rule_values() -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    return {"symbol_share": share("n_symbols", "word_chars"), "shout_share": share("n_shouts", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "run_share": share("n_runs", "n_words"), "capital_share": share("n_capitals", "word_chars")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def band() -> Column:
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(F.col("n_words") < BANDS[k], k).otherwise(out)
    return out.cast("int")


def binomial_tail(n: str, k: str, risk: float) -> Column:
    """P(Bin(n, risk) <= k), exactly, summed in logarithms; 1 where k is over n * risk."""
    return F.expr(
        f"CASE WHEN {k} > {n} * {risk!r}D OR {n} = 0 THEN 1.0D ELSE exp(aggregate(sequence(0L, {k}), "
        f"struct({n} * ln(1 - {risk!r}D) AS term, CAST(NULL AS DOUBLE) AS total), (a, i) -> struct("
        f"CASE WHEN i = 0 THEN a.term ELSE a.term + ln(({n} - i + 1) / i) + ln({risk!r}D / (1 - {risk!r}D)) END AS term, "
        f"CASE WHEN i = 0 THEN a.term ELSE greatest(a.total, a.term + ln(({n} - i + 1) / i) + ln({risk!r}D / (1 - {risk!r}D))) "
        f"+ log1p(exp(-abs(a.total - a.term - ln(({n} - i + 1) / i) - ln({risk!r}D / (1 - {risk!r}D))))) END AS total), "
        "a -> a.total)) END")


def levels() -> list[dict[str, float]]:
    """One nested family of cutoff vectors, from lenient to strict: a rule that has run out of cutoffs keeps its strictest."""
    return [{rule: cuts[min(k, len(cuts) - 1)] for rule, cuts in RULES.items()} for k in range(max(map(len, RULES.values())))]


def thresholds(labelled: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(band, cut_<rule>...) from labelled features (``quality`` 1 is good).

    In a stratum, the rules are certified together: at each level of ``levels``, k
    of the n good held-out documents would be rejected by any rule. The level is
    certified when P(Bin(n, risk) <= k) is at most delta / strata, so the true
    false-rejection rate of all rules together is then no higher than ``risk``.
    Multiple testing: ``delta`` is split over the strata (Bonferroni); within one
    the levels are tested from lenient to strict and testing stops at the first
    that fails (fixed sequence), so the family-wise error is ``delta``. The
    strictest certified level is used, none (null) where none is certified: about
    200 good labels of a stratum certify a level that rejects none of them.
    """
    family, each = levels(), delta / (len(BANDS) + 1)
    values = rule_values()
    good = labelled.where("quality = 1").select(band().alias("band"), *[v.alias(n) for n, v in values.items()])

    def broken(cuts: dict[str, float]) -> Column:
        out = F.lit(False)
        for rule, cut in cuts.items():
            out = out | (F.col(rule) > cut)
        return out

    counts = good.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(broken(c)).alias(f"k_{i}") for i, c in enumerate(family)])
    tests = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"k_{i}").alias("k")) for i in range(len(family))])
    rows = counts.select("band", "n", F.inline(tests))
    passed = rows.withColumn("ok", (binomial_tail("n", "k", risk) <= each).cast("int"))
    sofar = F.min("ok").over(Window.partitionBy("band").orderBy("step"))
    level = (passed.withColumn("ok", sofar).groupBy("band").agg(F.max(F.when(F.col("ok") == 1, F.col("step"))).alias("level")))
    return level.select("band", *[F.get(F.array(*[F.lit(c[rule]) for c in family]), F.col("level")).alias(f"cut_{rule}") for rule in RULES])


def labelled_features(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled document: the worst values of its rows, the worst label."""
    names = ["n_words", "word_chars", "n_symbols", "n_shouts", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "n_runs"]
    one = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return (feats.select("doc_id", *names).join(one, "doc_id")
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), *[F.max(n).alias(n) for n in names]))


def verdict() -> Column:
    """True when the row is within every certified cutoff of its stratum."""
    broken = F.lit(False)
    for rule, value in rule_values().items():
        broken = broken | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    return ~base_failed() & ~broken


def apply_rules(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds base_failed and kept; ``cuts`` has at most one row for each fixed
    band, so it is broadcast."""
    joined = feats.withColumn("band", band()).join(F.broadcast(cuts), "band", "left")
    return (joined.withColumn("base_failed", base_failed()).withColumn("kept", verdict())
            .drop(*[f"cut_{rule}" for rule in RULES]))


def quality_report(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per document: counts, base_failed, kept.

    A null or empty text has no words and fails the base rule; repeated rows get
    the same verdict each; with no labels nothing is certified and only the base
    rule rejects; extra columns of either table play no part.
    """
    feats = cut_lineage(features(docs.select("doc_id", "text"), ["doc_id"]))
    cuts = cut_lineage(thresholds(labelled_features(feats, labels), risk, delta))
    return apply_rules(feats, cuts)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that pass, with their own columns. Counts are taken once for the
    thresholds and once for the verdicts: keeping them beside the whole texts would
    write the corpus once more."""
    columns = docs.columns
    feats = features(docs.select("doc_id", "text"), ["doc_id"])
    cuts = cut_lineage(thresholds(labelled_features(feats, labels), risk, delta))
    packed = docs.select(F.struct(*columns).alias("q_row"), "doc_id", "text")
    return apply_rules(features(packed, ["q_row"]), cuts).where("kept").select("q_row.*")
