"""Spelling variants: words one edit apart, grouped under their common form.

The near words of all words of a block are found at once on bit sets: for every
(position, letter) one set over the block's words, for every query word four sets
that move along its letters (no error so far; one letter replaced; one letter
more; one letter less in the word found).

Blocks come from the place of the edit. A pair of words of ``l`` and ``l`` or ``l`` + 1
letters with a common start of exactly ``d`` letters agrees on everything behind the
edit too, so with lo <= d < hi both lie in the block (l, lo, hi, first lo letters,
last l - hi letters). The regions [lo, hi) of a class cut up all ``d``, hence each pair
is met in exactly one block. Blocks with too many words have their region halved
until they fit or the region is one position, where distinct words run out of
letters: no block is ever unbounded and no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Letters of a run, and the least length and number of occurrences of a word.
LETTER = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form must be so many times as frequent as the word.
RATIO = 10
#: Of runs, one in so many loses a letter (decided by a hash).
DROP_ONE_IN = 31
#: Words of a block beyond which its region is halved, and words that are searched together.
BLOCK_LIMIT, TOGETHER = 4096, 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = ["l", "lo", "hi", "head", "tail"]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of whole texts with at least LEAST_COUNT occurrences.

    Runs of letters (null text: none), ``A-Z`` in lower case; where the crc32 of
    ``<doc_id>:<run>`` is a multiple of DROP_ONE_IN, the letter at crc32 % length
    goes. A null doc_id reads as an empty id. Runs under LEAST_LENGTH cannot become
    words and are never made into rows. Counts are summed before the shuffle.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER),
                                       F.lit(f"[{LETTER}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"), F.length("run").alias("size"))
    at = F.pmod("h", "size").cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    word = F.when(F.col("h") % DROP_ONE_IN == 0, shorter).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))


def _entries(regions: DataFrame) -> DataFrame:
    """Adds the shared start and end of every row's region."""
    behind = F.col("l") - F.col("hi")
    return regions.withColumns({
        "head": F.substring(F.col("word"), F.lit(1), F.col("lo")),
        "tail": F.when(behind > 0, F.substring(F.col("word"), F.length("word") - behind + 1, behind)).otherwise("")})


def blocks(words: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(word, n, l, lo, hi, head, tail): every word in the blocks where its near words are.

    A word of k letters is in the classes k (with words of k and k + 1) and k - 1.
    """
    size = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("l"))
    half = (F.col("l") / 2).cast("int")
    rows = _entries(classes.select("word", "n", "l", F.inline(F.array(
        F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("l").alias("hi"))))))
    while True:
        wide = rows.where("hi - lo > 1").groupBy(*_KEYS).count().where(F.col("count") > limit).select(*_KEYS)
        wide = materialise(wide)
        if wide.isEmpty():
            return rows
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = rows.join(wide, _KEYS, "left_semi").select("word", "n", "l", F.inline(F.array(
            F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))))
        rows = materialise(rows.join(wide, _KEYS, "left_anti").unionByName(_entries(halves).select(*rows.columns)))


def near_in_block(words: list[str], lo: int, hi: int, l: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: how many words are near it, and the first of them (-1: none).

    Only pairs whose common start is at least ``lo`` letters and, unless ``hi`` is
    the end, below ``hi``, and only words of ``l`` and ``l`` + 1 letters, of which two
    of ``l`` + 1 belong to another class. Every step works on all pairs of a row's
    64 words at a time; rows are taken in slices of bounded size.
    """
    count = len(words)
    sizes = np.array([len(w) for w in words])
    letters = np.zeros((count, l + 1), np.int64)  # 0 stands behind the end
    points = np.frombuffer("".join(w.ljust(l + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(count, l + 1)
    alphabet, letters = np.unique(points, return_inverse=True)
    letters = letters.reshape(count, l + 1)
    lanes = -(-count // 64)

    def bits(flags: np.ndarray) -> np.ndarray:
        """Rows of flags over the words as rows of 64-bit lanes."""
        padded = np.zeros((*flags.shape[:-1], lanes * 64), bool)
        padded[..., :count] = flags
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    def index(position: int) -> np.ndarray:
        """The set of words with each letter of the alphabet at ``position``."""
        if not 0 <= position <= l:
            return np.zeros((len(alphabet), lanes), np.uint64)
        return bits(letters[:, position][None, :] == np.arange(len(alphabet))[:, None])

    short, long = bits(sizes == l), bits(sizes == l + 1)
    totals, firsts = np.zeros(count, np.int64), np.full(count, -1, np.int64)
    for begin in range(0, count, TOGETHER):
        rows = slice(begin, min(begin + TOGETHER, count))
        here, size = letters[rows], sizes[rows]
        exact = np.broadcast_to(bits(np.ones(count, bool)), (len(here), lanes)).copy()
        replaced, more, less = (np.zeros_like(exact) for _ in range(3))
        found = np.zeros_like(exact)
        ahead, at, behind = index(1), index(0), index(-1)
        barred = np.zeros_like(exact)
        for p in range(l + 1):
            if p == hi and hi < l:  # pairs that still agree have their edit in another region
                barred = exact.copy()
            if p == lo:  # an edit before the region is another region's as well
                replaced[:], more[:], less[:] = 0, 0, 0
            ended = size == p  # a short query is done one step before a long one
            if ended.any():
                found[ended] = (replaced[ended] & short) | ((more[ended] | exact[ended]) & long)
            letter = here[:, p]
            same, next_same, last_same = at[letter], ahead[letter], behind[letter]
            replaced = (replaced & same) | (exact & ~same)
            more = (more | exact) & next_same
            less = (less & last_same) | exact
            exact &= same
            behind, at, ahead = at, ahead, index(p + 2)
        whole = size == l + 1
        found[whole] = less[whole] & short
        found &= ~barred
        totals[rows] = np.bitwise_count(found).sum(axis=1)
        lane = (found != 0).argmax(axis=1)
        lowest = found[np.arange(len(found)), lane]
        some = lowest != 0
        firsts[rows][some] = lane[some] * 64 + np.bitwise_count((lowest[some] & -lowest[some]) - np.uint64(1)).astype(np.int64)
    return totals, firsts


def _search(table: pa.Table) -> pa.Table:
    """One row for each word of a block with near words: their number and the best of them."""
    l, lo, hi = (table.column(c)[0].as_py() for c in ("l", "lo", "hi"))
    rows = sorted(zip(table.column("n").to_pylist(), table.column("word").to_pylist()), key=lambda r: (-r[0], r[1]))
    words, counts = [w for _, w in rows], [n for n, _ in rows]
    totals, firsts = near_in_block(words, lo, hi, l)
    hits = np.flatnonzero(totals)
    best = firsts[hits]
    return pa.table({
        "word": pa.array([words[i] for i in hits], pa.string()), "near": pa.array(totals[hits], pa.int64()),
        "best_n": pa.array([counts[i] for i in best], pa.int64()), "best": pa.array([words[i] for i in best], pa.string())})


def near_words(words: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(word, n_near, best_n, best): number of near words, and the most frequent of
    them (ties: smallest in code-point order); words without one have no row.

    Blocks of a class and region are searched some hundred words together (as many
    buckets as the fullest region needs, by a hash of the block): words of two blocks
    are never a pair of that region, so mixing them changes nothing.
    No pair of words leaves a task.
    """
    rows = blocks(words, limit)
    most = rows.groupBy("l", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("head", "tail"), F.ceil(most / TOGETHER)))
    found = dealt.select("l", "lo", "hi", "bucket", "word", "n").groupBy("l", "lo", "hi", "bucket").applyInArrow(
        _search, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top"))
            .select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best")))


def spelling_groups(docs: DataFrame, ratio: int = RATIO, limit: int = BLOCK_LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs``.

    ``form`` is the near word of largest n, where that is at least ``ratio`` times
    the word's; ``root`` is the last word on the way from form to form (the word
    itself without one). Counts grow on the way by ``ratio`` a step, so it ends; each
    round doubles the steps taken. Nulls, repeated rows and empty texts: see
    ``word_counts``; no words, no rows.
    """
    words = materialise(word_counts(docs.select("doc_id", "text")))
    near = near_words(words, limit)
    enough = F.col("best_n") >= ratio * F.col("n")
    formed = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        steps = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(links.join(steps, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                     F.col("further").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
