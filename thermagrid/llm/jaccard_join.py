"""Documents joined by the Jaccard similarity of their word shingles.

1. Every text becomes its set of hashed shingles; equal sets are one set.
2. Two similar sets share one of their first tokens in any common order (prefix
   filter). The order is by hash, but the most frequent tokens come last, so
   passages that many documents share hardly make candidates.
3. Sets that share a token are first linked to centres of their tokens' groups;
   checked links give first components. This takes the many copies of one text
   together without looking at their pairs.
4. Groups that still hold more than one component are searched by signature
   trees: nodes hold OR-combined token bitmaps and size ranges, and a dual
   traversal drops node pairs that are one component already, cannot reach the
   similarity by size, or cannot by their largest possible overlap. Of the pairs
   that remain the best few of each set are checked on the whole sets and joined;
   groups that have pairs left over are then searched once more for whatever is
   still apart.
5. The pairs that remain are checked on the whole sets; components are closed.

Steps 3 to 5 lose no link: a pair is left out only if a bound excludes it or if
both sets are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermagrid.session import cut_lineage

from .common import arrow_batches, materialise, mix64, scratch

SHINGLE, SIMILAR = 5, 80
#: A token in this many prefixes is frequent; at most FREQUENT_MOST of them (8 bytes each) are broadcast.
FREQUENT, FREQUENT_MOST = 48, 500_000
#: Members of a group that are searched in one piece; larger groups are searched by pairs of pieces.
PIECE = 2048
#: Groups up to this size are searched together in one sweep, larger ones by a tree.
SMALL = 64
#: Tokens stored beyond the prefix, for those that turn out to be frequent.
SPARE = 32
#: Bits of the bitmaps that thin rows before a shuffle.
FILTER_BITS = 1 << 25
FANOUT = 16
#: Bits a token that the trees see, bytes of bitmaps that a search gathers at a time, and candidates
#: of a set in a group that are checked before the rest of the group is searched.
TREE_BITS, GATHER_BYTES, FIRST_BEST = 4, 16 << 20, 6
#: Node pairs of a tree that are opened together, and pairs held before the best of each set are taken.
OPENED, HELD = 1 << 11, 200_000
#: Tokens of a set, and bits of a group, by which a pair is known to meet in an earlier group too.
EARLIER_TOKENS, EARLIER_BITS = 64, 1 << 15
CACHED_WORDS = 200_000
#: Rows of a batch that carry whole texts, sets or bitmaps.
BATCH_ROWS = 1000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: list[str | None], hashes: _WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer words
    than one shingle are one shingle, no words none."""
    split = [t.encode().lower().split() if t else () for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    h = np.concatenate([np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in split] + [np.zeros(SHINGLE, np.uint64)])
    total = np.full(len(h) - SHINGLE + 1, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        total += h[k:len(h) - SHINGLE + 1 + k] * _ODD[k]
    total = mix64(total)
    out, begin = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            tokens = np.sort(total[begin:begin + n - SHINGLE + 1])
            fresh = tokens[1:] != tokens[:-1]
            out.append(tokens if fresh.all() else tokens[np.concatenate(([True], fresh))])
        elif n:
            few = np.uint64(n)
            for k in range(n):
                few = few + h[begin + k:begin + k + 1] * _ODD[k]
            out.append(mix64(few))
        else:
            out.append(np.empty(0, np.uint64))
        begin += n
    return out


def set_id(tokens: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(tokens.tobytes()), np.int64)[0])


def prefix_size(n: int) -> int:
    return n - (SIMILAR * n + 99) // 100 + 1


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit for the low bits of every token; at least eight bits a token, so that a
    set can be folded to fewer bits by OR of its halves."""
    width = 256
    while width < 8 * len(tokens) and width < 1 << 20:
        width *= 2
    bits = np.zeros(width, np.bool_)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as 8-byte words, folded to ``size`` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id and size of every text's set; its least tokens and its bitmap once for each task."""
    hashes, seen = _WordHashes(), set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = shingle_sets(part.column(2).to_pylist(), hashes)
            sids = [set_id(s) if len(s) else None for s in sets]
            least: list[bytes | None] = []
            bits: list[bytes | None] = []
            for sid, tokens in zip(sids, sets):
                known = sid is None or sid in seen
                if not known and len(seen) < 200_000:
                    seen.add(sid)
                least.append(None if known else tokens[:prefix_size(len(tokens)) + SPARE].tobytes())
                bits.append(None if known else bitmap(tokens))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.int64()),
                 pa.array(least, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "text_key", "n_shingles", "sid", "least", "bits"])


def _repeated_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the tokens met twice or more among a few million of this task, in
    prefixes in the order of the hash. What falls short in every task is left out:
    the order that follows from the counts may be any, it only steers the work."""
    held, total = [], 0

    def flush() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1]), pa.array(n[n > 1])], ["token", "n"])

    for batch in batches:
        for n, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append(np.frombuffer(b.as_py(), np.int64)[:prefix_size(n)])
            total += len(held[-1])
        if total > 2_000_000:
            yield flush()
            held, total = [], 0
    if total:
        yield flush()


def _prefix_tokens(frequent):
    """(sid, n, token) of the prefix with frequent tokens last; token is null, once,
    where the stored tokens do not reach that far."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent()
        for batch in batches:
            parts, lacking = [], []
            for sid, n, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens, first = np.frombuffer(stored.as_py(), np.uint64), prefix_size(n)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, tokens), len(last) - 1)] == tokens
                    whole = len(tokens) == n
                    tokens = np.concatenate((tokens[~late], tokens[late])) if whole else tokens[~late]
                if len(tokens) >= first:
                    parts.append((sid, n, tokens[:first]))
                else:
                    lacking.append((sid, n))
            counts = [len(t) for *_, t in parts]
            sids = np.repeat(np.array([p[0] for p in parts], np.int64), counts)
            sizes = np.repeat(np.array([p[1] for p in parts], np.int64), counts)
            tokens = np.concatenate([t for *_, t in parts]).view(np.int64) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(sizes), pa.array(tokens)], ["sid", "n", "token"])
            if lacking:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in lacking], pa.int64()), pa.array([n for _, n in lacking], pa.int64()),
                                                  pa.nulls(len(lacking), pa.int64())], ["sid", "n", "token"])
    return rows


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = shingle_sets(part.column(1).to_pylist(), hashes)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "n", "tokens"])


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of the column ``key``, FILTER_BITS bits whatever the
    number of keys: it thins rows before a shuffle, lets too many through, never too few."""
    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, np.bool_)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (FILTER_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bits"])

    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in keys.select("key").coalesce(8).mapInArrow(spots, "bits binary").collect():  # at most 8 bitmaps
        whole |= np.frombuffer(zstandard.decompress(bytes(r.bits)), np.uint8)
    return whole


def passing(bits: np.ndarray):
    """A row filter for mapInArrow: rows whose first column may be among the keys."""
    shared = SparkSession.active().sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy() & (FILTER_BITS - 1)
            yield batch.filter(pa.array((known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
    return rows


def sets_of(wanted: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """(sid, n, tokens) of the ids in ``wanted``, from their whole texts."""
    keyed = cut_lineage(rows.where("sid IS NOT NULL").join(wanted.select("sid").distinct(), "sid")
                        .groupBy("sid").agg(F.min("text_key").alias("text_key")))
    thin = passing(key_filter(keyed.select(F.col("text_key").alias("key"))))
    texts = (named.where("text IS NOT NULL").select("text_key", "text").mapInArrow(thin, "text_key long, text string")
             .groupBy("text_key").agg(F.first("text").alias("text")))
    return materialise(texts.join(keyed, "text_key").select("sid", "text").mapInArrow(_set_rows, "sid long, n long, tokens binary"))


def _possible_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that sizes and whole bitmaps leave possible; rows a, b, n_a, n_b, bits_a, bits_b."""
    for batch in batches:
        good = []
        for n, m, left, right in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
            size = min(len(left), len(right))
            x, y = folded(left, size), folded(right, size)
            only_x, only_y = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
            good.append((100 + SIMILAR) * min(n - only_x, m - only_y) >= SIMILAR * (n + m))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def possible_pairs(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return maps.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(f"100 * n_a >= {SIMILAR} * n_b AND 100 * n_b >= {SIMILAR} * n_a")
            .select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_possible_rows, "a long, b long"))


def _linked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that are similar, checked on their whole sets."""
    for batch in batches:
        good = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(side.as_py(), np.uint64) for side in (left, right))
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            good.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    tokens = sets.select("sid", "tokens")
    return (pairs.join(tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("left")), "a")
            .join(tokens.select(F.col("sid").alias("b"), F.col("tokens").alias("right")), "b")
            .select("a", "b", "left", "right").mapInArrow(_linked_rows, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(sid, comp): the smallest id reachable from every id of ``links`` (a, b).

    Labels take the least label around them and then the label of their label,
    until nothing changes; each round is checkpointed.
    """
    both = cut_lineage(links.union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("sid"), "comp"))
    while True:
        around = (both.join(labels.select(F.col("sid").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
                  .select(F.col("a").alias("sid"), "near"))
        step = labels.join(around, "sid").select("sid", F.col("comp").alias("before"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("sid").alias("comp"), F.col("comp").alias("beyond"))
        step = cut_lineage(step.join(jump, "comp", "left").select(
            "sid", "before", F.least("comp", F.coalesce("beyond", "comp")).alias("comp")))
        labels = step.select("sid", "comp")
        if step.where("before <> comp").isEmpty():
            return labels


class SignatureTree:
    """Members in the order of their component and size; every level ORs FANOUT
    nodes of the level below and keeps the ranges of sizes, bits set and components."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        used = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, used, comps, comps)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, least, first, last = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.minimum.reduceat(least, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def possible(self, other: SignatureTree, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x and y, largest possible overlap) of the node pairs whose sets may be similar and apart.

        Components and sizes are compared first; bitmaps are gathered for what is left only, in blocks of bounded bytes.
        """
        bits, low, high, least, first, last = self.levels[level]
        bits_, low_, high_, least_, first_, last_ = other.levels[level]
        apart = ~((first[x] == last[x]) & (first_[y] == last_[y]) & (first[x] == first_[y]))
        sized = (100 * high[x] >= SIMILAR * low_[y]) & (100 * high_[y] >= SIMILAR * low[x])
        at = np.flatnonzero(apart & sized)
        overlap = np.empty(len(at), np.int64)
        step = max(1, GATHER_BYTES // (8 * bits.shape[1]))
        for begin in range(0, len(at), step):
            i, j = x[at[begin:begin + step]], y[at[begin:begin + step]]
            common = np.bitwise_count(bits[i] & bits_[j]).sum(axis=1).astype(np.int64)
            overlap[begin:begin + step] = np.minimum(high[i] - np.maximum(least[i] - common, 0), high_[j] - np.maximum(least_[j] - common, 0))
        good = (100 + SIMILAR) * overlap >= SIMILAR * (low[x[at]] + low_[y[at]])
        return at[good], overlap[good]

    def pairs(self, other: SignatureTree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Member pairs that the bounds leave, with the overlap they may have, by dual traversal from the roots."""
        top = max(len(self.levels), len(other.levels)) - 1
        for tree in (self, other):
            while len(tree.levels) <= top:
                tree.levels.append(tree.levels[-1])
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, x, y = stack.pop()
            if len(x) > OPENED:
                stack += [(level, x[OPENED:], y[OPENED:])]
                x, y = x[:OPENED], y[:OPENED]
            if same:
                ahead = x < y if level == 0 else x <= y
                x, y = x[ahead], y[ahead]
            at, overlap = self.possible(other, level, x, y)
            x, y = x[at], y[at]
            if not len(x):
                continue
            if level == 0:
                yield x, y, overlap
                continue
            below = [len(t.levels[level - 1][0]) if len(t.levels[level - 1][0]) > len(t.levels[level][0]) else None for t in (self, other)]
            for side, many in enumerate(below):
                if many is None:
                    continue
                node, mate = (x, y) if side == 0 else (y, x)
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                mate = np.repeat(mate, FANOUT)
                real = child < many
                x, y = (child[real], mate[real]) if side == 0 else (mate[real], child[real])
            stack.append((level - 1, x, y))


def _tree_pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of row numbers of one group (or of two pieces of it) that signature trees leave, with their possible overlap.

    Sets are taken by the width of their bitmaps: similar sets have equal widths or
    neighbouring ones, so no bitmap is folded to less than half of its bits.
    """
    n, comp, piece = (rows.column(c).to_numpy() for c in ("n", "comp", "piece"))
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    maps = rows.column("bits").to_pylist()
    width = np.array([len(b) for b in maps])

    def tree(number: int, own: int, width_: int) -> tuple[np.ndarray, SignatureTree] | None:
        at = np.flatnonzero((piece == number) & (width == own))
        at = at[np.lexsort((n[at], comp[at]))]
        return (at, SignatureTree(np.stack([folded(maps[k], width_) for k in at]), n[at], comp[at])) if len(at) else None

    for own in np.unique(width).tolist():
        for other in (own, 2 * own):
            for one, two in {(i, j), (j, i)} if other != own else {(i, j)}:
                left, right = tree(one, own, own), tree(two, other, own)
                if left and right:
                    for x, y, overlap in left[1].pairs(left[1] if one == two and other == own else right[1], one == two and other == own):
                        yield left[0][x], right[0][y], overlap


def _small_pairs(rows: pa.Table, begins: np.ndarray, sizes: np.ndarray, first_met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of row numbers inside many small groups that ``first_met`` and one level of bounds leave, with their possible overlap."""
    n, comp, sid = (rows.column(c).to_numpy() for c in ("n", "comp", "sid"))
    first, second = [], []
    for size in np.unique(sizes):
        x, y = np.triu_indices(size, 1)
        at = begins[sizes == size][:, None]
        first.append((at + x).ravel())
        second.append((at + y).ravel())
    x, y = np.concatenate(first), np.concatenate(second)
    keep = (comp[x] != comp[y]) & (100 * n[x] >= SIMILAR * n[y]) & (100 * n[y] >= SIMILAR * n[x])
    x, y = x[keep], y[keep]
    keep = first_met(x, y)
    x, y = x[keep], y[keep]
    low, high = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
    order = np.lexsort((high, low))
    fresh = np.ones(len(order), np.bool_)
    fresh[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    x, y = x[order[fresh]], y[order[fresh]]
    maps = rows.column("bits")
    width = np.array([len(b) for b in maps.to_pylist()])
    common = np.minimum(width[x], width[y])
    overlap = np.zeros(len(x), np.int64)
    for size in np.unique(common):
        some = np.flatnonzero(common == size)
        step = max(1, GATHER_BYTES // (2 * int(size)))
        for at in range(0, len(some), step):
            part = some[at:at + step]
            used, back = np.unique(np.concatenate((x[part], y[part])), return_inverse=True)
            bits = np.stack([folded(b, size) for b in maps.take(pa.array(used)).to_pylist()])
            both = np.bitwise_count(bits[back[:len(part)]] & bits[back[len(part):]]).sum(axis=1, dtype=np.int64)
            alone = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)[back]
            overlap[part] = np.minimum(n[x[part]] - alone[:len(part)] + both, n[y[part]] - alone[len(part):] + both)
    good = (100 + SIMILAR) * overlap >= SIMILAR * (n[x] + n[y])
    return x[good], y[good], overlap[good]


def _best_of_each(a: np.ndarray, b: np.ndarray, estimate: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` of largest estimate of either end."""
    keep = np.zeros(len(a), bool)
    for end, other in ((a, b), (b, a)):
        order = np.lexsort((other, -estimate, end))
        fresh = np.ones(len(order), bool)
        fresh[1:] = end[order][1:] != end[order][:-1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        keep[order[np.arange(len(order)) - first < most]] = True
    return keep


def _earlier_groups(rows: pa.Table, own: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(rows, words): a bit for each group with a smaller token that several rows of this one are in too.

    Bits and tokens are bounded: a bit that is lacking only lets a pair come once more.
    """
    if "tokens" not in rows.column_names:
        return np.zeros((rows.num_rows, 1), np.uint64)
    tokens = rows.column("tokens").combine_chunks()
    flat, counts = tokens.flatten().to_numpy(), tokens.value_lengths().to_numpy()
    row = np.repeat(np.arange(rows.num_rows), counts)
    at = np.flatnonzero(flat < own[row])
    at = at[np.lexsort((flat[at], group[row[at]]))]
    row, flat, place = row[at], flat[at], group[row[at]]
    fresh = np.ones(len(at), np.bool_)
    fresh[1:] = (flat[1:] != flat[:-1]) | (place[1:] != place[:-1])
    met = np.cumsum(fresh) - 1
    several = np.bincount(met)[met] > 1 if len(met) else fresh
    row, place, fresh = row[several], place[several], fresh[several]
    column = np.cumsum(fresh) - 1
    first = np.ones(len(place), np.bool_)
    first[1:] = place[1:] != place[:-1]
    column -= np.maximum.accumulate(np.where(first, column, 0)) if len(column) else 0
    some = column < EARLIER_BITS
    row, column = row[some], column[some]
    out = np.zeros((rows.num_rows, int(column.max()) // 64 + 1 if len(column) else 1), np.uint64)
    np.bitwise_or.at(out, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return out


def _candidate_rows(most: int | None):
    """Pairs (a, b) that the bounds leave, from rows (token, i, j, piece, sid, n, comp, bits, tokens)
    sorted by group; a last group that may go on is kept for the next batch. A pair comes from the
    first of the searched groups that both sets are in (``tokens``: the first of each set's groups, if given).

    With ``most`` only the best few pairs of each set in a group, by the share of both sets
    that they may have in common, and a row with the group's token (a and b null) where
    some were put off.
    """
    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
        begins = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        sizes = np.diff(np.append(begins, rows.num_rows))
        sid, n = rows.column("sid").to_numpy(), rows.column("n").to_numpy()
        small = (sizes <= SMALL) & (sizes > 1)
        earlier = _earlier_groups(rows, keys[0], np.repeat(np.arange(len(sizes)), sizes))
        step = max(1, GATHER_BYTES // (8 * earlier.shape[1]))

        def first_met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Which pairs no earlier group has."""
            return np.concatenate([np.zeros(0, np.bool_), *[~(earlier[x[at:at + step]] & earlier[y[at:at + step]]).any(axis=1) for at in range(0, len(x), step)]])

        def best(x: np.ndarray, y: np.ndarray, overlap: np.ndarray) -> np.ndarray:
            return _best_of_each(np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y]), overlap / (n[x] + n[y] - overlap), most)

        late: set[int] = set()

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            if small.any():
                yield _small_pairs(rows, begins[small], sizes[small], first_met)
            for begin, size in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                held, count = [], 0
                for x, y, overlap in _tree_pairs(rows.slice(begin, size).combine_chunks()):
                    keep = first_met(begin + x, begin + y)
                    held.append((begin + x[keep], begin + y[keep], overlap[keep]))
                    count += len(held[-1][0])
                    if count > HELD:
                        pairs = tuple(np.concatenate(c) for c in zip(*held))
                        if most is None:  # all pairs go on as they are met
                            yield pairs
                            held, count = [], 0
                        else:  # what is not among the best of these is not among the best of more
                            keep = best(*pairs)
                            if not keep.all():
                                late.add(int(keys[0][begin]))
                            held = [tuple(c[keep] for c in pairs)]
                            count = 0
                if held:
                    yield tuple(np.concatenate(c) for c in zip(*held))

        for x, y, overlap in found():
            low, high = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
            if most is not None and len(x):
                keep = best(x, y, overlap)
                late.update(np.unique(keys[0][x[~keep]]).tolist())
                low, high = low[keep], high[keep]
            pairs = np.unique(np.stack((low, high)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], ["a", "b", "token"])
        if late:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(late), pa.int64()), pa.nulls(len(late), pa.int64()), pa.array(sorted(late), pa.int64())], ["a", "b", "token"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            keys = [batch.column(k) for k in range(3)]
            if all(k[0] == k[-1] for k in keys):
                continue  # one group so far
            keys = np.stack([c.to_numpy() for c in held.select([0, 1, 2]).columns])
            cut = int(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[-1]) + 1
            yield from search(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from search(held.combine_chunks())
    return groups


def _closed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of every document with its set's id, component of every linked set); both are written."""
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    rows = materialise(named.mapInArrow(
        _document_rows, "doc_id long, text_key long, n_shingles long, sid long, least binary, bits binary"))
    stored = rows.where("least IS NOT NULL").select("sid", F.col("n_shingles").alias("n"), "least")

    often = (stored.select("n", "least").mapInArrow(_repeated_tokens, "token long, n long")
             .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
             .orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).select("token").toPandas())
    shared = spark.sparkContext.broadcast(np.sort(often.token.to_numpy(np.int64).view(np.uint64)))
    tokens = stored.mapInArrow(_prefix_tokens(lambda: shared.value), "sid long, n long, token long")
    deeper = sets_of(tokens.where("token IS NULL").select("sid"), rows, named)
    prefixes = tokens.where("token IS NOT NULL").unionByName(
        deeper.select("sid", "n", F.col("tokens").alias("least")).mapInArrow(
            _prefix_tokens(lambda: shared.value), "sid long, n long, token long"))
    # Only tokens of two sets or more go on: a bitmap of those seen twice thins the rows, then their sets are compared.
    twice = key_filter(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.col("token").alias("key")))
    some = materialise(prefixes.select(F.col("token").alias("key"), "sid", "n").mapInArrow(
        passing(twice), "key long, sid long, n long").withColumnRenamed("key", "token").distinct())
    groups = some.groupBy("token").agg(F.count(F.lit(1)).alias("g")).where("g >= 2")
    members = materialise(some.join(groups, "token"))
    maps = materialise(rows.where("bits IS NOT NULL").join(members.select("sid").distinct(), "sid", "left_semi")
                       .groupBy("sid").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits")))

    def links_among(pairs: DataFrame) -> DataFrame:
        left = cut_lineage(possible_pairs(pairs, maps))
        ends = left.select(F.col("a").alias("sid")).union(left.select("b"))
        return cut_lineage(checked(left, sets_of(ends, rows, named)))

    # A group's centre is the member that shares most tokens with most sets: the text that many copies come from.
    hubs = members.groupBy("sid").agg(F.sum("g").alias("hub"))
    centres = members.join(hubs, "sid").groupBy("token").agg(F.max(F.struct("hub", "sid", "n")).alias("centre"))
    near = (members.join(centres, "token").where("sid <> centre.sid")
            .where(f"100 * n >= {SIMILAR} * centre.n AND 100 * centre.n >= {SIMILAR} * n")
            .groupBy("sid", F.col("centre.sid").alias("other")).agg(F.count(F.lit(1)).alias("shared"), F.max("centre.hub").alias("hub")))
    stars = near.groupBy("sid").agg(F.max(F.struct("shared", "other"))["other"].alias("most"), F.max(F.struct("hub", "other"))["other"].alias("top"))
    first = links_among(stars.select(F.col("sid").alias("a"), F.explode(F.array_distinct(F.array("most", "top"))).alias("b"))
                        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    comps = components(first)

    def tree_view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [max(min(128, len(b)), len(b) * TREE_BITS // 8) for b in batch.column(1).to_pylist()]
            bits = [folded(b, k).tobytes() for b, k in zip(batch.column(1).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["sid", "bits"])

    views = maps.select("sid", "bits").mapInArrow(tree_view, "sid long, bits binary")

    def candidates(groups: DataFrame, comps: DataFrame, most: int | None) -> DataFrame:
        """Candidate rows of the groups of ``groups`` (token, sid, n) that hold more than one component."""
        labelled = materialise(groups.join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")))
        # Tokens of one passage mostly have the same members: of groups with equal member hashes one is searched.
        member_hash = [F.bit_xor(F.xxhash64("sid", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
        still = (labelled.groupBy("token").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *member_hash)
                 .where("lo <> hi").groupBy("g", "x1", "x2").agg(F.min("token").alias("token"))
                 .select("token", (F.ceil(F.col("g") / PIECE)).cast("int").alias("pieces")))
        grouped = labelled.join(still, "token")
        # The first groups of every set, so that a pair that shares many of them comes once.
        listed = views.join(grouped.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("token")), 1, EARLIER_TOKENS).alias("tokens")), "sid")
        # In a group that is one piece, sets without another of fitting size go before bitmaps are fetched.
        by_size = Window.partitionBy("token").orderBy("n", "sid")
        alone = grouped.where("pieces = 1").withColumns({"lower": F.lag("n").over(by_size), "upper": F.lead("n").over(by_size)})
        alone = alone.where(f"100 * lower >= {SIMILAR} * n OR 100 * n >= {SIMILAR} * upper").drop("lower", "upper")
        grouped = grouped.where("pieces > 1").unionByName(alone)
        placed = (grouped.withColumn("piece", F.pmod(F.xxhash64("sid"), F.col("pieces")).cast("int"))
                  .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
                  .withColumn("i", F.least("piece", "other")).withColumn("j", F.greatest("piece", "other")))
        return (placed.join(listed, "sid").select("token", "i", "j", "piece", "sid", "n", "comp", "bits", "tokens")
                .repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
                .mapInArrow(_candidate_rows(most), "a long, b long, token long"))

    # The best few pairs of every set first: their links join most of a family, so that the rest of its pairs need no look.
    members = members.select("token", "sid", "n")
    some = materialise(candidates(members, comps, FIRST_BEST))
    second = first.unionByName(links_among(some.where("a IS NOT NULL").select("a", "b").distinct()))
    comps = components(second)
    late = some.where("token IS NOT NULL").select("token").distinct()
    rest = candidates(members.join(late, "token"), comps, None).select("a", "b").distinct()
    tried = some.where("a IS NOT NULL").select("a", "b").distinct()
    closed = components(second.unionByName(links_among(rest.join(tried, ["a", "b"], "left_anti"))))

    return materialise(rows.select("doc_id", "text_key", "n_shingles", "sid"), keep=True), closed


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and component (its own key, null
    without shingles) for every row of ``docs``.

    Two documents link when 100 * intersection >= 80 * union of their shingle
    sets; component_id is the smallest doc_id reachable. A null or empty text has
    no shingles and links with nothing; rows with equal texts are linked; repeated
    doc_ids are rows of their own; extra columns are ignored; an empty table gives
    no rows. Sets are told apart by 64-bit hashes of their hashed shingles.
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS), scratch(docs.sparkSession):
        rows, closed = _closed(docs)
    whole = rows.join(closed, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = whole.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return whole.join(least, "comp", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("comp").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component only (of rows
    that share it, the one with the least text hash). Rows without a doc_id cannot
    be told apart and stay."""
    columns = docs.columns
    known = docs.where("doc_id IS NOT NULL")
    found = link_components(known)
    alone = F.when(F.col("component").isNull(), F.struct("doc_id", "text_key"))
    stay = (found.groupBy("component", alone.alias("alone")).agg(F.min(F.struct("doc_id", "text_key")).alias("stay"))
            .select("stay.*"))
    keyed = known.withColumn("text_key", F.xxhash64("text"))
    kept = keyed.join(stay, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select(*columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))
