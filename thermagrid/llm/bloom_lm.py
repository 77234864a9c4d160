"""Language-model scores from a log-frequency Bloom filter."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, fold, materialise, mix64

#: Bytes of text that one slice of the n-gram space stands for, tokens gathered before a flush.
SLICE_BYTES, FLUSH_TOKENS = 8 << 20, 2_000_000
#: Growth of the counts from one quantisation level to the next.
LEVEL_BASE = 1.5
#: Filter: bits and probes for each inserted key.
BITS_PER_KEY, PROBES = 10, 4
#: Weight of the pair estimate and its absolute discount.
PAIR_WEIGHT, DISCOUNT = 0.25, 0.75
END, START = 1, 2


class Vocabulary(dict):
    """Word -> running number; ``hashes`` has each word's 64-bit hash."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, each text closed by the end token 0, and tokens by text."""
        parts, sizes = [], np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            # bytes.lower and bytes.split know ASCII letters and the six ASCII spaces only
            words = text.encode().lower().split() if text else ()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
            sizes[k] = len(words) + 1
        return (np.concatenate(parts) if parts else np.empty(0, np.int64)), sizes


def pair_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Key of (previous token, token) for every token; a text's first token follows START."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    if len(hashes):
        before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = np.uint64(START)
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + hashes) | np.uint64(1)


def pack_sorted(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes, compressed; then the counts."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(keys).to_bytes(8, "little") + zstandard.compress(planes, 1)


def unpack_sorted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8)
    steps = np.ascontiguousarray(planes[:8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(planes[8 * n:].reshape(4, n).T).view(np.uint32).ravel()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez(held, *arrays)
    return zstandard.compress(held.getvalue(), 1)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(zstandard.decompress(blob))) as held:
        return [held[f"arr_{k}"] for k in range(len(held.files))]


def to_planes(values: np.ndarray) -> np.ndarray:
    """Byte planes: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def from_planes(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def gather_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, size, blob) from rows of doc_id, asked, learnt, text: each task takes a
    few million tokens at a time, a chunk, and keeps their numbers, its words' hashes
    and the rows they stand in. ``size`` is the chunk's bytes of text; a chunk with
    nothing asked has no number. Whoever needs the chunks twice writes them once:
    rows that come in another order a second time would be numbered otherwise.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, total, size = Vocabulary(), [], 0, 0
        chunk = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids, known, asked, learnt, numbers, sizes = map(np.concatenate, zip(*held))
            blob = pack_arrays(ids, known, asked, learnt, sizes, to_planes(numbers.astype(np.uint32)),
                               np.array(vocabulary.hashes, np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([chunk if asked.any() else None], pa.int64()), pa.array([size], pa.int64()),
                                               pa.array([blob], pa.binary())], ["chunk", "size", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                numbers, sizes = vocabulary.numbers(part.column(3).to_pylist())
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                             *(part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)), numbers, sizes))
                total += len(numbers)
                size += pc.sum(pc.binary_length(part.column(3))).as_py() or 0
                if total >= FLUSH_TOKENS:
                    yield flush()
                    vocabulary, held, total, size, chunk = Vocabulary(), [], 0, 0, chunk + 1
        if total:
            yield flush()

    return rows.select("doc_id", "asked", "learnt", "text").mapInArrow(gather, "chunk long, size long, blob binary")


def runs_of_chunks(chunks: DataFrame, slices: int) -> DataFrame:
    """(kind, slice, chunk, blob): of each chunk one compressed sorted run for each
    slice of the key space, of words (kind 'w') and of word pairs (kind 'p'), with
    the uses in rows to learn from (0 for keys only asked for). A frequent word is
    one entry of each run, so no key is hot."""
    bounds = slice_bounds(slices)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, _, learnt, sizes, planes, hashes = unpack_arrays(blob.as_py())
                numbers = from_planes(planes, np.uint32).astype(np.int64)
                learns = np.repeat(learnt, sizes)
                uses = np.bincount(numbers[learns], minlength=len(hashes))
                order = np.argsort(hashes, kind="stable")
                # The lowest bit of a pair's key is free: it tells the uses to learn from.
                keys = np.sort((pair_keys(hashes[numbers], sizes) ^ np.uint64(1)) | learns.astype(np.uint64))
                counts, keys = (keys & np.uint64(1)).astype(np.int64), keys | np.uint64(1)
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                out = []
                for kind, every, n in (("w", hashes[order], uses[order]), ("p", keys[first], np.add.reduceat(counts, first))):
                    cuts = [0, *np.searchsorted(every, bounds), len(every)]
                    out += [(kind, k, number, pack_sorted(every[cuts[k]:cuts[k + 1]], n[cuts[k]:cuts[k + 1]]))
                            for k in range(slices) if cuts[k + 1] > cuts[k]]
                for at in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out[at:at + 64]), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["kind", "slice", "chunk", "blob"])

    return chunks.select("chunk", "blob").mapInArrow(split, "kind string, slice int, chunk long, blob binary")


def starts_of_levels(most: int = 1 << 62) -> np.ndarray:
    """Least count of each level: 1, 2, 3, then about LEVEL_BASE times the last."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * LEVEL_BASE)))
    return np.array(out, np.float64)


LEVELS = starts_of_levels()
#: What a level stands for: the geometric middle of its counts; level 0 is unseen.
VALUES = np.concatenate(([0.0], np.sqrt(LEVELS[:-1] * np.maximum(LEVELS[1:] - 1, LEVELS[:-1]))))


def quantise(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def slice_bounds(number: int) -> np.ndarray:
    """Where the slices of the 64-bit key space begin, without the first."""
    return np.array([(k << 64) // number for k in range(1, number)], np.uint64)


def probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and step (before the remainder) of the pair (key, level)."""
    one = mix64(keys + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    return one, ((one >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


class LogBloom:
    """A Bloom filter of (key, level): a key of level q is inserted with levels
    ``least``..q, so its level is found by asking for one level after the other
    until a miss. Each slice of the key space has its own range of bits."""

    def __init__(self, slices: dict[int, bytes], number: int, least: int):
        self.bounds, self.least = slice_bounds(number), least
        sizes = np.zeros(number, np.int64)
        for k, bits in slices.items():
            sizes[k] = len(bits)
        self.base = (np.cumsum(sizes) - sizes) * 8
        self.bits_of = (sizes * 8).astype(np.uint64)
        self.data = np.frombuffer(b"".join(slices[k] for k in sorted(slices)), np.uint8)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, bits_per_key: int, least: int) -> bytes:
        levels = quantise(counts)
        inserted = int(np.maximum(levels - least + 1, 0).sum())
        size = max(8, -(-inserted * bits_per_key // 8) * 8)
        bits = np.zeros(size, np.bool_)
        for level in range(least, int(levels.max(initial=0)) + 1):
            spot, step = probes(keys[levels >= level], level)
            for _ in range(PROBES):
                bits[spot % np.uint64(size)] = True
                spot = spot + step
        return np.packbits(bits).tobytes()

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        part = np.searchsorted(self.bounds, keys, side="right")
        at = np.flatnonzero(self.bits_of[part] > 0)
        keys, part, level = keys[at], part[at], self.least
        while len(at):
            base, bits = self.base[part], self.bits_of[part]
            spot, step = probes(keys, level)
            live = np.arange(len(at))
            for _ in range(PROBES):
                place = base[live] + (spot[live] % bits[live]).astype(np.int64)
                live = live[(self.data[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
                spot[live] += step[live]
            at, keys, part = at[live], keys[live], part[live]
            out[at] = level
            level += 1
        return out


def answer_runs(runs: DataFrame) -> DataFrame:
    """(kind, slice, chunk, n, v, blob): for each run the filter's level of each of
    its keys, and of words the exact count too; n uses and v keys learnt of the
    slice stand on one row without a chunk.

    The task of a slice merges its runs, builds the slice's filter of all its keys
    and asks it, so the filter as a whole grows with the keys and no process holds
    more than a slice of it.
    """
    def answer(table: pa.Table) -> pa.Table:
        kind, k = table.column("kind")[0].as_py(), table.column("slice")[0].as_py()
        parts = [unpack_sorted(b.as_py()) for b in table.column("blob")]
        ends = np.cumsum([len(p[0]) for p in parts])
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        first = np.flatnonzero(new)
        every, total = keys[order][first], np.add.reduceat(counts[order].astype(np.int64), first)
        learnt = total > 0
        bloom = LogBloom({0: LogBloom.build(every[learnt], total[learnt], BITS_PER_KEY, 1)}, 1, 1)
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        levels = bloom.level(every).astype(np.uint8)[place]
        exact = total[place] if kind == "w" else None
        rows = [(kind, k, None, int(total.sum()), int(learnt.sum()), None)]
        for chunk, end, part in zip(table.column("chunk").to_pylist(), ends.tolist(), parts):
            if chunk is not None:
                at = slice(end - len(part[0]), end)
                blob = levels[at].tobytes() + (to_planes(exact[at]).tobytes() if kind == "w" else b"")
                rows.append((kind, k, chunk, 0, 0, zstandard.compress(blob, 1)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "slice", "chunk", "n", "v", "blob"])

    return runs.groupBy("kind", "slice").applyInArrow(answer, "kind string, slice int, chunk long, n long, v long, blob binary")


def score_rows(rows: DataFrame) -> DataFrame:
    """``score`` of the rows with ``asked``, learnt from those with ``learnt``."""
    chunks = materialise(gather_chunks(rows))
    size = chunks.agg(F.sum("size").alias("b")).first().b or 0
    with arrow_batches(rows.sparkSession, 16):  # a chunk has some megabytes
        answers = materialise(answer_runs(runs_of_chunks(chunks, max(4, -(-size // SLICE_BYTES)))))
    totals = answers.where("kind = 'w' AND chunk IS NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens = totals.n or 0
    below = float(tokens + (totals.v or 0) + 1)

    def rate(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("kind").to_pylist(), table.column("slice").to_pylist(), range(table.num_rows)))
        blobs = {kind: [table.column("blob")[at].as_py() for x, _, at in found if x == kind] for kind in "twp"}
        ids, valid, asked, _, sizes, planes, hashes = unpack_arrays(blobs["t"][0])
        numbers = from_planes(planes, np.uint32).astype(np.int64)
        order, levels, exact = np.argsort(hashes, kind="stable"), [], []
        for blob in blobs["w"]:
            plain = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(9, -1)
            levels.append(plain[0])
            exact.append(from_planes(plain[1:], np.int64))
        value, known = np.empty(len(hashes)), np.empty(len(hashes), np.int64)
        value[order], known[order] = VALUES[np.concatenate(levels)], np.concatenate(exact)
        _, place = np.unique(pair_keys(hashes[numbers], sizes), return_inverse=True)
        seen = VALUES[np.concatenate([np.frombuffer(zstandard.decompress(b), np.uint8) for b in blobs["p"]])][place]
        begins = np.cumsum(sizes) - sizes
        single = value[numbers]
        context = np.empty_like(single)
        context[1:] = single[:-1]
        context[begins] = np.maximum(value[0], 1.0)  # as many starts as ends
        p1 = (single + 1.0) / below
        p2 = np.minimum(np.maximum(seen - DISCOUNT, 0.0) / np.maximum(np.maximum(context, seen), 1.0), 1.0)
        logs = np.log10((1 - PAIR_WEIGHT) * p1 + PAIR_WEIGHT * p2)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~valid), "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((known > 0)[numbers].astype(np.int64), begins)),
            "train_tokens": pa.array(np.full(len(sizes), tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10((known + 1.0) / below)[numbers], begins)),
            "score": pa.array(np.add.reduceat(logs, begins))}).filter(pa.array(asked))

    columns = ["kind", "slice", "chunk", "blob"]
    texts = chunks.select(F.lit("t").alias("kind"), F.lit(0).alias("slice"), "chunk", "blob")
    return (texts.where("chunk IS NOT NULL").union(answers.where("chunk IS NOT NULL").select(columns))
            .groupBy("chunk").applyInArrow(rate, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of
    ``docs``, learnt from the whole texts of ``train``.

    base_score is exact. The score of a token is (1 - w) p1 + w p2 with p1 the
    add-one word estimate and p2 the absolutely discounted pair estimate, all
    counts read from the filters of words and of all pairs seen at least once; a
    miss is certain, a rare false hit counts as the lowest level. A null text is
    empty: its end token alone is scored. Repeated rows are scored each; with no
    training rows N and V are 0; an empty ``docs`` gives no rows; extra columns
    are ignored.
    """
    def rows(df: DataFrame, doc_id: Column, asked: bool) -> DataFrame:
        return df.select(doc_id.cast("long").alias("doc_id"), F.lit(asked).alias("asked"), F.lit(not asked).alias("learnt"), "text")
    return score_rows(rows(docs, F.col("doc_id"), True).union(rows(train, F.lit(None), False)))


def score_folds(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """``score`` learnt from the rows outside the held-out fold, with held_out."""
    out = fold(F.col("doc_id"), parts) == held
    return score_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("asked"),
                                  F.coalesce(~out, F.lit(False)).alias("learnt"), "text")).withColumn("held_out", out)
