"""Removal of byte strings that repeat anywhere, by partitioned suffix sorting.

A byte goes when a string of ``length`` bytes that covers it starts at another
place too. The suffixes to compare are all positions of all texts, far too many
to ship with their leading bytes, so they are thinned without loss first:

1. Winnowing names, for every position, an anchor inside its ``length`` bytes: the
   least hashed string of ``anchor`` bytes. Equal strings have equal anchors at the same
   offset, so only positions whose anchor's string occurs twice go on.
2. The positions of an anchor are taken in blocks of neighbouring offsets. The
   bytes that all strings of a block share (inner) must repeat for any of them to
   repeat; when the bytes they cover together (outer) repeat, all of them do.
   Counting these two hashes decides whole blocks, first of 32, then of 4; only
   blocks on the edge of a repeat stay open.
3. The suffixes of open blocks are range-partitioned by their leading bytes with
   sampled splitters, each bucket is sorted by multikey quicksort, and equal
   neighbours are repeats. Splitters compare all leading bytes, so equal suffixes
   never lie on two sides of a boundary.

Counts are summed before they are shuffled and equal strings travel once for a
batch, so a passage that a third of all documents share is no hot task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, scratch

WIDE, NARROW = 32, 4
#: Suffixes that a bucket is meant to hold in memory: their number sets that of the buckets.
BUCKET_SUFFIXES = 100_000


@dataclass(frozen=True)
class Strings:
    """The strings that are compared: ``length`` bytes (a multiple of 8), named by anchors of ``anchor`` bytes inside them."""

    length: int = 400
    anchor: int = 200

    @property
    def reach(self) -> int:
        return self.length - self.anchor + 1


STRINGS = Strings()

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION_BITS = 24


class Rolling:
    """Hashes of any stretches of a byte string: sums of hashed bytes times powers
    of an odd base, modulo 2^64, whatever their place."""

    codes = mix64(np.arange(1, 257, dtype=np.uint64))
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        size = len(data)
        if len(Rolling.up) <= size:
            powers = np.full(2 * size + 1024, _BASE, np.uint64)
            inverses = np.full(2 * size + 1024, _INVERSE, np.uint64)
            powers[0] = inverses[0] = 1
            Rolling.up, Rolling.down = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(Rolling.codes[np.frombuffer(data, np.uint8)] * Rolling.down[:size], dtype=np.uint64, out=self.sums[1:])

    def stretch(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * Rolling.up[begin])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by least-so-far from both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(rolling: Rolling, size: int, of: Strings = STRINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, least offset, largest offset, key) for each run of positions with one
    anchor; offset is anchor minus position. Ties go to the last equal hash."""
    begin = np.arange(size - of.anchor + 1)
    keys = rolling.stretch(begin, begin + of.anchor)
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    ranked = (keys & ~mask) | (mask - (begin.astype(np.uint64) & mask))
    at = (mask - (sliding_least(ranked, of.reach) & mask)).astype(np.int64)
    if size > 1 << _POSITION_BITS:  # the position's low bits: the anchor is less than the reach ahead
        position = np.arange(len(at))
        at = position + ((at - position) & int(mask))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    anchor = at[first]
    return anchor, anchor - last, anchor - first, keys[anchor]


def blocks(rolling: Rolling, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, of: Strings = STRINGS):
    """Offsets low..high of every anchor cut at multiples of ``width``:
    (row, anchor, low, high, inner, outer)."""
    number = high // width - low // width + 1
    row = np.repeat(np.arange(len(anchor)), number)
    cell = low[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    at, least, most = anchor[row], np.maximum(low[row], cell * width), np.minimum(high[row], cell * width + width - 1)
    inner_from = at - cell * width
    inner = mix64(rolling.stretch(inner_from, inner_from - width + 1 + of.length) + cell.astype(np.uint64))
    outer = mix64(rolling.stretch(at - most, at - least + of.length) + ((least << 20) + most).astype(np.uint64))
    return row, at, least, most, inner.view(np.int64), outer.view(np.int64)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of its equals) of rows of 8-byte characters, by multikey
    quicksort: groups that still agree are split on the next character."""
    n = len(words)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # by place in the order
    open_rows = np.arange(n) if n > 1 else np.empty(0, np.int64)
    for depth in range(words.shape[1]):
        if not len(open_rows):
            break
        key = words[order[open_rows], depth]
        by = np.lexsort((key, group[open_rows]))
        order[open_rows] = order[open_rows][by]
        key = key[by]
        inside = group[open_rows]
        fresh = np.concatenate(([True], (inside[1:] != inside[:-1]) | (key[1:] != key[:-1])))
        group[open_rows] = open_rows[np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))]
        size = np.bincount(np.cumsum(fresh) - 1)
        open_rows = open_rows[np.repeat(size > 1, size)]
    return order, group


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _rows(parts: list[tuple], names: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Record batches from (rid, arrays...) parts."""
    if parts:
        rids = pa.array([p[0] for p in parts], pa.binary()).take(
            pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
        arrays = [pa.array(np.concatenate([p[k] for p in parts])).cast(kind) for k, (_, kind) in enumerate(names, 1)]
        yield pa.RecordBatch.from_arrays([rids, *arrays], ["rid", *[n for n, _ in names]])


def _anchor_rows(of: Strings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            parts = []
            for rid, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if rid in seen:  # a copy adds nothing: copies are known by their hash
                    continue
                if len(seen) < 200_000:
                    seen.add(rid)
                data = data.as_py()
                keys, n = np.unique(anchors(Rolling(data), len(data), of)[3], return_counts=True)
                parts.append((rid, keys.view(np.int64), np.minimum(n, 2)))
            yield from _rows(parts, [("key", pa.int64()), ("n", pa.int32())])
    return rows


def _block_rows(of: Strings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rid, data, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = data.as_py()
                rolling = Rolling(data)
                anchor, low, high, key = anchors(rolling, len(data), of)
                repeated = np.isin(key.view(np.int64), keys.values.to_numpy())
                _, at, least, most, inner, outer = blocks(rolling, anchor[repeated], low[repeated], high[repeated], WIDE, of)
                _, first, n = np.unique(outer, return_index=True, return_counts=True)
                parts.append((rid, inner[first], outer[first], np.minimum(n, 2), at[first], least[first], most[first]))
            yield from _rows(parts, [("inner", pa.int64()), ("outer", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()),
                                     ("low", pa.int32()), ("high", pa.int32())])
    return rows


_CONTEXT = pa.schema([("rid", pa.binary()), ("anchor", pa.int32()), ("cell", pa.int32()), ("low", pa.int32()),
                      ("high", pa.int32()), ("n", pa.int64()), ("context", pa.binary())])


def _context_rows(of: Strings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _CONTEXT.names}
            for rid, data, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for a in asked:
                    values = (rid, a["anchor"], a["low"] // WIDE, a["low"], a["high"], a["n"],
                              data[a["anchor"] - a["high"]:a["anchor"] - a["low"] + of.length])
                    for name, value in zip(_CONTEXT.names, values):
                        out[name].append(value)
            yield _batch(out, _CONTEXT)
    return rows


def _narrow_rows(of: Strings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, low, high, n = (batch.column(k).to_numpy() for k in (1, 3, 4, 5))
            contexts = batch.column(6).to_pylist()
            sizes = [len(c) for c in contexts]
            rolling = Rolling(b"".join(contexts))
            place = np.cumsum(sizes) - sizes + high  # the anchors, in the joined contexts
            row, _, least, most, inner, outer = blocks(rolling, place.astype(np.int64), low.astype(np.int64), high.astype(np.int64), NARROW, of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(anchor[row]), pa.array((low // WIDE)[row].astype(np.int32)), pa.array(n[row]),
                 pa.array(inner), pa.array(outer), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32))],
                ["rid", "anchor", "cell", "n", "inner", "outer", "low", "high"])
    return rows


_SUFFIX = pa.schema([("suffix", pa.binary()), ("n", pa.int64()), ("rids", pa.list_(pa.binary())), ("places", pa.list_(pa.int64()))])


def _suffix_rows(of: Strings):
    """Suffixes of open blocks, cut to the length; equal ones of a batch once, with their places."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, tuple[list, list, list]] = {}
            for r in batch.to_pylist():
                for offset in range(r["low"], r["high"] + 1):
                    begin = r["context_high"] - offset
                    counts, rids, places = found.setdefault(r["context"][begin:begin + of.length], ([0], [], []))
                    counts[0] += r["n"]
                    if r["n"] == 1:
                        rids.append(r["rid"])
                        places.append(r["anchor"] - offset)
            yield _batch({"suffix": list(found), "n": [f[0][0] for f in found.values()],
                          "rids": [f[1] for f in found.values()], "places": [f[2] for f in found.values()]}, _SUFFIX)
    return rows


def _sorted_repeats(of: Strings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            bucket = pa.Table.from_batches(held)
            n = bucket.column("n").to_numpy()
            data = b"".join(bucket.column("suffix").to_pylist())
            order, group = multikey_order(np.frombuffer(data, ">u8").reshape(len(n), of.length // 8))
            total = np.bincount(group, n[order], len(n))[group]
            for row in bucket.select(["rids", "places"]).take(pa.array(order[total >= 2])).to_pylist():
                if row["rids"]:
                    yield pa.RecordBatch.from_arrays([pa.array(row["rids"], pa.binary()), pa.array(row["places"], pa.int64()),
                                                      pa.array(row["places"], pa.int64())], ["rid", "first", "last"])
    return rows


def _cut_rows(of: Strings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, data, outers, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                data = data.as_py()
                starts = np.zeros(len(data) + 1, np.int64)
                if outers.is_valid and len(outers.values):
                    rolling = Rolling(data)
                    anchor, low, high, _ = anchors(rolling, len(data), of)
                    _, at, least, most, _, outer = blocks(rolling, anchor, low, high, WIDE, of)
                    hit = np.isin(outer, outers.values.to_numpy())
                    np.add.at(starts, (at - most)[hit], 1)
                    np.add.at(starts, (at - least)[hit] + of.length, -1)
                for r in ranges.as_py() or ():
                    starts[r["first"]] += 1
                    starts[r["last"] + of.length] -= 1
                gone = np.cumsum(starts[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((rid, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.nulls(0, k) for k in kinds],
                                             ["rid", "n_removed", "n_spans", "kept_sha256", "kept"])
    return rows


def _decided(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outers that repeat, one row of each outer whose inner group is still open)."""
    groups = counted.groupBy("inner").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    open_rows = counted.join(groups.where("kinds >= 2 AND least < 2").select("inner"), "inner")
    return counted.where("n >= 2").select("inner", "outer"), open_rows.select("at.*", "n")


def _repeated_ids(docs: DataFrame) -> DataFrame:
    """docs with rid (96 bits of the text's SHA-256), n_bytes and the whole hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.withColumn("whole_sha", F.sha2(text, 256)).withColumn("n_bytes", F.octet_length(text).cast("long"))
            .withColumn("rid", F.unhex(F.substring("whole_sha", 1, 24))))


def _marked(named: DataFrame, of: Strings) -> tuple[DataFrame, DataFrame]:
    """(texts with a repeated anchor, what goes of each: hashes of whole blocks and ranges of places); both are written."""
    long_rows = named.where(F.col("n_bytes") >= of.length).select("rid", F.col("text").cast("binary").alias("data"))
    keys = long_rows.mapInArrow(_anchor_rows(of), "rid binary, key long, n int")
    twice = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2").select("key")
    asked = keys.select("rid", "key").join(twice, "key").groupBy("rid").agg(F.collect_set("key").alias("keys"))
    once = long_rows.groupBy("rid").agg(F.first("data").alias("data"))
    texts = materialise(once.join(asked, "rid"), keep=True)

    place = F.min(F.struct("rid", "anchor", "low", "high")).alias("at")
    wide = materialise(texts.mapInArrow(_block_rows(of), "rid binary, inner long, outer long, n int, anchor int, low int, high int"))
    repeated, still = _decided(materialise(wide.groupBy("inner", "outer").agg(F.sum("n").alias("n"), place)))
    outers = wide.select("rid", "inner", "outer").join(repeated, ["inner", "outer"]).groupBy("rid").agg(F.collect_set("outer").alias("outers"))

    wanted = still.groupBy("rid").agg(F.collect_list(F.struct("anchor", "low", "high", "n")).alias("asked"))
    contexts = materialise(texts.select("rid", "data").join(wanted, "rid").mapInArrow(
        _context_rows(of), "rid binary, anchor int, cell int, low int, high int, n long, context binary"))
    narrow = materialise(contexts.mapInArrow(
        _narrow_rows(of), "rid binary, anchor int, cell int, n long, inner long, outer long, low int, high int"))
    repeated, still = _decided(narrow.groupBy("inner", "outer").agg(
        F.sum("n").alias("n"), F.min(F.struct("rid", "anchor", "cell", "low", "high")).alias("at")))
    some = narrow.where("n = 1").join(repeated, ["inner", "outer"]).select(
        "rid", (F.col("anchor") - F.col("high")).cast("long").alias("first"), (F.col("anchor") - F.col("low")).cast("long").alias("last"))
    still = materialise(still)
    open_suffixes = still.agg(F.coalesce(F.sum(F.col("high") - F.col("low") + 1), F.lit(0)).alias("n")).first().n
    buckets = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-open_suffixes // BUCKET_SUFFIXES))
    suffixes = (still.join(contexts.select("rid", "anchor", "cell", F.col("high").alias("context_high"), "context"), ["rid", "anchor", "cell"])
                .mapInArrow(_suffix_rows(of), "suffix binary, n long, rids array<binary>, places array<long>"))
    single = suffixes.repartitionByRange(buckets, "suffix").mapInArrow(_sorted_repeats(of), "rid binary, first long, last long")
    ranges = some.unionByName(single).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    return texts, materialise(outers.join(ranges, "rid", "full"), keep=True)


def cut_texts(named: DataFrame, of: Strings = STRINGS) -> DataFrame:
    """(rid, n_removed, n_spans, kept_sha256, kept) of every distinct text that loses
    bytes to another text or to itself; copies of whole texts are left to the caller."""
    with scratch(named.sparkSession):
        texts, marks = _marked(named, of)
    return texts.select("rid", "data").join(marks, "rid").mapInArrow(
        _cut_rows(of), "rid binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeat_report(docs: DataFrame, of: Strings = STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Texts are UTF-8 bytes, null is empty; matches stay inside a document; a text
    shorter than the strings loses nothing; of a text that occurs twice as a whole
    nothing is left (if it is long enough). Extra columns are ignored; an empty
    table gives no rows.
    """
    named = _repeated_ids(docs.select("doc_id", "text"))
    slim = named.select("doc_id", "rid", "n_bytes", "whole_sha")
    copies = slim.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"))
    cut = cut_texts(named, of).drop("kept")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= of.length)
    return slim.join(copies, "rid").join(cut, "rid", "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha")).alias("kept_sha256"))


def cut_documents(docs: DataFrame, of: Strings = STRINGS) -> DataFrame:
    """``docs`` without the repeated bytes: text and n_chars (if there) follow.

    A character of which only some bytes are left goes too, so that texts stay
    UTF-8. Documents that lose their whole text are left out; null, empty and
    short texts stay as they are.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*columns).alias("row"), "text")
    named = _repeated_ids(packed)

    def whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [None if b is None else b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["rid", "kept_text"])

    cut = (cut_texts(named, of).where("n_removed > 0").select("rid", "kept")
           .mapInArrow(whole_characters, "rid binary, kept_text string"))
    twice = named.groupBy("rid", "n_bytes").agg(F.count(F.lit(1)).alias("copies")).where(
        (F.col("copies") > 1) & (F.col("n_bytes") >= of.length)).select("rid", F.lit("").alias("nothing"))
    marks = cut.join(twice, "rid", "full").select("rid", F.coalesce("nothing", "kept_text").alias("new_text"))
    joined = named.select("row", "rid").join(marks, "rid", "left").where("new_text IS NULL OR new_text <> ''")
    text = F.coalesce("new_text", "row.text")
    made = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return joined.select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in columns])
