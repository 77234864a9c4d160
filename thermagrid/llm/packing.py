"""Packing tokenised documents into fixed windows, best fit decreasing."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermagrid.session import cut_lineage

WINDOW = 1024
CACHED_WORDS = 200_000
ROWS_PER_SLICE = 4096


class _Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes; bounded, refilled when full."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(self.prefix + word)).tobytes()
        if len(word) <= 40:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of a whole text, as bytes of unsigned 32-bit integers.

    The vocabulary's pattern always starts a new piece at a single space between
    two characters that are not white space, so words can be encoded one by one
    and remembered; texts with neighbouring white space are encoded in one go.
    ``special`` maps added tokens of the vocabulary to their ids; a text that holds
    one is split there first, as by the vocabulary's own library.
    """

    close_spaces = re.compile(r"\s\s|^\s|\s$")

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = special or {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if special else None
        self.first, self.later = _Words(self.encode, ""), _Words(self.encode, " ")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.special):
            return b"".join(array("I", [self.special[part]] if part in self.special else self.encode(part)).tobytes()
                            for part in self.split(text))
        if self.close_spaces.search(text):
            return array("I", self.encode(text)).tobytes()
        words = text.split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))


def default_vocabulary() -> tuple[str, str, dict[str, int]]:
    """(rank file, pattern, added tokens) of the public byte-level vocabulary, looked up where the task runs."""
    import public_tokenizers as public
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as described:
        added = {token["content"]: token["id"] for token in json.load(described)["added_tokens"]}
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN, added


def token_pieces(docs: DataFrame, window: int = WINDOW, end_id: int = 0, vocabulary=default_vocabulary,
                 with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into full windows and a rest.

    (doc_id, start, length, ids_crc32, doc_tokens[, ids]); a null text is empty
    and has the end id only.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*vocabulary())
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start:4 * (start + window)]
                    for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), total, piece)):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


class OpenWindows:
    """A segment tree over remaining capacity 0..size: which capacities have open windows."""

    def __init__(self, size: int):
        self.size = size
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, room: int, first: int, number: int) -> None:
        if number and room:
            self.runs[room].append((first, number))
            self._add(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.runs[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least with an open window."""
        node = least + self.width
        if self.count[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over {length: pieces}, equal pieces and equal windows at once.

    Returns runs (length, first piece number, pieces per window, first window,
    offset): pieces of a length are numbered from 0, those of a run fill
    consecutive windows. Best fit puts equal pieces into one window until it is
    too full, as that window stays the tightest, so a run of equal windows takes
    the same number each. Work and runs depend on the number of lengths, at most
    ``window``, not on the number of pieces.
    """
    free, used, runs = OpenWindows(window), 0, []
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = free.tightest(length)
            if room is None:
                room, first = window, used
                number = -(-left // (window // length))
                used += number
            else:
                first, number = free.take(room)
            each = room // length
            whole = min(number, left // each)
            rest = left - whole * each if whole < number else 0
            runs.append((length, done, each, first, window - room))
            free.put(room - each * length, first, whole)
            done, left = done + whole * each, left - whole * each
            if rest:  # the last window of this length is not filled up
                runs.append((length, done, rest, first + whole, window - room))
                free.put(room - rest * length, first + whole, 1)
                done, left, whole = done + rest, 0, whole + 1
            free.put(room, first + whole, number - whole)
    return runs


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 0, vocabulary=default_vocabulary,
         with_ids: bool = False) -> DataFrame:
    """All documents' pieces with sequence_id and offset.

    Only the histogram of piece lengths (at most ``window`` rows) reaches the
    driver, where the plan of runs is made; pieces find their place by their
    number among the pieces of their length. That number is counted in slices of
    a hash of the document, so one length that holds a third of all pieces is not
    one task, and ordered by (doc_id, start, ids_crc32, doc_tokens), so reruns
    agree. Repeated rows are packed each; an empty table gives no rows; extra
    columns are left out.
    """
    pieces = cut_lineage(token_pieces(docs, window, end_id, vocabulary, with_ids))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    runs = best_fit_decreasing(counts, window)
    plan = [(length, first, following[1] if following[0] == length else counts[length], each, sequence, offset)
            for (length, first, each, sequence, offset), following in zip(runs, runs[1:] + [(0, 0)])]
    plan_df = spark.createDataFrame(
        plan, "length long, run_from long, run_to long, run_each long, run_sequence long, run_offset long")
    slices = max(1, sum(counts.values()) // ROWS_PER_SLICE)
    sliced = pieces.withColumn("pack_slice", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(slices)))
    sums = sliced.groupBy("length", "pack_slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pack_slice")) - F.col("n")
    starts = sums.select("length", "pack_slice", before.alias("pack_before"))
    order = Window.partitionBy("length", "pack_slice").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    placed = (sliced.withColumn("pack_row", F.row_number().over(order) - 1)
              .join(starts, ["length", "pack_slice"])
              .withColumn("pack_number", F.col("pack_before") + F.col("pack_row"))
              .join(F.broadcast(plan_df), "length")  # at most a few runs for each of 1024 lengths
              .where("pack_number >= run_from AND pack_number < run_to"))
    step = F.col("pack_number") - F.col("run_from")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("run_sequence") + F.floor(step / F.col("run_each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (step % F.col("run_each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []))
