"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

#: The fit sees about this many rows of each language, and its most used words.
FIT_ROWS, FIT_WORDS = 3000, 20_000
ROUNDS = 4
#: Added uses of every piece, and the probability of a character outside the vocabulary.
SMOOTHING, OUTSIDE = 0.05, 1e-7
CACHED_WORDS = 300_000
BEGIN = "▁"


def default_vocabulary() -> str:
    import public_tokenizers as public
    return public.path("piece_bpe_32k.model")


def load_pieces(model_path: str) -> dict[str, int]:
    """Lower-case piece -> number, from a public vocabulary file; control and byte pieces are left out."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out: dict[str, int] = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k)):
            out.setdefault(model.id_to_piece(k).lower(), len(out))
    return out


class Lattice:
    """All segmentations of words into pieces, for many words of one length at once.

    ``table`` has a row of probabilities for each piece, a last row but one for
    characters outside the vocabulary, and a last row of zeros for no piece.
    """

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.outside, self.none = len(pieces), len(pieces) + 1

    def arcs(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> piece number of that stretch in each word."""
        get, size = self.pieces.get, len(words[0])
        out = {}
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                missing = self.outside if end - start == 1 else self.none
                ids = np.fromiter((get(w[start:end], missing) for w in words), np.int64, len(words))
                if start + 1 == end or (ids != self.none).any():
                    out[start, end] = ids
        return out

    @staticmethod
    def forward(arcs: dict, table: np.ndarray, size: int, count: int, longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scaled probabilities of every prefix (count x columns) and their logarithmic scales.

        Only starts within the longest piece are tried: time grows with the length of a word.
        """
        alpha = [np.ones((count, table.shape[1]))]
        scales = [np.zeros(count)]
        for end in range(1, size + 1):
            total = np.zeros((count, table.shape[1]))
            for start in range(max(0, end - longest), end):
                ids = arcs.get((start, end))
                if ids is not None:
                    total += alpha[start] * np.exp(scales[start] - scales[end - 1])[:, None] * table[ids]
            peak = np.maximum(total.max(axis=1), 1e-300)
            alpha.append(total / peak[:, None])
            scales.append(scales[end - 1] + np.log(peak))
        return alpha, scales

    @staticmethod
    def backward(arcs: dict, table: np.ndarray, size: int, count: int, longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same for every suffix, by its start, for the first column of ``table``."""
        beta, scales = [np.ones(count)] * (size + 1), [np.zeros(count)] * (size + 1)
        for start in range(size - 1, -1, -1):
            total = np.zeros(count)
            for end in range(start + 1, min(size, start + longest) + 1):
                if (ids := arcs.get((start, end))) is not None:
                    total += beta[end] * np.exp(scales[end] - scales[start + 1]) * table[ids, 0]
            peak = np.maximum(total, 1e-300)
            beta[start], scales[start] = total / peak, scales[start + 1] + np.log(peak)
        return beta, scales

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Logarithm of the summed probability of every word, by column of ``table``."""
        out = np.zeros((len(words), table.shape[1]))
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_size.setdefault(len(word), []).append(k)
        for size, members in by_size.items():
            for at in range(0, len(members), 4096):
                some = members[at:at + 4096]
                alpha, scales = self.forward(self.arcs([words[k] for k in some]), table, size, len(some), self.longest)
                out[some] = np.log(np.maximum(alpha[-1], 1e-300)) + scales[-1][:, None]
        return out

    def fit(self, counts: dict[str, int], rounds: int) -> np.ndarray:
        """Piece probabilities of one language by expectation maximisation over all segmentations."""
        size = len(self.pieces)
        groups: dict[int, list[str]] = {}
        for word in counts:
            if word:
                groups.setdefault(len(word), []).append(word)
        made = []
        uses = np.zeros(size + 2)
        for length, words in groups.items():
            arcs, weight = self.arcs(words), np.array([counts[w] for w in words], float)
            made.append((length, arcs, weight))
            for ids in arcs.values():
                np.add.at(uses, ids, weight)
        for _ in range(rounds + 1):
            p = self._probabilities(uses)
            uses = np.zeros(size + 2)
            table = p[:, None]
            for length, arcs, weight in made:
                n = len(weight)
                alpha, ahead = self.forward(arcs, table, length, n, self.longest)
                beta, back = self.backward(arcs, table, length, n, self.longest)
                whole = weight / np.maximum(alpha[length][:, 0], 1e-300)
                for (start, end), ids in arcs.items():
                    level = np.exp(ahead[start] + back[end] - ahead[length])
                    np.add.at(uses, ids, alpha[start][:, 0] * table[ids, 0] * beta[end] * level * whole)
        return self._probabilities(uses)

    def _probabilities(self, uses: np.ndarray) -> np.ndarray:
        p = np.zeros(len(self.pieces) + 2)
        p[:-2] = (uses[:-2] + SMOOTHING) / (uses[:-2].sum() + SMOOTHING * len(self.pieces))
        p[self.outside] = OUTSIDE
        return p


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def fit(train: DataFrame, model_path=default_vocabulary, rows: int = FIT_ROWS,
        words: int = FIT_WORDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by column) from (text, lang).

    A bounded sample: about ``rows`` rows of each language, taken by a hash of the
    text, and their ``words`` most used words. Words are counted in Spark; only
    those counts reach the driver.
    """
    known = train.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("lang_rows"))
    ratio = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.select("text", "lang").join(F.broadcast(sizes), "lang").where(ratio * F.col("lang_rows") < rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word in words_of(text.as_py()):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
            langs, tokens = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(tokens, pa.string()),
                                              pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts = (sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("place", order)
              .where(F.col("place") <= words).select("lang", "word", "n").toPandas())
    lattice = Lattice(load_pieces(model_path()))
    langs = sorted(counts.lang.unique())
    columns = [lattice.fit({BEGIN + w: int(n) for w, n in zip(part.word, part.n)}, ROUNDS)
               for part in (counts[counts.lang == lang] for lang in langs)]
    return langs, np.stack(columns, axis=1) if columns else np.zeros((0, 0))


class _Cache(dict):
    """Word -> row; rows of new words are worked out together for a batch."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, model_path=default_vocabulary) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; 'und' with score 0 where the
    text is null or has no letter.

    Words share no piece, so a text's logarithm is the sum over its words, each
    worked out once for many texts. The score is the posterior under equal
    priors. Repeated rows are predicted each; an empty table gives no rows; with
    no language learnt every text is 'und'.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probabilities = shared.value
        lattice = Lattice(load_pieces(model_path()))
        width = max(len(names), 1)
        cache, logs, letters = _Cache(), np.empty((0, width)), np.empty(0, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if len(cache) > CACHED_WORDS:
                    cache, logs, letters = _Cache(), np.empty((0, width)), np.empty(0, bool)
                rows = [np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
                        for words in (words_of(t) for t in part.column(1).to_pylist())]
                if cache.fresh:
                    new = lattice.log_probabilities([BEGIN + w for w in cache.fresh], probabilities) if names else np.zeros((len(cache.fresh), 1))
                    logs = np.concatenate((logs, new))
                    letters = np.concatenate((letters, [any(map(str.isalpha, w)) for w in cache.fresh]))
                    cache.fresh.clear()
                out_lang, out_score = [], []
                for ids in rows:
                    if not names or not letters[ids].any():
                        out_lang.append("und")
                        out_score.append(0.0)
                        continue
                    total = logs[ids].sum(axis=0)
                    best = int(total.argmax())
                    out_lang.append(names[best])
                    out_score.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64())],
                                                 ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, lang_pred string, score double")


def identify_folds(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Every row's language, learnt from the rows outside the held-out fold only."""
    out = fold(F.col("doc_id"), parts) == held
    langs, table = fit(docs.where(~out).select("text", "lang"))
    return predict(docs, langs, table).withColumn("held_out", out)
