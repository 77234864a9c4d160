"""Toxicity of whole texts: a learned lexicon, met with misspellings, read in context.

Labelled rows give a lexicon of terms (words) and stems (starts of words) that toxic
documents hold far more often than others. The lexicon is a trie; a Levenshtein
automaton runs along it, so a word of a text is compared with all terms in one walk
over its letters. Each hit is judged by a window of words around it: quotation and
report lower its weight, direct address does not. A logistic model on the sums of
these weights gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, materialise

#: Labelled rows for the fit (about so many, chosen by a hash of the row).
FIT_ROWS = 8000
#: Entries of the lexicon, and clean words next to a term that are remembered as such.
LEXICON, CLEAN_FORMS = 2000, 20000
#: Least documents, log odds and standard deviations above chance of a term.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 3, 1.5, 4.0
STEM_SIZES = range(4, 9)
#: Errors allowed in a word by the length of the term.
ONE_ERROR, TWO_ERRORS = 5, 10
#: Share of the weight that a misspelled hit keeps for each error, and a quoted hit.
MISSPELLED, QUOTED = 0.7, 0.25
WINDOW = 6
#: States of the automaton that are kept; beyond, they are made anew.
STATES = 50_000

WORDS = re.compile(r"[^\W_](?:[\w@$*'’]*[^\W_])?")
QUOTES = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’")
# Words that report what others say, and words of direct address.
REPORTING = frozenset(
    "said says say saying wrote writes written called calls calling quote quoted quotes reported reports report term terms word words phrase "
    "slur slurs insult insults comment comments according means meaning defined translated character novel article study "
    "dit disait écrit appelé mot mots terme citation selon sagte schrieb nannte wort wörter begriff zitat laut "
    "dijo escribió llamó palabra palabras término cita según".split())
ADDRESS = frozenset("you your yours yourself youre you're u ur are tu te toi vous ton ta tes votre es êtes du dich dir dein deine ihr bist "
                    "seid tú ti vos usted ustedes eres sois".split())


class Lexicon:
    """Terms and stems in one trie, with a lazily built automaton over it.

    A state of the automaton is the set of (trie node, errors, allowed errors) that a
    start of a word can stand at; a step on a letter matches, replaces, skips or
    inserts. States and steps are made when a text first needs them and kept, so a
    known step is one look-up and most words fall out after a few letters.
    """

    def __init__(self, terms: dict[str, tuple[float, float]], stems: dict[str, tuple[float, float]], clean: frozenset = frozenset(),
                 totals: tuple[float, float] = (1.0, 1.0)):
        self.terms, self.stems, self.clean, self.totals = terms, stems, clean, totals
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.deepest = [0]
        for term in sorted(terms):
            node = 0
            allowed = 0 if len(term) < ONE_ERROR else 1 if len(term) < TWO_ERRORS else 2
            self.deepest[0] = max(self.deepest[0], allowed)
            for letter in term:
                nxt = self.children[node].get(letter)
                if nxt is None:
                    nxt = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.deepest.append(0)
                node = nxt
                self.deepest[node] = max(self.deepest[node], allowed)
            self.ends[node] = term
        self.start_over()

    def start_over(self) -> None:
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.known: dict[tuple, int] = {}
        self.begin = self.state({0: 0})

    def state(self, reached: dict[int, int]) -> int:
        """Number of the state with these nodes and errors; skipped letters of terms are followed up. -1: none left."""
        todo = list(reached.items())
        while todo:
            node, errors = todo.pop()
            if reached.get(node) != errors:
                continue
            for nxt in self.children[node].values():
                if errors + 1 <= self.deepest[nxt] and errors + 1 < reached.get(nxt, 9):
                    reached[nxt] = errors + 1
                    todo.append((nxt, errors + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        number = self.known.get(key)
        if number is None:
            number = self.known[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return number

    def step(self, state: int, letter: str) -> int:
        """The state after one more letter: matched, replaced, or one too many."""
        reached: dict[int, int] = {}
        for node, errors in self.states[state]:
            if errors + 1 <= self.deepest[node]:
                reached[node] = min(errors + 1, reached.get(node, 9))
            for other, nxt in self.children[node].items():
                e = errors + (other != letter)
                if e <= self.deepest[nxt] and e < reached.get(nxt, 9):
                    reached[nxt] = e
        return self.state(reached)

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term with fewest errors (ties: first in order) within its allowance."""
        if len(self.states) > STATES:
            self.start_over()
        state = self.begin
        for letter in word:
            nxt = self.steps[state].get(letter)
            if nxt is None:
                nxt = self.steps[state][letter] = self.step(state, letter)
            if nxt < 0:
                return None
            state = nxt
        ends = [(errors, self.ends[node]) for node, errors in self.states[state] if node in self.ends]
        ends = [(e, t) for e, t in ends if e <= (0 if len(t) < ONE_ERROR else 1 if len(t) < TWO_ERRORS else 2)]
        if not ends:
            return None
        errors, term = min(ends)
        return term, errors

    def odds(self, entry: tuple[float, float], label: int | None = None) -> float:
        """Log odds of an entry; with ``label`` as if that document had not been counted."""
        pos, neg = entry
        if label is not None:
            pos, neg = max(pos - label, 0), max(neg - (1 - label), 0)
        return float(np.log((pos + 0.5) / (self.totals[0] + 1)) - np.log((neg + 0.5) / (self.totals[1] + 1)))

    def hit(self, word: str) -> tuple[str, tuple[float, float], float, bool] | None:
        """(term, its counts, share of the weight that counts, whether it is a stem) of a lower-case word."""
        if word in self.terms:
            return word, self.terms[word], 1.0, False
        found = None if word in self.clean else self.nearest(word)
        if found:
            return found[0], self.terms[found[0]], MISSPELLED ** found[1], False
        for size in reversed(STEM_SIZES):
            if word[:size] in self.stems:
                return word[:size], self.stems[word[:size]], 1.0, True
        return None


def features(text: str | None, lexicon: Lexicon, memory: dict, label: int | None = None) -> list[float]:
    """What the model sees of one whole text. ``memory`` keeps what is known of words."""
    low = (text or "").lower()
    words = WORDS.findall(low)
    hits = []
    for place, word in enumerate(words):
        found = memory.get(word, 0)
        if found == 0:
            found = memory[word] = lexicon.hit(word)
        if found:
            hits.append((place, found))
    term_sum = stem_sum = best = quoted = 0.0
    distinct, spelled = set(), 0
    if hits:
        spans = [m.span() for m in QUOTES.finditer(low)]
        places = [m.start() for m in WORDS.finditer(low)] if spans else []
        span = 0
        for place, (term, counts, share, stem) in hits:
            weight = lexicon.odds(counts, label)
            if weight < LEAST_ODDS / 2:
                continue
            around = words[max(0, place - WINDOW):place] + words[place + 1:place + 1 + WINDOW]
            inside = False
            if spans:
                while span < len(spans) and spans[span][1] <= places[place]:
                    span += 1
                inside = span < len(spans) and spans[span][0] <= places[place]
            quotation = 2.0 * inside + sum(w in REPORTING for w in around)
            abuse = sum(w in ADDRESS for w in around)
            if quotation > abuse:
                quoted += 1
                weight *= QUOTED
            weight *= share
            spelled += share < 1
            best = max(best, weight)
            distinct.add(term)
            if stem:
                stem_sum += weight
            else:
                term_sum += weight
    n = len(words)
    return [np.log1p(term_sum), best, np.log1p(stem_sum), np.log1p(len(distinct)), term_sum / np.sqrt(n + 10.0),
            stem_sum / np.sqrt(n + 10.0), quoted / max(len(hits), 1), np.log1p(n), float(bool(hits))]


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, pos, neg): documents of a batch by label for each word and start of a word."""
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(WORDS.findall((text or "").lower()))
            stems = {w[:k] for w in words for k in STEM_SIZES if len(w) >= k}
            for key in [(w, False) for w in words] + [(s, True) for s in stems]:
                counts.setdefault(key, [0, 0])[1 - toxic] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({
            "term": pa.array([k[0] for k in keys], pa.string()), "stem": pa.array([k[1] for k in keys], pa.bool_()),
            "pos": pa.array([counts[k][0] for k in keys], pa.int64()), "neg": pa.array([counts[k][1] for k in keys], pa.int64())})


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled rows (text, toxic 0 or 1).

    Terms and stems are counted by Spark; at most LEXICON of them (the least likely
    by chance first) and CLEAN_FORMS clean words one or two errors from a term come
    to the driver.
    """
    totals = rows.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    pos, neg = float(totals.pos or 0), float(totals.neg or 0)
    if not pos or not neg:
        return Lexicon({}, {}, totals=(pos, neg))
    counts = materialise(rows.mapInArrow(_document_terms, "term string, stem boolean, pos long, neg long")
                         .groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
                         .where(F.col("pos") + F.col("neg") >= LEAST_DOCS))
    share = pos / (pos + neg)
    expected = (F.col("pos") + F.col("neg")) * share
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    scored = counts.withColumns({"odds": odds, "z": (F.col("pos") - expected) / F.sqrt(expected * (1 - share))})
    top = (scored.where((F.col("pos") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
           .orderBy(F.desc("z"), "term", "stem").limit(LEXICON).collect())
    terms = {r.term: (r.pos, r.neg) for r in top if not r.stem}
    stems = {r.term: (r.pos, r.neg) for r in top if r.stem}
    lexicon = Lexicon(terms, stems, totals=(pos, neg))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("term").to_pylist()
            yield batch.filter(pa.array([w not in lexicon.terms and lexicon.nearest(w) is not None for w in words], pa.bool_()))

    plain = scored.where((~F.col("stem")) & (F.col("odds") < LEAST_ODDS / 2)).select("term", "pos", "neg")
    clean = plain.mapInArrow(beside, "term string, pos long, neg long").orderBy(F.desc("neg"), "term").limit(CLEAN_FORMS).collect()
    return Lexicon(terms, stems, frozenset(r.term for r in clean), (pos, neg))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, centres, scales) by Newton steps with a ridge."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    weights = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights, centre, scale


def learn(rows: DataFrame) -> dict:
    """The model of labelled rows (text, toxic): a lexicon and a logistic layer.

    The features of a fitted row leave the row's own count out of the odds, so words
    that one document alone brings in do not look telling. Without rows of both
    labels every text gets the share of label 1 (0 without any row).
    """
    lexicon = learn_lexicon(rows)
    pos, neg = lexicon.totals
    if not pos or not neg:
        return {"lexicon": lexicon, "share": pos / max(pos + neg, 1)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memory: dict = {}
            labels = batch.column("toxic").to_pylist()
            found = [features(t, lexicon, memory, y) for t, y in zip(batch.column("text").to_pylist(), labels)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.list_(pa.float64())), "y": pa.array(labels, pa.int32())})

    got = rows.mapInArrow(measure, "x array<double>, y int").toPandas()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(float)
    return {"lexicon": lexicon, "layer": fit_logistic(x, y)}


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` in place of ``text``; every row is scored by its whole text."""
    others = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in others] + [StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if len(memory) > 200_000:
                memory = {}
            if "layer" in model:
                weights, centre, scale = model["layer"]
                x = np.array([features(t, model["lexicon"], memory) for t in texts]).reshape(len(texts), len(centre))
                margin = ((x - centre) / scale) @ weights[:-1] + weights[-1]
                scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            else:
                scores = np.full(len(texts), model["share"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(scores, pa.float64())], [*others, "score"])

    return docs.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """About ``most`` labelled rows (all, if fewer), chosen by a hash of id and text.

    A document with several label rows is toxic when one of them says so; rows
    without an id have no label.
    """
    marks = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = docs.select("doc_id", "text").join(marks, "doc_id")
    n = max(docs.select("doc_id").join(marks, "doc_id").count(), 1)
    return materialise(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < most).select("text", "toxic"))


def score_folds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0. Null and
    empty texts are texts without words; repeated rows get the same score; a null
    doc_id is not held out and has no label; extra columns play no part.
    """
    docs = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    model = learn(labelled_sample(docs.where("NOT held_out"), labels))
    scored = score_texts(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
