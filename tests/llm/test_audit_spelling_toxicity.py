"""Filter audit, spelling variants and toxicity against brute force, on small tables with odd rows."""

import collections
import itertools
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from thermagrid.llm import filter_audit, spelling, toxicity

DOCS = "doc_id long, text string, lang string, source string, n long, word string, mask int, part string, toxic int, score double"


def documents(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "en", s, 1, "w", 3, "p", 9, 0.5) for i, t, s in rows], DOCS)


def label_rows(spark, rows):
    return spark.createDataFrame([(*r, "t", "s") for r in rows], "doc_id long, quality int, toxic int, text string, source string")


# Filter audit

GOOD = " ".join(f"word{k}" for k in range(60))
AUDIT_ROWS = [
    (1, GOOD, "a"), (2, GOOD, "b"), (2, GOOD, "b"), (1, GOOD, "a"), (3, GOOD + " #", None), (4, None, None), (5, "", ""), (6, "  \n", "a"),
    (7, "SHOUT " * 80, "a"), (8, "same words " * 40 + "$", "b"), (9, "é" * 40, "a"), (10, GOOD.upper(), "c"), (None, GOOD, "a"),
    (None, "x & y", "b"), (11, GOOD + " #", "b"), (0, "only here", "z"), (12, "pipe | " * 3000, "b"), (4, GOOD, "z")]
LABEL_ROWS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, 0, 1), (8, None, None), (None, 1, 1), (9, 1, 1), (5, 1, 0), (99, 1, 1)]


def audit_brute(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    marks = {i: (any(q == 1 for j, q, _ in labels if j == i), any(x == 1 for j, _, x in labels if j == i)) for i, _, _ in labels if i is not None}
    seen = collections.defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        seen[s or ""].append((fails, *marks.get(i, (False, False))))
    out = []
    for part, members in seen.items():
        removed_by = collections.Counter()
        rows_out = []
        for order in itertools.permutations("ABCDE"):
            alive = members
            for k, f in enumerate(order):
                gone = [m for m in alive if m[0][f]]
                alive = [m for m in alive if not m[0][f]]
                early = sum(m[0][f] and any(m[0][g] for g in order[:k]) for m in members)
                only = sum(m[0][f] and not any(v for g, v in m[0].items() if g != f) for m in members)
                removed_by[f] += len(gone)
                rows_out.append((part, "".join(order), k + 1, len(alive), len(gone), early, only, sum(m[1] for m in gone), sum(m[2] for m in gone), f))
        out += [(*r[:9], removed_by[r[9]]) for r in rows_out]
    return sorted(out)


def test_audit_equals_replay_of_all_orders(spark):
    got = filter_audit.audit(documents(spark, AUDIT_ROWS), label_rows(spark, LABEL_ROWS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == audit_brute(AUDIT_ROWS, LABEL_ROWS)


def test_audit_of_empty_tables(spark):
    docs, labels = documents(spark, AUDIT_ROWS), label_rows(spark, LABEL_ROWS)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels.where("false")).collect())
    assert got == audit_brute(AUDIT_ROWS, [])


@pytest.mark.parametrize("players", [2, 3, 5])
def test_least_squares_gives_shapley_values_exactly(players):
    rng = np.random.default_rng(players)
    value = [0] + [int(v) for v in rng.integers(0, 1000, (1 << players) - 1)]
    orders = list(itertools.permutations(range(players)))
    want = [Fraction(0)] * players
    for order in orders:
        mask = 0
        for f in order:
            want[f] += Fraction(value[mask | 1 << f] - value[mask], len(orders))
            mask |= 1 << f
    got = [sum(w * v for w, v in zip(row, value)) for row in filter_audit.shapley_weights(players)]
    assert got == want


# Spelling variants

def words_brute(rows):
    counts = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:k] + v[k + 1:] == u for k in range(len(v)))


def groups_brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def spelled_rows():
    rng = np.random.default_rng(5)
    rows, letters = [], "abcé÷ß"
    base = ["".join(rng.choice(list(letters), rng.integers(7, 12))) for _ in range(60)]
    for k in range(400):
        words = []
        for w in rng.choice(base, 30):
            w = str(w)
            at, kind = rng.integers(len(w)), rng.integers(12)
            if kind < 3:
                w = w[:at] + ["", letters[rng.integers(6)], letters[rng.integers(6)] + w[at]][kind] + w[at + 1:]
            words.append(w if kind % 2 else w.upper() if w.isascii() else w)
        rows.append((k % 350, " ".join(words), "a"))
    return rows + [(None, "nullname " * 40, "a"), (1, None, "b"), (2, "", "b"), (3, "z" * 9000 + " " + "z" * 9000, None), (4, "z" * 8999 + "y z" + "z" * 8999, None),
                   (5, "chained " * 3000 + "chainad " * 200 + "chaimad " * 12, "b")]


def test_spelling_groups_equal_brute_force(spark):
    rows = spelled_rows()
    want = groups_brute(words_brute(rows))
    docs = documents(spark, rows)
    got = spelling.spelling_groups(docs)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[3] and r[5] != r[3] for r in want) and sum(r[2] > 0 for r in want) > 100
    # Halving every region to single positions loses and doubles nothing.
    assert sorted(tuple(r) for r in spelling.spelling_groups(docs, limit=3).collect()) == want


def test_spelling_of_nothing(spark):
    docs = documents(spark, [(1, None, "a"), (2, "short words only", "a"), (None, "", None)])
    assert spelling.spelling_groups(docs).count() == 0
    assert spelling.spelling_groups(docs.where("false")).count() == 0


def test_block_pairs_belong_to_one_region():
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("ab"), n)) for n in (8, 9) for _ in range(150)})
    total = np.zeros(len(words), int)
    for lo, hi in [(0, 2), (2, 3), (3, 4), (4, 8)]:
        counts, firsts = spelling.near_in_block(words, lo, hi, 8)
        total += counts
        assert ((firsts >= 0) == (counts > 0)).all() and all(one_edit(words[k], words[f]) for k, f in enumerate(firsts) if f >= 0)
    want = [sum(one_edit(w, v) and min(len(w), len(v)) == 8 for v in words) for w in words]
    assert total.tolist() == want


# Toxicity

INSULTS = "blockhead nincompoop dunderhead".split()


def toxic_rows(n=400):
    rng = np.random.default_rng(3)
    filler = [f"{a}{b}" for a in "river stone cloud table paper window garden".split() for b in "ing ed ly s er".split()]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = list(rng.choice(filler, rng.integers(15, 60)))
        if bad:
            for _ in range(rng.integers(1, 4)):
                words.insert(int(rng.integers(len(words))), str(rng.choice(INSULTS)))
        rows.append((i, " ".join(map(str, words)), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_misspelled_terms_and_spares_quotation(spark):
    rows, labels = toxic_rows()
    plain = "river tables are papers and stoned clouds "
    odd = [(10_000, plain + "you are a blockhaed dunderhed", "a"), (10_001, plain + "you blockhead", "a"),
           (10_002, plain + "he said the word “blockhead” is an insult", "a"), (10_003, None, "a"), (10_004, "", None), (None, plain, "a"),
           (10_005, plain * 20000, "b"), (10_006, plain, "b"), (10_006, plain, "b")]
    scores = toxicity.score_folds(documents(spark, rows + odd), label_rows(spark, labels + [(None, 1, 1), (3, 1, None)]))
    assert scores.columns == ["doc_id", "held_out", "score", "predicted"]
    got = collections.defaultdict(list)
    for r in scores.collect():
        got[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(got[i][0].predicted, y) for i, _, y in labels if got[i][0].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[10_000][0].predicted == 1
    assert got[10_002][0].score < got[10_001][0].score
    assert all(got[i][0].predicted == 0 for i in (10_003, 10_004, 10_005, 10_006)) and len(got[10_006]) == 2 and len(got[None]) == 1


def test_toxicity_never_reads_held_out_labels(spark):
    rows, labels = toxic_rows(120)
    flipped = [(i, q, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, q, x in labels]
    docs = documents(spark, rows)
    a, b = (toxicity.score_folds(docs, label_rows(spark, ls)).orderBy("doc_id").collect() for ls in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = toxic_rows(20)
    docs, marks = documents(spark, rows), label_rows(spark, labels)
    assert {r.score for r in toxicity.score_folds(docs, marks.where("false")).collect()} == {0.0}
    assert toxicity.score_folds(docs.where("false"), marks).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(row[j + 1] + 1, out[j] + 1, row[j] + (x != y)))
    return out


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(1)
    random_word = lambda n: "".join(rng.choice(list("abc"), n))
    terms = {random_word(n): (9, 0) for n in (3, 4, 5, 6, 7, 10, 11) for _ in range(4)}
    lexicon = toxicity.Lexicon(terms, {}, totals=(10, 10))
    for word in [random_word(rng.integers(1, 13)) for _ in range(1500)] + list(terms):
        allowed = [(distance(word, t), t) for t in terms]
        allowed = [(d, t) for d, t in allowed if d <= (0 if len(t) < 5 else 1 if len(t) < 10 else 2)]
        want = min(allowed, default=None)
        got = lexicon.nearest(word)
        assert (got and (got[1], got[0])) == want
