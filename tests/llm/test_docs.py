"""Operators on documents against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


from thermagrid.llm import bloom_lm, jaccard_join, langid, license_scan, mixing, packing, quality, suffix_repeats

PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards quietly brew strange purple potions in the old "
         "tower by the river and nobody in the village knows why the smoke turns green at night ").split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(PROSE[k] + str(rng.integers(0, 50)) for k in rng.integers(0, len(PROSE), n))


@pytest.fixture(scope="module")
def texts():
    shared = prose(1, 120)
    near = prose(2, 200)
    words = near.split()
    out = [None, "", " \t\n", "one two three", "one two three", prose(3, 5000), shared + " " + prose(4, 80),
           prose(5, 70) + "\n" + shared, near, near, " ".join(words[:100] + ["changed"] + words[101:]), "ab " * 400,
           "é" * 500, "naïve façade " * 3, "HELLO, World!! #%&", prose(6, 40) + "\n" + "line again\n" * 12]
    return out + [prose(10 + k, 60) for k in range(20)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None, "Z"][k % 4], 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats_brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(docs, texts, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.repeat_report(docs).collect()}
    assert got == dict(enumerate(repeats_brute(texts, 400)))
    assert suffix_repeats.repeat_report(empty).count() == 0


def test_cut_documents_follow_the_report(spark, docs, texts):
    cut = {r.doc_id: r for r in suffix_repeats.cut_documents(docs).collect()}
    report = {r.doc_id: r for r in suffix_repeats.repeat_report(docs).collect()}
    for k, text in enumerate(texts):
        if report[k].n_removed == 0:
            assert cut[k].text == text and cut[k].size == 7
        elif report[k].n_removed == report[k].n_bytes:
            assert k not in cut
        else:
            assert len(cut[k].text.encode()) <= report[k].n_bytes - report[k].n_removed


def test_a_passage_of_51_words_is_cut_at_the_length_of_the_pipeline(spark):
    """Passages of over 50 words are some 300 bytes: op3's 400 miss them, the pipeline's strings do not."""
    import corpus_pipeline
    passage = " ".join(f"{w[:3]}{w[-1]}x" for w in prose(77, 51).split())
    rows = [(k, prose(3000 + k, 300) + " " + (passage if k in (2, 5) else "") + " " + prose(4000 + k, 200)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_repeats.cut_documents(docs, corpus_pipeline.REPEATED).collect()}
    assert 200 < len(passage.encode()) < 400
    for k, text in rows:
        assert got[k] == text if k not in (2, 5) else passage[20:-20] not in got[k] and len(got[k]) >= len(text) - len(passage) - 2
    for length, anchor in ((40, 16), (200, 100)):
        of = suffix_repeats.Strings(length, anchor)
        report = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.repeat_report(docs, of).collect()}
        assert report == {k: want for (k, _), want in zip(rows, repeats_brute([t for _, t in rows], length))}



def test_multikey_order_sorts_and_groups():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (200, 5)).astype(np.uint64)
    order, group = suffix_repeats.multikey_order(words)
    rows = [tuple(w) for w in words[order]]
    assert rows == sorted(rows)
    assert [rows.index(r) for r in rows] == group.tolist()


def components_brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k:k + 5]) for k in range(len(w) - 4)]))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_similar_documents_match_brute_force(docs, texts, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(docs).collect()}
    assert got == components_brute(texts)
    assert jaccard_join.link_components(empty).count() == 0


def test_similar_documents_of_a_chain(spark):
    """Neighbours are similar, ends are not; many near copies around one text."""
    words = prose(50, 150).split()
    texts = []
    for k in range(40):
        words = words[:]
        words[(k * 7) % 150] = f"new{k}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(rows).collect()}
    assert got == components_brute(texts)


def test_frequent_tokens_and_pieces_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "PIECE", 4)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "SPARE", 0)
    passage = prose(60, 60)
    texts = [passage + " " + prose(100 + k, 10 + k % 15) for k in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(rows).collect()}
    assert got == components_brute(texts)


def test_one_of_each_keeps_the_smallest(docs, texts):
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs.unionByName(docs)).collect()}
    assert kept == {c for _, c in components_brute(texts).values()}
    assert jaccard_join.one_of_each(docs.unionByName(docs)).count() == len(kept)


def test_scores_match_brute_force(docs, texts, empty):
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    seen = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, below = sum(seen.values()), sum(seen.values()) + len(seen) + 1
    rows = {r.doc_id: r for r in bloom_lm.score_folds(docs).collect()}
    for k, t in enumerate(tokens):
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(seen[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / below) for w in t), rel_tol=1e-9)
        assert r.score <= 0
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert bloom_lm.score_folds(empty).count() == 0


def test_pairs_seen_once_count(spark):
    train, asked = ["a b c d", "e f g a b", "h i c d"], ["a b c d", "e f g h", "d c b a", "x a b", None]
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = collections.Counter(), collections.Counter()
    for t in train:
        one.update(w := [*t.split(), 0])
        two.update(zip(["start", *w], w))
    below = one.total() + len(one) + 1
    for r in bloom_lm.score(table(asked), table(train)).collect():
        w, want = [*(asked[r.doc_id] or "").split(), 0], 0
        for before, word in zip(["start", *w], w):
            p2 = max(two[before, word] - 0.75, 0) / max(one[before] if before != "start" else one[0], two[before, word], 1)
            want += math.log10(0.75 * (one[word] + 1) / below + 0.25 * p2)
        assert math.isclose(r.score, want, rel_tol=1e-9), r


def test_rows_in_no_fixed_order_are_scored(docs):
    want = {r.doc_id: r for r in bloom_lm.score_folds(docs).collect()}
    loose = docs.repartition(3, F.rand()).sortWithinPartitions(F.rand())
    got = bloom_lm.score_folds(loose).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_known, r.train_tokens) == (want[r.doc_id].n_known, want[r.doc_id].train_tokens)
        assert math.isclose(r.score, want[r.doc_id].score, rel_tol=1e-9)


def test_log_bloom_has_no_false_miss():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    counts = rng.zipf(1.5, len(keys)).clip(1, 10 ** 9)
    bounds = bloom_lm.slice_bounds(7)
    part = np.searchsorted(bounds, keys, side="right")
    filled = {k: bloom_lm.LogBloom.build(keys[part == k], counts[part == k], 10, 1) for k in range(7)}
    levels = bloom_lm.LogBloom(filled, 7, 1).level(keys)
    assert (levels >= bloom_lm.quantise(counts)).all()
    assert (levels == bloom_lm.quantise(counts)).mean() > 0.97
    assert (bloom_lm.LogBloom(filled, 7, 1).level(keys + np.uint64(1)) == 0).mean() > 0.97


def test_packed_runs_come_back():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    a, b = bloom_lm.unpack_sorted(bloom_lm.pack_sorted(keys, np.arange(1000)))
    assert (a == keys).all() and (b == np.arange(1000)).all()


def test_quality_counts_match_brute_force(spark, docs, texts, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    for k, text in enumerate(texts):
        w = words_of(text)
        grams = collections.Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        twice = {j + o for j in range(len(w) - 7) if grams[tuple(w[j:j + 8])] > 1 for o in range(8)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), failed), k
        assert r.kept == (not failed)  # too few labels to certify any cutoff
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(docs, labels.where("false")).count() == len(texts)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_thresholds_hold_their_risk(spark):
    """Cutoffs certified on a holdout where a known share of good rows is extreme."""
    rows = [(k, 200, 1000, 450 if k % 1000 == 0 else 5, 0, 10, 10, 0, 0, 0, 1) for k in range(20000)]
    feats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_shouts long, n_capitals long, "
                                        "n_lines long, n_dup_lines long, n_repeat_words long, n_runs long, quality int")
    cuts = quality.thresholds(feats).collect()
    assert len(cuts) == 1 and cuts[0].cut_symbol_share == min(quality.RULES["symbol_share"])
    few = quality.thresholds(feats.where("doc_id < 100")).collect()
    assert few[0].cut_symbol_share is None
    # The union of the rules counts: six rules that each reject 1 % of the good rows reject too many together.
    many = feats.withColumns({c: F.when(F.col("doc_id") % 100 == k, F.col("n_words")).otherwise(F.col(c))
                              for k, c in enumerate(("n_symbols", "n_shouts", "n_capitals", "n_dup_lines", "n_repeat_words", "n_runs"))})
    assert quality.thresholds(many.withColumn("n_lines", F.lit(200)).withColumn("word_chars", F.lit(200))).collect()[0].cut_symbol_share is None


def test_some_hundred_labels_certify_and_junk_goes(spark):
    """240 clean labelled rows of a band certify a level without an error; junk beyond its cutoffs is rejected."""
    rows = [(k, prose(1000 + k, 160)) for k in range(260)] + [
        (900 + k, " ".join(w + "#$%"[j % 3] * 5 for j, w in enumerate(prose(2000 + k, 200).split()))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(240)] + [(900 + k, 0) for k in range(5)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    assert all(got[k].kept for k in range(260))
    assert not any(got[900 + k].kept or got[900 + k].base_failed for k in range(5))
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {k for k, r in got.items() if r.kept}


def test_binomial_tail_is_exact(spark):
    cases = [(10, 0), (100, 1), (2000, 7), (50000, 100), (5, 5), (0, 0)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality.binomial_tail("n", "k", 0.004))
    for r in df.collect():
        want = 1.0 if r.k > r.n * 0.004 or r.n == 0 else sum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.004)
                     + (r.n - j) * math.log(0.996)) for j in range(r.k + 1))
        assert math.isclose(r.p, want, rel_tol=1e-9)


def test_mix_targets_and_words(docs, texts, empty):
    rows = mixing.mix(docs, carry_text=False).collect()
    size = {r.doc_id: r["size"] for r in rows}
    assert size == {k: len(words_of(t)) for k, t in enumerate(texts)}
    total = sum(size.values())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id % 4].append(r)  # sources in turn
    weight = dict(zip([3, 0, 1, 2], (1, 2, 3, 1)))  # code points: Z, a, b, then null
    limit = {s: 3 * sum(r["size"] for r in x) for s, x in by.items()}
    target, free = {}, set(by)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > limit[s]}
        if not over:
            break
        target |= {s: limit[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s, x in by.items():
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) and r.source_size * 3 == limit[s] for r in x)
        assert abs(sum(r.taken for r in x) - target[s]) <= 0.5
        assert all(0 <= r.taken <= 3 * r["size"] for r in x)
    assert mixing.mix(empty).count() == 0
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7), carry_text=False).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_pack_is_gapless_and_complete(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, with_ids=True).collect()
    ids = collections.defaultdict(dict)
    windows = collections.defaultdict(list)
    for r in rows:
        piece = np.frombuffer(r.ids, np.uint32)
        assert len(piece) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        ids[r.doc_id][r.start] = piece.tolist()
        windows[r.sequence_id].append((r.offset, r.length))
    for k, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert [i for s in sorted(ids[k]) for i in ids[k][s]] == want
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_best_fit_decreasing_is_that_of_one_piece_at_a_time():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        window = int(rng.choice([8, 16, 64]))
        lengths = rng.integers(1, window + 1, int(rng.integers(1, 150))).tolist()
        left = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, r in enumerate(left) if r >= n]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= n
            else:
                left.append(window - n)
        counts = collections.Counter(lengths)
        runs = packing.best_fit_decreasing(dict(counts), window)
        used = collections.Counter()
        for (n, first, each, sequence, _), following in zip(runs, runs[1:] + [(0, 0)]):
            for k in range(following[1] - first if following[0] == n else counts[n] - first):
                used[sequence + k // each] += n
        assert sorted(left) == sorted(window - u for u in used.values())


def test_words_are_encoded_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(*packing.default_vocabulary())
    for s in ["", "a  b", "\nab c", " x y", "it's 12 34  ", "é ü ß  k", "x \ty", "don't we'll  go", "日本語 テキスト", "a\r\nb c", "a  b"]:
        assert np.frombuffer(encode(s), np.uint32).tolist() == tokenizer.encode(s, add_special_tokens=False).ids


def test_added_tokens_in_texts_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(*packing.default_vocabulary())
    for s in ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>  y\n", " <|endoftext|", "it's<|endoftext|>'s  12 "]:
        assert np.frombuffer(encode(s), np.uint32).tolist() == tokenizer.encode(s, add_special_tokens=False).ids


def test_language_on_made_up_languages(spark):
    rng = np.random.default_rng(5)
    stems = {"aa": ["the", "house", "where", "which", "night"], "bb": ["und", "nicht", "straße", "schön", "haus"]}
    rows = [(k, " ".join(rng.choice(stems[lang], 12)), lang) for k in range(200) for lang in [["aa", "bb"][k % 2]]]
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None), (903, "x" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_folds(docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert all(got[k].lang_pred == lang and 0.9 < got[k].score <= 1 for k, _, lang in rows[:200])
    assert got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert langid.identify_folds(docs.where("false")).count() == 0


def test_lattice_sums_all_segmentations():
    lattice = langid.Lattice({"a": 0, "b": 1, "ab": 2, "ba": 3})
    table = np.array([[0.3], [0.2], [0.1], [0.05], [1e-7], [0.0]])

    def brute(word):
        if not word:
            return 1.0
        pieces = {"a": 0.3, "b": 0.2, "ab": 0.1, "ba": 0.05}
        return sum(p * brute(word[len(w):]) for w, p in pieces.items() if word.startswith(w))
    words = ["abab", "b", "ababababba" * 5, "ba"]
    got = lattice.log_probabilities(words, table)[:, 0]
    assert np.allclose(got[[0, 1, 3]], [math.log(brute(w)) for w in ("abab", "b", "ba")])
    assert np.isfinite(got).all()


def test_licenses_are_found_with_their_spans(spark, empty):
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("without restriction", "with no restriction at all")
    texts = ["code\n" + mit + "\nend", "Élan İ " + changed, "Licensed under the Apache License, Version 2.0. And more words.",
             "the license of the software is free", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.find_licenses(docs).collect()}
    assert {k: r.license for k, r in got.items()} == {0: "MIT", 1: "MIT", 2: "Apache-2.0 notice"}
    assert got[0].coverage == 1.0 and got[1].coverage > 0.9
    assert got[1].passage.startswith("Permission") and got[1].passage.endswith("SOFTWARE")
    assert texts[2][got[2].span_begin:got[2].span_end] == "Licensed under the Apache License, Version 2.0"
    assert license_scan.find_licenses(empty).count() == 0


def test_short_notices_match_word_for_word():
    hashes = license_scan._WordHashes()
    index = license_scan.Index(license_scan.TEMPLATES, hashes)
    names = lambda t: [r[0] for r in license_scan.scan(t, index, hashes, license_scan.COVERAGE)]
    assert names("x. Licensed under CC BY-ND 4.0. y") == ["CC-BY-ND notice"]
    assert names("Licensed under CC BY-NC-SA 4.0, see there") == ["CC-BY-NC-SA notice"]
    assert names("Released under the BSD License.") == ["BSD notice"] and names("Released under the XYZ License.") == []
    assert names("Licensed under CC BY 4.0.") == ["CC-BY-4.0 notice"] and names("Licensed under the fine MIT License") == []
    for name, text in license_scan.TEMPLATES.items():  # every text is its own best match
        assert names("before " + text + " after") == [name]


def test_stages_take_nulls_in_every_column(spark):
    """A row of nulls, a text of nulls' neighbours and clashing names go through every stage."""
    rows = [(None, None, None, None, None), (None, prose(70, 30), "en", "a", 1), (1, None, "en", None, 2), (2, prose(71, 30), None, "a", None),
            (2, prose(71, 30), None, "a", None), (2, prose(72, 30), "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("text_key", "size", "rid", "n_words", "band"):
        docs = docs.withColumn(extra, F.lit(7))
    labels = spark.createDataFrame([(None, 1, None), (2, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    kept = jaccard_join.one_of_each(docs.drop("text_key"))
    assert kept.columns == docs.drop("text_key").columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted(
        (r[0] or 0, len(r[1] or "")) for r in {(r[0], r[1]) for r in rows})
    assert suffix_repeats.cut_documents(docs).count() == 6
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_report(docs, labels).count() == 6
    assert mixing.mix(docs).count() == 6
    assert packing.pack(docs).count() == 6
    assert bloom_lm.score_folds(docs).count() == 6
    assert langid.identify_folds(docs).count() == 6
    assert license_scan.find_licenses(docs).count() == 0


def test_a_family_under_the_threshold_makes_few_candidates(spark):
    """500 near copies: most pairs are just below the similarity, some above. Few pairs are emitted, no link is lost."""
    rng = np.random.default_rng(12)
    base = prose(50, 320).split()
    rows = []
    for k in range(500):
        words = list(base)
        for at in rng.choice(320, 8 if k % 10 else 3, replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    parent = list(range(500))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    near = 0
    for a in range(500):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                near += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in jaccard_join.link_components(docs).collect()}
    assert got == {k: root(k) for k in range(500)} and 100 < near < 60_000

    sid = np.arange(500)
    hashed = [np.sort(np.array([hash(s) & 0xFFFFFFFFFFFFFFFF for s in x], np.uint64)) for x in sets]
    import pyarrow as pa
    bits = [jaccard_join.folded(jaccard_join.bitmap(h), len(jaccard_join.bitmap(h)) * jaccard_join.TREE_BITS // 8).tobytes() for h in hashed]
    table = pa.RecordBatch.from_pydict({"token": np.zeros(500, np.int64), "i": np.zeros(500, np.int32), "j": np.zeros(500, np.int32),
                                        "piece": np.zeros(500, np.int32), "sid": sid, "n": np.array([len(h) for h in hashed]), "comp": sid, "bits": bits})
    made = sum(b.num_rows - b.column(0).null_count for b in jaccard_join._candidate_rows(jaccard_join.FIRST_BEST)(iter([table])))
    everything = sum(b.num_rows for b in jaccard_join._candidate_rows(None)(iter([table])))
    assert made <= 2 * jaccard_join.FIRST_BEST * 500 and near <= everything < 124_750


def test_a_pair_of_many_groups_comes_once():
    """Sets that share many tokens are candidates of one group only, in small groups and in trees, whatever is held back."""
    import numpy as np
    import pyarrow as pa

    from thermagrid.llm import jaccard_join as J

    rng = np.random.default_rng(3)
    shared = [set(rng.choice(12, 6, replace=False).tolist()) | ({100} if k < 90 else {200}) for k in range(120)]
    tokens = [np.unique(np.concatenate((np.arange(60), 60 + rng.integers(0, 30, 4)))).astype(np.uint64) for _ in shared]
    rows = [(t, 0, 0, 0, k, len(tokens[k]), k, J.bitmap(tokens[k]), sorted(s)) for t in sorted({t for s in shared for t in s})
            for k, s in enumerate(shared) if t in s]
    names = ["token", "i", "j", "piece", "sid", "n", "comp", "bits", "tokens"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    met = {(a, b) for a in range(120) for b in range(a + 1, 120) if shared[a] & shared[b]}

    def found(most):
        out = [r for b in J._candidate_rows(most)(iter(table.to_batches(100))) for r in b.to_pylist()]
        return [(r["a"], r["b"]) for r in out if r["a"] is not None], {r["token"] for r in out if r["a"] is None}

    every, none = found(None)
    assert len(every) == len(set(every)) and set(every) == met and not none
    few, late = found(2)
    assert len(few) == len(set(few)) and set(few) < met and late
    for a, b in met - set(few):  # what is put off is in a group that is searched again
        assert shared[a] & shared[b] & late
