"""Pages and vectors against brute force; the pipeline against its parts."""

import itertools
import os
import time

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from thermagrid.llm import boosting, graph_ann, html_extract
from thermagrid.llm.common import materialise, table

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SMALL), reason="given tables are absent")


def page(k: int) -> str:
    links = "".join(f"<li><a href=/{j}>menu {j}</a></li>" for j in range(6))
    body = "".join(f"<p>Paragraph {j} of page {k} tells a long story, with commas, full stops and many words in it.</p>" for j in range(5))
    return (f"<html><head><title>T{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{links}</ul></nav>"
            f"<div class=ad>Buy thing {k} now</div><article><h1>Title {k}</h1>{body}</article><footer>&copy; site</footer></body></html>")


def want(k: int) -> str:
    return f"Title {k} " + " ".join(f"Paragraph {j} of page {k} tells a long story, with commas, full stops and many words in it." for j in range(5))


def test_pages(spark):
    odd = [(100, None), (101, ""), (102, "plain   text"), (103, "<p>un<b>clo</b>sed &lt;x&gt; &amp;&nbsp;y<br>z"), (104, "<<<"),
           (105, "<main><p>Kept text of the page.</p><aside>no</aside><div class='comments'><p>no</p></div></main>")]
    rows = [(k, f"u{k}", page(k), 1) for k in range(40)] + [(k, None, h, 2) for k, h in odd]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    assert {k: got[k].text for k in range(40)} == {k: want(k) for k in range(40)}
    assert {k: got[k].text for k, _ in odd} == {100: "", 101: "", 102: "plain text", 103: "unclosed <x> & y z", 104: "<<<",
                                              105: "Kept text of the page."}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.main_text(pages.where("false")).count() == 0
    assert html_extract.main_text(pages.where("page_id = 102")).first().text == "plain text"


def test_a_bad_token_does_not_veto_the_article(spark):
    """Tokens and forms around the page, and on headings, sections and paragraphs of an article."""
    inner = "<h2 id='search'>Search for text</h2><section id='related-work'>" + "".join(
        f"<p>Section {j} tells of other long works, with commas, full stops and many words in it.</p>" for j in range(3)) + "</section>"
    told = " Search for text " + " ".join(f"Section {j} tells of other long works, with commas, full stops and many words in it." for j in range(3))
    plain = {100: page(100).replace("<body>", "<body class='single has-sidebar'>"),
             101: page(101).replace("<body>", "<body><div class='page header-fixed'>").replace("</body>", "</div></body>"),
             102: page(102).replace("<body>", "<body><form id='aspnetForm'>").replace("</body>", "</form></body>"),
             103: page(103).replace("<p>Paragraph 3", "<p class='notice'>Paragraph 3"),
             104: page(104).replace("</article>", inner + "</article>")}
    rows = [(k, f"u{k}", page(k)) for k in range(40)] + [(k, f"u{k}", h) for k, h in plain.items()]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want(k) + (told if k == 104 else "") for k in [*range(40), *plain]}


def test_decoding_never_contradicts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        parents = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        odds, weight = rng.normal(0, 2, n), rng.integers(0, 30, n).astype(float)
        prior = np.where(rng.random(n) < 0.2, -np.inf, 0.0)
        for k in range(1, n):
            prior[k] = min(prior[k], prior[parents[k]])
        keep = html_extract.decode(parents, odds, weight, prior)
        assert not keep[np.isinf(prior)].any()


def test_decoding_finds_the_best_legal_choice():
    """Every labelling of small trees: a whole binds what is below, a mixed node costs SPLIT_COST."""
    rng = np.random.default_rng(4)
    cost = html_extract.SPLIT_COST
    for _ in range(60):
        n = int(rng.integers(1, 8))
        parents = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        odds, weight = rng.normal(0, 2, n), rng.integers(0, 60, n).astype(float)
        score = odds * weight
        best: dict[tuple, float] = {}
        for states in itertools.product("ixo", repeat=n):  # in, mixed, out
            if any(states[parents[k]] != "x" and states[k] != states[parents[k]] for k in range(1, n)):
                continue
            value = sum(score[k] if s == "i" else max(score[k], 0) - cost if s == "x" else 0 for k, s in enumerate(states))
            keep = tuple(s == "i" or s == "x" and score[k] > 0 for k, s in enumerate(states))
            best[keep] = max(value, best.get(keep, -np.inf))
        got = html_extract.decode(parents, odds, weight, np.zeros(n))
        top = max(best.values())
        if any(best[k] == top and (weight[list(k)] > 0).any() for k in best):
            assert best[tuple(got.tolist())] == pytest.approx(top)


def test_broken_pages_never_fail():
    rng = np.random.default_rng(6)
    parts = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "<?", "<![CDATA[", "<![if x]>", "<!doctype", "&", "&#", "&#x110000;", "&amp", ";", "'", '"', "=", " ",
             "<p>", "</p>", "<div class='ad", "<script>", "</script", "<style>", "<b>", "</i>", "<li>", "<table><td>", "text, words.", "\x00", "é", "<svg/>", "<textarea>",
             "<title>", "<plaintext>", "<article>", "</article>", "<a href=", "\n"]
    for _ in range(2000):
        page = "".join(rng.choice(parts, rng.integers(1, 25)))
        dom = html_extract.parse(page)
        x, weight, prior, label = html_extract.node_table(dom)
        html_extract.text_of(dom, html_extract.decode(dom.parents, np.ones(len(x)), weight, prior))
    dom = html_extract.parse("<p>hello</p> <![foo[ x ]]>")
    assert html_extract.text_of(dom, np.ones(len(dom.tags), bool)).startswith("hello")


@pytest.mark.parametrize("opening, closing", [("<div>", ""), ("<p><b>", "</i>"), ("<ul><li>", "</x>"), ("<div><li>", "</p>"), ("<b>", "</u>")])
def test_deep_pages_take_time_in_proportion(opening, closing):
    def seconds(n: int) -> float:
        begin = time.process_time()
        dom = html_extract.parse((opening + "t " + closing) * n)
        html_extract.node_table(dom)
        return time.process_time() - begin

    assert seconds(50_000) < 20 * max(seconds(5000), 0.05)


def test_the_fit_sample_takes_equal_pages_once(spark):
    rows = [(k, page(k)) for k in range(30)] + [(100 + k, page(0)) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    alone = spark.createDataFrame(rows[:30], "page_id long, html string")
    a, b = (html_extract.fit(p, fit_pages=10_000) for p in (pages, alone))
    assert all(np.array_equal(a[c], b[c]) for c in ("feature", "cut", "value"))


def test_boosted_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = boosting.fit_trees(x[:2000], y[:2000])
    assert ((boosting.margins(model, x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12))
    x[300:420] = x[5]  # one common vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0, None] + [0.0] * 10), (2080, [1.0, 2.0]),
             (2081, [float("inf")] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vectors.unionByName(vectors.limit(3))
    got = {}
    for r in graph_ann.nearest(vectors, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -scores))[:10]
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        assert [r for r, *_ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and all(np.isclose(s, x[v] @ x[q]) for _, v, s in found)
    assert hits >= 0.95 * 10 * len(got)
    assert graph_ann.nearest(vectors.where("false")).count() == 0
    few = graph_ann.nearest(vectors.where("vec_id < 3"), k=10).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def skewed(kind: str) -> np.ndarray:
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "outlier":
        x[7] *= 5000
    elif kind == "huge":
        x *= 1e19
        x[11] *= 50
    else:
        x *= np.exp(rng.normal(0, float(kind), 3000))[:, None]
    return x


@pytest.mark.parametrize("kind", ["outlier", "huge", "0.2", "0.5", "1.5"])
def test_vectors_of_any_norm_are_found(spark, kind):
    x = skewed(kind)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph_ann.nearest(vectors).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(3000), -scores))[:20].tolist()))
    assert hits >= 0.95 * 20 * 150


@needs_data
def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL))
        assert docs.columns == names and docs.count() > 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    per_window = {}
    for r in pieces:
        per_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in per_window.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


@needs_data
def test_all_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@needs_data
@pytest.mark.parametrize("name", ["op6_similar_documents", "op8_quality_rules", "op10_mix_sources", "op11_filter_audit"])
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for given in ("documents", "labels"):
        con.execute(f"CREATE VIEW {given} AS SELECT * FROM '{SMALL}/{given}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in cur.description]
    rows = entry.queries()[name](spark, SMALL)
    assert sorted(rows.columns) == sorted(heads)
    assert sorted(map(str, (tuple(r[h] for h in heads) for r in rows.collect()))) == sorted(map(str, cur.fetchall()))
