"""M-tree search, HTML extraction, license scans, the queries' SQL, and the pipeline."""

import glob
import math
import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from proofsearch.llm import html_text, license_scan, mtree, near_dedup, queries
from proofsearch.llm.base import table

SMALL = "/root/testdata/sf0.01"


def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    text = lambda d: sorted(tuple("-" if pd.isna(v) else f"{v:.6f}" if isinstance(v, (float, np.floating)) and v != int(v) else str(int(v)) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v) for v in row) for row in d[cols].itertuples(index=False))
    assert text(a) == text(b)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).sql(queries.SQL[name]).df())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 400), st.integers(1, 5), st.booleans())
def test_tree_is_exact(seed, n, dim, copies):
    r = np.random.default_rng(seed)
    v = r.integers(-30, 30, (n, dim))
    if copies:
        v[: n // 2] = v[0]
    ids = r.permutation(n)
    leaf, mtree.LEAF_ROWS = mtree.LEAF_ROWS, 8
    try:
        tree = mtree.Tree(mtree.build(ids, v))
    finally:
        mtree.LEAF_ROWS = leaf
    q = r.integers(-30, 30, dim)
    want = sorted(((int(s), -int(i)) for s, i in zip(v @ q, ids) if i != 3), reverse=True)[:5]
    assert tree.top(3, q, 5) == [(s, -i) for s, i in want]


def test_tree_leaves_out_what_bounds_exclude(monkeypatch):
    monkeypatch.setattr(mtree, "LEAF_ROWS", 64)
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 8))
    centres *= 600 / np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.round(np.repeat(centres, 100, axis=0) + r.normal(size=(4000, 8)) * 3).astype(int)
    tree = mtree.Tree(mtree.build(np.arange(4000), v))
    tree.top(-1, v[17], 5)
    assert tree.computed < 3000


def test_pages_and_levels():
    """A block is a tree of many small pages, whose balls hold what is below them."""
    r = np.random.default_rng(3)
    v = r.integers(-200, 200, (mtree.BLOCK_ROWS, 16))
    tree = mtree.Tree(mtree.build(np.arange(len(v)), v))
    leaves = [p for p in tree.pages if isinstance(p, mtree.Leaf)]
    assert len(leaves) >= len(v) / mtree.LEAF_ROWS and max(len(p.ids) for p in leaves) <= mtree.LEAF_ROWS and sum(len(p.ids) for p in leaves) == len(v)

    def below(number):
        page = tree.pages[number]
        if isinstance(page, mtree.Leaf):
            return 1, mtree.lift(page.vectors, page.norm)
        levels, points = [], []
        for child, pivot, radius in zip(page.children, page.pivots, page.radius):
            depth, held = below(int(child))
            assert (np.sqrt(((held - pivot) ** 2).sum(axis=1)) <= radius + 1e-6).all()
            levels.append(depth)
            points.append(held)
        return 1 + max(levels), np.concatenate(points)

    assert below(0)[0] >= 3


def test_many_blocks_match_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=(900, 6)), np.tile(r.normal(size=6), (300, 1))]).astype(np.float32)
    ids = r.permutation(3000)[: len(v)]
    d = spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(mtree, "BLOCK_ROWS", 100)
    monkeypatch.setattr(mtree, "LEAF_ROWS", 16)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 10)
    whole = np.floor(256.0 * v.astype(float)).astype(int)
    want = []
    for i, x in zip(ids, whole):
        if i % 50 == 0:
            best = sorted((-int(s), int(j)) for s, j in zip(whole @ x, ids) if j != i)[:5]
            want += [(int(i), n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in mtree.top_k(d).collect()) == sorted(want)


def test_search_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (1, [0.5, None]), (2, [nan, 1.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, 0.0]), (6, [1.0]), (7, [1.0, 0.0])]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    out = sorted(tuple(r) for r in mtree.top_k(d).collect())
    assert out == [(0, 1, 5, 65536), (0, 2, 7, 65536), (0, 3, 50, 32768), (0, 4, 50, 32768), (50, 1, 0, 32768), (50, 2, 5, 32768), (50, 3, 7, 32768)]
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<div class="menu"><a href="/">Home</a> <a>More</a></div><div class="cookie-notice">We use cookies, of course.</div>
<div id="content"><h2>The title</h2><p>First  paragraph, with <b>bold</b> text &amp; more; quite long, in fact.</p><script>var a="<p>no</p>";</script>
<p>Short one.</p><ul><li>a point, made.</li><li>another</li></ul><p>Last&nbsp;paragraph: it ends here, as texts do.<br>Same block.</p></div>
<div class="sidebar"><p>Related things, with many words, that could pass for text.</p></div><form><p>Your name</p></form>
<div id="comments"><p>Great article, thanks! I liked it, really, a lot.</p></div><footer>&copy; us</footer></body></html>"""


def test_page_without_article_element():
    want = "The title\nFirst paragraph, with bold text & more; quite long, in fact.\nShort one.\na point, made.\nanother\nLast paragraph: it ends here, as texts do. Same block."
    assert html_text.main_text(PAGE) == want


def test_article_holds_its_blocks():
    page = "<nav><p>Menu, of many words, in a row.</p></nav><article><h1>T</h1><p><b>One.<br><p>Two, three.</p><aside>no</aside><div class=ad>Buy, now!</div></article><p>Outside, text.</p>"
    assert html_text.main_text(page) == "T\nOne.\nTwo, three."


@pytest.mark.parametrize("tag", ['<p title="The hidden valley">', "<p data-hidden=false>", "<p data-id='sidebar'>", '<p data-x = "a > b" title=\'class="menu"\'>', "<p data-class=menu/>", '<p class="text" class="menu">', "<p title = hidden>"])
def test_only_whole_attribute_names_count(tag):
    page = f'<article><p>First words, of many; and so on.</p>{tag}See <a href="/hidden-lake">the lake</a>, which is there.</p></article>'
    assert html_text.main_text(page) == "First words, of many; and so on.\nSee the lake, which is there."


@pytest.mark.parametrize("tag", ['<div id="sidebar" width="3">', "<div width=3 id=sidebar>", "<div HIDDEN>", '<div class="x"id="menu">', "<div hidden=''>", '<div style="display: none" title="a">', "<div aria-hidden = true>"])
def test_furniture_is_known_by_its_attributes(tag):
    page = f"<article><p>First words, of many; and so on.</p>{tag}<p>Other words, of many; and so on.</p></div></article>"
    assert html_text.main_text(page) == "First words, of many; and so on."


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbdiv=\"' a&;!-[]", max_size=60))
def test_any_markup_gives_lines_of_text(page):
    out = html_text.main_text(page)
    assert all(x and x == " ".join(x.split()) for x in out.split("\n")) or out == ""


@pytest.mark.parametrize("name", ['class="text-navy"', 'class="share-price"', 'class="related-work"', 'class="menu-prices"', 'class="promo-code-explained"', 'id="overlay-text"', 'class="socket navy_blue"'])
@pytest.mark.parametrize("around", ["article", "div"])
def test_a_name_that_holds_more_than_furniture_keeps_its_text(name, around):
    page = f"<nav><a href=/>Home</a></nav><{around}><p>Some text before, long enough; with marks.</p><p {name}>This one stays, as all its words say; with marks.</p><p>Some text after, long enough; with marks.</p></{around}>"
    assert html_text.main_text(page).split("\n")[1:2] == ["This one stays, as all its words say; with marks."]


@pytest.mark.parametrize("name", ['class="ad"', 'class="ad-728x90"', 'class="share-buttons"', 'class="related_posts"', 'class="x cookie-notice"', 'id="comment-17"', 'class="comment-text"', 'class="sign-up"', 'class="post-comments"', 'class="newsletter-box"'])
@pytest.mark.parametrize("tag", ["p", "div"])
def test_a_name_of_furniture_alone_takes_its_text(name, tag):
    page = f"<article><p>Some text before, long enough; with marks.</p><{tag} {name}>This one goes, as its name says; with marks.</{tag}><p>Some text after, long enough; with marks.</p></article>"
    assert "goes" not in html_text.main_text(page)


SOUP = """<div><div class="x"><a href=1>Home</a></div><div class="x"><a href=2>News of today</a></div></div><div class="y"><b>Tiny</b></div>
<div><p>Long text, with marks; and so on. It goes on, and on, for quite a while, as texts do.</p><p>More of it, here. And words; many.</p>
<div class="z"><a href=3>Another story</a></div><p>And the end, which is long as well; or nearly so, at least.</p></div><div class="y">Odds</div><div class="y">Ends</div>"""
FARM = """<article><h1>Title</h1><div class="entry-header"><h2>Under it</h2></div><p>Some text, long enough; with <a href=x>a link</a> in it, and marks.</p>
<ul><li>one</li><li>two</li></ul><ul class="more"><li><a href=a>Link one</a></li><li><a href=b>Link two</a></li><li><a href=c>Link three</a></li></ul>
<p class="legal">A paragraph on law, between two others.</p><p>Some more text, long enough; with marks.</p></article>"""


def test_ratios_decide(monkeypatch):
    soup = "Long text, with marks; and so on. It goes on, and on, for quite a while, as texts do.\nMore of it, here. And words; many.\nAnd the end, which is long as well; or nearly so, at least."
    farm = "Title\nUnder it\nSome text, long enough; with a link in it, and marks.\none\ntwo\nA paragraph on law, between two others.\nSome more text, long enough; with marks."
    assert (html_text.main_text(SOUP), html_text.main_text(FARM)) == (soup, farm)
    monkeypatch.setattr(html_text, "path_scores", lambda found: np.ones(len(found)))
    assert "Home" in html_text.main_text(SOUP) and "Odds" in html_text.main_text(SOUP) and "Link two" in html_text.main_text(FARM)


def test_path_scores_match_brute_force():
    for page in (SOUP, FARM, PAGE, "<p>a", "<a href=x>only</a>"):
        found = [b for b in html_text.read(page).blocks if not b.furniture]
        fused = []
        for b in found:
            path = [c for c in found if c.path == b.path]
            fused.append(math.sqrt(sum(len(c.text) for c in path) / len(path) * (1 + sum(sum(x in ".,;:!?" for x in c.text) for c in path) / len(path))))
        smooth = []
        for k in range(len(found)):
            w = {j: math.exp(-((j - k) ** 2) / 2) for j in range(max(0, k - 3), min(len(found), k + 4))}
            smooth.append(sum(w[j] * fused[j] for j in w) / sum(w.values()))
        want = []
        for b in found:
            path = [j for j, c in enumerate(found) if c.path == b.path]
            linked, length = sum(min(found[j].linked, len(found[j].text)) for j in path), sum(len(found[j].text) for j in path)
            want.append(math.sqrt(sum(smooth[j] for j in path) / len(path) * sum(fused[j] for j in path) / len(path)) * (1 - linked / length))
        assert np.allclose(html_text.path_scores(found), want)


def test_deep_pages_take_time_in_proportion():
    for step in ("<div>x, y.", "<p><b>x, y.", "<span class=ad>x", "<ul><li>x", "<a href=x>", "</b></div>"):
        began = time.process_time()
        html_text.main_text(step * 20_000)
        assert time.process_time() - began < 5


def test_pages(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, None), (None, "v", "", 1), (3, "w", "<p>" + "long text, and more. " * 20_000, 2)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html_text.extract(d).collect()
    assert len(out) == 5 and {(r.page_id, r.n_chars) for r in out} >= {(2, 0), (None, 0), (3, 20_000 * 21 - 1)}
    assert html_text.extract(d.limit(0)).count() == 0
    whole = html_text.extract(table(spark, SMALL, "pages")).collect()
    assert all(r.n_chars == len(r.text) > 0 for r in whole)
    assert not any("<p>" in r.text or "track(" in r.text for r in whole)


def test_license_edges(spark):
    long = "word " * 30_000
    rows = [
        (1, "MIT License mit  license"), (2, "Licensed under the Apache\nLicense"), (3, "licensed under CC BY-NC 4.0!"), (4, None), (5, " - "), (None, long + "MIT L\u0130CENSE mit license"),
        (6, "x\nThis work is licensed under the GNU General Public License, version 3 or so\ny"), (6, "general public licenses"), (7, "Redistribution and use in source or binary forms, with or without modification, are permitted provided that following conditions are met:"), (7, "mit licenſe Kmit license"),
    ]
    d = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, labels string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t) for i, t in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    got = license_scan.license_scan(d)
    same(got.toPandas(), con.sql(license_scan.oracle()).df())
    by = {r.doc_id: r for r in got.where("doc_id < 6").collect()}
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[2].labels, by[3].labels, by[4].score, by[5].n_words) == (2, 0, 2, "apache", "cc-by-nc", 0.0, 0)
    assert license_scan.license_scan(d.limit(0)).count() == 0


def test_license_notices(spark):
    """Notices in capitals, over several lines or in comments, and ones that share most words."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining\n// a copy of this software and associated documentation\n// files"
    texts = {
        "THIS WORK IS LICENSED UNDER A CREATIVE COMMONS ATTRIBUTION 4.0 INTERNATIONAL LICENSE. KKK": "cc-by",
        "This work is licensed under a Creative Commons\n Attribution-NonCommercial 4.0\n International License.": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        f"/*\n * {mit}": "mit",
        "word " * 1000 + mit + " word" * 1000: "mit",
        "word " * 61 + mit: "mit",
        "Licensed under the GNU Lesser\n\nGeneral Public License, version 2.1.": "gpl,lgpl",
        "BSD: redistribution and use in source and binary forms": "",
        "work work work this is licensed": "",
        "Licensed under CC B\u212a-SA 4.0": "",
    }
    d = spark.createDataFrame([(k, t, "") for k, t in enumerate([*texts, *texts])], "doc_id long, text string, key string")
    got = license_scan.license_scan(d).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [*texts.values()] * 2
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(k, t) for k, t in enumerate([*texts, *texts])], columns=["doc_id", "text"]))
    same(license_scan.license_scan(d).toPandas(), con.sql(license_scan.oracle()).df())


def test_license_plan_has_no_python(spark):
    plan = license_scan.license_scan(table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0 and 0 < docs.count() <= before.count()
        if name == "near_dedup":
            assert near_dedup.near_groups(docs).where("NOT kept").count() == 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()} == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "mixing", "packing"]
