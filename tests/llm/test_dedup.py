import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofsearch.llm import near_dedup as N
from proofsearch.llm.base import table
from proofsearch.llm.components import components

SCHEMA = "doc_id long, text string, vertex string"


def brute(rows, width, percent):
    """Smallest doc_id that links reach, from all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for m, both in Counter(m for x in s for m in holders[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                a, b = find(n), find(m)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(n)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return [(len(s), least.get(find(n))) for n, s in enumerate(sets)]


def family(seed, copies, words, edits):
    """A base text and its copies with a few words changed, in one large group."""
    r = random.Random(seed)
    vocabulary = [f"w{seed}x{k}" for k in range(4000)]
    base = [r.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(words)] = r.choice(vocabulary)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_groups_match_brute_force(spark, width, percent):
    texts = family(1, 120, 200, 12) + family(2, 40, 60, 5) + family(3, 30, 12, 2) + ["same few words"] * 40 + ["Same FEW words", "a b", "a b", "a", ""]
    r = random.Random(4)
    line = " ".join(f"c{k}" for k in range(20))
    texts += [line + " " + " ".join(f"u{n}y{k}" for k in range(r.randint(3, 25))) for n in range(60)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    want = brute(sorted(rows), width, percent)
    got = N.near_groups(spark.createDataFrame([(i, t, "z") for i, t in rows], SCHEMA), width, percent).orderBy("doc_id").collect()
    for (i, _), (n, c), g in zip(sorted(rows), want, got, strict=True):
        assert (g.doc_id, g.n_shingles, g.component_id, g.kept) == (i, n, i if n == 0 else c, n == 0 or i == c)


def test_whole_table_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = N.near_groups(docs, 3, 85).orderBy("doc_id").collect()
    assert [(g.n_shingles, g.component_id) for g in got] == [(n, i if n == 0 else c) for (i, _), (n, c) in zip(rows, brute(rows, 3, 85))]


def test_edges(spark):
    rows = [(None, "a b c d", ""), (None, None, ""), (4, "a b c d", ""), (4, "a b c d", ""), (4, "other words stand here", ""), (3, " \n", ""), (2, "a b c  D", ""), (None, "lonely text of nobody", "")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_groups(d, 3, 85).collect())
    assert got == Counter({(None, 2, 2, False): 1, (None, 0, None, True): 1, (4, 2, 2, False): 2, (4, 2, 4, True): 1, (3, 0, 3, True): 1, (2, 2, 2, True): 1, (None, 2, None, True): 1})
    assert N.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = N.drop_near_copies(spark.createDataFrame([(1, "x y z", "a"), (1, "x y z", "a"), (2, "x y z", "b"), (3, "q", "c")], SCHEMA))
    assert kept.columns == ["doc_id", "text", "vertex"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, links):
    parent = list(range(26))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in range(26) if find(x) != x}


def test_estimate_is_close_and_corrected():
    r = np.random.default_rng(1)
    for shared in (0.3, 0.6, 0.9):
        a = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
        b = np.concatenate([a[: int(4000 * shared)], r.integers(0, 1 << 63, 4000 - int(4000 * shared), dtype=np.uint64)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(N.estimate(N.registers(a, 512), N.registers(b, 512), 4000, 4000) - truth) < 0.08
    few = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    assert len(set(N.registers(few, 512).tolist())) <= 3 and (N.registers(few, 512) == N.registers(few[::-1].copy(), 512)).all()


def test_long_text_and_bands():
    words = N.Shingler.words("Ab " * 100_000)
    assert len(N.Shingler(3).hashes(words)) == 1
    bands, rows = N.band_plan(85)
    assert (1 - 0.85**rows) ** bands <= 1e-6
    regs = N.registers(np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), bands * rows)
    assert len(set(N.band_keys(regs, bands, rows).tolist())) == bands


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_equal_sets_of_different_words(spark, width, percent):
    texts = ["spam " * 4, "spam " * 5, "egg " * 1000, "egg " * 1001, "a b c " * 2, "a b c " * 3, "a b c " * 9, "a b c", "b c a " * 4, "p q r s " * 40, "p q r s " * 41 + "p", "spam", "spam spam", "other text of its own words"]
    rows = list(enumerate(texts))
    want = brute(rows, width, percent)
    got = N.near_groups(spark.createDataFrame([(i, t, "z") for i, t in rows], SCHEMA), width, percent).orderBy("doc_id").collect()
    assert [(g.n_shingles, g.component_id) for g in got] == want
    assert got[2].component_id == got[3].component_id == 2


def test_only_near_copies_go(spark):
    rows = [(None, "one text of nobody", "a"), (None, "quite another text here", "b"), (None, "one text of nobody", "c"), (None, None, "d"), (None, " ", "e"), (7, "first words of seven", "f"), (7, "second and other words", "g"), (7, "second and other words", "h"), (9, "first words of SEVEN", "i"), (3, "One text of nobody", "j")]
    kept = N.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, (r.text or "").strip()) for r in kept) == Counter({(3, "One text of nobody"): 1, (None, "quite another text here"): 1, (None, ""): 2, (7, "first words of seven"): 1, (7, "second and other words"): 1})
    one = N.drop_near_copies(spark.createDataFrame([(None, "x y z", "a"), (None, "x y z", "b"), (1, "p q r", "c")], SCHEMA)).collect()
    assert sorted(r.text for r in one) == ["p q r", "x y z"]


def test_any_long_is_an_id(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    texts = {high: "one two three four five six", high - 1: "one two three four five six", low: "red green blue black white grey", 1 << 62: "Red green blue black white grey", (1 << 62) + 1: "all by itself it stands here", -5: "alone as well this one is", 0: "", None: "one two three four five six"}
    d = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_groups(d).collect()}
    assert got == {high: (high - 1, False), high - 1: (high - 1, True), low: (low, True), 1 << 62: (low, False), (1 << 62) + 1: ((1 << 62) + 1, True), -5: (-5, True), 0: (0, True), None: (high - 1, False)}
    assert {r.doc_id for r in N.drop_near_copies(d).collect()} == {high - 1, low, (1 << 62) + 1, -5, 0}


def test_sql_agrees(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({N.oracle()}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in N.near_groups(table(spark, sf, "documents"), 3, 85).orderBy("doc_id").collect()] == want
