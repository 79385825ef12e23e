import hashlib
import random

from proofsearch.llm import mixing
from proofsearch.llm.mixing import Mix, MixTree

DOCS = "doc_id long, text string, lang string, source string, extra string"


def brute_share(weights, caps, budget):
    """Repeated division of what is left among children that are not full."""
    got = [0.0] * len(caps)
    live = [k for k in range(len(caps)) if weights[k] > 0]
    left = min(budget, sum(caps[k] for k in live))
    while live and left > 1e-9:
        total = sum(weights[k] for k in live)
        full = [k for k in live if got[k] + left * weights[k] / total >= caps[k] - 1e-12]
        if not full:
            for k in live:
                got[k] += left * weights[k] / total
            break
        level = min((caps[k] - got[k]) / weights[k] for k in live)
        for k in live:
            got[k] += level * weights[k]
            left -= level * weights[k]
        live = [k for k in live if got[k] < caps[k] - 1e-9]
    return got


def corpus(n=300, seed=1):
    r = random.Random(seed)
    langs, sources = ["en", "en", "en", "fr", "de", None], ["src0", "src0", "src0", "src11", "src16", "x", None]
    return [(k, " ".join(["w"] * r.randint(1, 40)), r.choice(langs), r.choice(sources), "e") for k in range(n)]


def leaf_of(row):
    return mixing._default_domains().get(row[3], mixing.NONE), row[2] or mixing.NONE, row[3] or mixing.NONE


def expected_budgets(rows, tree, share, epochs):
    tokens = {}
    for row in rows:
        tokens[leaf_of(row)] = tokens.get(leaf_of(row), 0) + len((row[1] or "").split())
    out = {}
    total = share * sum(tokens.values())
    domains = sorted({k[0] for k in tokens})
    cap = lambda keep: epochs * sum(v for k, v in tokens.items() if keep(k))
    by_domain = brute_share([tree.domains.get(d, tree.other_domain) for d in domains], [cap(lambda k, d=d: k[0] == d) for d in domains], total)
    for d, b in zip(domains, by_domain):
        langs = sorted({k[1] for k in tokens if k[0] == d})
        for lang, lb in zip(langs, brute_share([tree.languages.get(x, tree.other_language) for x in langs], [cap(lambda k, x=x: k[:2] == (d, x)) for x in langs], b)):
            leaves = sorted(k for k in tokens if k[:2] == (d, lang))
            for leaf, v in zip(leaves, brute_share([1.0] * len(leaves), [epochs * tokens[k] for k in leaves], lb)):
                out[leaf] = v
    return out, tokens


def test_budgets_match_repeated_division(spark):
    rows = corpus()
    for share, epochs in ((0.3, 1), (0.9, 1), (1.5, 2), (5.0, 2)):
        settings = Mix(share=share, epochs=epochs)
        got = {(r.domain, r.lang, r.source): r.budget for r in settings.budgets(settings.counted(spark.createDataFrame(rows, DOCS))).collect()}
        want, tokens = expected_budgets(rows, MixTree(), share, epochs)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1 + 1e-3 for k in want)
        assert sum(got.values()) <= share * sum(tokens.values()) + 1e-6


def test_prefix_reaches_the_budget_and_no_more(spark):
    rows = corpus()
    settings = Mix(share=0.8, epochs=2)
    d = spark.createDataFrame(rows, DOCS)
    budgets = {(r.domain, r.lang, r.source): r for r in settings.budgets(settings.counted(d)).collect()}
    taken = mixing.mix(d, settings).collect()
    assert len(taken) == len(rows)
    for leaf, b in budgets.items():
        own = [r for r in taken if tuple(x or mixing.NONE for x in (r.domain, r.lang, r.source)) == leaf]
        got = sum(r.tokens * r.copies for r in own)
        assert b.budget <= got < b.budget + 41
        assert {r.copies for r in own} <= {b.full, b.full + 1}
    again = {(r.doc_id, r.copies) for r in mixing.mix(d.repartition(7), settings).collect()}
    assert again == {(r.doc_id, r.copies) for r in taken}
    assert mixing.take(d, settings).count() == sum(r.copies for r in taken)


def test_edges(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "src0", "a"), (1, "a b", "en", "src0", "b"), (1, "a b", "en", "src0", "b")]
    d = spark.createDataFrame(rows, DOCS).withColumnRenamed("extra", "tokens")
    out = mixing.mix(d).collect()
    assert len(out) == 4 and all(r.copies >= 0 for r in out)
    assert mixing.take(d).columns == d.columns
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_prefix_is_that_of_the_seeded_order(spark):
    """Which rows a leaf's prefix takes, by sorting its rows."""
    rows = corpus(400, 2)
    settings = Mix(share=0.8, epochs=2)
    d = spark.createDataFrame(rows, DOCS)
    budgets = {(r.domain, r.lang, r.source): r for r in settings.budgets(settings.counted(d)).collect()}
    want = {}
    for leaf, b in budgets.items():
        place = lambda row: hashlib.md5(f"17:{b.full}:{row[0]}".encode()).hexdigest()  # noqa: B023, E731
        before = 0
        for row in sorted((r for r in rows if leaf_of(r) == leaf), key=place):
            want[row[0]] = b.full + (before < b.rest)
            before += len(row[1].split())
    assert {r.doc_id: r.copies for r in mixing.mix(d, settings).collect()} == want


def test_children_without_weight_get_nothing(spark):
    rows = [(k, "a b c d", "en" if k % 2 else "fr", f"src{k % 3}", "") for k in range(60)]
    d = spark.createDataFrame(rows, DOCS)
    for tree, none in ((MixTree(sources={"src0": 0.0}), lambda r: r.source == "src0"), (MixTree(languages={"en": 0.0}), lambda r: r.lang == "en"), (MixTree(domains={"web": 0.0}), lambda r: True), (MixTree(sources={f"src{k}": 0.0 for k in range(3)}), lambda r: True)):
        out = mixing.mix(d, Mix(tree=tree, share=2.0, epochs=1)).collect()
        assert all(r.copies == (0 if none(r) else 1) for r in out)
    # what a child without weight could hold is no room of its parent: its siblings get the whole budget
    tree = MixTree(domain_of={"a": "x", "b": "x", "c": "y"}, domains={"x": 0.5, "y": 0.5}, sources={"a": 0.0})
    rows = [(k, "w w", "en", "abc"[k % 3], "") for k in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), Mix(tree=tree, total=390, epochs=1)).collect()
    assert {s: sum(r.tokens * r.copies for r in out if r.source == s) for s in "abc"} == {"a": 0, "b": 196, "c": 196} or sum(r.tokens * r.copies for r in out) in range(390, 394)


def test_null_keys_are_no_names(spark):
    rows = [(1, "a", None, None, ""), (2, "b", "\0", "\0", ""), (3, "c", "(none)", "(none)", ""), (4, "d", "\0\0", "\0x", "")]
    out = {r.doc_id: (r.lang, r.source) for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: (None, None), 2: ("\0", "\0"), 3: ("(none)", "(none)"), 4: ("\0\0", "\0x")}
    assert Mix().budgets(Mix().counted(spark.createDataFrame(rows, DOCS))).count() == 4
