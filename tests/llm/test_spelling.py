import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from proofsearch.llm import spelling as S
from proofsearch.llm.base import table

LETTERS = st.text("abcé中", max_size=7)


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=300, deadline=None)
@given(st.sets(LETTERS, max_size=60), st.lists(LETTERS, max_size=20))
def test_neighbours_are_all_words_at_distance_one(words, asked):
    words, asked = sorted(words), asked + sorted(words)
    shard = S.Shard.load(S.Shard.build(words, [1] * len(words)).dump())
    row, word = shard.neighbours(*S.code_points(asked))
    got = list(zip(row.tolist(), word.tolist(), strict=True))
    assert len(got) == len(set(got))
    assert set(got) == {(i, k) for i, a in enumerate(asked) for k, w in enumerate(words) if near(a, w)}
    assert [shard.word(k) for k in range(len(words))] == words


def test_many_letters():
    r = np.random.default_rng(1)
    words = sorted({"".join(chr(0x4E00 + c) for c in r.integers(0, 300, 3)) for _ in range(900)})
    shard = S.Shard.build(words, [1] * len(words))
    assert shard.columns > 2
    row, word = shard.neighbours(*S.code_points(words))
    assert {(i, k) for i, k in zip(row.tolist(), word.tolist(), strict=True)} == {(i, k) for i, a in enumerate(words) for k, b in enumerate(words) if near(a, b)}


def brute(counts: dict[str, int]) -> dict:
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out[w] = (form, n, len(close), counts[form] if form else None)
    roots = {}
    for w in counts:
        at = w
        while out[at][0]:
            at = out[at][0]
        roots[w] = at
    return {w: (f, roots[w], n, m, k) for w, (f, n, m, k) in out.items()}


def test_variants_over_several_shards_and_rounds(spark, monkeypatch):
    r = np.random.default_rng(3)
    counts = {}
    for _ in range(3000):
        counts["".join(r.choice(list("abcd"), r.integers(4, 8)))] = int(10 ** r.uniform(0, 4))
    monkeypatch.setattr(S, "SHARD_WORDS", 300)
    monkeypatch.setattr(S, "ROUND_BYTES", 30_000)
    monkeypatch.setattr(S, "BATCH", 500)
    monkeypatch.setattr(S, "STEP", 700)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in S.spelling_variants(df).collect()}
    assert got == brute(counts)
    assert any(root != form for form, root, *_ in got.values() if form)


def test_counts_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    want: Counter = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        run = ""
        for c in (t or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{d}:{run}".encode())
                run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                want[run] += 1 if len(run) >= 7 else 0
            run = ""
    got = {r.word: r.n for r in S.run_counts(docs).collect()}
    assert got == {w: n for w, n in want.items() if n}


def test_edges(spark):
    long = "x" * 40_000
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "Abcdefgh abcdefgh", 0), (4, f"{long} {long} {long}x {long}x ×÷×÷×÷× ×÷×÷×÷×", 0), (4, "abcdefgh ABCDEFGH", 0)], "doc_id long, text string, word int")
    got = {r.word: r for r in S.document_variants(odd, noise=0).collect()}
    assert set(got) == {"abcdefgh", long, long + "x", "×÷×÷×÷×"} and got["abcdefgh"].n == 4 and got["abcdefgh"].n_near == 0
    assert got[long].n_near == 1 and got[long].form is None and got[long].root == long
    assert S.document_variants(odd.limit(0)).count() == 0
    assert S.document_variants(odd.where("doc_id < 3")).count() == 0
