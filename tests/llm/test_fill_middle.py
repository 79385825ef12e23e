import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofsearch.llm.fill_middle import EventScan, Fim, digests, draws, fill_in_middle, rearranged, restored

UNITS = {"char": r"[\s\S]", "word": r"[ \t\n\r\x0b\x0c]+|[^ \t\n\r\x0b\x0c]+", "line": r"[^\n]*\n|[^\n]+"}
PIECES = st.lists(st.sampled_from(["a", "é", "\U0001f600", " ", "  ", "\n", "\t", "<", "P>", "<P", ">", "S>", "word", " ", "<M"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.sampled_from(sorted(UNITS)))
def test_ranks_are_those_of_listed_units(text, kind):
    scan = EventScan(kind)
    starts, before, marked = scan.segments(text)
    units = re.findall(UNITS[kind], text)
    assert before[-1] == len(units)
    assert [scan.place(starts, before, k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
    assert marked == any(s in text for s in ("<P>", "<S>", "<M>"))


def brute(doc_id, text):
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["one two\nthree", "", "<P> in it", "x<S", "<<<S", "P>", "\U0001f600é" * 40, "z" * 300_000, "a<M>b", "<P", ">S><M"]


def test_output_and_round_trip(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = rows[r.doc_id][1]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, text)
        assert r.back == text


@pytest.mark.parametrize("kind", ["word", "line"])
def test_other_units(spark, kind):
    scan, fim = EventScan(kind), Fim(units=kind)
    for i in range(50):
        text = f"one two  three\nfour {i}\n\nfive"
        units = re.findall(UNITS[kind], text)
        n, form, prefix, middle, output = rearranged(text, i, scan, fim)
        h1, h2, *_ = draws(i, fim.salt)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        assert n == len(units)
        if form != "plain":
            assert (prefix, middle) == (len("".join(units[:a])), len("".join(units[a:b])))


def test_edges(spark):
    odd = spark.createDataFrame([(None, None, 1), (None, "text", 2), (3, None, 3), (4, "same", 4), (4, "same", 5)], "doc_id long, text string, n int")
    got = digests(fill_in_middle(odd)).collect()
    assert len(got) == 5 and [r.n for r in got] == [0, 4, 0, 4, 4]
    assert got[0].form == got[2].form == "plain" and got[3] == got[4]
    assert got[0].output_sha256 == hashlib.sha256(b"").hexdigest()
    assert digests(fill_in_middle(odd.limit(0))).count() == 0
