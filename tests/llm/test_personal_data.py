import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofsearch.llm import personal_data as P

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind: str, v: str) -> bool:
    digits = [int(c) for c in v if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return True


def plain_spans(text: str) -> list:
    return sorted((m.start(), k, m.end()) for k, name in enumerate(P.KINDS) for m in PLAIN[name].finditer(text) if passes(name, m.group()))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "b.c", "1", "25", "256", "4111111111111111", " ", "-", "+", "+1 (555) 010-9999", "(", "1.2.3.4", "é", "x@y.z", "_%"]), max_size=14).map("".join))
def test_patterns_match_as_written(text):
    assert P.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    n = 300_000
    for text in ("a" * n, "1" * n, "a@" * n, "+1" * n, "1." * n, "1 " * n + "x", "+1" + "(" * n, "1.2.3" + "4" * n, "a@b." * 50_000):
        P.base_spans(text)


WORDS = ["thing", "other", "place", "apple", "river", "stone", "cloud", "month"]


def people(r: random.Random) -> list[str]:
    """Quibbly reveals one address, Quintus another one and so do its first letters; thing stands everywhere."""
    texts = [" ".join(r.choices(WORDS, k=30)) for _ in range(60)]
    for k in range(6):
        texts.append(f"{' '.join(r.choices(WORDS, k=9))} {r.choice(WORDS)} Quibbly wrote from quib@mail.example.com thing {k} {' '.join(r.choices(WORDS, k=9))}")
        texts.append(f"{' '.join(r.choices(WORDS, k=9))} call Zebulon at +1 555 010 {4000 + k // 6} thing {k} {r.choice(WORDS)}")
    texts += ["Quibbly was here too", "no quisling here but quince", "zebulon alone"]
    return texts + ["seldom rare@mail.example.com words"] * 5


def brute(texts: list[str]) -> list[list]:
    """All pairs of entities and terms, by their definition."""
    def words(t):
        return [(m.group().lower(), m.start(), m.end()) for m in re.finditer("[A-Za-zÀ-ÿ]+", t) if len(m.group()) >= P.LEAST]

    def keys(w):
        return {w, w[: P.KEPT] + "*"}

    n = len(texts)
    n_t, n_e, pairs = {}, {}, {}
    for t in texts:
        for x in set().union(set(), *(keys(w) for w, _, _ in words(t))):
            n_t[x] = n_t.get(x, 0) + 1
        seen = {}
        for a, k, b in plain_spans(t):
            e = P.entity(k, t[a:b])
            seen.setdefault((e, None), 0)
            for w, s, f in words(t):
                if s >= a - P.WINDOW and f <= b + P.WINDOW and (f <= a or s >= b):
                    for x in keys(w):
                        seen.setdefault((e, x), (t[max(0, a - P.WINDOW) : a], t[b : b + P.WINDOW]))
        for (e, x), around in seen.items():
            if x is None:
                n_e[e] = n_e.get(e, 0) + 1
            else:
                pairs.setdefault((e, x), []).append(around)
    told = {(e, x) for (e, x), all_ in pairs.items() if len(set(all_)) >= P.SUPPORT and n_e[e] < n and math.log2(len(all_) * n / n_e[e] / n_t[x]) / math.log2(n / n_e[e]) >= P.DISCLOSED - 1e-9}
    terms = {}
    for e, x in told:
        if not x.endswith("*"):
            terms[x] = terms.get(x, False) or (e, x[: P.KEPT] + "*") in told
    out = []
    for t in texts:
        base = plain_spans(t)
        out.append(sorted((s, f, terms[w]) for w, s, f in words(t) if w in terms and not any(a < f and b > s for a, _, b in base)))
    return out


def test_revealing_terms_against_all_pairs(spark):
    texts = people(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    got = {r.doc_id: r for r in P.find_personal_data(docs).collect()}
    assert [[(s.start, s.end, s.removed) for s in got[i].terms] for i in range(len(texts))] == want
    assert [[(s.start, s.kind, s.end) for s in got[i].base] for i in range(len(texts))] == [plain_spans(t) for t in texts]
    clean = {r.doc_id: r.text for r in P.sanitised(docs).collect()}
    i = next(i for i, t in enumerate(texts) if "Quibbly wrote" in t)
    assert "Quibbly" not in clean[i] and "[EMAIL]" in clean[i] and "thing" in clean[i]
    assert clean[texts.index("Quibbly was here too")].endswith(" was here too")
    assert clean[len(texts) - 1] == "seldom [EMAIL] words"
    assert {s.removed for r in got.values() for s in r.terms} == {True, False}


def test_query_columns(spark):
    docs = spark.createDataFrame([(7, "mail a@b.cd or 10.0.0.1")], "doc_id long, text string")
    r = P.span_digests(P.find_personal_data(docs)).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 0, "email:5:11,ip:15:23")
    assert r.base_sha256 == hashlib.sha256(b"email:5:11,ip:15:23").hexdigest()


@pytest.mark.parametrize("bits", [1 << 13, 1 << 15])
def test_bitmap_holds_every_term(spark, bits, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BITS", bits)
    terms = [f"term{k}" for k in range(400)]
    held = P.bitmap(spark.createDataFrame([(t,) for t in terms], "term string"), len(terms))
    assert len(held) == bits and all(held[P.bit_of(t, bits)] for t in terms) and held.sum() <= 400


def test_edges(spark):
    long = "a@b.cd " + "word " * 60_000
    odd = spark.createDataFrame([(None, None, "x"), (None, "a@b.cd", "x"), (1, "", "x"), (2, long, "x"), (3, "same 10.0.0.1", "x"), (3, "same 10.0.0.1", "x")], "doc_id long, text string, digest string")
    got = P.span_digests(P.find_personal_data(odd)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in got) == [(0, 0, 0, ""), (0, 1, 0, "email:0:6"), (1, 0, 0, ""), (2, 1, 0, "email:0:6"), (3, 0, 1, "ip:5:13"), (3, 0, 1, "ip:5:13")]
    assert P.span_digests(P.find_personal_data(odd.limit(0))).count() == 0
    assert sorted(r.text for r in P.sanitised(odd).collect())[:3] == ["", "", "[EMAIL]"]
