"""Alias resolution against the fold that defines it."""

import random

import pytest

from proofsearch.operators import aliases

SCHEMA = "query_id long, ordinal long, key string"


def alike(a: str, b: str) -> bool:
    wa, wb = set(a.split()), set(b.split())
    digits = lambda w: {x for x in w if any("0" <= c <= "9" for c in x)}
    if a == b:
        return True
    if not wa or not wb or digits(wa) != digits(wb):
        return False
    return (wa <= wb or wb <= wa) and min(len(wa), len(wb)) >= 2 or len(wa & wb) / len(wa | wb) >= 0.6


def fold(rows: list[tuple]) -> dict:
    """(query, key) -> the first leader, in order of first ordinals, ties by key."""
    first: dict = {}
    for q, o, k in rows:
        if k is not None:
            first[q, k] = min(first.get((q, k), (True, 0)), (o is None, o or 0))
    leaders, out = {}, {}
    for (q, k), _ in sorted(first.items(), key=lambda x: (x[1], x[0][1])):
        known = leaders.setdefault(q, [])
        out[q, k] = next((x for x in known if alike(k, x)), k)
        if out[q, k] == k:
            known.append(k)
    return out


def resolved(spark, rows: list[tuple]) -> list[tuple]:
    found = aliases.resolve_entities(spark.createDataFrame(rows, SCHEMA))
    return [(r.query_id, r.ordinal, r.key, r.canonical) for r in found.collect()]


def check(spark, rows: list[tuple]) -> None:
    want = fold(rows)
    assert sorted(resolved(spark, rows), key=str) == sorted(((q, o, k, want.get((q, k))) for q, o, k in rows), key=str)


def test_order_decides(spark):
    """b is alike to a and c, which are not alike: who leads depends on who comes first."""
    a, b, c = "red car", "red car fast", "car fast"
    for first, second, third in [(a, b, c), (b, a, c), (c, b, a), (a, c, b)]:
        check(spark, [(1, 1, first), (1, 2, second), (1, 3, third)])
    assert {(k, x) for _, _, k, x in resolved(spark, [(1, 1, a), (1, 2, b), (1, 3, c)])} == {(a, a), (b, a), (c, c)}
    assert {(k, x) for _, _, k, x in resolved(spark, [(1, 2, a), (1, 1, b), (1, 3, c)])} == {(a, b), (b, b), (c, b)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_fold(spark, seed):
    """Few words, so that keys are alike in long rows; digits, permuted words, ties and repeats among them."""
    rnd = random.Random(seed)
    words = ["pro", "max", "slim", "x1", "2", "blue", "ion", "air"]
    rows = [(rnd.randrange(3), rnd.randrange(60), " ".join(rnd.sample(words, rnd.randint(1, 6)))) for _ in range(400)]
    check(spark, rows)


def test_edges(spark):
    rows = [(1, 1, ""), (1, 2, None), (1, 3, " "), (None, 1, "big bus"), (None, 2, "big bus red"), (1, None, "big bus red"), (1, 9, "big bus"), (1, 9, "big bus"), (2, 1, "one " * 3000 + "end"), (2, 2, "one end")]
    found = resolved(spark, rows)
    assert len(found) == len(rows)
    assert {(q, k, x) for q, _, k, x in found if k is None or not k.strip()} == {(1, "", ""), (1, None, None), (1, " ", " ")}
    assert {x for q, _, k, x in found if q is None} == {"big bus"}
    assert {x for q, _, k, x in found if k and k.startswith("big") and q == 1} == {"big bus"}
    assert {len(x) for q, _, k, x in found if q == 2} == {len(rows[8][2])}
    assert resolved(spark, []) == []


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, 1, "a b", "x", 3, "p")], SCHEMA + ", word string, n long, place string")
    assert aliases.resolve_entities(d).columns == ["query_id", "ordinal", "key", "canonical"]


def test_batches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(aliases, "FIRST_BATCH", 4)
    rnd = random.Random(5)
    words = ["pro", "max", "slim", "x1", "2", "blue", "ion", "air"]
    check(spark, [(rnd.randrange(2), rnd.choice([None, *range(90)]), " ".join(rnd.sample(words, rnd.randint(1, 5)))) for _ in range(200)])


def test_one_large_question(spark, monkeypatch):
    """2,600 keys of one question in dense groups (one word of four differs), in no order: few of their pairs meet."""
    keys = [f"{'brand ' if i % 3 == 0 else ''}w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} v{chr(97 + i // 676 % 26)} item" for i in range(2_600)]
    random.Random(1).shuffle(keys)
    rows = [(1, i, k) for i, k in enumerate(keys)]
    met, pairs = [], aliases.alike_pairs

    def counted(*args):
        found = pairs(*args)
        met.append(found.count())
        return found

    monkeypatch.setattr(aliases, "alike_pairs", counted)
    check(spark, rows)
    assert len(met) > 3
    assert sum(met) < pairs(aliases.keyed(spark.createDataFrame(rows, SCHEMA))).count() / 5
