"""Keyed state in event time against the batch join."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofsearch.operators import links, state
from proofsearch.streaming import answers

START = dt.datetime(2024, 5, 1)


def events(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind = r.randint(0, 1)
        out.append((r.randint(1, 4), kind, f"T{r.randint(0, 2)}", r.choice("abc") if kind == 0 else None, START + dt.timedelta(minutes=r.randint(0, 6 * 1440) * 7 / 7)))
    # one showing at a time, so that the batch join has no ties
    seen, kept = set(), []
    for e in out:
        if (e[0], e[2], e[4], e[1]) not in seen:
            seen.add((e[0], e[2], e[4], e[1]))
            kept.append(e)
    return sorted(kept, key=lambda e: e[4])


def close(spark, days: int):
    return [(None, 0, "end", "end", START + dt.timedelta(days=days)), (99, 0, "end", "end", START + dt.timedelta(days=days))]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    answers.on_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def test_clicks_meet_showings_as_in_the_batch(spark, rocks, tmp_path):
    rows, inbox, out = events(400, 3), f"{tmp_path}/inbox", f"{tmp_path}/out"

    def run(part):
        spark.createDataFrame(part, answers.ROWS).coalesce(1).write.mode("append").parquet(inbox)
        q = answers.clicked(spark.readStream.schema(answers.ROWS).parquet(inbox), 86400, "12 hours").writeStream
        q = q.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress

    cut = len(rows) // 2
    early, late = rows[:cut], rows[cut:]
    early[-5:], late[:5] = late[:5], early[-5:]  # some come in the wrong order, within the watermark
    random.Random(1).shuffle(early)
    run(early)
    run(late)
    held = run(close(spark, 7))
    gone = run(close(spark, 12))
    got = {(r.key, r.interp_id, r.ts): (r.facet, r.known) for r in spark.read.schema(answers.CLICKS).parquet(out).collect()}
    df = spark.createDataFrame(rows, answers.ROWS)
    want = state.shown_answers(df.where("kind = 0"), df.where("kind = 1").select("key", "interp_id", "ts").distinct()).collect()
    assert got == {(r.key, r.interp_id, r.ts): (r.facet, r.facet is not None) for r in want}
    assert {known for _, known in got.values()} == {True, False}
    assert gone.stateOperators[0].numRowsTotal <= held.stateOperators[0].numRowsTotal
    assert gone.stateOperators[0].numRowsTotal < 12  # one closing row of the 400


TITLES = [(1, "marie curie"), (2, "curie"), (3, "marie curie institute of science"), (4, "the 3.5 plan"), (5, "marie curie"), (6, "")]
TEXTS = [(1, "So Marie Curie, and the Marie Curie Institute of Science."), (2, "Institute of science; curie curie marie"), (3, None), (4, ""), (5, "THE 3.5 PLAN"), (6, "mariecurie marie")]


@pytest.mark.parametrize("chars", [10_000, 0])
def test_titles_by_automaton_and_by_beginnings(spark, monkeypatch, chars):
    monkeypatch.setattr(links, "AUTOMATON_CHARS", chars)
    titles = spark.createDataFrame(TITLES, "document_id long, title string").select("document_id", F.expr("filter(split(title, ' '), x -> x <> '')").alias("key")).withColumn("n", F.size("key"))
    got = {(r.text_id, r.document_id): r.position for r in links.mentions(spark.createDataFrame(TEXTS, "text_id long, text string"), titles).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (1, 3): 6, (1, 5): 2, (2, 2): 4, (5, 4): 1}
    assert links.mentions(spark.createDataFrame(TEXTS, "text_id long, text string"), titles.limit(0)).count() == 0
    assert links.mentions(spark.createDataFrame([], "text_id long, text string"), titles).count() == 0


def test_many_documents_of_one_title_and_long_titles(spark, monkeypatch):
    """Equal titles of many documents, heavy ones dealt over tasks; a run that two hashes share is told apart by its words."""
    titles = [(i, ["the", "red", "fox"][: 1 + i % 3], 1 + i % 3) for i in range(300)] + [(900, list("abcdefgh"), 8), (7, ["den"], 1)]
    texts = [(i, "A fox. The red fox, the red den! " + ("a b c d e f g h" if i % 2 else "a b c d e f g x h")) for i in range(40)] + [(99, "the red"), (98, "red fox"), (97, None), (None, "the")]
    want: dict[tuple, int] = {}
    for t, text in texts:
        words = [w for w in (text or "").lower().replace(".", "").replace(",", "").replace("!", "").split()]
        for d, key, n in titles:
            at = next((i + 1 for i in range(len(words) - n + 1) if words[i : i + n] == key), None)
            if at is not None:
                want[t, d] = min(at, want.get((t, d), at))
    held = spark.createDataFrame(titles, "document_id long, key array<string>, n int")
    for chars in (1 << 20, 0):
        monkeypatch.setattr(links, "AUTOMATON_CHARS", chars)
        for rows, part in ((2_000_000, 2_000_000), (50, 9)):
            monkeypatch.setattr(links, "TASK_ROWS", rows)
            monkeypatch.setattr(links, "PART_WORDS", part)
            found = links.mentions(spark.createDataFrame(texts, "text_id long, text string"), held).collect()
            assert len(found) == len(want) and {(r.text_id, r.document_id): r.position for r in found} == want


class Calls:
    """State of one key in memory that counts the messages to it."""

    def __init__(self):
        self.n, self.rows, self.held = 0, [], {}

    def getListState(self, *a):
        return self

    getMapState = getListState

    def __getattr__(self, name):
        def call(*a):
            self.n += 1
            return {
                "appendValue": lambda r: self.rows.append(r), "appendList": lambda r: self.rows.extend(r), "put": lambda r: self.rows.__setitem__(slice(None), r), "get": lambda: list(self.rows), "clear": self.rows.clear,
                "exists": lambda: True, "iterator": lambda: iter([(k, v) for k, v in self.held.items()]), "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k],
                "updateValue": self.held.__setitem__, "removeKey": self.held.pop, "registerTimer": lambda t: None,
            }[name](*a)

        return call


def test_messages_to_the_state_grow_with_names_and_not_with_rows():
    class At:
        def getExpiryTimeInMs(self):
            return int((START + dt.timedelta(hours=1)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    calls = {}
    for n in (20, 2000):
        own, p = Calls(), answers.ShownAnswers(86400)
        p.init(own)
        # two names whose showings and clicks take turns, and one row that comes after the timer's time
        rows = pd.DataFrame([(1, i // 2 % 2, f"T{i % 2}", None if i // 2 % 2 else "abc"[i % 3], pd.Timestamp(START) + pd.Timedelta(microseconds=i)) for i in range(n)] + [(1, 1, "T0", None, pd.Timestamp(START) + pd.Timedelta(hours=10))], columns=["key", "kind", "interp_id", "facet", "ts"])
        assert list(p.handleInputRows((1,), iter([rows]), None)) == []
        out = pd.concat(p.handleExpiredTimer((1,), None, At()))
        assert len(out) == n // 2 and out["known"].all() and out["facet"].tolist() == ["abc"[(i - 2) % 3] for i in range(n) if i // 2 % 2]
        assert len(own.rows) == 1 and set(own.held) == {("T0",), ("T1",)}
        calls[n] = own.n
    assert calls[2000] == calls[20] < 20
