"""Stateful operators over event tables: quotas, click priors, caches, breakers, budgets, carried focus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Forgetting factor of the click prior, and where it starts.
FORGETTING, PRIOR, COVARIANCE = 0.98, 0.5, 1.0
#: Events of a facet that its prior is folded from.
TAIL = 2_000


def quota(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Adds window_start, n (requests of the key in its fixed window so far), allowed and retry_after.

    Refused requests count too; a limit of 0 allows all. Keys and windows are even small, so the window sorts little.
    """
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    start = t - F.pmod(t, F.lit(seconds))
    out = requests.withColumn("window_start", start)
    n = F.row_number().over(W.partitionBy("key", "window_start").orderBy("ts", "id"))
    ok = F.lit(limit == 0) | (n <= limit)
    return out.withColumn("n", n.cast("long")).withColumn("allowed", ok).withColumn("retry_after", F.when(~F.col("allowed"), F.col("window_start") + seconds - t))


def rls(p: Column, cov: Column, y: Column, forgetting: float = FORGETTING) -> tuple[Column, Column]:
    """One recursive least-squares step towards y."""
    k = cov / (forgetting + cov)
    p2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + k * (y - p)))
    return p2, F.greatest(F.lit(1e-4), F.least(F.lit(1e3), (1 - k) * cov / forgetting))


def click_prior(clicks: DataFrame) -> DataFrame:
    """(facet, prior, n): clicks (facet, ts, id, y) folded in time order; y is 1 for the chosen facet, 0 for others shown.

    Forgetting makes what lies TAIL events back weigh less than a double can tell (0.98 to the power of 2,000 is 3e-18),
    so the fold of a facet's last TAIL events is that of all; the window's limit keeps each task's last ones before the
    shuffle, and no facet is gathered whole.
    """
    order = W.partitionBy("facet").orderBy(F.desc("ts"), F.desc("id"))
    tail = clicks.withColumn("back", F.row_number().over(order)).where(F.col("back") <= TAIL)
    total = clicks.groupBy("facet").agg(F.count(F.lit(1)).alias("n"))
    ordered = tail.groupBy("facet").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "y"))).alias("e"))
    start = F.struct(F.lit(PRIOR).alias("p"), F.lit(COVARIANCE).alias("cov"))

    def step(s: Column, e: Column) -> Column:
        p, cov = rls(s["p"], s["cov"], e["y"])
        return F.struct(p.alias("p"), cov.alias("cov"))

    return ordered.join(total, "facet").select("facet", F.round(F.aggregate("e", start, step)["p"], 6).alias("prior"), "n")


def folded(rows: DataFrame, columns: list[str], step: Callable[[Any, dict], tuple[Any, dict]], schema: str) -> DataFrame:
    """Rows (key, ts, id and `columns`) of each key in order of time, through `step(state, row) -> (state, output)`; a
    key's first state is None.

    Keys are dealt by hash and sorted, and a task streams through its rows with the state of one key: nothing of a key is
    gathered, whatever its size.
    """
    names = ["key", "id", *[c.split()[0] for c in schema.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if row["key"] != key:
                    key, state = row["key"], None
                state, found = step(state, row)
                out.append((row["key"], row["id"], *found.values()))
            yield pd.DataFrame(out, columns=names)

    kinds = dict(rows.dtypes)
    seconds = F.col("ts").cast("timestamp").cast("double").alias("t")
    ordered = rows.where("key IS NOT NULL").select("key", "id", "ts", seconds, *columns).repartition("key").sortWithinPartitions("key", "ts", "id").drop("ts")
    return ordered.mapInPandas(run, f"key {kinds['key']}, id {kinds['id']}, {schema}")


def cache_hits(requests: DataFrame, ttl: int) -> DataFrame:
    """(key, id, hit): a request within `ttl` seconds of its key's last miss."""

    def step(miss: float | None, row: dict) -> tuple[float, dict]:
        hit = miss is not None and row["t"] - miss < ttl
        return miss if hit else row["t"], {"hit": hit}

    return folded(requests, [], step, "hit boolean")


def breaker(calls: DataFrame, failures: int = 3, recovery: int = 60) -> DataFrame:
    """(key, id, state before the call: closed, open or half-open): open after so many failures in a row, tried again later.

    A refusal (a call whose `refused` is true, where there is such a column) counts as an answer, not as a failure.
    """

    def step(state: tuple | None, row: dict) -> tuple[tuple, dict]:
        bad, since = state or (0, None)
        name = "closed" if since is None else "half-open" if row["t"] - since >= recovery else "open"
        if name != "open":
            if row["failed"] and not row.get("refused"):
                bad += 1
                since = row["t"] if bad >= failures or name == "half-open" else None
            else:
                bad, since = 0, None
        return (bad, since), {"state": name}

    return folded(calls, ["failed", *[c for c in calls.columns if c == "refused"]], step, "state string")


def ttl_store(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """(key, id, value) of reads (key, ts, id): the last value written (key, ts, id, value, ttl) up to then, null once its
    ttl has passed. An as-of join, as one window over both tables."""
    both = writes.select("key", "ts", "id", "value", "ttl", F.lit(0).alias("kind")).unionByName(reads.select("key", "ts", "id", F.lit(None).cast(dict(writes.dtypes)["value"]).alias("value"), F.lit(None).cast("int").alias("ttl"), F.lit(1).alias("kind")))
    w = W.partitionBy("key").orderBy("ts", "kind", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("kind") == 0, F.struct("ts", "value", "ttl")), ignorenulls=True).over(w)
    seconds = lambda c: c.cast("timestamp").cast("double")
    held = both.withColumn("last", last).where("kind = 1")
    alive = seconds(F.col("ts")) - seconds(F.col("last.ts")) < F.col("last.ttl")
    return held.select("key", "id", F.when(alive, F.col("last.value")).alias("value"))


def ttl_counter(increments: DataFrame, ttl: int) -> DataFrame:
    """(key, id, n): each increment's count, in a window that begins with a key's first one and keeps that expiry."""

    def step(state: tuple | None, row: dict) -> tuple[tuple, dict]:
        start, n = state or (row["t"], 0)
        if row["t"] - start >= ttl:
            start, n = row["t"], 0
        return (start, n + 1), {"n": n + 1}

    return folded(increments, [], step, "n long")


def carry_forward(rows: DataFrame, by: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last value that is not null, up to the row itself."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def budget_cut(rows: DataFrame, by: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows in order while their costs stay within the budget; the first that overflows ends the list."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def round_robin(rows: DataFrame, by: str, lists: str, rank: str, item: str) -> DataFrame:
    """Ranked lists of each `by`, interleaved depth first, each item once."""
    first = rows.withColumn("r", F.row_number().over(W.partitionBy(by, item).orderBy(rank, lists))).where("r = 1").drop("r")
    return first.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(rank, lists)))


def shown_answers(shown: DataFrame, clicks: DataFrame, ttl: int = 86400) -> DataFrame:
    """Clicks (key, interp_id, ts) with the facet that the last showing within `ttl` had; null for unknown ones."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    both = clicks.alias("c").join(shown.alias("s"), (F.col("c.key") == F.col("s.key")) & (F.col("c.interp_id") == F.col("s.interp_id")) & (F.col("s.ts") <= F.col("c.ts")) & (seconds("c.ts") - seconds("s.ts") < ttl), "left")
    return both.groupBy("c.key", "c.interp_id", "c.ts").agg(F.max_by("s.facet", "s.ts").alias("facet"))
