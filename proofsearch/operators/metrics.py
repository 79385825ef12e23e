"""Measures of rankings and answers, intervals, usage and prices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RESAMPLES = 2000
#: Groups whose sums a task holds before it hands them on.
HELD_GROUPS = 256


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int, within: int = 10) -> DataFrame:
    """(query_id, recall, all_found, mrr): of gold (query_id, document_id) in ranked (query_id, document_id, rank)."""
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranked.join(gold, ["query_id", "document_id"])
    found = hits.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hits"), F.min("rank").alias("first"))
    out = n.join(found, "query_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return out.select("query_id", F.round(h / F.col("n_gold"), 6).alias("recall"), (h == F.col("n_gold")).alias("all_found"), F.round(F.when(F.col("first") <= within, 1 / F.col("first")).otherwise(0.0), 6).alias("mrr"))


def answer_f1(pairs: DataFrame) -> DataFrame:
    """(id, exact, f1, contained) of (id, prediction, gold): overlap of normalised tokens with their counts."""
    p = pairs.select("id", T.normalize_answer(F.col("prediction")).alias("p"), T.normalize_answer(F.col("gold")).alias("g"))
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    counts = lambda c: p.select("id", F.explode(tokens(F.col(c))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    common = counts("p").join(counts("g"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("n_p", "n_g")).alias("common"))
    out = p.join(common, "id", "left").select("id", "p", "g", F.size(tokens(F.col("p"))).alias("np"), F.size(tokens(F.col("g"))).alias("ng"), F.coalesce("common", F.lit(0)).alias("common"))
    special = ["yes", "no", "noanswer"]
    f1 = F.when((F.col("p").isin(special) | F.col("g").isin(special)) & (F.col("p") != F.col("g")), 0.0).when(F.col("common") == 0, 0.0).otherwise(2 * F.col("common") / (F.col("np") + F.col("ng")))
    contained = (F.col("g") != "") & F.contains(F.concat(F.lit(" "), "p", F.lit(" ")), F.concat(F.lit(" "), "g", F.lit(" ")))
    return out.select("id", (F.col("p") == F.col("g")).alias("exact"), F.round(f1, 6).alias("f1"), contained.alias("contained"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95, mean): exact percentiles with linear interpolation."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95"), F.round(F.avg(value), 6).alias("mean"))


def bootstrap(rows: DataFrame, by: str, value: str, seed: int = 0, resamples: int = RESAMPLES) -> DataFrame:
    """(key, mean, low, high): 95 % interval of the mean over seeded resamples.

    Each value weighs a Poisson number in each resample, drawn from a generator of its own (seed, group and value), so
    tasks sum weights and weighted values on their own and the sums of all tasks add up: the draw doesn't depend on how
    rows are dealt, and a task holds two numbers a resample and group, however many values there are. The interval's
    ends differ from those of drawing n of n by a share of its width that falls with the root of the number of resamples,
    under a twentieth for 2000 of them.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).cast("string").alias("key"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"key": list(sums), "sums": [s.tobytes() for s in sums.values()]})

        for b in batches:
            for key, v, n in zip(b["key"], b["v"], b["n"], strict=True):
                digest = hashlib.blake2b(f"{seed}|{key}|{v!r}".encode(), digest_size=16).digest()
                w = np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64))).poisson(n, resamples).astype(np.float64)
                held = sums.setdefault(key, np.zeros((3, resamples)))
                # the third row has the plain sums, which no draw changes
                held[0] += w
                held[1] += w * v
                held[2, :2] += (n, n * v)
            if len(sums) >= HELD_GROUPS:
                yield out()
                sums.clear()
        if sums:
            yield out()

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for b in batches:
            for k, raw in zip(b["key"], b["sums"], strict=True):
                own = np.frombuffer(raw).reshape(3, resamples)
                if k != key:
                    if key is not None:
                        yield interval(key, total)
                    key, total = k, np.zeros((3, resamples))
                total += own
        if key is not None:
            yield interval(key, total)

    def interval(key: str, total: np.ndarray) -> pd.DataFrame:
        drawn = total[0] > 0  # a resample of a few values may be empty
        means = total[1][drawn] / total[0][drawn] if drawn.any() else np.array([total[2, 1] / total[2, 0]])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"key": [key], "mean": [total[2, 1] / total[2, 0]], "low": [round(low, 9)], "high": [round(high, 9)]})

    partial = counted.mapInPandas(draw, "key string, sums binary")
    # a row for each task and group; a task streams through them, sorted, with the sums of one group
    return partial.repartition("key").sortWithinPartitions("key").mapInPandas(added, "key string, mean double, low double, high double")


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str, seed: int = 0) -> DataFrame:
    """Interval of the mean difference of two systems on the same items; an item that either lacks is left out."""
    d = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    return bootstrap(d.select(F.lit("difference").alias("system"), (F.col("a") - F.col("b")).alias("d")), "system", "d", seed)


def usage(rows: DataFrame, by: str) -> DataFrame:
    """(by, calls, tokens, cost): the cost is unknown as soon as one is."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.when(~F.bool_or(F.col("cost").isNull()), F.round(F.sum("cost"), 6)).alias("cost"))


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost by the longest price prefix of the model's name; null where none fits. `prices` has (prefix, price) a million tokens."""
    fits = rows.join(F.broadcast(prices), F.startswith("model", "prefix"), "left") if prices.count() <= 10_000 else rows.join(prices, F.startswith("model", "prefix"), "left")
    keep = [c for c in rows.columns]
    best = fits.groupBy(*keep).agg(F.max_by("price", F.length("prefix")).alias("price"))
    return best.withColumn("cost", F.col("tokens") * F.col("price") / 1e6)
