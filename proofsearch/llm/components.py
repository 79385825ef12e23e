"""Connected components of a link table, with no link or component ever on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialise


def _minimum(edges: DataFrame) -> DataFrame:
    """Each vertex with the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every linked vertex but the roots; root is the component's smallest vertex.

    `links` has columns u and v (longs). Alternating large and small stars turn every component into one
    star in a few rounds; each round groups by vertex with partial sums, and its joins split at hot keys.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = _both(edges)
        large = both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    out = edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    out._stored_at = edges._stored_at
    return out
