"""Retrieval under many settings in one pass: lists are made once, and all settings are scored where a question's rows are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus, evaluation, retrieval

SETTING = ["vector_weight", "secondary", "link_boost"]


@dataclass(frozen=True)
class Grid:
    """Values of each setting; all their combinations are scored."""

    vector_weight: tuple[float, ...] = (1.0, 0.25, 0.1, 0.0)
    secondary: tuple[float, ...] = (1.0, 0.5)
    link_boost: tuple[float, ...] = (0.0, 0.5, 1.0)


GRID = Grid()


def candidates(first: DataFrame, others: DataFrame, documents: DataFrame | corpus.Index, top_k: int, params: retrieval.RetrievalParams = retrieval.PARAMS) -> DataFrame:
    """(query_id, batch, part, document_id, bm25, bm25_rank, reach): both lists of each question (batch 0) and of its
    fragments (batch 1, a part each, equal ones once), as deep as `retrieval.multi_query` asks for top_k."""
    index, deep = corpus.as_index(documents), params.pool * 3 * top_k
    main = first.select("query_id", F.lit(0).alias("batch"), "query")
    asked = main.unionByName(others.select("query_id", F.lit(1).alias("batch"), "query").distinct()).withColumn("part", F.xxhash64("query_id", "batch", "query"))
    queries = asked.select(F.col("part").alias("query_id"), "query")
    lex = retrieval.ranked(retrieval.bm25(queries, index, params, deep).withColumnRenamed("score", "bm25"), "bm25", "bm25_rank", deep)
    vec = retrieval.ranked(retrieval.reach(queries, index, params.least_reach, deep), "reach", "vector_rank", deep).drop("vector_rank")
    both = lex.join(vec, ["query_id", "document_id"], "full_outer").where(F.col("bm25_rank").isNotNull() | (F.col("reach") >= params.vector_only_reach))
    return both.withColumnRenamed("query_id", "part").join(asked.drop("query"), "part").select("query_id", "batch", "part", "document_id", "bm25", "bm25_rank", "reach")


def _each(values: tuple[float, ...], name: str) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def rankings(lists: DataFrame, links: DataFrame, top_k: int, grid: Grid = GRID, params: retrieval.RetrievalParams = retrieval.PARAMS) -> DataFrame:
    """(query_id, vector_weight, secondary, link_boost, document_id, score, rank): under each setting, what
    `retrieval.multi_query` and then `retrieval.link_hop` rank, from `candidates` and links (text_id, document_id).

    Rows are dealt by question once, and settings unfold there step by step: fusion has as many rows a candidate as there
    are weights, merging as weights and discounts, links as all settings, on the `3 * top_k` rows that are left. A
    question holds at most `24 * top_k` candidates a part. Without links or lists nothing is lost; repeated links count once.
    """
    cited = links.where("text_id <> document_id").groupBy("text_id").agg(F.collect_set("document_id").alias("cites"))
    rows = lists.join(cited.withColumnRenamed("text_id", "document_id"), "document_id", "left").repartition("query_id")
    part, pool = W.partitionBy("query_id", "part"), 3 * top_k
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(part), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("b", share("bm25")).withColumn("v", share("reach"))
    rows = rows.select("query_id", "batch", "part", "document_id", "bm25_rank", "cites", "b", "v", _each(grid.vector_weight, "vector_weight"))
    rows = rows.withColumn("score", F.round((F.col("b") + F.col("vector_weight") * F.col("v")) / (1 + F.col("vector_weight")), 6))
    order = W.partitionBy("query_id", "part", "vector_weight").orderBy(F.desc("score"), F.asc_nulls_last("bm25_rank"), "document_id")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pool)

    rows = rows.select("query_id", "batch", "document_id", "cites", "vector_weight", "score", _each(grid.secondary, "secondary"))
    rows = rows.withColumn("score", T.settled(F.col("score") * F.when(F.col("batch") == 0, 1.0).otherwise(F.col("secondary"))))
    by = ["query_id", "vector_weight", "secondary"]
    best = rows.groupBy(*by, "document_id").agg(F.max_by("batch", F.struct("score", -F.col("batch"))).alias("batch"), F.max("score").alias("score"), F.first("cites").alias("cites"))
    found = best.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "batch", "document_id"))).where(F.col("r") <= pool)

    # a row of a document's own score, and one for each document that a leading one cites
    kind = dict(lists.dtypes)["document_id"]
    own = F.array(F.struct("document_id", F.col("score").alias("own"), F.lit(None).cast("double").alias("citing")))
    hop = F.transform(F.when(F.col("r") <= params.link_sources, F.col("cites")), lambda d: F.struct(d.cast(kind).alias("document_id"), F.lit(None).cast("double").alias("own"), F.col("score").alias("citing")))
    met = found.select(*by, F.explode(F.concat(own, F.coalesce(hop, F.array().cast(f"array<struct<document_id:{kind},own:double,citing:double>>")))).alias("x"))
    met = met.groupBy(*by, F.col("x.document_id").alias("document_id")).agg(F.max("x.own").alias("own"), F.max("x.citing").alias("citing"))
    met = met.select("*", _each(grid.link_boost, "link_boost"))
    boosted = F.when(F.col("citing").isNotNull(), T.settled(F.coalesce("own", F.lit(0.0)) + F.col("link_boost") * F.col("citing")))
    met = met.withColumn("score", F.greatest("own", boosted)).withColumn("batch", F.when(F.col("own") >= F.coalesce(boosted, F.lit(-1.0)), 0).otherwise(1))
    last = W.partitionBy("query_id", *SETTING).orderBy(F.desc("score"), "batch", "document_id")
    return met.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top_k).select("query_id", *SETTING, "document_id", "score", "rank")


def report(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(vector_weight, secondary, link_boost, metric, mean in percent) of `rankings` against gold (query_id, document_id)."""
    named = ranked.withColumn("system", F.concat_ws("|", *SETTING))
    means = evaluation.retrieval_rows(named, gold).groupBy("system", "metric").agg(F.round(100 * F.avg("value"), 1).alias("mean"))
    return means.select(*[F.split("system", "\\|")[i].cast("double").alias(c) for i, c in enumerate(SETTING)], "metric", "mean")
