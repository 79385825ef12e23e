"""All settings at once against the operators, one setting after another."""

import itertools
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from proofsearch.functions import text as T
from proofsearch.operators import corpus, retrieval, settings


@pytest.fixture(scope="module")
def lists(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).limit(12).cache()
    parts = b.select("query_id", F.explode(T.split_sentences(F.col("query"))).alias("query"))
    return b, parts, corpus.build_index(d), d


def test_each_setting_equals_the_operators(spark, lists):
    b, parts, index, d = lists
    links = d.select(F.col("document_id").alias("text_id"), (F.col("document_id") + 1).alias("document_id"))
    links = links.unionByName(links).unionByName(d.select(F.col("document_id").alias("text_id"), F.lit(3).cast("long").alias("document_id")))
    grid = settings.Grid((1.0, 0.1), (0.5,), (0.0, 0.5))
    found = settings.rankings(settings.candidates(b, parts, index, 5), links, 5, grid)
    got = {}
    for r in found.collect():
        got.setdefault((r.vector_weight, r.secondary, r.link_boost), []).append((r.query_id, r["rank"], r.document_id, round(r.score, 5)))
    assert len(got) == 4
    for w, s, boost in itertools.product(grid.vector_weight, grid.secondary, grid.link_boost):
        params = replace(retrieval.PARAMS, vector_weight=w, secondary=s, link_boost=boost)
        one = retrieval.link_hop(retrieval.multi_query(b, parts, index, 5, params), links, 5, params)
        assert sorted(got[w, s, boost]) == sorted((r.query_id, r["rank"], r.document_id, round(r.score, 5)) for r in one.collect())


def test_one_shuffle_of_candidates_and_edges(spark, lists):
    rows = [(1, 0, 9, 5, 2.0, 1, 0.5), (1, 0, 9, 6, None, None, 0.4), (1, 1, 8, 6, 1.0, 1, None), (2, 0, 7, 5, 0.0, 1, None)]
    own = spark.createDataFrame(rows, "query_id long, batch int, part long, document_id long, bm25 double, bm25_rank int, reach double")
    none = spark.createDataFrame([], "text_id long, document_id long")
    ranked = settings.rankings(own, none, 5)
    assert ranked.groupBy(*settings.SETTING).count().count() == 24
    assert ranked.where("query_id = 1").groupBy(*settings.SETTING).agg(F.count_distinct("document_id").alias("n")).where("n <> 2").count() == 0
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1
    assert settings.rankings(own.limit(0), none, 5).count() == 0
    # a self-link and a repeated one count for nothing, a link to a document that no list holds brings it in
    links = spark.createDataFrame([(5, 5), (5, 77), (5, 77), (None, 5), (6, None)], "text_id long, document_id long")
    some = settings.rankings(own, links, 5).where("query_id = 2 AND vector_weight = 1.0 AND secondary = 1.0").collect()
    assert {(r.document_id, r.link_boost) for r in some if r.document_id == 77} == {(77, 0.0), (77, 0.5), (77, 1.0)}
    assert not [r for r in some if r.document_id is None]
