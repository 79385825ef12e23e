"""What one task holds or gives out does not grow with the input."""

import random

import numpy as np

from proofsearch.operators import corpus, graph, postings, retrieval


def test_value_groups_tasks_follow_claims(spark, monkeypatch):
    rows = [(q, f"e{q % 7}", "price", float(100 + (q * i) % 9), "EUR", i % 3, 0.5, i) for q in range(40) for i in range(5)]
    claims = spark.createDataFrame(rows, "query_id long, entity string, attribute string, value double, unit string, source_id long, reliability double, ordinal long")
    whole = sorted(map(tuple, graph.value_groups(claims).collect()))
    monkeypatch.setattr(graph, "TASK_ROWS", 20, raising=False)
    found = graph.value_groups(claims)
    assert found.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, found.collect())) == whole


def test_dense_scan_keeps_the_best_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCAN_ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        e = np.random.default_rng(3).integers(-2, 3, (300, 3)).astype(float) + 0.25  # many ties
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<double>").coalesce(1)
        queries = vectors.where("vec_id % 50 = 0")
        rows = retrieval._dense_scan(queries.selectExpr("vec_id", "embedding AS v"), vectors, 5)
        assert rows.count() == 6 * 5
        u = e / np.linalg.norm(e, axis=1, keepdims=True)
        found = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.dense_top_k(queries, vectors, 5).collect()}
        for q in range(0, 300, 50):
            s = np.round(u[q] @ u.T, 6)
            best = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
            assert [found[q, r + 1] for r in range(5)] == best
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_searches_give_out_little_beyond_the_k_best(spark, monkeypatch):
    r = random.Random(4)
    words = [a + b + c for a in ("mar", "lin", "tor", "ved") for b in ("ka", "bo", "dun") for c in ("x", "z", "rt")]
    rows = [(i, " ".join(r.choices(words, k=r.choice([2, 6, 20])))) for i in range(600)] + [(1000 + i, "marka linbo torduny") for i in range(200)]  # many ties
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=4))) for q in range(12)] + [(12, "marka linbo torduny")], "query_id long, query string")
    monkeypatch.setattr(postings, "SHARD_DOCS", 50)
    # several files, and a task for each
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "0"}
    before = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        check_searches(spark, monkeypatch, corpus.build_index(spark.createDataFrame(rows, "document_id long, text string").repartition(5)), queries)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def check_searches(spark, monkeypatch, index, queries):
    shards = index.held.lists().select("shard").distinct().count()
    assert shards > 10
    everything = {(x["query_id"], x["document_id"]): x["score"] for x in retrieval.bm25(queries, index).collect()}
    monkeypatch.setattr(postings, "SAMPLED", 3)
    k, n = 5, 13
    found = postings.scores(retrieval.query_terms(queries), index.held, k).collect()
    best = lambda scores: {(q, d) for q in range(n) for _, d in sorted((-s, d) for (p, d), s in scores.items() if p == q)[:k]}
    assert {(x["query_id"], x["document_id"]) for x in found} == best(everything)
    given = postings.search(retrieval.query_terms(queries.where("query_id < 12")), index.held, k, meters=False).count()
    assert given < shards * k * 12 / 2

    covered = {(x["query_id"], x["document_id"]): x["reach"] for x in retrieval.reach(queries, index).collect()}
    lexical = retrieval.bm25(queries, index, k=k)
    seeded = retrieval.reach(queries, index, 0.12, k, seeds=lexical)
    assert {(x["query_id"], x["document_id"]) for x in retrieval.ranked(seeded, "reach", "r", k).collect()} == best(covered)
    assert seeded.count() < retrieval.reach(queries, index, 0.12, k).count()
    # of documents alike, those behind the k-th are not given out
    assert seeded.where("query_id = 12").count() == k
