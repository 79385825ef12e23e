"""Small rules against their definition, and intervals against exact resampling."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofsearch import queries
from proofsearch.operators import metrics, planner, verify
from proofsearch.sources import documents as S


@pytest.mark.parametrize(
    "raw,text",
    [
        ("He -LRB- a king -RRB- said -- `` no '' .", 'He (a king) said – " no ".'),
        ("She 's here , he 'd n't go -LSB- 1 -RSB- !", "She's here, he'dn't go [1]!"),
        (" a  , b ", "a , b"),
    ],
)
def test_detokenised(spark, raw, text):
    assert spark.createDataFrame([(raw,)], "t string").select(S.detokenize(F.col("t")).alias("t")).first().t == text


def test_free_quantities(spark):
    values = ["16 Go", "2 To", " 12 ", "3,5", "7 or so", "", None, "1234567890", "costs 5 € or 3 kg"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(verify.free_quantity("v").alias("q")).collect()
    assert [(r.q.value, r.q.unit) for r in got] == [(16.0, "GB"), (2000.0, "GB"), (12.0, ""), (3.5, ""), (None, None), (None, None), (None, None), (None, None), (5.0, "EUR")]


def test_items_of_a_comparison_lose_their_articles(spark):
    q = spark.createDataFrame([(1, "le Orion X200 vs la Vega 3")], "query_id long, query string")
    rows = planner.interpretations(planner.plan(q)).orderBy("interp_id").collect()
    assert [(r.facet, r.label) for r in rows[1:]] == [("orion x200", "Orion X200"), ("vega 3", "Vega 3")]


def test_interval_is_that_of_exact_resampling(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(3, 1, 400), r.exponential(9, 100)])
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0)] * 3 + [("c", None)], "k string, v double")
    got = {x.key: x for x in metrics.bootstrap(df, "k", "v").collect()}
    means = v[r.integers(0, len(v), (4000, len(v)))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert abs(got["a"].low - low) < 0.06 * (high - low) and abs(got["a"].high - high) < 0.06 * (high - low)
    assert got["a"]["mean"] == pytest.approx(v.mean()) and set(got) == {"a", "b"}
    assert (got["b"]["mean"], got["b"].low, got["b"].high) == (1.0, 1.0, 1.0)
    again = {x.key: x for x in metrics.bootstrap(df.repartition(7), "k", "v").collect()}
    assert again["a"].low == got["a"].low and again["a"].high == got["a"].high


def test_question_types_have_the_word_boundaries_of_their_sql(spark, tmp_path):
    texts = ["öbest, ene", "te bestö sch", "the best one", "ébest", "compare\u000bthem", "what\u000bis it", "what  is it", "DÉFINITION", "top 10 phones", "qu'est-ce que X", "vs.", "xvs y", "lequel?", ""]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(queries.SQL["question_types"]).df().sort_values("query_id")
    got = queries.question_types(spark, str(tmp_path)).toPandas().sort_values("query_id")
    assert got.question_type.tolist() == want.question_type.tolist() and got.n_terms.tolist() == want.n_terms.tolist()
