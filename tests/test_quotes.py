"""A passage is made plain once, however many quotes it has."""

from proofsearch.operators import verify


def test_passages_are_plain_before_they_meet_quotes(spark):
    passages = spark.createDataFrame([(1, "Un  caf\xe9\nnoir."), (2, None)], "passage_id long, text string")
    claims = spark.createDataFrame([(1, "cafe noir"), (1, "the"), (1, ""), (1, None), (2, "cafe"), (3, "cafe")], "passage_id long, quote string")
    found = verify.quotes_found(claims, passages)
    assert [r["quote_found"] for r in found.orderBy("passage_id", "quote").collect()] == [False, False, True, False, False, False]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "text#" not in above and "regexp_replace" in below
