"""Statements as candidates: sentences of a question's passages, by how far they reach and cover it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import stored
from . import corpus, reason, retrieval

#: Passages of a question that are read, words a sentence has, and the least admissibility.
PASSAGES, WORDS, STATEMENT_FLOOR = 6, (4, 70), 0.12


def lexical_degree(text: Column, required: list[str] | None = None, forbidden: list[str] | None = None) -> Column:
    """0 with a forbidden term; else the share of required terms that are there, 1 if none is required."""
    plain = T.normalize(text)
    has = lambda t: F.contains(plain, T.normalize(F.lit(t)))
    share = F.lit(1.0)
    if required:
        share = sum((F.when(has(t), 1.0).otherwise(0.0) for t in required[1:]), F.when(has(required[0]), 1.0).otherwise(0.0)) / len(required)
    for t in forbidden or []:
        share = F.when(has(t), 0.0).otherwise(share)
    return share


def coverage(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, item, coverage): the question's terms (query_id, term) that an item (query_id, item, term) has, by weight.

    A term weighs ln((n + 1) / (df + 0.5)) over the question's items; if all weights vanish, plain shares count.
    """
    items = held.select("query_id", "item").distinct()
    n = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    terms = held.select("query_id", "item", "term").distinct()
    df = asked.join(terms, ["query_id", "term"]).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    w = asked.join(n, "query_id").join(df, ["query_id", "term"], "left")
    weight = F.greatest(F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 0.5)), F.lit(0.0))
    w = w.select("query_id", "term", weight.alias("w"))
    total = w.groupBy("query_id").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("terms"))
    hit = terms.join(w, ["query_id", "term"]).groupBy("query_id", "item").agg(F.sum("w").alias("got"), F.count(F.lit(1)).alias("hits"))
    out = items.join(total, "query_id", "left").join(hit, ["query_id", "item"], "left")
    got = F.when(F.col("total").isNull(), 1.0).when(F.col("total") > 0, F.coalesce("got", F.lit(0.0)) / F.col("total")).otherwise(F.coalesce("hits", F.lit(0)) / F.col("terms"))
    return out.select("query_id", "item", F.round(T.clamp01(got), 6).alias("coverage"))


def admissibility(queries: DataFrame, sentences: DataFrame, required: list[str] | None = None, forbidden: list[str] | None = None) -> DataFrame:
    """(query_id, item, reach, coverage, constraint, degree) of sentences (query_id, item, sentence): the least of three degrees."""
    key = F.struct("query_id", "item")
    own = sentences.select("query_id", "item", "sentence")
    words = own.select("query_id", "item", F.explode(T.content_words(F.col("sentence"))).alias("term"))
    vectors = corpus.vector(words.select(key.alias("document_id"), "term")).select("document_id.query_id", "document_id.item", "bucket", "w")
    asked = corpus.vector(retrieval.query_terms_all(queries)).withColumnRenamed("document_id", "query_id").withColumnRenamed("w", "q")
    norm = asked.groupBy("query_id").agg(F.sum(F.col("q") * F.col("q")).alias("norm"))
    left = F.greatest(F.col("q") - F.col("w"), F.lit(0.0))
    met = asked.join(vectors, ["query_id", "bucket"]).groupBy("query_id", "item").agg(F.sum(F.col("q") * F.col("q") - left * left).alias("met"))
    r = own.join(norm, "query_id", "left").join(met, ["query_id", "item"], "left")
    reach = F.when(F.col("norm").isNull(), 1.0).otherwise(1 - F.sqrt(F.greatest(F.col("norm") - F.coalesce("met", F.lit(0.0)), F.lit(0.0))) / F.sqrt("norm"))
    cover = coverage(retrieval.query_terms(queries), own.select("query_id", "item", F.explode_outer(T.content_words(F.col("sentence"))).alias("term")))
    out = r.withColumn("reach", F.round(T.clamp01(reach), 6)).withColumn("constraint", lexical_degree(F.col("sentence"), required, forbidden)).join(cover, ["query_id", "item"])
    return out.select("query_id", "item", "sentence", "reach", "coverage", "constraint", F.least("reach", "coverage", "constraint").alias("degree"))


def drafts(queries: DataFrame, found: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, place, document_id, sentence, degree) of each question's statements.

    `found` has (query_id, document_id, rank); sentences of the first passages that are neither short nor long are
    ranked by admissibility, near copies of one kept before go, and degrees are taken over the best.
    """
    # stored, so that Spark knows how few they are and sends them to the texts; what many steps read is made once
    found = stored(found.where(F.col("rank") <= PASSAGES), "found")
    read = found.join(passages.select("document_id", "text"), "document_id")
    s = read.select("query_id", "document_id", "rank", F.posexplode(T.split_sentences(F.col("text"))).alias("n", "sentence"))
    s = s.where(F.size(F.split(F.trim("sentence"), r"\s+")).between(*WORDS))
    s = stored(s.withColumn("item", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "n")).cast("long")), "sentences")
    judged = admissibility(queries, s).join(s.select("query_id", "item", "document_id"), ["query_id", "item"]).where(F.col("degree") >= STATEMENT_FLOOR)
    judged = stored(judged, "judged")
    order = W.partitionBy("query_id").orderBy(F.desc("degree"), "item")
    ranked = judged.withColumn("rank", F.row_number().over(order)).withColumn("id", F.col("item")).withColumn("words", F.array_distinct(T.content_words(F.col("sentence"))))
    kept = reason.suppress_near_duplicates(ranked.select("query_id", "rank", "id", "words")).withColumnRenamed("id", "item")
    best = F.max("degree").over(W.partitionBy("query_id"))
    out = judged.withColumn("share", F.round(F.least(F.lit(1.0), F.col("degree") / best), 4)).join(kept, ["query_id", "item"])
    return out.select("query_id", "place", "document_id", "sentence", F.col("share").alias("degree"))
