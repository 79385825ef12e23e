"""Candidates, premises, the gate, scores and the final selection; verification of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Least admissibility; support from which a claim is a fact; share of the first answer that a third needs.
FLOOR, FACT, KEEP_RATIO = 0.15, 0.6, 0.5
#: Drafts kept of each family, and what a status weighs.
MOST_ENTITIES, MOST_VALUES, MOST_STATEMENTS = 8, 6, 3
STATUS_WEIGHT = {"fact": 1.0, "inference": 1.0, "uncertain": 0.5, "unverified": 0.0}
SEVERITY = ["inference", "uncertain", "unverified"]
CANDIDATE = ["query_id", "interp_id", "candidate_key"]


def kleene_dienes(confidence: Column, satisfied: Column) -> Column:
    """How far a requirement holds: met, or not certain itself."""
    return F.greatest(1 - confidence, satisfied)


def facet_degree(own: Column, sibling: Column, has_terms: Column) -> Column:
    """1 with a term of its own facet, 0.1 with a sibling's, 0.5 with neither; null without terms: no premise."""
    return F.when(has_terms, F.when(own, 1.0).when(sibling, 0.1).otherwise(0.5))


def godel_gate(premises: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(candidate, admissibility, rejected, reason): the least degree decides, and the first weakest premise is the reason."""
    low = premises.groupBy(*CANDIDATE).agg(F.min("degree").alias("a"), F.min_by("label", F.struct("degree", "ordinal")).alias("weakest"))
    a = F.round("a", 4)
    rejected = (a <= 0) | (a < floor)
    return low.select(*CANDIDATE, a.alias("admissibility"), rejected.alias("rejected"), F.when(rejected, F.col("weakest")).alias("reason"))


def support_degree(reliabilities: Column) -> Column:
    """Aggregate over distinct sources' reliabilities."""
    return T.settled(1 - F.exp(-F.sum(reliabilities) / 2), 4)


def status_weight(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_WEIGHT.items() for x in kv]), status)


def tap_score(gate: DataFrame, claims: DataFrame, conflicts: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds support, faithfulness, penalty, quality and reliability to the gate's rows.

    `claims` (candidate, status), `conflicts` (candidate, n), `sources` (candidate, source_id, reliability).
    """
    best = sources.groupBy(*CANDIDATE, "source_id").agg(F.max("reliability").alias("r")).groupBy(*CANDIDATE).agg(support_degree(F.col("r")).alias("support"))
    faith = claims.groupBy(*CANDIDATE).agg(F.avg(status_weight(F.col("status"))).alias("faithfulness"))
    out = gate.join(best, CANDIDATE, "left").join(faith, CANDIDATE, "left").join(conflicts, CANDIDATE, "left")
    support, faithful = F.coalesce("support", F.lit(0.0)), F.coalesce("faithfulness", F.lit(0.5))
    penalty = F.least(F.lit(0.75), 0.25 * F.coalesce("n", F.lit(0)))
    quality = T.settled((1.0 + support + faithful) / 3 * (1 - penalty), 4)
    out = out.withColumns({"support": support, "faithfulness": F.round(faithful, 4), "penalty": penalty, "quality": quality}).drop("n")
    return out.withColumn("reliability", F.least("admissibility", "quality"))


def family_fallback(scored: DataFrame) -> DataFrame:
    """Rows up to the first family with an accepted candidate; a later family is only tried if all before were rejected."""
    first = F.min(F.when(~F.col("rejected"), F.col("family"))).over(W.partitionBy("query_id", "interp_id"))
    return scored.withColumn("__first", first).where(F.col("__first").isNull() | (F.col("family") <= F.col("__first"))).drop("__first")


def select_answers(scored: DataFrame, priors: DataFrame, limit: int = 3, keep_ratio: float = KEEP_RATIO) -> DataFrame:
    """Up to `limit` answers of each question, by integer percent, click prior and plausibility.

    `scored` has the candidate columns, facet, plausibility, ordinal, rejected and reliability. The best of each
    interpretation is taken; of equal keys the more reliable; a second candidate fills up where fewer than two are
    left; a third needs `keep_ratio` of the first.
    """
    ok = scored.where("NOT rejected")
    ok = ok.withColumn("place", F.row_number().over(W.partitionBy("query_id", "interp_id").orderBy(F.desc("reliability"), "ordinal", "candidate_key")))
    key = W.partitionBy("query_id", "candidate_key").orderBy("place", F.desc("reliability"), "interp_id")
    pool = ok.where("place <= 2").withColumn("dup", F.row_number().over(key)).where("dup = 1")
    firsts = F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).over(W.partitionBy("query_id"))
    turn = F.row_number().over(W.partitionBy("query_id").orderBy("place", F.desc("reliability"), "interp_id", "candidate_key"))
    pool = pool.withColumn("firsts", firsts).withColumn("turn", turn).where((F.col("place") == 1) | (F.col("turn") <= 2) & (F.col("firsts") < 2))
    pool = pool.join(priors, "facet", "left").withColumn("click_prior", F.round(F.coalesce("prior", F.lit(0.5)), 4)).withColumn("reliability_pct", F.bround(F.col("reliability") * 100).cast("long"))
    order = W.partitionBy("query_id").orderBy(F.desc("reliability_pct"), F.desc("click_prior"), F.desc("plausibility"), "interp_id", "candidate_key")
    out = pool.withColumn("rank", F.row_number().over(order)).withColumn("top", F.first("reliability").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    out = out.where((F.col("rank") <= 2) | (F.col("rank") <= limit) & (F.col("reliability") >= keep_ratio * F.col("top")))
    return out.select("query_id", "rank", "interp_id", "candidate_key", "facet", "reliability", "reliability_pct", "click_prior")


def attribute_status(groups_resolved: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """Adds status and confidence: open conflict, uncertain; quote missing, unverified; support under 0.6, unverified; else fact."""
    df = groups_resolved if quotes is None else groups_resolved.join(quotes, ["query_id", "entity", "attribute"], "left")
    found = F.lit(True) if quotes is None else F.coalesce("quote_found", F.lit(False))
    status = F.when(F.col("state") == "open", "uncertain").when(~found, "unverified").when(F.col("support") < FACT, "unverified").otherwise("fact")
    confidence = F.when(F.col("state") == "open", F.col("margin")).when(~found, 0.0).otherwise(F.col("support"))
    return df.withColumn("status", status).withColumn("confidence", F.round(confidence, 6))


def statement_status(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Status of a statement from all claims that make it: noisy-or of distinct sources, halved if disputed."""
    best = claims.groupBy(*keys, "source_id").agg(F.max("reliability").alias("r"), F.bool_and("quote_found").alias("q"), F.bool_or("disputed").alias("d"))
    s = best.groupBy(*keys).agg((1 - F.product(1 - F.col("r"))).alias("support"), F.bool_and("q").alias("quoted"), F.bool_or("d").alias("disputed"))
    status = F.when(~F.col("quoted"), "unverified").when(F.col("disputed"), "uncertain").when(F.col("support") < FACT, "unverified").otherwise("fact")
    confidence = F.when(~F.col("quoted"), 0.0).when(F.col("disputed"), F.col("support") / 2).otherwise(F.col("support"))
    return s.select(*keys, status.alias("status"), T.settled(confidence).alias("confidence"))


def infer(premises: DataFrame, keys: list[str]) -> DataFrame:
    """Inference from several claims (status, confidence): the worst status rules, the least confidence holds."""
    code = F.when(F.col("status") == "unverified", 2).when(F.col("status") == "uncertain", 1).otherwise(0)
    out = premises.groupBy(*keys).agg(F.max(code).alias("code"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_premises"))
    return out.select(*keys, F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("code") + 1).alias("status"), "confidence", "n_premises")


def suppress_near_duplicates(ranked: DataFrame, words: str = "words", keep: int = MOST_STATEMENTS, most: float = 0.7) -> DataFrame:
    """(query_id, kept): in rank order, items (rank, id, words) without those too like one kept before; `keep` of them.

    A question's items are one array, in the fold of which no more than `keep` are held.
    """
    items = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.col(words).alias("words")))).alias("items"))
    kind = dict(items.dtypes)["items"]

    def step(kept: Column, x: Column) -> Column:
        union = lambda k: F.size(F.array_union(k["words"], x["words"]))
        like = F.exists(kept, lambda k: F.size(F.array_intersect(k["words"], x["words"])) / F.greatest(union(k), F.lit(1)) >= most)
        return F.when(like | (F.size(kept) >= keep), kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate("items", F.array().cast(kind), step)
    return items.select("query_id", F.posexplode(kept).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("long").alias("place"), F.col("x.id").alias("id"))


def chain_support(steps: DataFrame, tau: float = 0.35) -> DataFrame:
    """(query_id, weakest, step, admissible) of a chain of sentences.

    `steps` has (query_id, step, bucket, w): step 0 is the context and the question. Each later step's reach is taken
    from the greatest weight of each bucket in all steps before it: a running maximum in a window.
    """
    before = F.max("w").over(W.partitionBy("query_id", "bucket").orderBy("step").rangeBetween(W.unboundedPreceding, -1))
    left = F.greatest(F.col("w") - F.coalesce("x", F.lit(0.0)), F.lit(0.0))
    reach = steps.withColumn("x", before).where("step > 0").groupBy("query_id", "step").agg(F.sqrt(F.sum(left * left)).alias("left"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    reach = reach.select("query_id", "step", F.round(F.when(F.col("norm") == 0, 1.0).otherwise(1 - F.col("left") / F.col("norm")), 6).alias("reach"))
    low = reach.groupBy("query_id").agg(F.min(F.struct("reach", "step")).alias("m"))
    return low.select("query_id", F.col("m.reach").alias("weakest"), F.col("m.step").alias("step"), (F.col("m.reach") >= tau).alias("admissible"))
