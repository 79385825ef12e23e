"""The whole search as tables: screened questions, plans, evidence, claims, groups, candidates, answers.

Each step is a DataFrame of all questions at once. Nothing is collected but blocks of question vectors; steps that several
others read are stored, which also keeps plans short. Passages are what is ranked and cited; documents give them their
title and reliability.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import units as U
from ..functions.units import format_quantity
from ..operators import answers as A
from ..operators import claims as C
from ..operators import corpus, graph, guard, planner, reason, retrieval, statements, verify
from ..sources.documents import reliability
from ..sources.storage import stored

#: Passages of the largest tier; hops that the deep tier takes.
MOST_PASSAGES = max(t[1] for t in planner.TIERS.values())
#: Claims of an entity that its answer may use.
MOST_CLAIMS = 6


@dataclass(frozen=True)
class Corpus:
    """Documents ready to be searched: passages (passage_id, document_id, ordinal, text, title, reliability), their index, titles."""

    passages: DataFrame
    index: corpus.Index
    titles: DataFrame

    @property
    def texts(self) -> DataFrame:
        return self.passages.select(F.col("passage_id").alias("document_id"), "text")


@dataclass(frozen=True)
class SearchTables:
    screened: DataFrame
    plans: DataFrame
    readings: DataFrame
    evidence: DataFrame
    claims: DataFrame
    groups: DataFrame
    conflicts: DataFrame
    premises: DataFrame
    candidates: DataFrame
    answers: DataFrame


def prepare(documents: DataFrame, web: DataFrame | None = None, name: str = "corpus") -> Corpus:
    """Documents (document_id, title, text, url, reliability, origin), and web results of the same columns, of which those
    with injections go and the others are masked."""
    documents = documents.withColumn("document_id", F.col("document_id").cast("string"))
    if web is not None:
        documents = documents.unionByName(guard.safe_passages(web).withColumn("document_id", F.col("document_id").cast("string")), allowMissingColumns=True)
    trusted = documents.select("document_id", "title", reliability(F.col("url"), F.col("reliability"), F.col("origin")).alias("reliability"))
    passages = stored(corpus.passages(documents).join(trusted, "document_id"), f"{name}-passages")
    index = corpus.build_index(passages.select(F.col("passage_id").alias("document_id"), "text"))
    return Corpus(passages, index, stored(corpus.titles(documents), f"{name}-titles"))


def passage_hop(found: DataFrame, held: Corpus, k: int, params: retrieval.RetrievalParams = retrieval.PARAMS) -> DataFrame:
    """Adds a passage of each document that a question's first documents cite: its best one in the pool, else its first, at
    its own score plus half of the citing one's. Only texts that were found are searched for titles."""
    pool = found.withColumnRenamed("document_id", "passage_id").join(held.passages.select("passage_id", "document_id"), "passage_id")
    best = pool.groupBy("query_id", "document_id").agg(F.min("rank").alias("at"), F.max("score").alias("citing"))
    first = best.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).where(F.col("place") <= params.link_sources)
    reading = stored(pool.join(first.select("query_id", "document_id", "citing"), ["query_id", "document_id"]), "reading")
    # stored, so that only texts that are read are cut into words
    texts = stored(held.passages.join(reading.select("passage_id").distinct(), "passage_id", "left_semi").select(F.col("passage_id").alias("text_id"), "text"), "texts-read")
    links = retrieval.mentions(texts, held.titles).select("text_id", F.col("document_id").alias("cited"))
    cited = reading.select("query_id", F.col("passage_id").alias("text_id"), "document_id", "citing").join(links, "text_id").where("cited <> document_id")
    cited = cited.groupBy("query_id", F.col("cited").alias("document_id")).agg(F.max("citing").alias("citing"))
    own = pool.groupBy("query_id", "document_id").agg(F.max_by(F.struct("passage_id", "score"), F.struct("score", -F.col("rank"))).alias("own"))
    opening = held.passages.where("ordinal = 0").select("document_id", F.col("passage_id").alias("opening"))
    boosted = cited.join(own, ["query_id", "document_id"], "left").join(opening, "document_id", "left")
    score = F.round(F.coalesce("own.score", F.lit(0.0)) + params.link_boost * F.col("citing"), 6)
    boosted = boosted.select("query_id", F.coalesce("own.passage_id", "opening").alias("document_id"), score.alias("score"), F.lit(1).alias("batch")).where("document_id IS NOT NULL")
    return retrieval.merge(found.select("query_id", "document_id", "score", F.lit(0).alias("batch")).unionByName(boosted), k)


def retrieve(asked: DataFrame, held: Corpus, secondary: float, k: int = MOST_PASSAGES) -> DataFrame:
    """(query_id, document_id: passage, score, batch, rank) of queries (query_id, n, query): the first of each at full
    weight, others at `secondary`, merged; then one hop over cited titles. Equal queries are searched once."""
    keyed = stored(asked.withColumn("key", F.xxhash64("query")), "asked")
    different = stored(keyed.select(F.col("key").alias("query_id"), "query").distinct(), "different")
    hits = retrieval.hybrid(different, held.index, 3 * k).withColumnRenamed("query_id", "key")
    back = hits.join(keyed.select("key", "query_id", "n"), "key")
    weight = F.when(F.col("n") == 0, 1.0).otherwise(secondary)
    pool = retrieval.merge(back.select("query_id", "document_id", T.settled(F.col("score") * weight).alias("score"), F.col("n").alias("batch")), 3 * k)
    return passage_hop(stored(pool, "pool"), held, k)


def with_second_hop(found: DataFrame, queries: DataFrame, held: Corpus, k: int = MOST_PASSAGES) -> DataFrame:
    """For queries (query_id, query, hops) of two hops: another search for bridge entities, at a discount, merged."""
    found = stored(found, "first-hop")
    deep = queries.where("hops > 1")
    bridge = retrieval.bridges(deep, found.join(deep.select("query_id"), "query_id", "left_semi"), held.texts)
    numbered = bridge.withColumn("n", F.lit(0)).withColumn("own", F.col("query_id")).withColumn("query_id", F.xxhash64("own", "query"))
    again = retrieve(numbered.select("query_id", "n", "query"), held, 1.0, k).join(numbered.select("query_id", "own"), "query_id").drop("query_id").withColumnRenamed("own", "query_id")
    more = retrieval.weighted(again, retrieval.PARAMS.hop_discount, 1)
    return retrieval.merge(found.select("query_id", "document_id", "score", F.lit(0).alias("batch")).unionByName(more), k)


def cut_to_tier(found: DataFrame, plans: DataFrame) -> DataFrame:
    return found.join(plans.select("query_id", "top_k"), "query_id").where(F.col("rank") <= F.col("top_k")).drop("top_k")


def evidence(queries: DataFrame, documents: DataFrame | Corpus, depth: str = "auto") -> DataFrame:
    """(query_id, passage_id, score, rank): retrieval alone, each question with its entities, a hop over titles and, in the
    deep tier, a second hop over bridge entities."""
    held = documents if isinstance(documents, Corpus) else prepare(documents)
    plans = stored(planner.plan(queries, depth), "plans")
    asked = plans.select("query_id", F.posexplode(F.array_distinct(F.concat(F.array("query"), "entities"))).alias("n", "query"))
    found = with_second_hop(retrieve(asked, held, retrieval.PARAMS.secondary), plans, held)
    return cut_to_tier(found, plans).select("query_id", F.col("document_id").alias("passage_id"), "score", "rank")


def _premise(df: DataFrame, n: int, kind: str, label: Column, degree: Column) -> DataFrame:
    return df.select(*reason.CANDIDATE, F.lit(n).alias("ordinal"), F.lit(kind).alias("kind"), label.alias("label"), degree.cast("double").alias("degree")).where("degree IS NOT NULL")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Family:
    """Candidates of one kind: `cases` (candidate, entity, label, ordinal), and what is known of them."""

    cases: DataFrame
    premises: DataFrame
    statuses: DataFrame
    sources: DataFrame


@dataclass(frozen=True)
class Found:
    """What candidates are made of, each table keyed by question."""

    plans: DataFrame
    readings: DataFrame
    passages: DataFrame
    facts: DataFrame
    groups: DataFrame
    settled: DataFrame
    statuses: DataFrame
    verdicts: DataFrame
    needs: DataFrame
    checked: DataFrame

    def facet(self, said: Column, exclusive: bool) -> Column:
        """Degree to which a text is of a reading's facet; a candidate of a sibling's facet is off the point if `exclusive`."""
        named = lambda terms: F.exists(terms, lambda t: F.contains(said, T.stems(t)) & (F.size(T.words(t)) > 0))
        return reason.facet_degree(named("facet_terms"), named("siblings") if exclusive else F.lit(False), F.size("facet_terms") > 0)

    def conflict_degree(self) -> Column:
        return F.when(F.col("state") == "open", 0.5).otherwise(1.0)


def quoted(facts: DataFrame, settled: DataFrame) -> DataFrame:
    """(query_id, entity, attribute, quote_found): whether all claims of the winning value, or of an open conflict, stand in their passages."""
    stated = facts.where("kind = 'fact' AND comparator = 'eq' AND value IS NOT NULL").join(settled.select(*graph.KEYS, "winner"), graph.KEYS)
    held = stated.where(F.col("winner").isNull() | U.same_value(F.col("value"), F.col("winner")))
    return held.groupBy(*graph.KEYS).agg(F.bool_and("quote_found").alias("quote_found"))


def documented(plans: DataFrame, facts: DataFrame) -> DataFrame:
    """What entities that a question names require of others: (query_id, attribute, comparator, bound, unit, weight, holder,
    status, confidence); the weight is the noisy-or of the sources, the status that of all extracts together."""
    named = plans.select("query_id", F.explode("entities").alias("name")).select("query_id", graph.entity_key(F.col("name")).alias("key"))
    own = facts.where("kind = 'requirement'").join(graph.holders(named, facts.select("query_id", "entity").distinct()), ["query_id", "entity"], "left_semi")
    keys = ["query_id", "attribute", "comparator", "value", "unit"]
    labels = graph.entity_labels(facts.select("query_id", "entity", F.col("subject").alias("label"), "ordinal")).withColumnRenamed("label", "holder")
    first = own.groupBy(*keys).agg(F.min_by("entity", "ordinal").alias("entity")).join(labels, ["query_id", "entity"]).drop("entity")
    status = verify.claim_set_status(own, keys)
    needed = graph.requirements(own).withColumnRenamed("confidence", "weight").join(first, keys).join(status, keys)
    return needed.withColumnRenamed("value", "bound")


def required(verdicts: DataFrame, needed: DataFrame) -> DataFrame:
    """Verdicts on documented requirements, each as far as it is certain that it holds: one that is not certain binds less."""
    keys = ["query_id", "attribute", "comparator", "bound", "unit"]
    held = verdicts.join(needed.select(*keys, "weight", "holder"), keys)
    return held.withColumn("degree", F.round(reason.kleene_dienes(F.col("weight"), F.col("degree")), 4)).drop("weight")


def entity_family(f: Found) -> Family:
    """Entities that facts of a reading's passages are about; the question's own subject is no answer to it."""
    pool = f.facts.where("kind IN ('fact', 'type')").join(f.passages.select("query_id", "interp_id", "passage_id", "relevance"), ["query_id", "passage_id"])
    key = F.concat(F.lit("entity:"), "entity").alias("candidate_key")
    case = pool.groupBy("query_id", "interp_id", key, "entity").agg(F.max("relevance").alias("relevance"), F.sum((F.col("kind") == "fact").cast("int")).alias("n_facts"))
    # all that is said of an entity in the question's passages
    told = f.facts.where("kind IN ('fact', 'type')").groupBy("query_id", "entity").agg(F.concat_ws(" ", "entity", F.array_sort(F.collect_set("quote")), F.array_sort(F.collect_set("value_text"))).alias("said"))
    named = f.plans.select("query_id", F.explode("entities").alias("name")).select("query_id", graph.entity_key(F.col("name")).alias("key"))
    held = graph.holders(named, case.select("query_id", "entity").distinct()).withColumn("named", F.lit(True))
    case = case.join(f.plans.select("query_id", "key_terms", "question_type"), "query_id").join(held, ["query_id", "entity"], "left")
    compared = F.col("question_type") == "comparison"
    own_topic = F.col("named").isNotNull() | (F.size(F.array_except(F.split("entity", " "), "key_terms")) == 0)
    case = case.where(compared | (~own_topic & (F.col("n_facts") > 0)))
    case = case.withColumn("ordinal", F.row_number().over(W.partitionBy("query_id", "interp_id").orderBy(F.desc("relevance"), "entity"))).where(F.col("ordinal") <= reason.MOST_ENTITIES)
    case = stored(case.join(told, ["query_id", "entity"]).join(f.readings, ["query_id", "interp_id"]).withColumn("said", T.stems(F.col("said"))), "entity-cases")
    source = case.join(f.facts.select("query_id", "entity", "source_id", "reliability").distinct(), ["query_id", "entity"])
    support = source.groupBy(*reason.CANDIDATE, "source_id").agg(F.max("reliability").alias("r")).groupBy(*reason.CANDIDATE).agg(F.round(graph.noisy_or(F.col("r")), 4).alias("support"))
    open_ = f.settled.where("state = 'open'").select("query_id", "entity").distinct()
    asked = f.verdicts.unionByName(f.needs.select(f.verdicts.columns)).select("query_id", "entity", F.col("attribute").alias("on"), F.col("degree").alias("d"))
    premises = _all([
        _premise(case, 0, "relevance", F.lit("relevance"), F.col("relevance")),
        _premise(support, 1, "evidence", F.lit("support"), F.col("support")),
        _premise(case, 2, "facet", F.lit("facet"), f.facet(F.col("said"), True)),
        _premise(case.join(asked, ["query_id", "entity"]), 3, "constraint", F.col("on"), F.col("d")),
        _premise(case.join(open_, ["query_id", "entity"]), 4, "consistency", F.lit("consistency"), F.lit(0.5)),
    ])
    claims = f.statuses.select("query_id", "entity", "status").unionByName(f.checked.select("query_id", "entity", "status"))
    statuses = case.join(claims, ["query_id", "entity"]).select(*reason.CANDIDATE, "status")
    return Family(case.select(*reason.CANDIDATE, "entity", F.col("entity").alias("label"), "ordinal"), premises, statuses, source.select(*reason.CANDIDATE, "source_id", "reliability"))


def value_family(f: Found) -> Family:
    """Values of the attributes asked for, of an entity that the question is about; one candidate a group of values."""
    pool = f.facts.where("kind = 'fact'").join(f.passages.select("query_id", "interp_id", "passage_id", "relevance"), ["query_id", "passage_id"]).join(f.plans.select("query_id", "key_terms", "asked"), "query_id")
    topic = (F.col("entity") != "") & (F.size(F.array_except(F.split("entity", " "), "key_terms")) == 0)
    pool = pool.where(topic & ((F.size("asked") == 0) | F.array_contains("asked", F.col("attribute"))))
    stated = pool.groupBy("query_id", "interp_id", "entity", "attribute").agg(F.max("relevance").alias("relevance"), F.min("ordinal").alias("first"))
    shown = F.when(F.coalesce("unit", F.lit("")) == "", F.col("value").cast("string")).otherwise(format_quantity(F.col("value"), F.col("unit")))
    case = stated.join(f.groups, ["query_id", "entity", "attribute"]).withColumn("shown", shown).join(f.settled.select("query_id", "entity", "attribute", "state", "winner"), ["query_id", "entity", "attribute"])
    case = case.withColumn("candidate_key", F.concat_ws(":", F.lit("value"), "entity", "attribute", "shown"))
    order = W.partitionBy("query_id", "interp_id").orderBy("first", "entity", "attribute", F.desc("support"), "value")
    case = case.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= reason.MOST_VALUES)
    # all sentences that state the value, with their documents' titles
    near = U.same_value(F.col("v"), F.col("value")) & F.col("own_unit").eqNullSafe(F.col("unit"))
    stating = f.facts.where("kind = 'fact' AND comparator = 'eq'").select("query_id", "entity", "attribute", F.col("value").alias("v"), F.col("unit").alias("own_unit"), "quote", "title")
    told = case.select("query_id", "entity", "attribute", "value", "unit").distinct().join(stating, ["query_id", "entity", "attribute"]).where(near)
    told = told.groupBy("query_id", "entity", "attribute", "value", "unit").agg(F.concat_ws(" ", F.array_sort(F.collect_set("quote")), F.array_sort(F.collect_set("title"))).alias("said"))
    case = case.join(told, ["query_id", "entity", "attribute", "value", "unit"], "left")
    case = stored(case.join(f.readings, ["query_id", "interp_id"]).withColumn("said", T.stems(F.coalesce("said", F.lit("")))), "value-cases")
    lost = (F.col("state") == "resolved") & (F.col("value") != F.col("winner"))
    bound = f.plans.select("query_id", F.explode("constraints").alias("c")).select("query_id", "c.attribute", "c.comparator", F.col("c.value").alias("bound"), F.col("c.unit").alias("bound_unit"))
    ok = U.satisfies(F.col("value"), F.col("unit"), F.col("comparator"), F.col("bound"), F.col("bound_unit"))
    premises = _all([
        _premise(case, 0, "relevance", F.lit("relevance"), F.col("relevance")),
        _premise(case, 1, "evidence", F.lit("support"), F.round("support", 4)),
        _premise(case, 2, "facet", F.lit("facet"), f.facet(F.col("said"), False)),
        _premise(case, 3, "consistency", F.lit("consistency"), F.when(lost, 0.0).otherwise(f.conflict_degree())),
        _premise(case.join(bound, ["query_id", "attribute"]), 4, "constraint", F.col("attribute"), F.coalesce(ok.cast("double"), F.lit(0.5))),
    ])
    status = case.join(f.statuses.select("query_id", "entity", "attribute", "status"), ["query_id", "entity", "attribute"])
    held = case.join(f.facts.select("query_id", "entity", "attribute", F.col("value").alias("v"), "source_id", "reliability").distinct(), ["query_id", "entity", "attribute"]).where(U.same_value(F.col("v"), F.col("value")))
    label = F.concat_ws(" : ", "entity", "shown").alias("label")
    return Family(case.select(*reason.CANDIDATE, "entity", label, "ordinal"), premises, status.select(*reason.CANDIDATE, F.when(lost, "unverified").otherwise(F.col("status")).alias("status")), held.select(*reason.CANDIDATE, "source_id", "reliability"))


def statement_family(f: Found, texts: DataFrame) -> Family:
    """Sentences of a reading's first passages, by how far they reach and cover the question."""
    key = F.xxhash64("query_id", "interp_id")
    readings = f.readings.select("query_id", "interp_id", key.alias("key"), "facet_terms", "siblings")
    asked = readings.join(f.plans.select("query_id", "query"), "query_id").select(F.col("key").alias("query_id"), "query")
    ranked = f.passages.select(key.alias("query_id"), F.col("passage_id").alias("document_id"), "rank")
    drafts = stored(statements.drafts(asked, ranked, texts).withColumnRenamed("query_id", "key").withColumnRenamed("document_id", "passage_id"), "drafts")
    case = drafts.join(readings, "key").withColumn("candidate_key", F.concat(F.lit("statement:"), T.content_id(F.col("sentence"), length=12)))
    case = case.withColumn("rank_", F.row_number().over(W.partitionBy(*reason.CANDIDATE).orderBy("place"))).where("rank_ = 1").withColumn("ordinal", F.col("place").cast("int"))
    trusted = f.passages.select("query_id", "interp_id", "passage_id", "source_id", "reliability")
    case = stored(case.join(trusted, ["query_id", "interp_id", "passage_id"]).withColumn("said", T.stems(F.col("sentence"))), "statement-cases")
    consistency = verify.sentence_consistency(f.facts.where("kind = 'fact' AND value IS NOT NULL"), f.settled).select("query_id", "passage_id", F.col("quote").alias("sentence"), "state")
    judged = case.join(consistency, ["query_id", "passage_id", "sentence"], "left").withColumn("state", F.coalesce("state", F.lit("consistent")))
    degree = F.when(F.col("state") == "contradicted", 0.0).when(F.col("state") == "disputed", 0.5).otherwise(1.0)
    premises = _all([
        _premise(case, 0, "relevance", F.lit("admissibility"), F.col("degree")),
        _premise(case, 1, "evidence", F.lit("support"), F.round("reliability", 4)),
        _premise(case, 2, "facet", F.lit("facet"), f.facet(F.col("said"), False)),
        _premise(judged, 3, "consistency", F.lit("consistency"), degree),
    ])
    status = F.when(F.col("state") == "contradicted", "unverified").when(F.col("state") == "disputed", "uncertain").when(F.col("reliability") < reason.FACT, "unverified").otherwise("fact")
    return Family(case.select(*reason.CANDIDATE, F.lit(None).cast("string").alias("entity"), F.col("sentence").alias("label"), "ordinal"), premises, judged.select(*reason.CANDIDATE, status.alias("status")), case.select(*reason.CANDIDATE, "source_id", "reliability"))


def search(queries: DataFrame, documents: DataFrame | Corpus, priors: DataFrame | None = None, web: DataFrame | None = None, depth: str = "auto") -> SearchTables:
    """Questions (query_id, query) over documents (document_id, title, text, url, reliability, origin)."""
    spark = queries.sparkSession
    held = documents if isinstance(documents, Corpus) else prepare(documents, web)
    screened = stored(guard.screen(queries), "screened")
    plans = planner.plan(screened.where("NOT blocked").select("query_id", F.col("text").alias("query")), depth)
    plans = stored(plans.withColumn("asked", C.asked_attributes(F.col("query"))), "plans")
    readings = planner.interpretations(plans)
    siblings = F.array_except(F.flatten(F.collect_set("facet_terms").over(W.partitionBy("query_id"))), "facet_terms")
    readings = stored(readings.withColumn("siblings", siblings), "readings")

    # each reading is searched by its sub-queries, each question also as it stands with its entities: that only feeds the graph
    reading = F.xxhash64("query_id", "interp_id").alias("rid")
    rows = readings.select("query_id", "interp_id", reading, F.posexplode("subqueries").alias("n", "query"))
    context = plans.select("query_id", F.lit("context").alias("interp_id"), F.xxhash64("query_id", F.lit("context")).alias("rid"), F.posexplode(F.array_distinct(F.concat(F.array("query"), "entities"))).alias("n", "query"))
    asked = stored(rows.unionByName(context), "sub-queries")
    hops = asked.where("n = 0").join(plans.select("query_id", "hops"), "query_id").select(F.col("rid").alias("query_id"), "query", "hops")
    hits = with_second_hop(retrieve(asked.select(F.col("rid").alias("query_id"), "n", "query"), held, 1.0), hops, held)
    back = hits.withColumnRenamed("query_id", "rid").join(asked.select("rid", "query_id", "interp_id").distinct(), "rid")
    top = F.max("score").over(W.partitionBy("query_id", "interp_id"))
    found = cut_to_tier(back, plans).withColumn("relevance", F.round(F.col("score") / F.nullif(top, F.lit(0.0)), 6)).withColumnRenamed("document_id", "passage_id")
    found = found.join(held.passages.select("passage_id", F.col("document_id").alias("source_id"), "title", "reliability"), "passage_id")
    found = stored(found.select("query_id", "interp_id", "passage_id", "source_id", "title", "reliability", "score", "rank", "relevance"), "found")

    # the focus of a document's sentences is carried over its passages, so whole documents are read
    cited = held.passages.join(found.select(F.col("source_id").alias("document_id")).distinct(), "document_id", "left_semi")
    stated = C.extract(cited.select("document_id", "ordinal", "passage_id", "text"))
    own = found.select("query_id", "passage_id", "source_id", "title", "reliability").distinct()
    stated = verify.quotes_found(stated, cited)
    per_query = own.join(stated.drop("document_id", "reliability"), "passage_id").dropDuplicates(["query_id", "claim_id"]).where("subject_key <> ''")
    ordinal = F.row_number().over(W.partitionBy("query_id").orderBy("source_id", "place", "claim_id")).cast("long")
    per_query = stored(per_query.withColumn("ordinal", ordinal), "per-query")
    named = graph.resolve_entities(per_query.select("query_id", "ordinal", F.col("subject_key").alias("key")))
    facts = stored(per_query.join(named.select("query_id", "ordinal", F.col("canonical").alias("entity")), ["query_id", "ordinal"]), "facts")
    groups = graph.value_groups(facts.where("kind = 'fact' AND comparator = 'eq' AND value IS NOT NULL").select("query_id", "entity", "attribute", "value", "unit", "ordinal", "source_id", "reliability"))
    groups = stored(groups, "groups")
    settled = stored(graph.resolve(groups), "settled")
    statuses = stored(reason.attribute_status(settled, quoted(facts, settled)), "statuses")
    bounds = plans.select("query_id", F.explode("constraints").alias("c")).select("query_id", "c.attribute", "c.comparator", F.col("c.value").alias("bound"), "c.unit")
    entities = stored(facts.where("kind IN ('fact', 'type')").select("query_id", "entity").distinct(), "entities")
    verdicts = stored(graph.constraint_verdicts(groups, bounds, entities), "verdicts")
    needed = stored(documented(plans, facts), "needed")
    needs = stored(required(graph.constraint_verdicts(groups, needed, entities), needed), "needs")
    checked = verify.constraint_claims(verdicts, statuses).unionByName(verify.constraint_claims(needs, statuses, needed))

    made = Found(plans, readings, found.where("interp_id <> 'context'"), facts, groups, settled, statuses, verdicts, needs, stored(checked, "checked"))
    families = [entity_family(made), value_family(made), statement_family(made, held.texts)]
    entity_first = F.col("question_type").isin("recommendation", "comparison") | (F.size("constraints") > 0)
    rank = lambda first, later: F.when(entity_first, first).otherwise(later)
    order = plans.select("query_id", F.array(rank(0, 1), rank(1, 0), rank(2, 0)).alias("order"))
    cases = _all([x.cases.withColumn("kind", F.lit(i)) for i, x in enumerate(families)]).join(order, "query_id").withColumn("family", F.element_at("order", F.col("kind") + 1)).drop("order")
    premises = stored(_all([x.premises for x in families]), "premises")
    judged, sources = _all([x.statuses for x in families]), stored(_all([x.sources for x in families]), "sources")
    open_ = settled.where("state = 'open'").groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    disputed = judged.where("candidate_key LIKE 'statement:%' AND status = 'uncertain'").select(*reason.CANDIDATE).distinct().withColumn("n", F.lit(1).cast("long"))
    conflicts = cases.where("entity IS NOT NULL").join(open_, ["query_id", "entity"]).select(*reason.CANDIDATE, "n").unionByName(disputed)
    scored = reason.tap_score(stored(reason.godel_gate(premises), "gate"), judged, conflicts, sources)
    scored = scored.join(cases.select(*reason.CANDIDATE, "entity", "label", "family", "kind", (F.col("kind") * 100 + F.col("ordinal")).alias("ordinal")), reason.CANDIDATE)
    scored = scored.join(readings.select("query_id", "interp_id", "facet", "plausibility"), ["query_id", "interp_id"])
    scored = stored(reason.family_fallback(scored), "scored")
    if priors is None:
        priors = spark.createDataFrame([], "facet string, prior double")
    chosen = stored(reason.select_answers(scored, priors), "chosen")
    return SearchTables(screened, plans, readings, found, facts, groups, settled, premises, scored, _told(chosen, scored, facts, statuses, made.checked, sources, found))


def _told(chosen: DataFrame, scored: DataFrame, facts: DataFrame, statuses: DataFrame, checked: DataFrame, sources: DataFrame, found: DataFrame) -> DataFrame:
    """Chosen answers with their texts and sources."""
    rows = chosen.join(scored.select(*reason.CANDIDATE, "entity", "label"), reason.CANDIDATE)
    titles = found.select("query_id", "source_id", "title").distinct()
    cited = sources.join(rows.select(*reason.CANDIDATE), reason.CANDIDATE, "left_semi").join(titles, ["query_id", "source_id"]).withColumn("ordinal", F.lit(0))
    named = A.ordered_sources(cited, reason.CANDIDATE)
    status = statuses.select("query_id", "entity", "attribute", "status")
    best = facts.where("kind IN ('fact', 'type')").groupBy("query_id", "entity", "attribute", "kind").agg(F.max_by("value_text", F.struct("reliability", -F.col("ordinal"))).alias("value_text"), F.min("ordinal").alias("at"))
    said = best.join(status, ["query_id", "entity", "attribute"], "left").withColumn("text", F.concat_ws(" : ", verify.attribute_label(F.col("attribute")), "value_text")).withColumn("status", F.coalesce("status", F.lit("fact"))).select("query_id", "entity", F.col("at"), "text", "status")
    checked = checked.select("query_id", "entity", F.lit(1_000_000).cast("long").alias("at"), "text", "status")
    place = F.row_number().over(W.partitionBy("query_id", "entity").orderBy("at", "text"))
    listed = said.withColumn("place", place).where(F.col("place") <= MOST_CLAIMS).drop("place").unionByName(checked)
    claims = listed.groupBy("query_id", "entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text", "status"))), lambda c: F.struct(c["text"].alias("text"), c["status"].alias("status"))).alias("claims"))
    label = graph.entity_labels(facts.select("query_id", "entity", F.col("subject").alias("label"), "ordinal")).withColumnRenamed("label", "name")
    out = rows.join(claims, ["query_id", "entity"], "left").join(label, ["query_id", "entity"], "left").join(named, reason.CANDIDATE, "left")
    none = F.array().cast("array<struct<text:string,status:string>>")
    short = F.when(F.length("label") > 90, F.concat(F.rtrim(F.substring("label", 1, 87)), F.lit("…"))).otherwise(F.col("label"))
    answer = A.answer_text(F.col("candidate_key"), A.entity_answer(F.coalesce("name", "entity"), F.coalesce("claims", none)), A.value_answer(F.col("label"), F.split(F.coalesce("names", F.lit("")), ", ")), F.col("label"))
    return out.select("query_id", "rank", "interp_id", "candidate_key", "facet", "reliability", "reliability_pct", "click_prior", short.alias("title"), answer.alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
