"""The knowledge graph: claims by entity and attribute, value groups, support, conflicts, constraints.

A claim row has query_id, claim_id, ordinal, entity, attribute, value (double) and unit, or value_text,
source_id, reliability, kind and comparator. Groups are keyed by (query_id, entity, attribute); aggregates
are taken per source before they meet, so a source that repeats itself counts once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import units as U
from .aliases import resolve_entities  # noqa: F401  the graph's own names

#: Margin of support from which a conflict is resolved; tolerance of equal values.
RESOLUTION_MARGIN, TOLERANCE = 0.25, 0.02
#: Claims that a task groups, about.
TASK_ROWS = 200_000
#: Kinds that never conflict, and text attributes that have one value.
NO_CONFLICT = ("type", "statement")
SINGLE_VALUED = [
    "capital",
    "date",
    "birth_date",
    "death_date",
    "birthplace",
    "founded",
    "founding_date",
    "release_date",
    "release_year",
    "author",
    "director",
    "founder",
    "ceo",
    "headquarters",
    "nationality",
    "country",
    "inventor",
    "creator",
    "composer",
    "spouse",
    "height",
    "duration",
    "deadline",
]
KEYS = ["query_id", "entity", "attribute"]


def noisy_or(r: Column) -> Column:
    """Aggregate: one minus the product of what is left of each reliability."""
    return 1 - F.product(1 - T.clamp01(r))


def entity_key(text: Column) -> Column:
    """Words with digits as they are, others stemmed and without stop-words, by spaces."""
    keep = F.filter(T.words(text), lambda w: w.rlike("[0-9]") | T.is_content(w))
    return F.array_join(F.transform(keep, T.stem), " ")


def same_entity(a: Column, b: Column) -> Column:
    """Equal keys; or equal digit words and a subset of two words or more, or a Jaccard of 0.6."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    digits = lambda w: F.array_sort(F.filter(w, lambda x: x.rlike("[0-9]")))
    both = F.size(F.array_intersect(wa, wb))
    low = F.least(F.size(wa), F.size(wb))
    filled = (a != "") & (b != "")
    return (a == b) | (filled & (digits(wa) == digits(wb)) & (((both == low) & (low >= 2)) | (T.jaccard(wa, wb) >= 0.6)))


def value_groups(claims: DataFrame) -> DataFrame:
    """(keys, value, unit, support, n_sources, n_claims): claims of equal units whose values lie within the tolerance of
    a group's first value, in order.

    Distinct values are grouped first, so a group's fold is over values and not over claims. Support is the noisy-or
    of each source's best reliability. The number of tasks follows the number of claims, so that what one holds doesn't grow.
    """
    parts = max(1, math.ceil(claims.count() / TASK_ROWS))
    each = claims.select(*KEYS, "unit", "value", "source_id", "reliability", "ordinal").repartition(parts, "query_id", "entity", "value", "source_id")
    each = each.groupBy(*KEYS, "unit", "value", "source_id").agg(F.max("reliability").alias("r"), F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("ordinal"))
    # what follows groups by these columns and more, and so stays in these partitions; a constant attribute or unit here would undo that
    each = each.repartition(parts, "query_id", "entity")
    first = each.groupBy(*KEYS, "unit", "value").agg(F.min("ordinal").alias("ordinal"))
    ordered = first.groupBy(*KEYS, "unit").agg(F.sort_array(F.collect_list(F.struct("ordinal", "value"))).alias("vs"))

    def step(heads: Column, v: Column) -> Column:
        near = F.exists(heads, lambda h: F.abs(h - v["value"]) <= TOLERANCE * F.greatest(F.abs(h), F.abs(v["value"]), F.lit(1e-9)))
        return F.when(near, heads).otherwise(F.array_append(heads, v["value"]))

    heads = ordered.select(*KEYS, "unit", F.aggregate("vs", F.array().cast("array<double>"), step).alias("heads"))
    head = F.element_at(F.filter("heads", lambda h: F.abs(h - F.col("value")) <= TOLERANCE * F.greatest(F.abs(h), F.abs(F.col("value")), F.lit(1e-9))), 1)
    placed = each.join(heads, [*KEYS, "unit"]).withColumn("head", head)
    by_source = placed.groupBy(*KEYS, "unit", "head", "source_id").agg(F.max("r").alias("r"), F.sum("n").alias("n"))
    out = by_source.groupBy(*KEYS, "unit", "head").agg(T.settled(noisy_or(F.col("r"))).alias("support"), F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_claims"))
    return out.withColumnRenamed("head", "value")


def same_text_value(a: Column, b: Column) -> Column:
    """Equal when normalised, or one's content words contain the other's."""
    wa, wb = T.content_words(a), T.content_words(b)
    inside = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return (T.normalize(a) == T.normalize(b)) | ((F.size(wa) > 0) & (F.size(wb) > 0) & inside)


def exact_groups(claims: DataFrame) -> DataFrame:
    """`value_groups` where equal values are equal numbers: two shuffles, the first of them pre-summed."""
    by_source = claims.groupBy(*KEYS, "value", "source_id").agg(F.max("reliability").alias("r"), F.count(F.lit(1)).alias("n"))
    return by_source.groupBy(*KEYS, "value").agg(T.settled(noisy_or(F.col("r"))).alias("support"), F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_claims"))


def text_groups(claims: DataFrame) -> DataFrame:
    """(keys, value_text, support, n_sources, n_claims): claims whose texts are the same value as a group's first one, in order.

    Distinct texts are grouped first, so a fold is over an attribute's texts and not over its claims.
    """
    first = claims.groupBy(*KEYS, "value_text").agg(F.min("ordinal").alias("ordinal"))
    forms = F.struct("ordinal", "value_text", T.normalize(F.col("value_text")).alias("plain"), F.array_distinct(T.content_words(F.col("value_text"))).alias("words"))
    ordered = first.groupBy(*KEYS).agg(F.sort_array(F.collect_list(forms)).alias("vs"))

    def same(a: Column, b: Column) -> Column:
        inside = (F.size(F.array_except(a["words"], b["words"])) == 0) | (F.size(F.array_except(b["words"], a["words"])) == 0)
        return (a["plain"] == b["plain"]) | ((F.size(a["words"]) > 0) & (F.size(b["words"]) > 0) & inside)

    kind = dict(ordered.dtypes)["vs"]
    heads = ordered.withColumn("heads", F.aggregate("vs", F.array().cast(kind), lambda kept, v: F.when(F.exists(kept, lambda h: same(h, v)), kept).otherwise(F.array_append(kept, v))))
    placed = heads.select(*KEYS, "heads", F.explode("vs").alias("v")).select(*KEYS, F.col("v.value_text").alias("value_text"), F.element_at(F.filter("heads", lambda h: same(h, F.col("v"))), 1)["value_text"].alias("head"))
    by_source = claims.join(placed, [*KEYS, "value_text"]).groupBy(*KEYS, "head", "source_id").agg(F.max("reliability").alias("r"), F.count(F.lit(1)).alias("n"))
    out = by_source.groupBy(*KEYS, "head").agg(T.settled(noisy_or(F.col("r"))).alias("support"), F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_claims"))
    return out.withColumnRenamed("head", "value_text")


def resolve(groups: DataFrame) -> DataFrame:
    """(keys, n_groups, winner, support, margin, state): consistent, resolved or open.

    Groups of text values (`value_text`, as `text_groups` has them) conflict only where an attribute has a single value.
    """
    plural = F.lit(False)
    if "value" not in groups.columns:
        groups, plural = groups.withColumn("value", F.col("value_text")), ~F.col("attribute").isin(SINGLE_VALUED)
    order = W.partitionBy(*KEYS).orderBy(F.desc("support"), F.desc("n_sources"), "value")
    top = groups.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("support").over(order)).withColumn("n_groups", F.count(F.lit(1)).over(W.partitionBy(*KEYS)))
    top = top.where("r = 1").withColumn("margin", T.settled(F.col("support") - F.coalesce("next", F.lit(0.0))))
    state = F.when((F.col("n_groups") == 1) | F.col("attribute").isin(*NO_CONFLICT) | plural, "consistent").when(F.col("margin") >= RESOLUTION_MARGIN, "resolved").otherwise("open")
    return top.select(*KEYS, "n_groups", F.when(state != "open", F.col("value")).alias("winner"), "support", "margin", state.alias("state"))


def contradictions(groups: DataFrame) -> DataFrame:
    """Conflicts with their groups, strongest first."""
    found = resolve(groups).where("state <> 'consistent'")
    each = groups.join(found.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("support", "n_sources", "value")), asc=False).alias("groups"))
    return found.join(each, KEYS)


def constraint_verdicts(groups: DataFrame, constraints: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(query_id, entity, attribute, comparator, bound, unit, state, degree) of each entity and constraint of its question;
    the unit only if both tables have units.

    What is observed is the winner of a settled attribute, or each group of an open one: all hold, satisfied 1;
    none, violated 0; some, uncertain 0.5; nothing observed, unknown 0.5. A value of another unit is not observed, and
    a constraint on `unit:X` observes all of an entity's values of that unit. `entities` (query_id, entity) are by
    default those of the groups.
    """
    united = "unit" in groups.columns and "unit" in constraints.columns
    keys = [*KEYS, "comparator", "bound", *["unit"] * united]
    settled = resolve(groups).select(*KEYS, "state", "winner")
    seen = groups.join(settled, KEYS).where((F.col("state") == "open") | (F.col("value") == F.col("winner"))).select(*KEYS, "value", (F.col("unit") if united else F.lit("")).alias("own_unit"))
    if united:
        seen = seen.unionByName(seen.withColumn("attribute", F.concat(F.lit("unit:"), "own_unit")))
    if entities is None:
        entities = groups.select("query_id", "entity").distinct()
    held = entities.join(constraints.select("query_id", *keys[2:]), "query_id").join(seen, KEYS, "left")
    ok = U.satisfies(F.col("value"), F.col("own_unit"), F.col("comparator"), F.col("bound"), F.col("unit") if united else F.lit(""))
    out = held.groupBy(*keys).agg(F.bool_and(ok).alias("all"), F.bool_or(ok).alias("any"))
    state = F.when(F.col("all").isNull(), "unknown").when(F.col("all"), "satisfied").when(~F.col("any"), "violated").otherwise("uncertain")
    degree = F.when(state == "satisfied", 1.0).when(state == "violated", 0.0).otherwise(0.5)
    return out.select(*keys, state.alias("state"), degree.alias("degree"))


def requirements(claims: DataFrame) -> DataFrame:
    """Requirement claims merged by attribute, comparator, value and unit; confidence is the noisy-or over sources."""
    keys = ["query_id", "attribute", "comparator", "value", "unit"]
    kept = claims.where((F.col("kind") == "requirement") & F.col("value").isNotNull() & ~((F.col("comparator") == "eq") & F.col("attribute").isin("value", "capacity")))
    return kept.groupBy(*keys, "source_id").agg(F.max("reliability").alias("r")).groupBy(*keys).agg(T.settled(noisy_or(F.col("r"))).alias("confidence"))


def claims_for(facts: DataFrame, wanted: DataFrame, kinds: tuple[str, ...] = ("fact",)) -> DataFrame:
    """Claims of wanted entities (query_id, entity and, if named there, attribute), of the given kinds."""
    on = ["query_id", "entity"] + ["attribute"] * ("attribute" in wanted.columns)
    return facts.where(F.col("kind").isin(*kinds)).join(wanted.select(*on).distinct(), on, "left_semi")


def entity_labels(mentions: DataFrame) -> DataFrame:
    """(query_id, entity, label): the longest label among an entity's mentions (query_id, entity, label, ordinal), the first of equal ones."""
    return mentions.groupBy("query_id", "entity").agg(F.max_by("label", F.struct(F.length("label"), -F.col("ordinal"))).alias("label"))


def holders(named: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities (query_id, entity) of the graph that a question names (query_id, key): what it asks about, not answers to it."""
    return entities.alias("e").join(named.alias("n"), (F.col("e.query_id") == F.col("n.query_id")) & same_entity(F.col("e.entity"), F.col("n.key")), "left_semi")


def exported(facts: DataFrame, settled: DataFrame, most: int = 300) -> DataFrame:
    """(query_id, n_entities, n_claims, n_sources, n_conflicts, claims): a question's graph, with its first `most` claims."""
    order = F.row_number().over(W.partitionBy("query_id").orderBy("ordinal", "claim_id"))
    listed = facts.withColumn("r", order)
    sums = listed.groupBy("query_id").agg(F.countDistinct("entity").alias("n_entities"), F.count(F.lit(1)).alias("n_claims"), F.countDistinct("source_id").alias("n_sources"))
    first = listed.where(F.col("r") <= most).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "claim_id"))), lambda x: x["claim_id"]).alias("claims"))
    conflicts = settled.where("state <> 'consistent'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_conflicts"))
    return sums.join(first, "query_id").join(conflicts, "query_id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0).cast("long")))


def property_graph(claims: DataFrame, settled: DataFrame | None = None, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node (kind, id) and edge (src, kind, dst) tables for a graph store: claims about entities, from sources; searches
    and the entities that they found; attributes on which sources contradict each other."""
    text = lambda c: F.col(c).cast("string")
    node = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), text(c).alias("id"))
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"))
    nodes = node(claims, "entity", "entity").unionByName(node(claims, "source", "source_id")).unionByName(node(claims, "claim", "claim_id"))
    edges = edge(claims, text("claim_id"), "ABOUT", text("entity")).unionByName(edge(claims, text("claim_id"), "FROM", text("source_id")))
    if queries is not None:
        nodes = nodes.unionByName(node(queries, "search", "query_id"))
        edges = edges.unionByName(edge(claims.join(queries.select("query_id").distinct(), "query_id", "left_semi"), text("query_id"), "FOUND", text("entity")))
    if settled is not None:
        edges = edges.unionByName(edge(settled.where("state <> 'consistent'"), text("entity"), "CONTRADICTION", F.concat_ws(":", text("attribute"), text("winner"))))
    return nodes.distinct(), edges.distinct()
