"""Answers as text, from verified claims alone: entity and value templates, sources, summaries, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .verify import NOT_VERIFIABLE, VERBS

#: Wording of answers.
GENERIC = ["valeur", "capacit\xe9", "\xe9nonc\xe9"]
TYPE = "type : "
TO_CONFIRM = "\xc0 confirmer : "
REFUSED, NOTHING = "Requ\xeate refus\xe9e : ", "Aucune r\xe9ponse ne passe la v\xe9rification : les sources disponibles ne permettent pas de r\xe9pondre de fa\xe7on fiable."


def derived(text: Column) -> Column:
    """Whether a claim is on a constraint."""
    begins = [F.startswith(text, F.lit(f"{v} ")) for v in VERBS.values()]
    return begins[0] | begins[1] | begins[2] | F.endswith(text, F.lit(NOT_VERIFIABLE.strip()))


def stated_value(text: Column) -> Column:
    """A claim's value, with its label unless that is generic or said in the value."""
    label, value = F.substring_index(text, " : ", 1), F.regexp_replace(text, "^.*? : ", "")
    bare = F.lower(label).isin(GENERIC) | F.contains(T.normalize(value), T.normalize(label))
    return F.when(~F.contains(text, F.lit(" : ")), text).when(bare, value).otherwise(F.concat_ws(" ", label, value))


def entity_answer(label: Column, claims: Column) -> Column:
    """A sentence on an entity from its claims, an array of (text, status): type, up to four facts, constraints met, doubts."""
    kinds = F.filter(claims, lambda c: F.startswith(c["text"], F.lit(TYPE)))
    facts = F.filter(claims, lambda c: ~derived(c["text"]) & ~F.startswith(c["text"], F.lit(TYPE)))
    head = F.when(F.size(kinds) > 0, F.concat(label, F.lit(" ("), F.replace(F.try_element_at(kinds, F.lit(1))["text"], F.lit(TYPE), F.lit("")), F.lit(")"))).otherwise(label)
    first = F.when(F.size(facts) > 0, F.concat(head, F.lit(" : "), F.array_join(F.transform(F.slice(facts, 1, 4), lambda c: stated_value(c["text"])), ", "))).otherwise(head)
    met = F.transform(F.filter(claims, lambda c: F.startswith(c["text"], F.lit("Respecte ")) & c["status"].isin("fact", "inference")), lambda c: F.substr(c["text"], F.lit(len("Respecte ") + 1)))
    doubts = F.transform(F.filter(claims, lambda c: derived(c["text"]) & c["status"].isin("uncertain", "unverified")), lambda c: c["text"])
    part = lambda lead, xs: F.when(F.size(xs) > 0, F.concat(F.lit(lead), F.array_join(xs, " ; "), F.lit(".")))
    return F.concat_ws(" ", F.concat(first, F.lit(".")), part("Respecte ", met), part(TO_CONFIRM, doubts))


def value_answer(label: Column, sources: Column) -> Column:
    """A value and the titles of up to two of its sources."""
    return F.when(F.size(sources) > 0, F.concat(label, F.lit(" ("), F.array_join(F.slice(sources, 1, 2), ", "), F.lit(")."))).otherwise(F.concat(label, F.lit(".")))


def answer_text(key: Column, entity: Column, value: Column, statement: Column) -> Column:
    """The text for a candidate's family, which its key begins with."""
    return F.when(F.startswith(key, F.lit("entity:")), entity).when(F.startswith(key, F.lit("value:")), value).otherwise(statement)


def ordered_sources(sources: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """(by, sources, names): distinct sources (source_id, title, reliability, ordinal), the most reliable first, then the first seen."""
    once = sources.groupBy(*by, "source_id").agg(F.max("reliability").alias("r"), F.min("ordinal").alias("ordinal"), F.min_by("title", "ordinal").alias("title"))
    w = W.partitionBy(*by).orderBy(F.desc("r"), "ordinal", "source_id")
    listed = once.withColumn("place", F.row_number().over(w)).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "source_id", "title"))).alias("s"))
    extra = F.size("s") - most
    names = F.array_join(F.transform(F.slice("s", 1, most), lambda x: x["title"]), ", ")
    return listed.select(*by, F.transform("s", lambda x: x["source_id"]).alias("sources"), F.when(extra > 0, F.concat(names, F.lit(" et "), extra.cast("string"), F.lit(" autre(s)"))).otherwise(names).alias("names"))


def summary(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text): a question's answers (query_id, rank, title, answer, reliability_pct, label, claims: (status, text),
    sources: titles) as lines, at most six claims and three sources each; a refusal or an abstention where there is none.
    `queries` has (query_id, query, blocked, reason)."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.col("rank").cast("string"), F.lit(". "), "title", F.lit(" (fiabilit\xe9 "), F.col("reliability_pct").cast("string"), F.lit(" %, lecture \xab "), "label", F.lit(" \xbb)")),
        F.concat(F.lit("   "), "answer"),
        F.when(F.size("claims") > 0, F.array_join(F.transform(F.slice("claims", 1, 6), lambda c: F.concat(F.lit("   ["), c["status"], F.lit("] "), c["text"])), "\n")),
        F.when(F.size("sources") > 0, F.concat(F.lit("   Sources : "), F.array_join(F.slice("sources", 1, 3), ", "))),
    )
    each = answers.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", lines.alias("lines")))), lambda x: x["lines"]), "\n\n").alias("lines"))
    head = F.concat(F.lit("R\xe9ponses v\xe9rifi\xe9es pour \xab "), "query", F.lit(" \xbb :\n\n"))
    text = F.when(F.col("blocked"), F.concat(F.lit(REFUSED), "reason", F.lit("."))).when(F.col("lines").isNull(), F.lit(NOTHING)).otherwise(F.concat(head, "lines"))
    return queries.join(each, "query_id", "left").select("query_id", text.alias("text"))


def trajectory_payload(candidates: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, interp_id, payload): the first candidates of each reading as JSON, kept ones first."""
    w = W.partitionBy("query_id", "interp_id").orderBy("rejected", F.desc("reliability"), "candidate_key")
    kept = candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return kept.groupBy("query_id", "interp_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("place", "candidate_key", "rejected", "reliability"))), lambda x: F.struct(x["candidate_key"].alias("key"), x["rejected"].alias("rejected"), x["reliability"].alias("reliability")))).alias("payload"))


def last_user_text(messages: DataFrame, by: str, turn: str) -> DataFrame:
    """(by, text): what the user said last in each conversation (role, text)."""
    return messages.where("role = 'user'").groupBy(by).agg(F.max_by("text", turn).alias("text"))
