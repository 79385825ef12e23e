"""Verification: claims by several extracts, constraints, sentences against the graph, written answers, proposed claims."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ..functions import text as T
from ..functions import units as U
from ..functions.units import format_quantity
from . import reason

#: How comparators are written, and labels of attributes that have no rule of their own.
COMPARATOR_LABELS = {"eq": "=", "le": "\u2264", "lt": "<", "ge": "\u2265", "gt": ">"}
ATTRIBUTE_LABELS = {"value": "valeur", "type": "type", "capacity": "capacit\xe9", "statement": "\xe9nonc\xe9"}
#: What a claim on a constraint begins or ends with.
VERBS = {"satisfied": "Respecte", "violated": "Ne respecte pas", "uncertain": "Respect incertain de"}
REQUIRED_BY = "exigence"
NOT_VERIFIABLE = " : non v\xe9rifiable"
STATUS_TAGS = r"\[(?:FAIT|INF\xc9RENCE|INCERTAIN|NON V\xc9RIFI\xc9)\]"


def looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def attribute_label(attribute: Column) -> Column:
    return F.when(F.startswith(attribute, F.lit("unit:")), "valeur").otherwise(F.coalesce(looked_up(ATTRIBUTE_LABELS, attribute), attribute))


def constraint_label(attribute: Column, comparator: Column, value: Column, unit: Column) -> Column:
    """Attribute, sign and quantity."""
    return F.concat_ws(" ", attribute_label(attribute), looked_up(COMPARATOR_LABELS, comparator), format_quantity(value, unit))


def claim_set_status(claims: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, confidence) of what several extracts state together: claims (keys, source_id, reliability, quote_found)."""
    return reason.statement_status(claims.withColumn("disputed", F.lit(False)), keys)


def infer(premises: DataFrame, keys: list[str]) -> DataFrame:
    """`reason.infer` with the union of the premises' sources (arrays `sources`), in order of their names."""
    held = premises.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))
    return reason.infer(premises, keys).join(held, keys)


def constraint_claims(verdicts: DataFrame, statuses: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """(query_id, entity, attribute, comparator, bound, text, status, confidence) for each verdict (with its unit) on a constraint.

    Unknown values are not verifiable. Else the claim is inferred from the attribute's status (query_id, entity,
    attribute, status, confidence) and that of the documented requirement (query_id, attribute, status, confidence, and
    comparator, bound and unit, if it has them), if any. Verdicts with a `holder` name the entity that requires it.
    """
    on = ["query_id", "entity", "attribute"]
    keys = [*on, "comparator", "bound", "unit", "state"]
    known = verdicts.where("state <> 'unknown'").select(*keys)
    premises = known.join(statuses.select(*on, "status", "confidence"), on)
    if requirements is not None:
        own = [c for c in keys if c in requirements.columns and c not in ("entity", "state")]
        premises = premises.unionByName(known.join(requirements.select(*own, "status", "confidence"), own).select(premises.columns))
    inferred = reason.infer(premises, keys)
    label = constraint_label(F.col("attribute"), F.col("comparator"), F.col("bound"), F.col("unit"))
    if "holder" in verdicts.columns:
        label = F.concat(F.lit(f"{REQUIRED_BY} "), "holder", F.lit(" : "), label)
    out = verdicts.drop("confidence").withColumn("label", label).join(inferred, keys, "left")
    unknown = F.col("state") == "unknown"
    text = F.when(unknown, F.concat("label", F.lit(NOT_VERIFIABLE))).otherwise(F.concat_ws(" ", looked_up(VERBS, F.col("state")), "label"))
    return out.select(*on, "comparator", "bound", text.alias("text"), F.when(unknown, "unverified").otherwise(F.coalesce("status", F.lit("unverified"))).alias("status"), F.when(unknown, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def sentence_consistency(claims: DataFrame, settled: DataFrame) -> DataFrame:
    """(query_id, passage_id, quote, state) of sentences that state claims (query_id, entity, attribute, value, passage_id, quote):
    contradicted by a resolved conflict that another value won, disputed in an open one, else consistent."""
    lost = (F.col("state") == "resolved") & (F.col("value") != F.col("winner"))
    code = F.when(lost, 2).when(F.col("state") == "open", 1).otherwise(0)
    worst = claims.join(settled.select("query_id", "entity", "attribute", "winner", "state"), ["query_id", "entity", "attribute"]).groupBy("query_id", "passage_id", "quote").agg(F.max(code).alias("code"))
    return worst.select("query_id", "passage_id", "quote", F.element_at(F.array(F.lit("consistent"), F.lit("disputed"), F.lit("contradicted")), F.col("code") + 1).alias("state"))


def quotes_found(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims (passage_id, quote) with quote_found: whether the quote stands in its passage; a missing passage has none."""
    # a passage is made plain once, before it meets its quotes
    held = claims.join(passages.select("passage_id", T.flat(F.col("text")).alias("__flat")), "passage_id", "left")
    return held.withColumn("quote_found", F.coalesce(T.quote_in_flat(F.col("quote"), F.col("__flat")), F.lit(False))).drop("__flat")


def accepted_claims(proposed: DataFrame, passages: DataFrame) -> DataFrame:
    """Proposed claims (passage_id, subject, value, quote) that a passage bears out: it is known, subject and value are
    given, the quote stands there word for word, and the value's words are in the quote."""
    filled = proposed.where((F.trim(F.coalesce("subject", F.lit(""))) != "") & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    return quotes_found(filled.where(T.value_in_quote(F.col("value"), F.col("quote"))), passages).where("quote_found").drop("quote_found")


@F.pandas_udf(StructType().add("value", DoubleType()).add("unit", StringType()))
def free_quantity(values: pd.Series) -> pd.DataFrame:
    """struct(value, unit) of a free value: its first quantity with a unit, else a bare number of up to nine digits; null fields otherwise."""
    out = []
    for v in values:
        found = next((q for q in U.quantities(v) if q.unit), None)
        bare = re.fullmatch(r"[0-9]{1,9}(?:[.,][0-9]+)?", (v or "").strip())
        out.append((found.value, found.unit) if found else (float(bare[0].replace(",", ".")), "") if bare else (None, None))
    return pd.DataFrame(out, columns=["value", "unit"])


def evidence_texts(answers: DataFrame, claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, rank, text): an answer's claims with their reasons, and all passages of the sources that they cite.

    `answers` (query_id, rank), `claims` (query_id, rank, text, reason, source_id), `passages` (query_id, source_id, text).
    """
    own = claims.join(answers.select("query_id", "rank"), ["query_id", "rank"], "left_semi")
    cited = own.select("query_id", "rank", "source_id").distinct().join(passages, ["query_id", "source_id"]).select("query_id", "rank", "text")
    return own.select("query_id", "rank", F.explode(F.array("text", "reason")).alias("text")).where("text <> ''").unionByName(cited)


def written_answers(written: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, rank, answer, supported): written answers whose every number stands in the evidence (query_id, rank, text)."""
    bare = F.regexp_replace("answer", STATUS_TAGS, "")
    asked = written.select("query_id", "rank", "answer", F.explode_outer(T.numbers(bare)).alias("number"))
    known = evidence.select("query_id", "rank", F.explode(T.numbers(F.col("text"))).alias("number")).distinct().withColumn("known", F.lit(True))
    hit = asked.join(known, ["query_id", "rank", "number"], "left")
    return hit.groupBy("query_id", "rank", "answer").agg(F.bool_and(F.col("number").isNull() | F.col("known").isNotNull()).alias("supported"))
