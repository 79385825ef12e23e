"""Mixing sources to target weights by hierarchical budgets.

A tree of domains, languages and sources has a weight at each node. The total budget of tokens goes down it:
children share a node's budget by weight, and what a child cannot use (its documents, times the most epochs,
are fewer) goes to its siblings by their weights; only when all children of a node are full does the rest reach
the node's own siblings. A leaf's budget is then a number of whole epochs and the prefix of one more, in the
order of a seeded hash of epoch and doc_id. Documents are taken whole: a prefix ends with the document that
reaches its budget. A child of weight 0 gets nothing, and what it could hold doesn't count for its parent.

Shares are closed-form window sums over the leaves, no loop; the prefix is found by hash buckets, about as many
for a leaf as a bucket has rows: only each leaf's last bucket is sorted, so a source with a third of all rows is
never in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import fresh, materialise

#: Bits of a row's place that tell buckets apart, at most.
BITS = 16
#: Leaves up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LEAVES = 50_000
#: Stands for a null key; keys that begin so get another one before them.
NONE = "\0"
KEYS = ("domain", "lang", "source")


def _default_domains() -> dict[str, str]:
    return {f"src{k}": "web" if k < 10 else "reference" if k < 15 else "forum" for k in range(20)}


@dataclass(frozen=True)
class MixTree:
    """Weights of domains, of languages within each domain and of sources within those; other keys get `other`."""

    domain_of: Mapping[str, str] = field(default_factory=_default_domains)
    domains: Mapping[str, float] = field(default_factory=lambda: {"web": 0.5, "reference": 0.3, "forum": 0.2})
    languages: Mapping[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1})
    sources: Mapping[str, float] = field(default_factory=dict)
    other_domain: float = 0.05
    other_language: float = 0.05
    other_source: float = 1.0


def _looked_up(values: Mapping, key: Column, other) -> Column:
    if not values:
        return F.lit(other).cast("string") if other is None else F.lit(other)
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other))


def _key(value: Column) -> Column:
    """A key without nulls."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit(NONE)).when(F.startswith(value, F.lit(NONE)), F.concat(F.lit(NONE), value)).otherwise(value)


def _value(key: Column) -> Column:
    """What `_key` was made from."""
    return F.when(key == NONE, F.lit(None)).when(F.startswith(key, F.lit(NONE)), F.substr(key, F.lit(2))).otherwise(key)


def words(text: Column) -> Column:
    """Tokens of a text: its words between ASCII white space; a null text has none."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def _share(children: DataFrame, parent: list[str], cap: str, weight: str, budget: str, out: str) -> DataFrame:
    """Adds each child's share of its parent's budget: by weight, full children's excess going to the others.

    With children in order of cap / weight, the level at child i is what the earlier ones leave, over the
    weights from i on; a child is full if its cap lies below its level, and the first that isn't sets the level.
    """
    by = W.partitionBy(*parent).orderBy(F.col("__ratio"), F.col("__key"))
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    c = children.withColumn("__ratio", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(float("inf"))))
    left = F.sum(weight).over(after)
    c = c.withColumn("__level", F.when(left > 0, (F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / left))
    c = c.withColumn("__full", F.col("__ratio") <= F.coalesce(F.col("__level"), F.lit(0.0)))
    level = F.coalesce(F.max(F.when(~F.col("__full"), F.col("__level"))).over(W.partitionBy(*parent)), F.lit(0.0))
    share = F.when(F.col(weight) <= 0, 0.0).when(F.col("__full"), F.col(cap)).otherwise(F.greatest(F.lit(0.0), F.col(weight) * level))
    return c.withColumn(out, F.least(share, F.col(cap))).drop("__ratio", "__level", "__full", "__key")


@dataclass
class Mix:
    """A mix's settings, and its two steps."""

    tree: MixTree = field(default_factory=MixTree)
    share: float = 0.7
    total: int | None = None
    epochs: int = 2
    seed: int = 17

    def keyed(self, docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """`docs` with a leaf's keys and the doc_id under names of our own."""
        name = {k: fresh(docs, f"mix_{k}") for k in ("domain", "lang", "source", "tokens", "id", "full", "rest", "last", "start", "width", "bucket", "hash", "at", "copies")}
        out = docs.withColumns({
            name["domain"]: _key(_looked_up(self.tree.domain_of, F.col("source").cast("string"), None)),
            name["lang"]: _key(F.col("lang")),
            name["source"]: _key(F.col("source")),
            name["id"]: F.col("doc_id").cast("long"),
        })
        return out, name

    def counted(self, docs: DataFrame) -> DataFrame:
        """domain, lang, source, id, tokens of every row: the one pass over the texts that counts them."""
        rows, n = self.keyed(docs)
        return materialise(rows.select(*[F.col(n[k]).alias(k) for k in (*KEYS, "id")], words(F.col("text").cast("string")).alias("tokens")), "counted")

    def budgets(self, counted: DataFrame) -> DataFrame:
        """domain, lang, source, tokens, budget, full (whole epochs), rest (tokens of one more), width (of a bucket) of each leaf."""
        t = self.tree
        leaf = counted.groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        leaf = materialise(leaf.where("tokens > 0"), "leaves")
        total = F.lit(float(self.total)) if self.total is not None else F.lit(self.share) * F.sum("tokens").over(W.partitionBy(F.lit(1)))
        leaf = leaf.withColumns({"w": _looked_up(t.sources, _value(F.col("source")), t.other_source), "lang_w": _looked_up(t.languages, _value(F.col("lang")), t.other_language), "domain_w": _looked_up(t.domains, _value(F.col("domain")), t.other_domain)})
        leaf = leaf.withColumn("cap", F.when(F.col("w") > 0, F.col("tokens") * float(self.epochs)).otherwise(0.0))
        lang = leaf.groupBy("domain", "lang", "lang_w", "domain_w").agg(F.sum("cap").alias("lang_cap"), F.sum("tokens").alias("tokens"))
        lang = lang.withColumn("lang_cap", F.when(F.col("lang_w") > 0, F.col("lang_cap")).otherwise(0.0))
        domain = lang.groupBy("domain", "domain_w").agg(F.sum("lang_cap").alias("domain_cap"), F.sum("tokens").alias("tokens"))
        domain = domain.withColumns({"domain_cap": F.when(F.col("domain_w") > 0, F.col("domain_cap")).otherwise(0.0), "total": total, "root": F.lit(1), "__key": F.col("domain")})
        domain = _share(domain, ["root"], "domain_cap", "domain_w", "total", "domain_budget").select("domain", "domain_budget")
        lang = _share(lang.join(domain, "domain").withColumn("__key", F.col("lang")), ["domain"], "lang_cap", "lang_w", "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
        leaf = _share(leaf.join(lang, ["domain", "lang"]).withColumn("__key", F.col("source")), ["domain", "lang"], "cap", "w", "lang_budget", "budget")
        leaf = leaf.withColumn("budget", F.floor(F.col("budget") + 1e-6))
        leaf = leaf.withColumn("full", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        bits = F.least(F.lit(BITS), F.ceil(F.log2(F.col("n").cast("double")) / 2).cast("int"))
        return leaf.select(*KEYS, "tokens", "budget", "full", "rest", F.pow(F.lit(2.0), F.lit(BITS) - bits).alias("width"))

    def _order(self, full: Column, doc_id: Column, width: Column) -> tuple[Column, Column]:
        """A row's place in its leaf's epoch after `full` whole ones, and the bucket of that place."""
        place = F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.coalesce(full, F.lit(0).cast("long")).cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
        return place, F.floor(F.conv(F.substr(place, F.lit(1), F.lit(BITS // 4)), 16, 10).cast("double") / width).cast("int")

    def copies(self, rows: DataFrame, n: dict[str, str], counted: DataFrame, tokens: Column) -> DataFrame:
        """Keyed rows with how often each is taken."""
        leaves = materialise(self.budgets(counted), "budgets")
        few = leaves.count() <= BROADCAST_LEAVES
        near = lambda df: F.broadcast(df) if few else df
        # each leaf's bucket in which its rest ends, and what the buckets before it hold
        held = counted.join(near(leaves.select(*KEYS, "full", "rest", "width").where("rest > 0")), list(KEYS))
        held = held.select(*KEYS, "rest", "tokens", self._order(F.col("full"), F.col("id"), F.col("width"))[1].alias("bucket")).groupBy(*KEYS, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
        end = held.withColumn("end", F.sum("tokens").over(W.partitionBy(*KEYS).orderBy("bucket"))).where(F.col("end") >= F.col("rest"))
        end = end.groupBy(*KEYS).agg(F.min(F.struct("bucket", (F.col("end") - F.col("tokens")).alias("start"))).alias("x"))
        leaf = materialise(leaves.join(end, list(KEYS), "left").select(*[F.col(k).alias(n[k]) for k in KEYS], F.col("full").alias(n["full"]), F.col("rest").alias(n["rest"]), F.col("x.bucket").alias(n["last"]), F.col("x.start").alias(n["start"]), F.col("width").alias(n["width"])), "ends")
        rows = rows.join(near(leaf), [n[k] for k in KEYS], "left")
        place, bucket = self._order(F.col(n["full"]), F.col(n["id"]), F.col(n["width"]))
        rows = rows.withColumn(n["hash"], place).withColumn(n["bucket"], bucket)
        whole = F.coalesce(n["full"], F.lit(0).cast("long"))
        on_edge = F.coalesce(F.col(n["bucket"]) == F.col(n["last"]), F.lit(False))
        clear = rows.where(~on_edge).withColumn(n["copies"], whole + F.coalesce((F.col(n["bucket"]) < F.col(n["last"])).cast("long"), F.lit(0).cast("long")))
        order = W.partitionBy(*[n[k] for k in KEYS]).orderBy(n["hash"], n["id"], n["tokens"]).rowsBetween(W.unboundedPreceding, -1)
        edge = rows.where(on_edge).withColumn(n["tokens"], tokens)
        edge = edge.withColumn(n["at"], F.col(n["start"]) + F.coalesce(F.sum(n["tokens"]).over(order), F.lit(0).cast("long")))
        edge = edge.withColumn(n["copies"], whole + (F.col(n["at"]) < F.col(n["rest"])).cast("long")).drop(n["at"], n["tokens"])
        return clear.unionByName(edge)


def mix(docs: DataFrame, settings: Mix | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies, kept of every row.

    A null language or source is a key of its own, and so is the null domain of sources that the tree doesn't name. A null or wordless text has no tokens: it is taken with its
    leaf's whole epochs and prefix, at no cost, and never if its leaf has no tokens at all. Rows with equal
    doc_ids are taken one by one. A null doc_id is kept. An empty table gives no rows. Other columns are ignored.
    """
    settings = settings or Mix()
    counted = settings.counted(docs.select("doc_id", "text", "lang", "source"))
    # what is counted already has a row for each, so the texts are read once
    n = {k: k for k in (*KEYS, "id")} | {k: f"__{k}" for k in ("tokens", "full", "rest", "last", "start", "width", "bucket", "hash", "at", "copies")}
    rows = settings.copies(counted, n, counted, F.col("tokens"))
    return rows.select(F.col("id").alias("doc_id"), *[_value(F.col(k)).alias(k) for k in KEYS], "tokens", F.col(n["copies"]).alias("copies"), (F.col(n["copies"]) > 0).alias("kept"))


def take(docs: DataFrame, settings: Mix | None = None) -> DataFrame:
    """The rows that the mix takes, each as often as it does; all columns as they were.

    Nulls, empty texts and an empty table are as in `mix`; equal rows are taken one by one, and ties of equal doc_ids go
    to the shorter text.
    """
    settings = settings or Mix()
    rows, n = settings.keyed(docs)
    rows = settings.copies(rows, n, settings.counted(docs), words(F.col("text").cast("string")))
    rows = rows.where(F.col(n["copies"]) > 0)
    if settings.epochs > 1:
        rows = rows.withColumn(n["at"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(n["copies"]))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """`mix` with its usual settings, the shares by trying each child's own level."""
    m, t = Mix(), MixTree()
    pairs = lambda values: ", ".join(f"('{k}', {v!r})" for k, v in values.items())

    def shared(children: str, parent: str, weight: str, cap: str, budget: str) -> str:
        """SQL of `children` with each one's share of its parent's budget."""
        same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in parent.split(", "))
        full = f"(SELECT sum(least(b.{cap}, b.{weight} * (a.{cap} / a.{weight}))) FROM {children} b WHERE {same}) <= a.{budget}"
        return f"""(SELECT c.*, CASE WHEN is_full THEN {cap} ELSE {weight} * ({budget} - sum(CASE WHEN is_full THEN {cap} ELSE 0 END) OVER p) / sum(CASE WHEN is_full THEN 0 ELSE {weight} END) OVER p END AS share
  FROM (SELECT a.*, {full} AS is_full FROM {children} a) c WINDOW p AS (PARTITION BY {parent}))"""

    return f"""
WITH d(source, domain) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in t.domain_of.items())}),
lw(lang, w) AS (VALUES {pairs(t.languages)}), dw(domain, w) AS (VALUES {pairs(t.domains)}),
k AS MATERIALIZED (SELECT doc_id, d.domain, lang, x.source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents x LEFT JOIN d ON d.source = x.source),
leaf AS MATERIALIZED (SELECT domain, lang, source, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE * {m.epochs} AS cap, {t.other_source} AS w FROM k GROUP BY ALL HAVING sum(tokens) > 0),
dom AS MATERIALIZED (SELECT l.domain, sum(cap) AS cap, coalesce(any_value(dw.w), {t.other_domain})::DOUBLE AS w, {m.share} * sum(sum(tokens)) OVER () AS budget, 1 AS root FROM leaf l LEFT JOIN dw ON dw.domain = l.domain GROUP BY l.domain),
dom2 AS MATERIALIZED (SELECT domain, share FROM {shared("dom", "root", "w", "cap", "budget")}),
lang AS MATERIALIZED (SELECT l.domain, l.lang, sum(cap) AS cap, coalesce(any_value(lw.w), {t.other_language})::DOUBLE AS w, any_value(dom2.share) AS budget
  FROM leaf l JOIN dom2 ON dom2.domain IS NOT DISTINCT FROM l.domain LEFT JOIN lw ON lw.lang = l.lang GROUP BY l.domain, l.lang),
lang2 AS MATERIALIZED (SELECT domain, lang, share FROM {shared("lang", "domain", "w", "cap", "budget")}),
leaf2 AS MATERIALIZED (SELECT l.*, s.share AS budget FROM leaf l JOIN lang2 s ON s.domain IS NOT DISTINCT FROM l.domain AND s.lang IS NOT DISTINCT FROM l.lang),
b AS (SELECT domain, lang, source, floor(floor(share + 1e-6) / tokens) AS whole, floor(share + 1e-6) - floor(floor(share + 1e-6) / tokens) * tokens AS rest FROM {shared("leaf2", "domain, lang", "w", "cap", "budget")}),
o AS (SELECT k.*, b.whole, b.rest, coalesce(sum(k.tokens) OVER (PARTITION BY k.domain, k.lang, k.source ORDER BY md5('{m.seed}:' || coalesce(whole, 0)::BIGINT || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k LEFT JOIN b ON b.domain IS NOT DISTINCT FROM k.domain AND b.lang IS NOT DISTINCT FROM k.lang AND b.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, domain, lang, source, tokens, (coalesce(whole, 0) + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies, coalesce(whole, 0) + CASE WHEN before < rest THEN 1 ELSE 0 END > 0 AS kept FROM o"""
