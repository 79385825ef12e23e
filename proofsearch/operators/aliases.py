"""Alias resolution: the keys of a question's entities, each with the first known key that it equals.

The rule depends on order: a key joins the first *leader* that it is alike to, and leads itself if there is none. So
the leaders are the keys without an earlier leader among those alike to them. Keys come in batches, in order, each four
times as large as what came before: a batch first meets the leaders so far, in a set-similarity join, and only keys
that none of them takes are compared with one another. Where a group's keys are spread over the order, its leader takes
most of them before they meet. Where a dense group first comes up late and all at once, its keys meet within their
batch: links there grow with the square of the group. No question and no block of keys is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Least Jaccard similarity of two keys, and least number of words of one that is part of another.
SIMILAR, PART_WORDS = 0.6, 2
#: Keys of a question in the first batch, and by how much those up to the next batch's end are more.
FIRST_BATCH, GROWTH = 64, 4
_BLOCK = ["query_id", "digits"]


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equality of columns of two aliased tables that takes nulls for equal."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def keyed(mentions: DataFrame) -> DataFrame:
    """(query_id, key, place, digits, words, n, prefix) of each distinct key that has words.

    `place` orders keys by their first mention, `digits` are the words with a digit, which alike keys share, `words` stand
    from rare to frequent among the block's keys, and one of the first `prefix` of them is shared by similar keys.
    """
    words = F.array_distinct(F.filter(F.split("key", " "), lambda w: w != ""))
    first = mentions.groupBy("query_id", "key").agg(F.min("ordinal").alias("ordinal"))
    rows = first.select("query_id", "key", F.struct(F.col("ordinal").isNull().alias("last"), "ordinal", "key").alias("place"), words.alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("digits", F.array_join(F.array_sort(F.filter("words", lambda w: w.rlike("[0-9]"))), " "))
    each = rows.select("query_id", "digits", "key", "place", F.explode("words").alias("word"))
    often = each.groupBy(*_BLOCK, "word").agg(F.count(F.lit(1)).alias("often"))
    counted = each.alias("e").join(often.alias("o"), _same("e", "o", [*_BLOCK, "word"])).select("e.*", "often")
    ordered = counted.groupBy(*_BLOCK, "key", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("often", "word"))), lambda x: x["word"]).alias("words"))
    n = F.size("words")
    # a billionth less, lest a product that should be whole is rounded up
    return ordered.withColumn("n", n).withColumn("prefix", n - F.ceil(n * SIMILAR - 1e-9).cast("int") + 1)


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, earlier, later, place): pairs alike by `graph.same_entity` whose smaller set is on the left, and whose larger
    one on the right; place is that of the earlier key.

    A pair meets on its first shared word only. Where the smaller set is part of the larger one, that is the smaller
    one's rarest word; where they are similar, it stands in both prefixes.
    """
    at = F.posexplode("words").alias("i", "word")
    small = left.select("*", at).where(F.col("i") < F.col("prefix")).alias("a")
    large = right.select("*", at).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    shared = F.array_intersect(a("words"), b("words"))
    both = F.size(shared)
    part = (a("i") == 0) & (a("n") >= PART_WORDS)
    close = (a("n") >= b("n") * SIMILAR - 1e-9) & (b("i") < b("prefix"))
    sized = (a("n") < b("n")) | ((a("n") == b("n")) & (a("place") < b("place")))
    alike = (part & (both == a("n"))) | (close & (both >= SIMILAR * (a("n") + b("n") - both) - 1e-9))
    met = small.join(large, _same("a", "b", [*_BLOCK, "word"]) & sized & (part | close) & (F.element_at(shared, 1) == a("word")) & alike)
    first = a("place") < b("place")
    pick = lambda x, y, c, out: F.when(first, x(c)).otherwise(y(c)).alias(out)
    return met.select(a("query_id").alias("query_id"), pick(a, b, "key", "earlier"), pick(b, a, "key", "later"), pick(a, b, "place", "place"))


def alike_pairs(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query_id, earlier, later, place): alike pairs among the keys, or between keys and earlier, known ones."""
    return _meet(keys, keys) if known is None else _meet(keys, known).unionByName(_meet(known, keys))


def batched(keys: DataFrame) -> tuple[DataFrame, int]:
    """Keys with their `batch`, from 0, and the number of batches; only how many keys meet depends on the batches' sizes."""
    most = keys.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    shares, size = [], FIRST_BATCH
    while size < most:
        shares.append(size / most)
        size *= GROWTH
    if not shares:
        return keys.withColumn("batch", F.lit(0)), 1
    ends = keys.groupBy("query_id").agg(F.percentile_approx(F.col("place.ordinal"), shares).alias("ends"))
    after = F.size(F.filter("ends", lambda e: F.col("place.ordinal") > e))
    placed = keys.alias("k").join(ends.alias("e"), _same("k", "e", ["query_id"])).select("k.*", "ends")
    return placed.withColumn("batch", F.when(F.col("place.last"), len(shares)).otherwise(after)).drop("ends"), len(shares) + 1


def _without(links: DataFrame, end: str, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows whose `end` is not (or, as a semi-join, is) among the keys (query_id, key)."""
    return links.alias("l").join(keys.alias("k"), _same("l", "k", ["query_id"]) & (F.col(f"l.{end}") == F.col("k.key")), how)


def followers(links: DataFrame) -> DataFrame:
    """(query_id, key) of all keys that don't lead, from links (query_id, earlier, later).

    In each round the keys that wait for none lead, what is linked to them follows, and links of followers go. There
    are as many rounds as the longest row of keys that wait for one another; each stores what is left of the links.
    """
    out, left = None, links.select("query_id", "earlier", "later")
    while not left.isEmpty():
        waiting = left.select("query_id", F.col("later").alias("key")).distinct()
        lost = stored(_without(_without(left, "earlier", waiting), "later", waiting, "left_semi").select("query_id", F.col("later").alias("key")).distinct(), "followers")
        out = lost if out is None else out.unionByName(lost)
        left = stored(_without(_without(left, "later", lost), "earlier", lost), "open-links")
    return links.select("query_id", F.col("later").alias("key")).limit(0) if out is None else out


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """(query_id, ordinal, key, canonical) of each mention: the first known key that its key equals by `same_entity`.

    Keys are taken in order of their first ordinal, keys of one ordinal in order of the key, null ordinals last. A key
    without words stands for itself, a null key gives null; null question ids are one question; repeated mentions
    stay; other columns go.
    """
    rows = mentions.select("query_id", "ordinal", "key")
    keys, batches = batched(stored(keyed(rows), "alias-keys"))
    first = F.min_by("earlier", "place").alias("leader")
    leaders, led = None, None
    for b in range(batches):
        own = keys.where(F.col("batch") == b).drop("batch")
        if leaders is not None:
            taken = stored(alike_pairs(own, leaders).groupBy("query_id", F.col("later").alias("key")).agg(first), "taken-keys")
            led = led.unionByName(taken)
            own = stored(_without(own, "key", taken), "free-keys")
        links = stored(alike_pairs(own), "alias-links")
        behind = followers(links)
        inner = stored(_without(links, "earlier", behind).groupBy("query_id", F.col("later").alias("key")).agg(first), "led-keys")
        led = inner if led is None else led.unionByName(inner)
        heads = stored(_without(own, "key", behind), "leaders")
        leaders = heads if leaders is None else leaders.unionByName(heads)
    found = rows.alias("r").join(led.alias("f"), _same("r", "f", ["query_id"]) & (F.col("r.key") == F.col("f.key")), "left")
    return found.select("r.query_id", "r.ordinal", "r.key", F.coalesce("f.leader", "r.key").alias("canonical"))
