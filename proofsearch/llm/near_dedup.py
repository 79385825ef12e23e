"""MinHash near-dedup with HyperMinHash registers.

A text's set is its distinct word shingles. One hash of each shingle picks a bucket and a 32-bit value;
a bucket's register keeps the smallest value as its count of leading zeros and its next ten bits. Empty
buckets borrow from a filled one, chosen by a fixed random table, so that registers of two texts agree
with the probability of their sets' Jaccard similarity, whatever the sets' sizes. Bands of registers give
candidates; the number of bands is what misses one link in a million at the threshold.

Texts of equal sets are one vertex from the start. Within a band's bucket no pairs are made: the heaviest
member of a round is compared with those that are not of its component yet, and a bucket whose members are
all of one component is done. Then every member goes that provably links to no other component, as too many
of its shingles occur in its own only. What two rounds leave is joined by the rarest shingles of each set,
which sets that overlap enough must share. A candidate passes the size bound and the collision-corrected estimate
(with a wide margin), then its full sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import discard, doc_columns, fresh, materialise, tidy, tune
from .components import components

MANTISSA_BITS = 10
ROUNDS = 2
#: Standard errors below the threshold at which the estimate still lets a candidate through.
MARGIN = 8.0
#: Ids of texts to be compared, and keys of buckets, are broadcast up to this many (8 to 32 MB), and shuffled beyond.
BROADCAST_KEYS = 500_000


def band_plan(percent: int) -> tuple[int, int]:
    """Bands and rows for a threshold: rows for selectivity, and bands for one miss in a million."""
    rows = 8 if percent >= 85 else 6
    return math.ceil(math.log(1e-6) / math.log1p(-((percent / 100) ** rows))), rows


class Shingler:
    """Exact shingle counts, and hashes of distinct shingles."""

    def __init__(self, width: int) -> None:
        self.width = width

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        """Words between ASCII white space, A-Z in lower case."""
        return text.encode("utf-8", "surrogatepass").lower().split() if text else []

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """A 64-bit hash of each distinct shingle; fewer words than the width are one shingle."""
        if not words:
            return np.zeros(0, np.uint64)
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))[at]
        k = min(self.width, len(words))
        n = len(words) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = (h ^ hashed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        if len(ids) ** k < 1 << 62:
            key = at[:n].copy()
            for i in range(1, k):
                key = key * len(ids) + at[i : i + n]
            return h[np.unique(key, return_index=True)[1]]
        return np.unique(h)


@lru_cache(maxsize=4)
def _choice(k: int) -> np.ndarray:
    return np.random.default_rng(20240607).permuted(np.tile(np.arange(k, dtype=np.uint16), (k, 1)), axis=1)


def registers(hashes: np.ndarray, k: int) -> np.ndarray:
    """HyperMinHash registers: leading zeros above, mantissa bits below."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    value = np.sort((bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF)))
    b = (value >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    b, low = b[first], (value[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = np.frexp(low.astype(float))[1]  # bits of the value; 0 for 0
    mantissa = np.where(length > MANTISSA_BITS, low >> np.maximum(length - 1 - MANTISSA_BITS, 0), low << np.maximum(MANTISSA_BITS + 1 - length, 0)) & ((1 << MANTISSA_BITS) - 1)
    out = np.zeros(k, np.uint16)
    out[b] = ((32 - length) << MANTISSA_BITS) | mantissa
    if len(b) < k:
        empty = np.setdiff1d(np.arange(k), b, assume_unique=True)
        out[empty] = out[b[np.argmin(_choice(k)[np.ix_(empty, b)], axis=1)]]
    return out


@lru_cache(maxsize=4)
def _mixers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(1, 1 << 63, rows, np.uint64) | np.uint64(1), r.integers(1, 1 << 63, bands, np.uint64)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    mix, own = _mixers(bands, rows)
    h = ((regs.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * mix).sum(axis=1) ^ own
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


@lru_cache(maxsize=4096)
def _collisions(a: int, b: int, k: int) -> float:
    """Chance that two registers agree though their values differ; a and b: eighths of log2 of the sets' sizes."""
    zeros = np.arange(33)[:, None]
    lo = np.where(zeros < 32, 2.0 ** (-zeros - 1), 0) * (1 + np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS))
    hi = lo + np.where(zeros < 32, 2.0 ** (-zeros - 1 - MANTISSA_BITS), 2.0**-32)
    cell = lambda e: np.clip((1 - lo) ** max(1.0, 2 ** (e / 8) / k) - np.clip(1 - hi, 0, 1) ** max(1.0, 2 ** (e / 8) / k), 0, 1)
    return float((cell(a) * cell(b)).sum())


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Jaccard similarity from registers, corrected for agreements of unlike values."""
    c = _collisions(round(8 * math.log2(na)), round(8 * math.log2(nb)), len(a))
    return max(0.0, (float((a == b).mean()) - c) / (1 - c))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether full sets reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def digest(hashes: np.ndarray) -> bytes:
    """A digest of a set of shingles, whatever their order."""
    return blake2b(np.sort(hashes).tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, content (digest of the full set; null without words), registers, bands."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = shingler.words(text)
                if not words:
                    out.append((doc_id, 0, None, None, None))
                    continue
                h = shingler.hashes(words)
                regs = registers(h, bands * rows)
                out.append((doc_id, len(h), digest(h), regs.astype("<u2").tobytes(), band_keys(regs, bands, rows)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "content", "registers", "bands"])

    made = doc_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(make, "doc_id string, n_shingles long, content binary, registers binary, bands array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _short(content):
    """A long from a digest. Two contents with the same one only cost a comparison more."""
    return F.xxhash64(content)


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted contents with their shingles (hashes, as bytes): one row for each content."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            held = [shingler.hashes(w) for w in map(shingler.words, batch["text"]) if w]
            yield pd.DataFrame([(digest(h), h.tobytes()) for h in held], columns=["content", "shingles"])

    ids = wanted.where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct()
    rows = doc_columns(docs, "doc_id", "text")
    here = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "doc_id").unionByName(rows.where("doc_id is null"))
    found = here.select("text").mapInPandas(make, "content binary, shingles binary").groupBy("content").agg(F.first("shingles").alias("shingles"))
    return found.join(wanted, "content")


def _near(table: DataFrame) -> DataFrame:
    """A stored table of keys, broadcast if it is small: then the hot key of the other side is never dealt to one task."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v: contents' vertices) among candidate pairs (a, b: contents)."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for a, b, sa, sb, ra, rb in zip(p["u"], p["v"], p["sa"], p["sb"], p["ra"], p["rb"]):
                na, nb = len(sa) // 8, len(sb) // 8
                if 100 * min(na, nb) < percent * max(na, nb):
                    continue
                ra, rb = np.frombuffer(ra, "<u2"), np.frombuffer(rb, "<u2")
                t = percent / 100
                if na > 64 and nb > 64 and estimate(ra, rb, na, nb) < t - MARGIN * math.sqrt(t * (1 - t) / len(ra)):
                    continue
                if linked(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), percent):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    one = lambda c, s, r, v: sets.select(F.col("vertex").alias(c), F.col("shingles").alias(s), F.col("registers").alias(r))
    both = pairs.join(one("u", "sa", "ra", "u"), "u").join(one("v", "sb", "rb", "v"), "v")
    return both.select("u", "v", "sa", "sb", "ra", "rb").mapInPandas(check, "u long, v long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Links join rows whose sets reach `percent` of Jaccard similarity; component_id is the smallest doc_id
    that links reach, and kept says that it is the row's own. A null or wordless text has no shingle, no
    link, and is kept. Rows with equal doc_ids are judged each by its text. A null doc_id takes part in
    links; its component_id is null if no linked row has an id. Ties do not arise: ids order the rows. Texts of
    any length are read whole, any long is an id, an empty table gives no rows, other columns are ignored.
    """
    tune(docs.sparkSession)
    bands, rows = band_plan(percent)
    made = materialise(sketch(docs, width, bands, rows), "sketches")
    some = made.where("content is not null")
    # vertices are numbered apart from the ids, which may be any long; once written, the numbers stand
    own = some.groupBy("content").agg(F.min("doc_id").alias("first_id"))
    own = materialise(own.withColumn("vertex", F.monotonically_increasing_id()), "vertices")

    # equal sets are one vertex; with a different set, one of n shingles reaches n / (n + 1) at most
    keyed = some.where(F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * percent).select(F.explode("bands").alias("key"), _short("content").alias("short"))
    shared = materialise(keyed.groupBy("key").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo < hi").select("key"), "shared-keys")
    # a bucket's members are dealt by both columns, so that no task holds a hot bucket
    buckets = materialise(keyed.join(_near(shared), "key").repartition("short", "key").distinct(), "buckets")

    wanted = some.select("content", "registers", _short("content").alias("short")).join(_near(materialise(buckets.select("short").distinct(), "shorts")), "short", "left_semi")
    wanted = wanted.groupBy("content").agg(F.first("registers").alias("registers"), F.first("short").alias("short")).join(own, "content")
    wanted = materialise(wanted, "wanted")
    sets = materialise(_full_sets(docs, wanted, width), "full-sets")
    members = _weighed(buckets.join(sets.select("short", "vertex"), "short").select("key", "vertex"))

    forest = None
    for _ in range(ROUNDS):
        open_ = _open(_labelled(members, forest), least=2)
        if not open_.take(1):
            break
        forest = _grown(forest, _verified(_star_pairs(open_), sets, percent))
        # a bucket of two has been compared; of the others, only members that may yet link to another component stay
        members = materialise(_may_link(_open(_labelled(members, forest), least=3), sets, percent), "members")
        tidy(docs.sparkSession)
    rest = _open(_labelled(members, forest), least=2)
    if rest.take(1):
        forest = _grown(forest, _verified(_prefix_pairs(rest, sets, percent), sets, percent))

    out = made.select("doc_id", "n_shingles", "content").join(own, "content", "left")
    if forest is None:
        out = out.withColumn("smallest", F.col("first_id"))
    else:
        out = out.join(_smallest(forest, own), "vertex", "left").withColumn("smallest", F.coalesce("smallest", "first_id"))
    group = F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))


def _smallest(forest: DataFrame, own: DataFrame) -> DataFrame:
    """vertex, smallest: the smallest doc_id of the component, for each vertex that has a link."""
    labelled = forest.select(F.col("v").alias("vertex"), "root").unionByName(forest.select(F.col("root").alias("vertex"), "root").distinct())
    ids = labelled.join(own.select("vertex", "first_id"), "vertex")
    return labelled.join(ids.groupBy("root").agg(F.min("first_id").alias("smallest")), "root").select("vertex", "smallest")


def _weighed(members: DataFrame) -> DataFrame:
    """Members of buckets with a weight: how many members the vertex meets in all its buckets."""
    members = materialise(members, "members")
    sized = members.join(_near(materialise(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "sizes")), "key")
    weight = sized.groupBy("vertex").agg(F.sum("size").alias("weight"))
    return materialise(members.join(weight, "vertex"), "weighed")


def _labelled(members: DataFrame, forest: DataFrame | None) -> DataFrame:
    """Members with their components so far."""
    if forest is None:
        return members.withColumn("root", F.col("vertex"))
    return members.join(forest.withColumnRenamed("v", "vertex"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))


def _open(labelled: DataFrame, least: int) -> DataFrame:
    """Members of buckets with `least` members or more, of two components or more."""
    open_ = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", "vertex", "root")).alias("lead")).where(F.col("lo") < F.col("hi")).where(F.col("size") >= least)
    leads = materialise(open_.select("key", "size", F.col("lead.vertex").alias("lead"), F.col("lead.root").alias("lead_root")), "leads")
    return materialise(labelled.join(_near(leads), "key"), "open")


def _star_pairs(open_: DataFrame) -> DataFrame:
    """Each open bucket's heaviest member, which is the likeliest to be what others were copied from, with those not of its component."""
    return open_.where("root <> lead_root").select(F.least("lead", "vertex").alias("u"), F.greatest("lead", "vertex").alias("v")).distinct()


def _may_link(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of open buckets without those that can reach no other component there: too many of their shingles occur
    in their own component only. Adds each vertex's size n, and the size that a set which it links to has at most."""
    vertices = open_.select("vertex", "root").distinct()
    single = sets.join(vertices, "vertex").select("vertex", "root", "shingles")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            held = [np.frombuffer(s, np.int64) for s in p["shingles"]]
            sizes = [len(h) for h in held]
            yield pd.DataFrame({"shingle": np.concatenate(held) if held else np.zeros(0, np.int64), "vertex": np.repeat(p["vertex"].to_numpy(), sizes), "root": np.repeat(p["root"].to_numpy(), sizes)})

    each = single.mapInPandas(split, "shingle long, vertex long, root long")
    # with w of its n shingles in other components, a set can only link to sets of up to this size
    wide = each.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle")
    size = sets.select("vertex", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    able = each.join(wide, "shingle").groupBy("vertex").agg(F.count(F.lit(1)).alias("wide")).join(size, "vertex").where(F.col("wide") * 100 >= F.col("n") * percent)
    able = able.select("vertex", "n", (F.col("wide") * (100 + percent) / percent - F.col("n")).alias("most"))
    kept = open_.select("key", "vertex", "weight").join(able, "vertex")
    kept = materialise(kept, "able")
    least = materialise(kept.groupBy("key").agg(F.min("n").alias("least")), "least")
    return kept.join(_near(least), "key").where(F.col("most") >= F.col("least")).drop("least")


def _grown(forest: DataFrame | None, links: DataFrame) -> DataFrame:
    """The forest with more links."""
    if forest is None:
        return components(links)
    out = components(links.select("u", "v").unionByName(forest.select(F.col("v").alias("u"), F.col("root").alias("v"))))
    discard(forest)
    return out


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components among the open members that can link: sets that overlap enough share one of
    their rarest shingles.

    Of n shingles, one of the n - o + 1 rarest must be in a set that holds o of them; o follows from the smallest set in
    the member's buckets. Shingles are dropped whose holders are all of one component, and of the others the rows of the
    component that holds most meet only those of other components.
    """
    least = open_.join(_near(materialise(open_.groupBy("key").agg(F.min("n").alias("least")), "least")), "key")
    each = least.groupBy("vertex", "root", "n", "most").agg(F.min("least").alias("least")).join(sets.select("vertex", "shingles"), "vertex")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            held = [np.frombuffer(x, np.int64) for x in p["shingles"]]
            sizes = [len(h) for h in held]
            own = {c: np.repeat(p[c].to_numpy(), sizes) for c in ("vertex", "root", "n", "most", "least")}
            yield pd.DataFrame({"shingle": np.concatenate(held) if held else np.zeros(0, np.int64)} | own)

    rows = materialise(each.select("vertex", "root", "n", "most", "least", "shingles").mapInPandas(split, "shingle long, vertex long, root long, n long, most double, least long"), "shingles")
    counted = rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "shingle")
    overlap = F.ceil(F.lit(percent) * (F.col("n") + F.col("least")) / (100 + percent) - 1e-9)
    rank = F.row_number().over(W.partitionBy("vertex").orderBy("df", "shingle"))
    prefix = materialise(counted.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - overlap + 1).select("shingle", "vertex", "root", "n", "most"), "prefixes")
    held = prefix.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("rows"))
    shared = held.groupBy("shingle").agg(F.max_by("root", F.struct("rows", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("shingle", "major")
    minor = prefix.join(shared, "shingle").where("root <> major").drop("major")
    other = prefix.select("shingle", F.col("vertex").alias("v"), F.col("root").alias("root_v"), F.col("n").alias("n_v"), F.col("most").alias("most_v"))
    pairs = minor.join(other, "shingle").where("root <> root_v and n_v <= most and n <= most_v")
    return pairs.select(F.least("vertex", "v").alias("u"), F.greatest("vertex", "v").alias("v")).distinct()


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group, all columns as they were: the row of the smallest doc_id.

    Of rows with equal doc_ids and equal texts one stays; equal doc_ids, or null ones, with other texts stay both.
    Rows without words are near copies of nothing and all stay. An empty table gives no rows.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if n["n"] == n["ids"]:
        name = fresh(docs, "kept_id")
        kept = near_groups(docs, width, percent).where("kept").select(F.col("doc_id").alias(name))
        return docs.join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    # a key of each row's own: a digest of id and text
    name, more = fresh(docs, "key"), fresh(docs, "more")
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    own = [F.col("doc_id").isNull(), own[0], own[1]]
    keyed = docs.withColumn(name, F.xxhash64(*own)).withColumn(more, F.xxhash64(F.lit(1), *own))
    found = near_groups(keyed.select(F.col(name).alias("doc_id"), "text"), width, percent)
    found = materialise(found.select(F.col("doc_id").alias(name), "n_shingles", F.col("component_id").alias("root")).distinct(), "row-groups")
    ids = keyed.select(name, F.col("doc_id").cast("long").alias("id")).distinct()
    best = found.where("n_shingles > 0").join(ids, name).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", name)).alias("best"))
    kept = keyed.join(best.select(F.col(f"best.{name}").alias(name)), name, "left_semi").dropDuplicates([name, more])
    wordless = keyed.join(found.where("n_shingles = 0").select(name), name, "left_semi")
    return kept.unionByName(wordless).select(docs.columns)


def oracle(width: int = 3, percent: int = 85) -> str:
    """The same by brute force: every pair of texts with a common shingle is counted in full."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i : i + {width - 1}], ' ')) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, hash(x) AS h FROM (SELECT doc_id, sh, unnest(sh) AS x FROM s)),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edge AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(u, v) AS (SELECT u, v FROM edge UNION SELECT r.u, edge.v FROM r JOIN edge ON r.v = edge.u),
c AS (SELECT u, min(v) AS least FROM r GROUP BY u)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id))::BIGINT AS component_id,
  s.doc_id <= coalesce(c.least, s.doc_id) AS kept FROM s LEFT JOIN c ON c.u = s.doc_id"""
