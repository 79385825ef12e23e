"""Exact top-k search by inner product: best-first search over M-trees.

Vectors are integers (floor of 256 times each component). An inner product is no metric, so a vector x gets one
more coordinate, the root of M^2 - |x|^2 with M the longest norm of all, and a query gets 0 there: then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and the highest scores are the nearest vectors. The top level of the tree is
dealt over the cluster: rows go to the nearest of some sampled routing vectors, a large group by a hash of its
rows on, so that a common vector cannot swell one block. Each block is bulk-loaded into pages. An inner page holds
routing vectors with covering radii and distances to their parent; a leaf page holds vectors with theirs. The
search takes pages from a queue by the least distance that their balls allow, and skips an entry without computing
its distance when the stored parent distance and the triangle inequality already put it beyond the k-th best.
Scores are exact integers; bounds only leave out.

Queries are a stated set. A bounded pilot sample gives each one a first k-th best, once; they travel in batches to
the blocks that some query's bound reaches.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import materialise

SCALE = 256.0
LEAF_ROWS, FAN = 128, 8
#: Rows in a block, at most on average; queries in a turn, on average; queries in a batch, at most; pilot rows, which routing vectors are taken from.
BLOCK_ROWS, QUERY_ROWS, BATCH_ROWS, PILOT_ROWS = 8_192, 4_096, 512, 1_024
HEAD = struct.Struct("<BIId")


@dataclass
class Leaf:
    ids: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    norm: float

    def pack(self) -> bytes:
        return HEAD.pack(0, *self.vectors.shape, self.norm) + self.ids.astype("<i8").tobytes() + self.vectors.astype("<i8").tobytes() + self.parent.astype("<f8").tobytes()


@dataclass
class Inner:
    children: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    norm: float

    def pack(self) -> bytes:
        return HEAD.pack(1, *self.pivots.shape, self.norm) + b"".join(x.astype(t).tobytes() for x, t in ((self.children, "<i8"), (self.pivots, "<f8"), (self.radius, "<f8"), (self.parent, "<f8")))


def unpack(raw: bytes) -> Leaf | Inner:
    inner, n, d, norm = HEAD.unpack_from(raw)
    at = HEAD.size

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, size, at)
        at += 8 * size
        return out

    if inner:
        return Inner(take("<i8", n), take("<f8", n * d).reshape(n, d), take("<f8", n), take("<f8", n), norm)
    return Leaf(take("<i8", n), take("<i8", n * d).reshape(n, d).astype(float), take("<f8", n), norm)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=-1))


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that makes their squared norm `norm`."""
    v = vectors.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(norm - (v**2).sum(axis=1), 0))])


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 5, norm: float | None = None, root: np.ndarray | None = None) -> list[bytes]:
    """Pages of a tree over the vectors; page 0 is the root, whose routing vector is `root` (lifted; else the origin)."""
    if norm is None:
        norm = float((vectors.astype(float) ** 2).sum(axis=1).max()) if len(ids) else 0.0
    points = lift(vectors, norm)
    pages: list[bytes] = []
    r = np.random.default_rng(seed)

    def grow(rows: np.ndarray, pivot: np.ndarray) -> int:
        me = len(pages)
        pages.append(b"")
        if len(rows) <= LEAF_ROWS:
            pages[me] = Leaf(ids[rows], vectors[rows], _distances(points[rows], pivot), norm).pack()
            return me
        fan = min(FAN, max(2, math.ceil(1.5 * len(rows) / LEAF_ROWS)))  # pages as full as may be
        chosen = points[r.choice(rows, fan, replace=False)]
        gap = (points[rows] ** 2).sum(axis=1)[:, None] + (chosen**2).sum(axis=1) - 2 * points[rows] @ chosen.T
        nearest = gap.argmin(axis=1)
        if np.bincount(nearest, minlength=fan).max() > 0.9 * len(rows):  # many equal vectors: any even cut is as good
            nearest = np.arange(len(rows)) * fan // len(rows)
        children, pivots, radius = [], [], []
        for k in range(fan):
            part = rows[nearest == k]
            if len(part):
                pivots.append(chosen[k])
                radius.append(_distances(points[part], chosen[k]).max())
                children.append(grow(part, chosen[k]))
        pivots = np.array(pivots)
        pages[me] = Inner(np.array(children), pivots, np.array(radius), _distances(pivots, pivot), norm).pack()
        return me

    if len(ids):
        grow(np.arange(len(ids)), np.zeros(points.shape[1]) if root is None else root)
    return pages


class Tree:
    """Opened pages, and the search."""

    def __init__(self, pages: list[bytes], root: np.ndarray | None = None) -> None:
        self.pages = [unpack(p) for p in pages]
        self.root = root
        self.computed = 0

    def top(self, query_id: int, q: np.ndarray, k: int, least: float = -math.inf) -> list[tuple[int, int]]:
        """The k best (score, id) with a score of `least` or more, but for the query's own id; ties to smaller ids."""
        if not self.pages:
            return []
        norm = self.pages[0].norm
        q = q.astype(float)
        point = np.append(q, 0.0)
        total = float(q @ q) + norm
        slack = 1e-7 * (1 + math.sqrt(total))  # rounding never leaves out a tie
        reach = lambda score: math.inf if score == -math.inf else math.sqrt(max(total - 2 * score, 0.0)) + slack
        bound = reach(least)
        best: list[tuple[int, int]] = []  # smallest first: (score, -id)
        queue = [(0.0, 0, float(_distances(point, 0.0 * point if self.root is None else self.root)))]
        while queue:
            low, number, to_parent = heapq.heappop(queue)
            if low > bound:
                break
            page = self.pages[number]
            gap = np.abs(to_parent - page.parent)
            if isinstance(page, Inner):
                near = np.flatnonzero(gap - page.radius <= bound)
                d = _distances(page.pivots[near], point)
                self.computed += len(near)
                for j, x in zip(near.tolist(), d.tolist()):
                    if (least_d := max(x - page.radius[j], 0.0)) <= bound:
                        heapq.heappush(queue, (least_d, int(page.children[j]), x))
                continue
            near = np.flatnonzero(gap <= bound)
            if not len(near):
                continue
            self.computed += len(near)
            whole = len(near) == len(page.ids)
            scores, ids = (page.vectors if whole else page.vectors[near]) @ q, page.ids if whole else page.ids[near]
            enough = np.flatnonzero(scores >= (best[0][0] if len(best) == k else least))
            for j in enough[np.lexsort((ids[enough], -scores[enough]))].tolist() if len(enough) else []:
                s, i = int(scores[j]), int(ids[j])
                if i == query_id:
                    continue
                if len(best) == k and (s, -i) < best[0]:
                    break
                (heapq.heapreplace if len(best) == k else heapq.heappush)(best, (s, -i))
            if len(best) == k:
                bound = min(bound, reach(best[0][0]))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (longs) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(SCALE) * c).cast("long"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole & (F.size("embedding") > 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


@dataclass
class Routing:
    """The tree's top level for vectors of one length: routing vectors (lifted), and in how many blocks each one's rows are."""

    norm: float
    pivots: np.ndarray
    blocks: np.ndarray

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        p = lift(vectors, self.norm)
        return ((self.pivots**2).sum(axis=1) - 2 * p @ self.pivots.T).argmin(axis=1)


def _routing(rows: DataFrame, pilot: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, Routing]:
    """The routing of each length of vectors; lengths and pivots are bounded by the pilot sample."""
    square = F.aggregate("v", F.lit(0.0), lambda t, c: t + c * c)
    out = {}
    for r in rows.groupBy("dim").agg(F.max(square).alias("norm"), F.count(F.lit(1)).alias("n")).collect():
        _, known = pilot.get(r["dim"], (None, np.zeros((1, r["dim"]))))  # a rare length may not be in the sample
        out[r["dim"]] = Routing(r["norm"], lift(known[: math.ceil(r["n"] / BLOCK_ROWS)], r["norm"]), np.ones(0, np.int64))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in b.groupby("dim"):
                pivot, n = np.unique(out[dim].nearest(np.stack(own["v"].to_numpy())), return_counts=True)
                yield pd.DataFrame({"dim": dim, "pivot": pivot, "n": n})

    counted = {(r["dim"], r["pivot"]): r["n"] for r in rows.select("dim", "v").mapInPandas(near, "dim int, pivot long, n long").groupBy("dim", "pivot").agg(F.sum("n").alias("n")).collect()}
    for dim, routing in out.items():
        routing.blocks = np.array([max(1, math.ceil(counted.get((dim, k), 0) / BLOCK_ROWS)) for k in range(len(routing.pivots))])
    return out


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, its k best others.

    Null vectors, empty ones, and those with a null or non-finite component take no part, nor do null ids;
    vectors of other lengths than the query's are no candidates of it. All rows are candidates, also those with
    equal vec_ids; of query rows with equal vec_ids, that with the smallest vector asks, and no row of its id is a
    candidate. Ties go to the smaller vec_id. A query with fewer than k candidates gets them all. An empty table
    gives no rows. Other columns are ignored. Inner products are to stay below 2^53.
    """
    rows = materialise(vectors_of(embeddings).withColumn("dim", F.size("v")), "vectors")
    n = rows.count()
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    turns = max(1, math.ceil(n / every / QUERY_ROWS))
    sampled = [(r["vec_id"], r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT_ROWS).collect()]
    pilot = {}
    for d in {len(v) for _, v in sampled}:
        own = [(i, v) for i, v in sampled if len(v) == d]
        pilot[d] = np.array([i for i, _ in own]), np.array([v for _, v in own], float)
    routing = _routing(rows, pilot)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, own in b.groupby("dim"):
                top = routing[dim]
                pivot = top.nearest(np.stack(own["v"].to_numpy()))
                first = np.concatenate([[0], np.cumsum(top.blocks)])
                yield own.assign(pivot=pivot, block=first[pivot] + own["salt"].to_numpy() % top.blocks[pivot])[["vec_id", "v", "dim", "pivot", "block"]]

    def load(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, pivot = int(pdf["dim"].iloc[0]), int(pdf["pivot"].iloc[0])
        top, v = routing[dim], np.stack(pdf["v"].to_numpy())
        pages = build(pdf["vec_id"].to_numpy(), v, norm=top.norm, root=top.pivots[pivot])
        radius = float(_distances(lift(v, top.norm), top.pivots[pivot]).max())
        return pd.DataFrame({"dim": dim, "block": pdf["block"].iloc[0], "pivot": pivot, "radius": radius, "page_id": range(len(pages)), "page": pages})

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)))
    dealt = salted.mapInPandas(deal, "vec_id long, v array<long>, dim int, pivot long, block long")
    pages = materialise(dealt.groupBy("dim", "block").applyInPandas(load, "dim int, block long, pivot long, radius double, page_id int, page binary"), "pages")
    # two numbers for each block of BLOCK_ROWS rows
    balls = pages.where("page_id = 0").select("dim", "block", "pivot", "radius").toPandas().sort_values(["dim", "block"])

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches of queries for each block that one of them may find something in, with each query's first bound."""
        for b in batches:
            for dim, own in b.groupby("dim"):
                for at in range(0, len(own), BATCH_ROWS):
                    part = own.iloc[at : at + BATCH_ROWS]
                    ids, v, top = part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float), routing[dim]
                    least = np.full(len(ids), -np.inf)
                    if dim in pilot and len(pilot[dim][0]) > k:
                        scores = v @ pilot[dim][1].T
                        scores[ids[:, None] == pilot[dim][0]] = -np.inf
                        least = np.partition(scores, -k, axis=1)[:, -k]
                    total = (v**2).sum(axis=1) + top.norm
                    reach = np.sqrt(np.maximum(total - 2 * least, 0)) + 1e-7 * (1 + np.sqrt(total))
                    point, here = np.column_stack([v, np.zeros(len(v))]), balls[balls["dim"] == dim]
                    away = np.sqrt(np.maximum((point**2).sum(axis=1)[:, None] + (top.pivots**2).sum(axis=1) - 2 * point @ top.pivots.T, 0))
                    for block, pivot, radius in zip(here["block"], here["pivot"], here["radius"]):
                        if len(near := np.flatnonzero(away[:, pivot] - radius <= reach * (1 + 1e-9) + 1e-6)):
                            packed = np.column_stack([v[near], least[near]]).tobytes()
                            yield pd.DataFrame({"dim": [dim], "block": [block], "turn": [int(ids[0]) // every % turns], "ids": [ids[near].astype("<i8").tobytes()], "queries": [packed]})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        dim = int(left["dim"].iloc[0])
        tree = Tree(left.sort_values("page_id")["page"].tolist(), routing[dim].pivots[int(left["pivot"].iloc[0])])
        out = []
        for ids, queries in zip(right["ids"], right["queries"]):
            ids, q = np.frombuffer(ids, "<i8"), np.frombuffer(queries).reshape(-1, dim + 1)
            for query_id, x in zip(ids.tolist(), q):
                out += [(query_id, i, s) for s, i in tree.top(query_id, x[:-1], k, float(x[-1]))]
        return pd.DataFrame(out, columns=names, dtype=np.int64)

    index = pages.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    asked = queries.mapInPandas(plan, "dim int, block long, turn int, ids binary, queries binary")
    found = index.groupBy("dim", "block", "turn").cogroup(asked.groupBy("dim", "block", "turn")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    """The same by brute force."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
