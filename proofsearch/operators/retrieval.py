"""Evidence retrieval: BM25, reach of hashed vectors, fusion, merging, title links and the second hop.

Every operator takes many questions at once, keyed by query_id; corpora are joined by term or bucket, never
crossed with the questions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import stored
from . import corpus, postings
from .links import mentions  # noqa: F401  searches take it from here
from .planner import entities

#: Questions that travel to a scan at once; documents that a scan holds as dense vectors at once, for hashed and for signed vectors.
QUERY_BLOCK, REACH_ROWS, SCAN_ROWS = 8_192, 4_096, 512
#: Buckets up to which a question's shares are added up in bytes; numbers that are so few that a scan looks at them at once.
BYTE_BUCKETS, FEW = 64, 8_192
#: Pairs of questions and documents that may travel to the vectors for a first k-th best.
MOST_SEEDS = 1 << 20


@dataclass(frozen=True)
class RetrievalParams:
    k1: float = 1.5
    b: float = 0.75
    vector_weight: float = 0.1
    least_reach: float = 0.12
    vector_only_reach: float = 0.3
    pool: int = 4
    secondary: float = 0.5
    link_boost: float = 0.5
    link_sources: int = 2
    hop_discount: float = 0.8


PARAMS = RetrievalParams()


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term)."""
    return queries.select("query_id", F.explode(F.array_distinct(T.content_words(F.col("query")))).alias("term"))


def bm25(queries: DataFrame, documents: DataFrame | corpus.Index, params: RetrievalParams = PARAMS, k: int | None = None) -> DataFrame:
    """(query_id, document_id, score) of the k best documents of each question, or of all that share a term with it.

    With k, blocks of postings that can't reach the k best stay closed; bounds hold for the parameters of the build,
    so with others all blocks are opened.
    """
    index = corpus.as_index(documents).held
    own = postings.Bm25(params.k1, params.b)
    if own == index.params:
        return postings.scores(query_terms(queries), index, k)
    found = postings.scores(query_terms(queries), replace(index, params=own))
    return found if k is None else ranked(found, "score", "place", k).drop("place")


def query_vectors(queries: DataFrame) -> DataFrame:
    """(query_id, bucket, w): content words only; the raw words of a question without any."""
    return corpus.vector(query_terms_all(queries)).withColumnRenamed("document_id", "query_id")


def weighted_jaccard(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, other, similarity) of pairs of sparse vectors (query_id, bucket, w): sum of least weights over that of greatest."""
    a = pairs.join(vectors.withColumnRenamed("w", "a"), "query_id")
    b = pairs.join(vectors.select(F.col("query_id").alias("other"), "bucket", F.col("w").alias("b")), "other")
    both = a.join(b, ["query_id", "other", "bucket"], "full_outer").na.fill(0.0, ["a", "b"])
    return both.groupBy("query_id", "other").agg(F.round(F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b")), 6).alias("similarity"))


def reach(queries: DataFrame, documents: DataFrame | corpus.Index, least: float | None = None, k: int | None = None, meter: Accumulator | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id, reach): how much of the question's vector the document covers.

    Vectors are non-negative, so the uncovered part differs from the question's own vector only in the question's
    buckets, and grows with each bucket looked at. A question's buckets are therefore taken in the order of what documents
    leave uncovered of them, rare and heavy ones first; a document that has left more than `least` (or the k-th best so
    far) allows is dropped, and the common buckets are only looked at for those that stay. Before that, documents go that could
    not reach as far if they covered each bucket they have anything in, which takes a byte a bucket. The stored vectors are scanned
    once for each QUERY_BLOCK of questions; a task gives out what reaches `least`, and the `k` best of each question (ties
    to the smaller document) where k is given. `seeds` (query_id, document_id), with at least k documents to a question, are
    looked at first: what is not better than the k-th of them is left at once, by all tasks. `meter` counts the buckets that
    were looked at, and all of them, as pairs.
    """
    index = corpus.as_index(documents)
    asked = queries.select("query_id", query_stems(F.col("query")).alias("words"))
    n = queries.count()
    # the stated set of questions in blocks, each of a size that a task can hold
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    own = lambda df, i: df if blocks == 1 else df.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
    seeded = seeds is not None and k is not None and min(n, QUERY_BLOCK) * k <= MOST_SEEDS
    return reduce(DataFrame.unionByName, [_reach_scan(own(asked, i), index, least, k, meter, own(seeds, i) if seeded else None) for i in range(blocks)])


def _reach_floors(seeds: DataFrame, index: corpus.Index, k: int, held, schema: str) -> dict:
    """The k-th best (reach, document) of each question's seeds, for questions with so many. The pairs, MOST_SEEDS at most, travel to the vectors."""
    pairs = seeds.groupBy("document_id").agg(F.collect_set("query_id").alias("asked"))
    met = index.vectors.join(F.broadcast(pairs), "document_id").select("document_id", "buckets", "weights", "asked")
    kinds = [pa.string() if f.split()[1] == "string" else pa.int64() for f in schema.split(", ")[:2]]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, buckets, weights = held.value
        number, x = {q: j for j, q in enumerate(names)}, np.zeros(corpus.BUCKETS)
        norms = [float((w**2).sum()) for w in weights]
        for b in batches:
            ends = np.cumsum(b["buckets"].value_lengths().to_numpy(zero_copy_only=False))
            flat, heavy, ids = b["buckets"].flatten().to_numpy(), b["weights"].flatten().to_numpy(), b["document_id"].to_pylist()
            q, d, r = [], [], []
            for i, asked in enumerate(b["asked"].to_pylist()):
                own = slice(ends[i - 1] if i else 0, ends[i])
                x[flat[own]] = heavy[own]
                for j in (number[a] for a in asked if a in number):
                    gap = weights[j] - x[buckets[j]]
                    np.maximum(gap, 0, out=gap)
                    q.append(names[j])
                    d.append(ids[i])
                    r.append(1 - math.sqrt(gap @ gap / norms[j]))
                x[flat[own]] = 0
            yield pa.record_batch([pa.array(q, kinds[0]), pa.array(d, kinds[1]), pa.array(np.round(np.clip(np.array(r, float), 0, 1), 6))], names=["query_id", "document_id", "reach"])

    last = ranked(met.mapInArrow(meet, schema), "reach", "place", k).where(F.col("place") == k)
    return {r["query_id"]: (r["reach"], r["document_id"]) for r in last.collect()}  # a row for each question of a block


def sparse_questions(asked: DataFrame) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
    """Ids, buckets and weights of questions (query_id, words); those without a word are left out."""
    rows = asked.groupBy("query_id").agg(F.flatten(F.collect_list("words")).alias("words")).where(F.size("words") > 0).orderBy("query_id").collect()
    names = sorted({w for r in rows for w in r["words"]})
    number = {w: i for i, w in enumerate(names)}
    flat = np.array([number[w] for r in rows for w in r["words"]], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r["words"]) for r in rows])
    pair, n = postings.grouped(row * max(len(names), 1) + flat, np.ones(len(flat), np.int64))
    at, bucket, w = postings.hashed(pair // max(len(names), 1), pair % max(len(names), 1), n, names, len(rows))
    cuts = np.searchsorted(at, np.arange(1, len(rows)))
    return [r["query_id"] for r in rows], np.split(bucket, cuts), np.split(w, cuts)


def _reach_scan(asked: DataFrame, index: corpus.Index, least: float | None, k: int | None, meter: Accumulator | None, seeds: DataFrame | None) -> DataFrame:
    query_kind, id_kind = dict(asked.dtypes)["query_id"], index.held.id_type
    schema = f"query_id {query_kind}, document_id {id_kind}, reach double"
    # QUERY_BLOCK questions of at most BUCKETS numbers, in fact some hundred each
    names, buckets, weights = sparse_questions(asked)
    if not names:
        return index.spark.createDataFrame([], schema)
    norms = np.sqrt([float((w**2).sum()) for w in weights])
    id_type = pa.string() if id_kind == "string" else pa.int64()
    query_type = pa.string() if query_kind == "string" else pa.int64()
    held = index.spark.sparkContext.broadcast((names, buckets, weights))
    known = {} if seeds is None else _reach_floors(seeds, index, k, held, schema)
    first = index.spark.sparkContext.broadcast([known.get(q) for q in names])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, a row for each bucket, and where it is filled; few documents first, so that there is a k-th best to reach."""
        rows = REACH_ROWS // 32
        x, filled = np.zeros((corpus.BUCKETS, REACH_ROWS)), np.zeros((corpus.BUCKETS, REACH_ROWS), np.uint8)
        for b in batches:
            start = 0
            while start < b.num_rows:
                part = b.slice(start, rows)
                start, rows = start + rows, min(2 * rows, REACH_ROWS)
                sizes = part["buckets"].value_lengths().to_numpy(zero_copy_only=False)
                at = part["buckets"].flatten().to_numpy(), np.repeat(np.arange(part.num_rows), sizes)
                x[at], filled[at] = part["weights"].flatten().to_numpy(), 255
                yield part["document_id"].to_numpy(zero_copy_only=False), x[:, : part.num_rows], filled[:, : part.num_rows]
                x[at], filled[at] = 0, 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, buckets, weights = held.value
        best = [(np.zeros(0), np.zeros(0, object if id_kind == "string" else np.int64))] * len(names)
        # what may be left uncovered; reach is rounded to six places
        room = np.full(len(names), np.inf) if least is None else ((1 - least + 1e-6) * norms) ** 2
        floors = list(first.value)  # the k-th best so far, and its document
        # what each bucket covers if it is filled, in whole steps rounded up, and how many of these a unit has
        units = [(255 - len(w)) / (w**2).sum() if len(w) <= BYTE_BUCKETS else min(254 / (w**2).max(), (65_535 - len(w)) / (w**2).sum()) for w in weights]
        shares = [np.ceil(w**2 * u).astype(np.uint8)[:, None] for w, u in zip(weights, units, strict=True)]

        def narrow(j: int) -> None:
            room[j] = min(room[j], ((1 - floors[j][0] + 2e-6) * norms[j]) ** 2)

        for j, known in enumerate(floors):
            if known is not None:
                narrow(j)
        plans: list[list[tuple]] = []
        looked = of = 0

        def near(j: int, filled: np.ndarray) -> np.ndarray | None:
            """Rows that the filled buckets let come near enough; none are left out where all may."""
            need = math.ceil(units[j] * (norms[j] ** 2 - room[j]) - 1e-3) if room[j] < np.inf else 0
            if need <= 0:
                return None
            return np.flatnonzero(np.add.reduce(filled[buckets[j]] & shares[j], axis=0, dtype=np.uint8 if len(buckets[j]) <= BYTE_BUCKETS else np.uint16) >= need)

        def given(q: np.ndarray, ids: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(names, query_type).take(pa.array(q)), pa.array(ids, id_type), pa.array(r)], names=["query_id", "document_id", "reach"])

        for ids, x, filled in dense(batches):
            total = x.shape[1]
            if not plans:
                for b, w in zip(buckets, weights, strict=True):
                    order = np.argsort(-(np.maximum(w[:, None] - x[b, :64], 0) ** 2).mean(axis=1), kind="stable")
                    cuts = [0, *sorted({max(1, len(b) * s // 16) for s in (1, 2, 4, 8)}), len(b)]
                    plans.append([(b[order[c:d]], w[order[c:d], None]) for c, d in zip(cuts, cuts[1:], strict=False) if d > c])
            for j, parts in enumerate(plans):
                rows, left = near(j, filled), None
                of += total * len(buckets[j])
                if rows is not None and not len(rows):
                    continue
                if rows is not None and len(rows) * len(buckets[j]) <= FEW:
                    parts = [(buckets[j], weights[j][:, None])]
                for b, w in parts:
                    gap = w - (x[b] if rows is None else x[b[:, None], rows])
                    looked += gap.size
                    np.maximum(gap, 0, out=gap)
                    more = np.einsum("ij,ij->j", gap, gap)
                    left = more if left is None else left + more
                    stay = np.flatnonzero(left <= room[j])
                    if len(stay) < len(left) or rows is None:
                        rows, left = stay if rows is None else rows[stay], left[stay]
                    if not len(rows):
                        break
                if not len(rows):
                    continue
                r = np.round(np.clip(1 - np.sqrt(left) / norms[j], 0, 1), 6)
                # without a limit, whatever shares a bucket
                hit = r >= least if least is not None else x[buckets[j][:, None], rows].max(axis=0) > 0
                if floors[j] is not None:
                    last, name = floors[j]
                    hit &= r >= last
                    tied = np.flatnonzero(hit & (r == last))
                    if len(tied):
                        hit[tied] = ids[rows[tied]] <= name
                rows, r = rows[hit], r[hit]
                if not len(rows):
                    continue
                if k is None:
                    yield given(np.full(len(rows), j), ids[rows], r)
                    continue
                values, own = np.concatenate([best[j][0], r]), np.concatenate([best[j][1], ids[rows]])
                if len(values) >= k:
                    last = np.partition(values, len(values) - k)[len(values) - k]
                    above, tied = np.flatnonzero(values > last), np.flatnonzero(values == last)
                    tied = tied[np.argsort(own[tied], kind="stable")[: k - len(above)]]
                    keep = np.concatenate([above, tied])
                    values, own = values[keep], own[keep]
                    floors[j] = (last, own[-1])
                    narrow(j)
                best[j] = (values, own)
        if k is not None:
            q = np.repeat(np.arange(len(best)), [len(values) for values, _ in best])
            yield given(q, np.concatenate([own for _, own in best]), np.concatenate([values for values, _ in best]))
        if meter is not None:
            meter.add(np.array([looked, of]))

    return index.vectors.mapInArrow(scan, schema)


def query_stems(query: Column) -> Column:
    """Content words with repeats; the raw words of a question that has none."""
    own = T.content_words(query)
    return F.when(F.size(own) > 0, own).otherwise(T.words(query))


def query_terms_all(queries: DataFrame) -> DataFrame:
    """Content words with repeats, as (document_id, term) rows; the raw words of a question that has none."""
    return queries.select(F.col("query_id").alias("document_id"), F.explode(query_stems(F.col("query"))).alias("term"))


def ranked(scores: DataFrame, score: str, rank: str, k: int) -> DataFrame:
    """The k best of each question, ties to the smaller document."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), "document_id")
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hybrid(queries: DataFrame, documents: DataFrame | corpus.Index, top_k: int = 5, params: RetrievalParams = PARAMS) -> DataFrame:
    """(query_id, document_id, score, bm25_rank, vector_rank): both lists, cut to a pool, each over its best.

    A document of the vector list alone needs a reach of its own; the best possible score is 1.
    """
    index, pool = corpus.as_index(documents), params.pool * top_k
    # the scan of the vectors begins with what shares words with a question
    lexical = stored(bm25(queries, index, params, pool), "lexical")
    return fuse(lexical, reach(queries, index, params.least_reach, pool, seeds=lexical), top_k, params)


def fuse(lexical: DataFrame, vectors: DataFrame, top_k: int, params: RetrievalParams = PARAMS) -> DataFrame:
    pool = params.pool * top_k
    lex = ranked(lexical.withColumnRenamed("score", "bm25"), "bm25", "bm25_rank", pool)
    vec = ranked(vectors.where(F.col("reach") >= params.least_reach), "reach", "vector_rank", pool)
    both = lex.join(vec, ["query_id", "document_id"], "full_outer").where(F.col("bm25_rank").isNotNull() | (F.col("reach") >= params.vector_only_reach))
    own = W.partitionBy("query_id")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(own), F.lit(0.0)), F.lit(0.0))
    scored = both.withColumn("score", F.round((share("bm25") + params.vector_weight * share("reach")) / (1 + params.vector_weight), 6))
    order = own.orderBy(F.desc("score"), F.asc_nulls_last("bm25_rank"), "document_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "document_id", "score", "bm25_rank", "vector_rank", "rank")


def merge(batches: DataFrame, k: int) -> DataFrame:
    """Batches (query_id, document_id, score, batch) into the k best, each document once: its best score, ties to the first batch."""
    best = batches.withColumn("r", F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "batch"))).where("r = 1").drop("r")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "batch", "document_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weighted(scores: DataFrame, weight: float, batch: int) -> DataFrame:
    return scores.select("query_id", "document_id", T.settled(F.col("score") * weight).alias("score"), F.lit(batch).alias("batch"))


def multi_query(first: DataFrame, others: DataFrame, documents: DataFrame | corpus.Index, top_k: int, params: RetrievalParams = PARAMS) -> DataFrame:
    """The question at full weight and its fragments at `secondary`, merged into a pool of three times top_k.

    `others` has any number of fragments (query_id, query) to a question; each is searched on its own, equal ones once.
    """
    pool, documents = 3 * top_k, corpus.as_index(documents)
    keyed = others.select("query_id", "query").distinct().withColumn("key", F.xxhash64("query_id", "query"))
    each = hybrid(keyed.select(F.col("key").alias("query_id"), "query"), documents, pool, params).withColumnRenamed("query_id", "key")
    main = weighted(hybrid(first, documents, pool, params), 1.0, 0)
    more = weighted(each.join(keyed.select("key", "query_id"), "key"), params.secondary, 1)
    return merge(main.unionByName(more), pool)


def citing_texts(found: DataFrame, documents: DataFrame, params: RetrievalParams = PARAMS) -> DataFrame:
    """(text_id, text) of the documents whose citations `link_hop` follows; no others need to be searched for titles."""
    first = found.where(F.col("rank") <= params.link_sources).select("document_id").distinct()
    return documents.join(first, "document_id", "left_semi").select(F.col("document_id").alias("text_id"), "text")


def link_hop(found: DataFrame, links: DataFrame, top_k: int, params: RetrievalParams = PARAMS) -> DataFrame:
    """Adds the documents that the first `link_sources` documents of each question cite, at their own score plus
    half of the citing one's, and keeps the top_k. `links` has (text_id, document_id): citing and cited."""
    citing = found.where(F.col("rank") <= params.link_sources).select("query_id", F.col("document_id").alias("text_id"), F.col("score").alias("citing"))
    cited = citing.join(links.select("text_id", "document_id"), "text_id").where("text_id <> document_id")
    cited = cited.groupBy("query_id", "document_id").agg(F.max("citing").alias("citing"))
    own = found.select("query_id", "document_id", F.col("score").alias("own"))
    boosted = cited.join(own, ["query_id", "document_id"], "left").select("query_id", "document_id", F.round(F.coalesce("own", F.lit(0.0)) + params.link_boost * F.col("citing"), 6).alias("score"), F.lit(1).alias("batch"))
    return merge(found.select("query_id", "document_id", "score", F.lit(0).alias("batch")).unionByName(boosted), top_k)


def bridges(queries: DataFrame, found: DataFrame, texts: DataFrame, key_terms: int = 4) -> DataFrame:
    """(query_id, query): the first two entities of a question's three best documents that the question does not hold,
    each with the question's first terms. `texts` has (document_id, text)."""
    best = found.where("rank <= 3").select("query_id", "document_id", "rank").join(texts.select("document_id", "text"), "document_id")
    named = best.select("query_id", "rank", F.posexplode(entities(F.col("text"))).alias("n", "entity"))
    own = queries.select("query_id", T.content_words(F.col("query")).alias("stems"))
    stems = T.content_words(F.col("entity"))
    new = named.join(own, "query_id").where((F.size(stems) > 0) & (F.size(F.array_except(stems, "stems")) > 0))
    once = new.groupBy("query_id", "entity").agg(F.min(F.struct("rank", "n")).alias("at"), F.first("stems").alias("stems"))
    kept = once.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("at", "entity"))).where("r <= 2")
    return kept.select("query_id", F.trim(F.concat_ws(" ", "entity", F.array_join(F.slice(F.array_distinct("stems"), 1, key_terms), " "))).alias("query"))


def second_hop(found: DataFrame, bridges: DataFrame, documents: DataFrame | corpus.Index, top_k: int, params: RetrievalParams = PARAMS) -> DataFrame:
    """A second search with bridge queries (query_id, query), discounted and merged with the first."""
    documents = corpus.as_index(documents)
    # the search reads its questions several times
    keyed = stored(bridges.select("query_id", "query").distinct().withColumn("key", F.xxhash64("query_id", "query")), "bridges")
    each = hybrid(keyed.select(F.col("key").alias("query_id"), "query"), documents, 3 * top_k, params).withColumnRenamed("query_id", "key")
    again = weighted(each.join(keyed.select("key", "query_id"), "key"), params.hop_discount, 1)
    return merge(found.select("query_id", "document_id", "score", F.lit(0).alias("batch")).unionByName(again), top_k)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): cosine similarity of a stated query set and all vectors of signed components.

    The queries travel to one scan of the vectors for each QUERY_BLOCK of them; a task multiplies SCAN_ROWS vectors with
    them at once, keeps the k best of each query as it goes and gives those out at its end.
    """
    n = queries.count()
    parts = max(1, math.ceil(n / QUERY_BLOCK))
    keyed = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    found = [_dense_scan(keyed.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i), vectors, k) for i in range(parts)]
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dense_scan(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    rows = queries.collect()  # QUERY_BLOCK vectors at most
    names = np.array([r["vec_id"] for r in rows], np.int64)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    q = unit(np.array([r["v"] for r in rows], float)) if rows else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # rows of queries, ids and scores
        floor = np.full(len(names), -np.inf)
        for b in (b.slice(start, SCAN_ROWS) for b in batches if q is not None for start in range(0, b.num_rows, SCAN_ROWS)):
            ids = b["vec_id"].to_numpy()
            v = unit(b["v"].flatten().to_numpy().reshape(len(ids), -1))
            score = np.round(q @ v.T, 6)
            score[names[:, None] == ids] = -np.inf
            if len(ids) >= k and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
            row, at = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
            row, own, value = (np.concatenate(x) for x in zip(best, (row, ids[at], score[row, at]), strict=True))
            # ties to the smaller id
            order = np.lexsort((own, -value, row))
            row, own, value = row[order], own[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = (row[place < k], own[place < k], value[place < k])
            full = place == k - 1
            floor[row[full]] = value[full]
        row, own, value = best
        yield pa.record_batch([pa.array(names[row]), pa.array(own), pa.array(value)], names=["query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(scan, "query_id long, vec_id long, score double")


def sentence_rows(documents: DataFrame) -> DataFrame:
    """(document_id, ordinal, item, sentence, title): sentences of each document but for one that only repeats its title."""
    each = documents.select("document_id", "title", F.posexplode(T.split_sentences(F.col("text"))).alias("ordinal", "sentence"))
    bare = lambda c: F.regexp_replace(T.flat(c), r"[ .!?;]+$", "")
    return each.where(bare(F.col("sentence")) != bare(F.col("title"))).withColumn("item", F.concat_ws("#", F.col("document_id").cast("string"), F.col("ordinal").cast("string")))


def top_sentences(queries: DataFrame, documents: DataFrame, top_k: int, index: corpus.Index | None = None) -> DataFrame:
    """(query_id, document_id, ordinal, score, sentence): plain BM25 over documents (document_id, title, text), then the best
    sentence of the `top_k` found, by BM25 over those questions' sentences, each read with its document's title.

    Sentences of a question's documents are a corpus of their own: their df, number and mean length are counted for it.
    """
    found = ranked(bm25(queries, index or documents, k=top_k), "score", "place", top_k).select("query_id", "document_id", "place")
    found = stored(found, "found")
    # only documents that were found are cut into sentences; what follows reads these several times
    hits = found.join(sentence_rows(documents.join(found.select("document_id").distinct(), "document_id", "left_semi")), "document_id")
    raw = stored(hits.select("query_id", "document_id", "place", "ordinal", "sentence", T.content_words(F.concat_ws(" ", "title", "sentence")).alias("w")).withColumn("n_terms", F.size("w")), "sentences")
    per = raw.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("mean"))
    tf = raw.select("query_id", "document_id", "place", "ordinal", "n_terms", F.explode("w").alias("term")).join(query_terms(queries), ["query_id", "term"], "left_semi").groupBy("query_id", "document_id", "place", "ordinal", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (PARAMS.k1 + 1) / (F.col("tf") + PARAMS.k1 * (1 - PARAMS.b + PARAMS.b * F.col("n_terms") / F.greatest(F.col("mean"), F.lit(1e-9))))
    scored = tf.join(df, ["query_id", "term"]).join(per, "query_id").groupBy("query_id", "document_id", "place", "ordinal").agg(F.round(F.sum(weight), 6).alias("score"))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "place", "ordinal"))).where("r = 1")
    out = best.join(raw.select("query_id", "document_id", "ordinal", "sentence"), ["query_id", "document_id", "ordinal"])
    return out.select("query_id", "document_id", F.col("ordinal").cast("long").alias("ordinal"), "score", "sentence")
