"""Packing: lexical retrieval fills each window with a seed document's neighbours.

Documents are dealt to shards by what they say: the first key of a document is one of its terms, drawn by a
weighted minimum hash (weights are powers of idf over all documents), so two documents have the same key as often as their
terms' weights overlap. Small keys share a shard; a key beyond a shard is dealt by a second such term, and what
is still too large (copies) by a hash of the row, so shards have a bounded size. A shard holds a BM25 inverted
index of its own documents, over their token ids; df, number of documents and mean length are those of the
whole table. The window's seed asks the index with all its terms for its unused neighbours, and they fill the
window greedily, best score first; the document that does not fit is cut there, and its rest seeds the next window. All windows of a shard but
the last are thus full, and the last is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import doc_columns, materialise, tune
from .tokens import batched, binary_rows, one_array, unit_tokenizer, values_of

WINDOW = 2048
END_ID = 1
#: A shard's share of the corpus: characters and documents it holds on average.
SHARD_CHARS, SHARD_DOCS = 3_000_000, 1_500
#: Terms with which a seed asks: all. BM25's two constants.
QUERY_TERMS = None
K1, B = 1.5, 0.75
#: A term that more than one of so many documents of a shard hold has its weights in a row, with zeros.
DENSE = 4
#: Token ids are below this; slots of a key for each shard that it fills; power of idf at which keys are drawn.
IDS, SLOTS, KEY_POWER = 1 << 16, 8, 3


@dataclass(frozen=True)
class Corpus:
    """What BM25 takes from all documents: their number, mean length, and each id's document frequency."""

    n: int
    mean: float
    df: np.ndarray

    def draws(self) -> tuple[np.ndarray, np.ndarray]:
        """Two exponential draws for each id, at the rate of its idf to KEY_POWER: the ids in their order, and their places in it.

        An id of one document has no draw; its place is IDS, where IDS stands.
        """
        r = np.random.default_rng(20240607).exponential(size=(2, IDS))
        with np.errstate(divide="ignore"):
            drawn = np.where(self.df > 1, r / np.log1p((self.n - self.df + 0.5) / (self.df + 0.5)) ** KEY_POWER, np.inf)
        order = np.argsort(drawn, axis=1, kind="stable")
        place = np.empty((2, IDS), np.int32)
        np.put_along_axis(place, order, np.arange(IDS, dtype=np.int32)[None], axis=1)
        place[~np.isfinite(drawn)] = IDS
        return np.append(order, [[IDS], [IDS]], axis=1), place


def keys(flat: np.ndarray, size: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Two ids of each document, the smallest of either draw; IDS for a document that shares no term."""
    out = np.full((2, len(size)), IDS, np.int64)
    if len(flat):
        some = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[some]
        for j, (order, place) in enumerate(zip(*draws)):
            out[j, some] = order[np.minimum.reduceat(place[flat], start)]
    return out


def pairs_of(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The different ids of each document, one after another."""
    kind = np.uint32 if len(size) <= IDS else np.uint64
    pairs = np.repeat(np.arange(len(size), dtype=kind) * kind(IDS), size) | flat
    pairs.sort()
    return pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] % kind(IDS)


class Deal:
    """Which shard a document goes to, from how many documents and characters each key and slot of it holds."""

    def __init__(self, by_key: list[tuple[int, int, int]]) -> None:
        self.slots = np.ones(IDS + 1, np.int64)
        for key, n, chars in by_key:
            if (load := self.load(n, chars)) > 1:
                self.slots[key] = math.ceil(load) * SLOTS
        self.start = np.concatenate([[0], np.cumsum(self.slots)])

    @staticmethod
    def load(n: int, chars: int) -> float:
        return max(n / SHARD_DOCS, chars / SHARD_CHARS)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return self.start[keys[0]] + (mixed % self.slots[keys[0]].astype(np.uint64)).astype(np.int64)

    def fill(self, by_slot: list[tuple[int, int, int]]) -> None:
        """Slots in order fill a shard up; a slot beyond one has shards of its own."""
        self.first, self.shards = np.zeros(self.start[-1], np.int64), np.ones(self.start[-1], np.int64)
        shard, held_n, held_chars = 0, 0, 0
        for slot, n, chars in sorted(by_slot):
            if held_n and self.load(held_n + n, held_chars + chars) > 1:
                shard, held_n, held_chars = shard + 1, 0, 0
            self.first[slot], self.shards[slot] = shard, max(1, math.ceil(self.load(n, chars)))
            if self.shards[slot] > 1:
                shard, held_n, held_chars = shard + self.shards[slot], 0, 0
            else:
                held_n, held_chars = held_n + n, held_chars + chars

    def shard(self, slots: np.ndarray, salts: np.ndarray) -> np.ndarray:
        return self.first[slots] + salts % self.shards[slots]


class Bm25Shard:
    """Inverted index over a shard's documents, each an array of token ids; `corpus` is of these alone if not given."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None) -> None:
        n = max(len(docs), 1)
        length = np.array([len(d) for d in docs], np.int64)
        term = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        pair, tf = np.unique(term * n + np.repeat(np.arange(len(docs)), length), return_counts=True)
        term, doc = pair // n, pair % n
        df = np.bincount(term, minlength=1)
        whole = corpus or Corpus(len(docs), length.mean() if len(docs) else 1, df)
        norm = K1 * (1 - B + B * length / max(whole.mean, 1e-9))
        idf = np.log1p((whole.n - whole.df[: len(df)] + 0.5) / (whole.df[: len(df)] + 0.5))
        shared = df[term] > 1  # a term of one document leads to no neighbour
        term, doc, tf = term[shared], doc[shared], tf[shared]
        self.n, self.doc, self.weight = len(docs), doc, idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.start = np.searchsorted(term, np.arange(len(df) + 1))
        # terms of many documents as rows of weights: at most DENSE values for each of their postings
        self.row = np.full(len(df), -1, np.int64)
        many = np.flatnonzero(np.diff(self.start) * DENSE > n)
        self.row[many] = np.arange(len(many))
        self.dense, at = np.zeros((len(many), n)), self.row[term]
        self.dense[at[at >= 0], doc[at >= 0]] = self.weight[at >= 0]
        order = np.argsort(doc, kind="stable")
        self.terms, self.terms_at = term[order], np.searchsorted(doc[order], np.arange(len(docs) + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed: best first, ties to the earlier document."""
        terms = self.terms[self.terms_at[seed] : self.terms_at[seed + 1]]
        if not len(terms):
            return terms
        row = self.row[terms]
        score, terms = self.dense[row[row >= 0]].sum(axis=0), terms[row < 0]
        if len(terms):
            start, size = self.start[terms], self.start[terms + 1] - self.start[terms]
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        found = np.flatnonzero((score > 0) & ~used)  # every weight is positive
        return found[np.argsort(-np.round(score[found], 9), kind="stable")]


def pack_shard(ids: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents, each the ids of its tokens with the end id."""
    n, index, lengths = len(ids), Bm25Shard([x[:-1] for x in ids], corpus), [len(x) for x in ids]
    used, pieces = np.zeros(n, bool), []
    sequence = offset = 0
    seed: int | None = None
    queue: list[int] = []
    nxt = 0

    def place(d: int) -> bool:
        """Puts a whole document, in pieces; true if a new window began within or after it."""
        nonlocal sequence, offset
        at, turned = 0, False
        while at < lengths[d]:
            k = min(window - offset, lengths[d] - at)
            pieces.append((d, at, k, sequence, offset))
            at, offset = at + k, offset + k
            if offset == window:
                sequence, offset, turned = sequence + 1, 0, True
        return turned

    while True:
        while queue and used[queue[-1]]:
            queue.pop()
        if queue:
            d = queue.pop()
        else:
            while nxt < n and used[nxt]:
                nxt += 1
            if nxt == n:
                break
            d, seed = nxt, None
        used[d] = True
        # the document that crosses into a window is that window's seed
        if place(d) or seed is None:
            seed = d
            queue = index.neighbours(d, used)[::-1].tolist()
    return _cut_last(pieces, sequence, offset) if offset else pieces


def _cut_last(pieces: list, sequence: int, filled: int) -> list:
    """The last window, cut into sequences whose lengths are powers of two."""
    out = [p for p in pieces if p[3] != sequence]
    bounds, at = [], 0
    for k in range(filled.bit_length() - 1, -1, -1):
        if filled >> k & 1:
            bounds.append((at, at + (1 << k)))
            at += 1 << k
    for d, start, length, _, offset in (p for p in pieces if p[3] == sequence):
        for j, (lo, hi) in enumerate(bounds):
            a, b = max(lo, offset), min(hi, offset + length)
            if a < b:
                out.append((d, start + a - offset, b - a, sequence + j, a - lo))
    return out


def _tokens(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id (a string), chars, ids (bytes) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = unit_tokenizer(tokenizer, False)
        if tok.bpe.size > IDS:
            raise ValueError(f"packing keeps token ids in two bytes, and this vocabulary has {tok.bpe.size}")
        for b in batched(batches):
            texts = one_array(b["text"]).fill_null("")
            yield pa.record_batch({"doc_id": one_array(b["doc_id"]), "chars": pc.utf8_length(texts).cast(pa.int64()), "ids": binary_rows(*tok.flat(texts))})

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(make, "doc_id string, chars long, ids binary")


def _corpus(tokens: DataFrame) -> Corpus:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(IDS, np.int64), 0, 0
        for b in batches:
            flat, size = values_of(b["ids"], np.dtype("<u2"))
            n, length = n + len(size), length + len(flat)
            df += np.bincount(pairs_of(flat, size).astype(np.int64), minlength=IDS)
        at = np.flatnonzero(df)
        # beyond the ids: the number of documents, and of their tokens
        yield pa.record_batch({"id": np.append(at, [IDS, IDS + 1]), "n": np.append(df[at], [n, length])})

    out = np.zeros(IDS + 2, np.int64)
    # bounded by the vocabulary
    for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return Corpus(int(out[IDS]), float(out[IDS + 1] / max(out[IDS], 1)), out[:IDS])


def _counted(tokens: DataFrame, place) -> list[tuple[int, int, int]]:
    """(place, documents, characters); `place` makes an array of places from a batch's ids, and how many each document has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, which = np.unique(place(*values_of(b["ids"], np.dtype("<u2"))), return_inverse=True)
            chars = np.zeros(len(at), np.int64)
            np.add.at(chars, which, b["chars"].to_numpy())
            yield pa.record_batch({"at": at, "n": np.bincount(which, minlength=len(at)), "chars": chars})

    found = tokens.select("chars", "ids").mapInArrow(count, "at long, n long, chars long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    # bounded by the vocabulary and the number of shards
    return [tuple(r) for r in found.collect()]


def dealt(tokens: DataFrame, corpus: Corpus) -> DataFrame:
    """shard, doc_id, ids of every row."""
    draws = corpus.draws()
    deal = Deal(_counted(tokens, lambda flat, size: keys(flat, size, draws)[0]))
    deal.fill(_counted(tokens, lambda flat, size: deal.slot(keys(flat, size, draws))))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = deal.slot(keys(*values_of(b["ids"], np.dtype("<u2")), draws))
            yield pa.record_batch({"shard": deal.shard(slots, b["salt"].to_numpy()), "doc_id": b["doc_id"], "ids": b["ids"]})

    # rows of one doc_id, or of none, are dealt apart: tokens are stored, so a row's number is the same in every attempt
    salted = tokens.select("doc_id", "ids", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 40)).alias("salt"))
    return salted.mapInArrow(put, "shard long, doc_id string, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A null or empty text is the end id alone; a null doc_id is kept; rows with equal doc_ids are packed
    each for itself, and are dealt over shards where they are many; an empty table gives no rows. Other columns are
    ignored. Very long texts are cut over windows. Neighbours of equal score come in the order of doc_id (as text), then
    of their ids. A vocabulary of more than 65,536 tokens is refused.
    """
    tune(docs.sparkSession)
    tokens = materialise(_tokens(doc_columns(docs, "doc_id", "text"), tokenizer), "token-ids")
    corpus = _corpus(tokens)
    end = np.array([end_id], "<u2")

    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "ids"], kind="stable", na_position="first")
        ids = [np.append(np.frombuffer(b, "<u2"), end) for b in pdf["ids"]]
        doc_ids = pdf["doc_id"].tolist()
        out = [(doc_ids[d], start, k, zlib.crc32(cut := ids[d][start : start + k].astype("<u4").tobytes()), len(ids[d]), (key[0] << 32) + sequence, offset, cut) for d, start, k, sequence, offset in pack_shard(ids, window, corpus)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pd.DataFrame(out, columns=names)[names if with_ids else names[:-1]]

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt(tokens, corpus).groupBy("shard").applyInPandas(pack_group, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
