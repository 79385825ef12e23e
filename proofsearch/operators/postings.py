"""An inverted index in versions: postings in blocks with their greatest impact, searched with stopping bounds.

Documents are dealt by a hash of their id into shards of bounded size. Within a shard, documents with like words are
next to each other (halved again and again along the direction in which they differ most), and places are cut into
slices of SLICE documents. A row of `lists` is one term of one shard: its postings by place, cut into a block for each slice that
has any, and each block's greatest impact. A shard's rows are sorted by term, so that a search for few terms skips the
pages of others; how many documents hold a term is stored, not counted again.

A search sums a question's block impacts to a bound for each slice of a shard, opens the few greatest, and goes
through the terms, strongest first: a slice whose scores so far and bounds of the terms to come are below the
k-th best score is left, with all its blocks that are still closed. What is left can't be among the k best.
A shard's rows for the questions' terms meet in one task, whose size is bounded by the shard's. Questions of which the shard
holds the same terms have the same scores there, and are searched as one.

Sparse vectors of a segment's documents are made from its lists when a search first asks for them.

Changes are segments of their own: an update writes the new documents' shards, the places that are gone, and how
document frequencies change, so bytes written grow with the change. Each version is one row that names its
segments; compaction inverts all that is live again.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import shared_folder, stored

#: Documents of a slice; documents and characters of a shard.
SLICE, SHARD_DOCS, SHARD_CHARS = 16, 4_096, 5_000_000
#: Words, and bytes of texts, that are counted at once; a batch of rows is looked at in parts of so many, a longer document alone.
PART_WORDS, PART_BYTES = 400_000, 2_500_000
#: Features of documents that are put into buckets at once.
PAIRS = 1 << 20
#: Dimensions in which documents are compared for their order, and steps towards the direction of a cut.
DIMENSIONS, TURNS = 64, 6
#: Questions that travel to the shards at once.
QUERY_BLOCK = 16_384
#: One shard of so many is searched first, for a k-th best that the others have to reach; of many shards, one of STEP times as many before that.
SAMPLED, STEP = 8, 16
#: Terms up to which a search's filter is pushed into the scan as equalities.
PUSHED = 64
#: Scores are rounded to six places, and so may pass a bound by this much.
SLACK = 1e-6
#: Segments from which on an update compacts, and the share of places that may be gone.
MOST_SEGMENTS, MOST_DEAD = 8, 0.5

LIST = "shard int, term string, n long, reference double, places binary, tfs binary, slices binary, starts binary, tops binary"
VERSION = "version long, segments array<string>, n_docs long, n_terms long, n_places long, id_type string, batch long"


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75

    def impact(self, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / (mean or 1.0)))


# Vectors of words and their trigrams (weights as in `corpus`)

BUCKETS, WORD_WEIGHT, CHAR_WEIGHT = 2048, 1.0, 0.25


def bucket_of(feature: str) -> int:
    return int(hashlib.md5(feature.encode()).hexdigest()[:8], 16) % BUCKETS


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges that begin at `starts`."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the places they come from, equal ones as they came; keys with their places are numbers to sort where they fit."""
    bits = len(keys).bit_length()
    if len(keys) and keys.min() >= 0 and int(keys.max()) < 1 << (62 - bits):
        packed = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
        return packed >> bits, packed & ((1 << bits) - 1)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sum of each one's weights."""
    if not len(keys):
        return keys, weights
    keys, order = in_order(keys)
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(weights[order], first)


def trigrams(terms: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different trigrams of terms with a space on both sides, how many each term has, and which these are."""
    if "" not in terms and (line := "".join(f" {t} " for t in terms)).isascii():
        data, sizes = np.frombuffer(line.encode(), np.uint8).astype(np.int32), np.fromiter(map(len, terms), np.int64, len(terms))
        at = spans(np.cumsum(sizes + 2) - sizes - 2, sizes)
        codes, began, own = np.unique(data[at] << 16 | data[at + 1] << 8 | data[at + 2], return_index=True, return_inverse=True)
        order = np.argsort(began)  # as they come
        place = np.empty(len(codes), np.int32)
        place[order] = np.arange(len(codes))
        return [bytes([c >> 16, c >> 8 & 255, c & 255]).decode() for c in codes[order].tolist()], sizes, place[own]
    features: dict[str, int] = {}
    grams = [[features.setdefault(f" {t} "[i : i + 3], len(features)) for i in range(max(len(t), 1))] for t in terms]
    sizes = np.array([len(g) for g in grams], np.int64)
    return list(features), sizes, np.fromiter((g for own in grams for g in own), np.int32, int(sizes.sum()))


def hashed(row: np.ndarray, term: np.ndarray, tf: np.ndarray, terms: list[str], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and weights of sparse vectors of counted terms, by row; PAIRS features at once."""
    features, sizes, flat = trigrams(terms)
    first = np.cumsum(sizes) - sizes
    chars = np.array([bucket_of(f"c:{f}") for f in features], np.int64)
    words = np.array([bucket_of(f"w:{t}") for t in terms], np.int64)
    weight = lambda x: np.where(x >= 1, 1 + np.log(np.maximum(x, 1e-300)), x)
    order = np.argsort(row, kind="stable")
    row, term, tf = row[order], term[order], tf[order]
    ends = np.searchsorted(row, np.arange(rows), "right")  # postings up to each row's last
    filled = np.cumsum(sizes[term]) if len(term) else np.zeros(0, np.int64)
    out, begin, low = [], 0, 0
    while low < rows and len(term):
        done = int(filled[begin - 1]) if begin else 0
        high = max(low + 1, int(np.searchsorted(filled[np.maximum(ends, 1) - 1], done + PAIRS, "right")))
        end = int(ends[min(high, rows) - 1])
        r, t, n = row[begin:end], term[begin:end], tf[begin:end].astype(np.float64)
        key, many = grouped(np.repeat(r, sizes[t]) * len(features) + flat[spans(first[t], sizes[t])], np.repeat(n, sizes[t]) * CHAR_WEIGHT)
        where = np.concatenate([r * BUCKETS + words[t], key // len(features) * BUCKETS + chars[key % len(features)]])
        out.append(grouped(where, np.concatenate([weight(n * WORD_WEIGHT), weight(many)])))
        begin, low = end, high
    key, w = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0))
    return key // BUCKETS, key % BUCKETS, w


# Shards


def stemmed(words: pa.Array) -> pa.Array:
    """The stem of each word, null for those without a meaning of their own."""
    idle = pc.or_(pc.less(pc.utf8_length(words), 2), pc.is_in(words, pa.array(T.STOPWORDS)))
    return pc.if_else(idle, pa.scalar(None, pa.string()), pc.replace_substring_regex(words, T.STEM_PATTERN, r"\1"))


#: What a byte of a normalised text is to `T.WORD_PATTERN`: a letter, a digit, a mark that can stand before digits, or none.
LETTER, DIGIT, MARK = 1, 2, 4
KINDS = np.zeros(256, np.uint8)
KINDS[ord("a") : ord("z") + 1], KINDS[ord("0") : ord("9") + 1], KINDS[[ord("."), ord(",")]] = LETTER, DIGIT, MARK
#: The letter that is left of an accented one (`T.normalize`), by code point; their UTF-8 has two bytes.
BARE = np.zeros(0x800, np.uint8)
for _from, _to in zip(T.ACCENTED, T.BARE, strict=True):
    BARE[ord(_from)] = ord(_to) if _to.isascii() else 0


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each lower-case text has, and all words in a row: those of `T.WORD_PATTERN` without accents."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    two = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
    if len(two):
        bare = BARE[(data[two] & 0x1F).astype(np.int64) << 6 | data[two + 1] & 0x3F]
        two, bare = two[bare > 0], bare[bare > 0]
        data = data.copy()
        data[two] = bare
        data, ends = np.delete(data, two + 1), ends - np.searchsorted(two, ends)
    kind = KINDS[data]
    inside = (kind & (LETTER | DIGIT)) > 0
    # every text ends in a space, so a neighbour is always there and of the same text
    marks = np.flatnonzero(kind == MARK)
    marks = marks[(marks > 0) & inside[marks - 1] & (kind[marks + 1] == DIGIT)] if len(marks) else marks
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if len(marks):
        stop, going = marks + 2, np.arange(len(marks))
        while len(going := going[kind[stop[going]] == DIGIT]):
            stop[going] += 1
        # digits after a mark end the word, so that of marks with digits alone between them every second one counts
        turn = np.arange(len(marks))
        fresh = np.append(True, stop[:-1] != marks[1:])
        used = (turn - np.maximum.accumulate(np.where(fresh, turn, 0))) % 2 == 0
        begins[marks[used] + 1] = False
        inside[marks[used]] = True
        after = stop[used]
        begins[after] = inside[after] & ~np.isin(after, marks[used])
    at = np.flatnonzero(begins)
    offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
    held = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return np.diff(np.searchsorted(at, ends)), held


def alike(row: np.ndarray, term: np.ndarray, impact: np.ndarray, names: list[str], total: int) -> np.ndarray:
    """Documents in an order in which those with like words are near each other."""
    if total <= SLICE:
        return np.arange(total)
    code = np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "little") for t in names], np.int64)
    df = np.bincount(term, minlength=len(names))
    weight = impact * np.log(1 + total / np.maximum(df, 1))[term] * np.where(code & 1, 1.0, -1.0)[term]
    at = row * DIMENSIONS + ((code >> 1) % DIMENSIONS)[term]
    x = np.bincount(at, weight, total * DIMENSIONS).reshape(total, DIMENSIONS)
    done, todo = [], [np.arange(total)]
    while todo:
        own = todo.pop()
        if len(own) <= SLICE:
            done.append(own)
            continue
        y = x[own] - x[own].mean(axis=0)
        v = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(TURNS):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        own = own[np.argsort(y @ v, kind="stable")]
        half = max(1, len(own) // SLICE // 2) * SLICE
        todo += [own[half:], own[:half]]
    return np.concatenate(done)


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each run of `sizes` values."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def listed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def mixed_schema(id_type: str) -> str:
    return f"kind string, {LIST}, place int, document_id {id_type}, n_terms long"


def vector_schema(id_type: str) -> str:
    return f"shard int, place int, document_id {id_type}, n_terms long, buckets array<int>, weights array<double>"


def arrow_schema(id_type: str) -> pa.Schema:
    ids = pa.string() if id_type == "string" else pa.int64()
    held = [("kind", pa.string()), ("shard", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("reference", pa.float64())]
    held += [(c, pa.binary()) for c in ("places", "tfs", "slices", "starts", "tops")]
    return pa.schema([*held, ("place", pa.int32()), ("document_id", ids), ("n_terms", pa.int64())])


def parted(batches: Iterator[pa.RecordBatch], sizes, most: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most `most` by the sizes of their rows; a row of more is a part alone."""
    for b in batches:
        ends, low = np.cumsum(sizes(b)), 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
            yield b.slice(low, high - low)
            low = high


def tallied(b: pa.RecordBatch, sizes: np.ndarray, words: pa.Array, id_kind: pa.DataType) -> pa.RecordBatch:
    """(shard, document_id, words: different stems, counts) of a batch whose rows have `sizes` of the `words`."""
    coded = pc.dictionary_encode(words)
    stems = pc.dictionary_encode(stemmed(coded.dictionary))
    lut = pc.fill_null(stems.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = lut[coded.indices.to_numpy()] if len(lut) else np.zeros(0, np.int64)
    row, many = np.repeat(np.arange(b.num_rows), sizes)[term >= 0], max(len(stems.dictionary), 1)
    key = np.sort(row * many + term[term >= 0])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, n = key[first], np.diff(np.append(first, len(key)))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(key // many, minlength=b.num_rows))]).astype(np.int32))
    held = stems.dictionary.take(pa.array(key % many))
    return pa.record_batch([b["shard"], b["document_id"].cast(id_kind), pa.ListArray.from_arrays(ends, held), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))], names=["shard", "document_id", "words", "counts"])


def counted(rows: DataFrame, id_type: str) -> DataFrame:
    """(shard, document_id, words: different stems, counts) of raw words, or of lower-case texts where rows have `low`, so that each
    term of a document is dealt once."""
    ids, cuts = pa.string() if id_type == "string" else pa.int64(), "low" in rows.columns
    held = lambda f, c: pc.fill_null(f(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cuts:
            for b in parted(batches, lambda b: held(pc.binary_length, b["low"]), PART_BYTES):
                yield tallied(b, *cut(b["low"]), ids)
            return
        for b in parted(batches, lambda b: held(pc.list_value_length, b["words"]), PART_WORDS):
            yield tallied(b, held(pc.list_value_length, b["words"]), b["words"].flatten(), ids)

    return rows.select("shard", "document_id", "low" if cuts else "words").mapInArrow(count, f"shard int, document_id {id_type}, words array<string>, counts array<bigint>")


def inverted(rows: DataFrame, id_type: str, params: Bm25) -> DataFrame:
    """Lists and documents of each shard of (shard, document_id, words: different terms, counts)."""
    schema = arrow_schema(id_type)

    def invert(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        table = table.select(["document_id", "words", "counts"]).sort_by("document_id").combine_chunks()
        words, total = table["words"].combine_chunks(), table.num_rows
        if isinstance(words, pa.ChunkedArray):
            words = words.chunk(0)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        up = pc.sort_indices(coded.dictionary)
        names, lut = coded.dictionary.take(up).to_pylist(), np.empty(len(up), np.int64)
        lut[up.to_numpy()] = np.arange(len(up))
        term = lut[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(total), sizes)
        tf = table["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        length = np.bincount(row, tf, total).astype(np.int64)
        reference = float(length.mean()) if total else 0.0
        impact = params.impact(tf.astype(np.float64), length[row].astype(np.float64), reference)
        order = alike(row, term, impact, names, total)
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        moved = np.argsort(term * total + place[row], kind="stable")
        term, row, tf, impact, length, ids = term[moved], place[row][moved], tf[moved], impact[moved], length[order], table["document_id"].combine_chunks().take(pa.array(order))
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        part = row // SLICE
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        many, blocks = np.bincount(term, minlength=len(names)), np.bincount(term[first], minlength=len(names))
        began = np.cumsum(many) - many
        columns = {
            "kind": pa.array(["list"] * len(names) + ["doc"] * total, pa.string()),
            "shard": pa.array(np.full(len(names) + total, shard, np.int32)),
        }
        lists = {
            "term": pa.array(names, pa.string()), "n": pa.array(many.astype(np.int64)), "reference": pa.array(np.full(len(names), reference)),
            "places": packed(row.astype(np.int32), many), "tfs": packed(tf.astype(np.int32), many), "slices": packed(part[first].astype(np.int32), blocks),
            "starts": packed((first - began[term[first]]).astype(np.int32), blocks), "tops": packed(np.maximum.reduceat(impact, first) if len(first) else impact, blocks),
        }
        documents = {"place": pa.array(np.arange(total, dtype=np.int32)), "document_id": ids, "n_terms": pa.array(length)}
        for f in schema:
            if f.name not in columns:
                a, b = lists.get(f.name, pa.nulls(len(names), f.type)), documents.get(f.name, pa.nulls(total, f.type))
                b = b.chunk(0) if isinstance(b, pa.ChunkedArray) else b
                columns[f.name] = pa.concat_arrays([a.cast(f.type), b.cast(f.type)])
        return pa.table([columns[f.name] for f in schema], schema=schema)

    return rows.groupBy("shard").applyInArrow(invert, mixed_schema(id_type))


def opened(lists: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of `lists`, place and count of each posting."""
    flat = lambda c: np.frombuffer(b"".join(v.as_buffer() for v in lists[c].combine_chunks()), np.int32)
    places = flat("places")
    return np.repeat(np.arange(lists.num_rows), pc.binary_length(lists["places"]).to_numpy() // 4), places, flat("tfs") if "tfs" in lists.column_names else places


def hashed_shards(lists: DataFrame, documents: DataFrame, id_type: str) -> DataFrame:
    """The sparse vectors of each shard's documents, from its lists."""
    ids = pa.string() if id_type == "string" else pa.int64()

    def weigh(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("place")
        term, place, tf = opened(left)
        at, bucket, w = hashed(place.astype(np.int64), term, tf.astype(np.int64), left["term"].to_pylist(), right.num_rows)
        held = np.bincount(at, minlength=right.num_rows)
        columns = [pa.array(np.full(right.num_rows, key[0].as_py(), np.int32)), right["place"], right["document_id"].cast(ids), right["n_terms"], listed(bucket.astype(np.int32), held), listed(w, held)]
        return pa.table(columns, names=["shard", "place", "document_id", "n_terms", "buckets", "weights"])

    own = lists.select("shard", "term", "places", "tfs").groupBy("shard")
    return own.cogroup(documents.select("shard", "place", "document_id", "n_terms").groupBy("shard")).applyInArrow(weigh, vector_schema(id_type))


# Versions


@dataclass(frozen=True)
class Postings:
    """One version of an index under `path`."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[str, ...]
    n_docs: int
    n_terms: int
    n_places: int
    id_type: str
    params: Bm25 = Bm25()
    batch: int = -1

    @property
    def mean(self) -> float:
        return self.n_terms / self.n_docs if self.n_docs else 0.0

    def _all(self, part: str, schema: str) -> DataFrame:
        read = lambda k, s: self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{part}").withColumn("segment", F.lit(k))
        return reduce(DataFrame.unionByName, [read(k, s) for k, s in enumerate(self.segments)])

    def lists(self) -> DataFrame:
        return self._all("shards", f"{LIST}, kind string").where("kind = 'list'").drop("kind")

    def _documents(self) -> DataFrame:
        kept = f"shard int, place int, document_id {self.id_type}, n_terms long, kind string"
        return self._all("shards", kept).where("kind = 'doc'").drop("kind")

    def _vectors(self) -> DataFrame:
        """All documents with their vectors, which a segment gets when they are first asked for."""
        for name in self.segments:
            at = f"{self.path}/{name}/vectors"
            if not _exists(self.spark, f"{at}/_SUCCESS"):
                one = replace(self, segments=(name,))
                _write(hashed_shards(one.lists(), one._documents(), self.id_type), at)
        return self._all("vectors", vector_schema(self.id_type))

    def dead(self) -> DataFrame:
        """(segment, shard, place) of documents that are gone; `segment` counts within this version."""
        names = F.array(*map(F.lit, self.segments))
        rows = self._all("dead", "name string, shard int, place int").drop("segment")
        return rows.select((F.array_position(names, F.col("name")) - 1).cast("int").alias("segment"), "shard", "place")

    def _live(self, all_: DataFrame) -> DataFrame:
        return all_ if len(self.segments) == 1 else all_.join(self.dead(), ["segment", "shard", "place"], "left_anti")

    def places(self) -> DataFrame:
        """(segment, shard, place, document_id, n_terms) of live documents."""
        return self._live(self._documents())

    def documents(self) -> DataFrame:
        """(segment, shard, place, document_id, n_terms, buckets, weights) of live documents."""
        return self._live(self._vectors())

    def vectors(self) -> DataFrame:
        return self.documents().select("document_id", "buckets", "weights")

    def terms(self) -> DataFrame:
        """(term, df), summed over the segments' changes."""
        own = self._all("terms", "term string, df long").select("term", "df")
        return own if len(self.segments) == 1 else own.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def shards(self) -> DataFrame:
        """(segment, shard, ids, lengths, gone) of each shard; a group is bounded by a shard's size."""
        own = self._documents().groupBy("segment", "shard").agg(F.sort_array(F.collect_list(F.struct("place", "document_id", "n_terms"))).alias("d"))
        own = own.select("segment", "shard", F.col("d.document_id").alias("ids"), F.col("d.n_terms").alias("lengths"))
        if len(self.segments) == 1:
            return own.withColumn("gone", F.array().cast("array<int>"))
        gone = self.dead().groupBy("segment", "shard").agg(F.collect_list("place").alias("gone"))
        return own.join(gone, ["segment", "shard"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))

    def held_by(self, only: DataFrame) -> DataFrame:
        """(term, df): how many of the places `only` (segment, shard, place) hold each term; no posting becomes a row."""

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            row, place, _ = opened(left)
            among = np.zeros(max(int(place.max(initial=-1)), int(pc.max(right["place"]).as_py())) + 1 if right.num_rows else 0, bool)
            among[right["place"].to_numpy()] = True
            df = np.bincount(row[among[place]] if len(among) else row[:0], minlength=left.num_rows)
            return pa.table([left["term"].combine_chunks().filter(pa.array(df > 0)), pa.array(df[df > 0].astype(np.int64))], names=["term", "df"])

        own = self.lists().join(F.broadcast(only.select("segment", "shard").distinct()), ["segment", "shard"], "left_semi").select("segment", "shard", "term", "places")
        by = ("segment", "shard")
        return own.groupBy(*by).cogroup(only.select("segment", "shard", "place").groupBy(*by)).applyInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))

    def forward(self) -> DataFrame:
        """(document_id, words, counts) of live documents, from their postings."""
        chosen = self.places().select("segment", "shard", "place", "document_id")

        def open_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [len(v.as_buffer()) // 4 for v in b["places"]]
                rows = np.repeat(np.arange(b.num_rows), n)
                flat = lambda c: np.frombuffer(b"".join(v.as_py() for v in b[c]), np.int32)  # noqa: B023, E731
                yield pa.record_batch([*[b[c].take(pa.array(rows)) for c in ("segment", "shard", "term")], pa.array(flat("places")), pa.array(flat("tfs"))], names=["segment", "shard", "term", "place", "tf"])

        opened = self.lists().select("segment", "shard", "term", "places", "tfs").mapInArrow(open_lists, "segment int, shard int, term string, place int, tf int")
        # at most a document's different words a group
        held = opened.join(chosen, ["segment", "shard", "place"]).groupBy("document_id").agg(F.collect_list(F.struct("term", "tf")).alias("t"))
        full = chosen.select("document_id").join(held, "document_id", "left")
        return full.select("document_id", F.coalesce("t.term", F.array().cast("array<string>")).alias("words"), F.coalesce("t.tf", F.array().cast("array<int>")).cast("array<bigint>").alias("counts"))


def _write(df: DataFrame, path: str, *by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, without a Python worker to make them."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _segment(spark: SparkSession, path: str, rows: DataFrame, id_type: str, params: Bm25, less: DataFrame | None = None, dead: DataFrame | None = None) -> tuple[str, int, int]:
    """Writes a segment of (shard, document_id, words, counts) under a new name; the name, documents and terms of it."""
    name = f"segment-{uuid.uuid4().hex}"
    at = f"{path}/{name}"
    _write(inverted(rows, id_type, params), f"{at}/shards", "kind")
    mixed = spark.read.schema(mixed_schema(id_type)).parquet(f"{at}/shards")
    df = mixed.where("kind = 'list'").groupBy("term").agg(F.sum("n").alias("df"))
    _write((df if less is None else df.unionByName(less)).sort("term"), f"{at}/terms")
    _write(dead if dead is not None else _empty(spark, "name string, shard int, place int"), f"{at}/dead")
    held = mixed.where("kind = 'doc'").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()
    return name, held["n"], held["t"]


def _committed(p: Postings) -> Postings:
    row = (p.version, list(p.segments), p.n_docs, p.n_terms, p.n_places, p.id_type, p.batch)
    _write(p.spark.createDataFrame([row], VERSION).coalesce(1), f"{p.path}/versions/at={p.version:012d}")
    return p


def _dealt(rows: DataFrame, n: int, chars: int) -> DataFrame:
    shards = max(1, math.ceil(n / SHARD_DOCS), math.ceil(chars / SHARD_CHARS))
    return rows.withColumn("shard", F.pmod(F.xxhash64("document_id"), F.lit(shards)).cast("int"))


def _size(documents: DataFrame) -> tuple[int, int]:
    """Number of texts, and their characters."""
    r = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    return r["n"], r["c"]


def _texts(documents: DataFrame, size: tuple[int, int]) -> tuple[DataFrame, str]:
    """Counted terms of documents, of that size at most, dealt into shards, and the type of their ids."""
    id_type = "string" if dict(documents.dtypes)["document_id"] == "string" else "bigint"
    rows = documents.select(F.col("document_id").cast(id_type).alias("document_id"), F.lower("text").alias("low"))
    return counted(_dealt(rows, *size), id_type), id_type


def build(documents: DataFrame, path: str | None = None, params: Bm25 | None = None) -> Postings:
    """The first version of an index of documents (document_id, text), whose ids are different; a null text has no words."""
    spark, params = documents.sparkSession, params or Bm25()
    if path is None:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    rows, id_type = _texts(documents, _size(documents))
    name, n, terms = _segment(spark, path, rows, id_type, params)
    return _committed(Postings(spark, path, 0, (name,), n, terms, n, id_type, params))


def latest(spark: SparkSession, path: str, params: Bm25 | None = None) -> Postings:
    """The newest version under a path."""
    r = spark.read.schema(VERSION).parquet(f"{path}/versions").orderBy(F.desc("version")).first()
    return Postings(spark, path, r["version"], tuple(r["segments"]), r["n_docs"], r["n_terms"], r["n_places"], r["id_type"], params or Bm25(), r["batch"])


def updated(index: Postings, gone: DataFrame | None, new: DataFrame | None, batch: int = -1, compacts: bool = True, size: tuple[int, int] | None = None) -> Postings:
    """The next version: without the documents `gone` (document_id), and with `new` ones (document_id, text), which replace those of their id.

    Of new rows of one id the greatest text stays. Ids that aren't there are passed over. What is written is the new
    documents' segment, the places that are gone and the terms whose frequency changes. `size` is that of `new` or more,
    where it is known.
    """
    spark, id_type = index.spark, index.id_type
    fresh = _empty(spark, f"document_id {id_type}, text string")
    if new is not None:
        fresh = new.select(F.col("document_id").cast(id_type).alias("document_id"), "text").groupBy("document_id").agg(F.max("text").alias("text"))
    out = fresh.select("document_id")
    if gone is not None:
        out = out.unionByName(gone.select(F.col("document_id").cast(id_type).alias("document_id"))).distinct()
    leaving = index.places().join(out, "document_id", "left_semi").select("segment", "shard", "place", "n_terms")
    scratch = f"{index.path}/scratch-{uuid.uuid4().hex}"
    _write(leaving, scratch)
    leaving = spark.read.schema("segment int, shard int, place int, n_terms long").parquet(scratch)
    lost = leaving.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()
    names = F.array(*map(F.lit, index.segments))
    dead = leaving.select(F.element_at(names, F.col("segment") + 1).alias("name"), "shard", "place")
    less = None
    if lost["n"]:
        less = index.held_by(leaving).select("term", (-F.col("df")).alias("df"))
    rows, _ = _texts(fresh, size or ((0, 0) if new is None else _size(new)))
    name, n, terms = _segment(spark, index.path, rows, id_type, index.params, less, dead)
    after = replace(index, version=index.version + 1, segments=(*index.segments, name), n_docs=index.n_docs - lost["n"] + n, n_terms=index.n_terms - lost["t"] + terms, n_places=index.n_places + n, batch=batch)
    _remove(spark, scratch)
    if compacts and (len(after.segments) > MOST_SEGMENTS or after.n_docs < (1 - MOST_DEAD) * after.n_places):
        return compacted(after)
    return _committed(after)


def compacted(index: Postings) -> Postings:
    """The same documents in one segment, from their postings; texts aren't read."""
    rows = _dealt(index.forward(), index.n_docs, 6 * index.n_terms)
    name, n, terms = _segment(index.spark, index.path, rows, index.id_type, index.params)
    return _committed(replace(index, version=index.version + 1, segments=(name,), n_docs=n, n_terms=terms, n_places=n))


def follow(changes: DataFrame, path: str, checkpoint: str):
    """A streaming writer that brings a stream of changes (document_id, text, removed) into the index at `path`.

    Each micro-batch is one version, which bears the batch's number: a batch that is run again after a loss is passed over.
    Within a batch the last word on an id is its removal, else its greatest text.
    """

    def apply(batch: DataFrame, number: int) -> None:
        index = latest(batch.sparkSession, path)
        if index.batch >= number:
            return
        removed = batch.where("removed").select("document_id").distinct()
        added = batch.where("not removed").select("document_id", "text").join(removed, "document_id", "left_anti")
        # the size is read off the batch, so that its texts move once, with their removals
        updated(index, removed, added, number, size=_size(batch.where("not removed")))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


# Search


def gather(lists: list[tuple], open_: np.ndarray, scores: np.ndarray) -> int:
    """Adds the impacts in open slices to the scores; the number of blocks opened."""
    opened = 0
    for weight, place, impact, slices, starts, sizes, _ in lists:
        own = np.flatnonzero(open_[slices])
        if len(own) == len(slices):
            scores[place] += weight * impact
        elif len(own):
            p = spans(starts[own], sizes[own])
            scores[place[p]] += weight * impact[p]
        opened += len(own)
    return opened


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th greatest score, none if there are fewer."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0.0


FOUND = "query_id {}, document_id {}, score double, blocks long, opened long"


def search(asked: DataFrame, index: Postings, k: int | None, meters: bool = True) -> DataFrame:
    """(query_id, document_id, score, blocks, opened) of (query_id, term): the k best of each question in each shard, or all
    that share a term; what is behind the k-th best of the shards searched before may be left out. With `meters`, a row without a document
    says how many blocks a shard has for a question, and how many were opened."""
    asked = asked.select("query_id", "term").distinct()
    names = asked.select("query_id").distinct()
    n = names.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    # the stated set of questions in blocks, each of a size that a task can hold
    parts = [asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]
    return reduce(DataFrame.unionByName, [_search(p, index, k, meters) for p in parts])


def _search(asked: DataFrame, index: Postings, k: int | None, meters: bool) -> DataFrame:
    spark, query_type = index.spark, "string" if dict(asked.dtypes)["query_id"] == "string" else "bigint"
    schema = FOUND.format(query_type, index.id_type)
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    idf = F.ln(1 + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # QUERY_BLOCK questions' terms
    rows = asked.join(index.terms(), "term").select("query_id", "term", idf.alias("idf")).orderBy("query_id", "term").toPandas()
    if not len(rows):
        return spark.createDataFrame([], schema)
    questions, first = np.unique(rows["query_id"].to_numpy(), return_index=True)
    wanted = sorted(set(rows["term"]))
    codes = np.searchsorted(wanted, rows["term"]).astype(np.int32)
    held = spark.sparkContext.broadcast((questions.tolist(), np.append(first, len(rows)), rows["idf"].to_numpy(np.float64), codes, wanted))
    params, mean, id_kind, query_kind = index.params, index.mean, kinds[index.id_type], kinds[query_type]

    def meet(left: pa.Table, right: pa.Table, low: np.ndarray, last: list) -> pa.Table:
        names, ends, idfs, codes, wanted = held.value
        if not right.num_rows or not left.num_rows:
            return pa.table([pa.nulls(0, f) for f in (query_kind, id_kind, pa.float64(), pa.int64(), pa.int64())], names=["query_id", "document_id", "score", "blocks", "opened"])
        ids = right["ids"].combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        lengths = np.array(right["lengths"][0].as_py(), np.float64)
        total = len(lengths)
        rank = np.empty(total, np.int64)  # ties go to the smaller id
        up = pc.sort_indices(ids)
        rank[up.to_numpy()] = np.arange(total)
        ordered = ids.take(up).to_pylist()
        gone = np.zeros(total, bool)
        gone[np.array(right["gone"][0].as_py(), np.int64)] = True
        norm = params.k1 * (1 - params.b + params.b * lengths / (mean or 1.0))
        lists = {}
        for row in left.select(["term", "reference", "places", "tfs", "slices", "starts", "tops"]).to_pylist():
            tf = np.frombuffer(row["tfs"], np.int32).astype(np.float64)
            place = np.frombuffer(row["places"], np.int32)
            starts = np.frombuffer(row["starts"], np.int32).astype(np.int64)
            # impacts grow with the mean length, by no more than its ratio
            factor = max(1.0, mean / row["reference"]) if row["reference"] else 1.0
            lists[row["term"]] = (place, tf * (params.k1 + 1) / (tf + norm[place]), np.frombuffer(row["slices"], np.int32), starts, np.append(starts[1:], len(tf)) - starts, np.frombuffer(row["tops"]) * factor)
        parts = -(-total // SLICE)
        out_q, out_p, out_s, metered = [], [], [], []
        top = np.array([lists[t][5].max() if t in lists else 0.0 for t in wanted])
        most = np.add.reduceat(idfs * top[codes], ends[:-1])
        here = np.array([t in lists for t in wanted])[codes]
        at, terms = np.append(0, np.cumsum(here))[ends].tolist(), codes[here]
        # questions of which the shard holds the same terms
        alike: dict[bytes, list[int]] = {}
        for j in np.flatnonzero(most > 0 if meters else (most > 0) & (most + SLACK >= low)).tolist():
            alike.setdefault(terms[at[j] : at[j + 1]].tobytes(), []).append(j)
        weights = idfs[here]
        for same in alike.values():
            js, lowest = np.array(same), low[same].min()
            own = [(weights[i], *lists[wanted[terms[i]]]) for i in range(at[same[0]], at[same[0] + 1])]
            blocks = sum(len(o[3]) for o in own)
            if k is None:
                opened = blocks
                scores = np.zeros(total)
                for w, place, impact, *_ in own:
                    scores[place] += w * impact
                best = np.flatnonzero((scores > 0) & ~gone)
                values = np.round(scores[best], 6)
            else:
                bound = np.zeros(parts)
                for w, _, _, slices, _, _, tops in own:
                    bound[slices] += w * tops
                if bound.max() + SLACK < lowest:
                    metered += [(j, blocks, 0) for j in same]
                    continue
                padded = np.zeros(parts * SLICE)
                grid = padded.reshape(parts, SLICE)
                # the slices of the greatest bounds first, so that there is a score to reach
                lead = np.argpartition(-bound, min(k // 4 + 2, parts - 1))[: k // 4 + 3]
                open_ = np.zeros(parts, bool)
                open_[lead] = True
                opened = gather(own, open_, padded)
                padded[:total][gone] = 0
                floor = max(lowest, kth(grid[lead].ravel(), k))
                # then the terms, strongest first and more at a time; a slice is left as soon as it can't reach that any more
                open_ = ~open_ & (bound > 0)
                own.sort(key=lambda o: -o[0] * o[6].max())
                turn = 0
                while turn < len(own):
                    open_ &= bound + grid.max(axis=1) + SLACK >= floor
                    now = own[turn : turn + max(2, turn // 2)]
                    opened += gather(now, open_, padded)
                    for w, _, _, slices, _, _, tops in now:
                        bound[slices] -= w * tops
                    padded[:total][gone] = 0
                    floor = max(floor, kth(padded, k))
                    turn += len(now)
                open_ &= grid.max(axis=1) + SLACK >= floor
                open_[lead] = True
                values = np.where(np.repeat(open_, SLICE), padded, 0)[:total]
                best = np.flatnonzero((values > 0) & (values + SLACK >= lowest))
                values = np.round(values[best], 6)
                keep = np.lexsort((rank[best], -values))[:k]
                best, values = best[keep], values[keep]
            # what is not behind the k-th best that a question has already
            within = np.array([total if last[j] is None else bisect_right(ordered, last[j]) for j in same])
            row, place = np.nonzero((values > low[js, None]) | ((values == low[js, None]) & (rank[best] < within[:, None])))
            out_q.append(js[row])
            out_p.append(best[place])
            out_s.append(values[place])
            metered += [(j, blocks, opened) for j in same]
        if not meters:
            metered = []
        q = np.concatenate([*out_q, np.array([m[0] for m in metered], np.int64)]).astype(np.int64)
        found = sum(map(len, out_p))
        documents = pa.concat_arrays([ids.take(pa.array(np.concatenate([*out_p, np.zeros(0, np.int64)]).astype(np.int64))), pa.nulls(len(metered), id_kind)])
        column = lambda values, kind: pa.concat_arrays([pa.nulls(found, kind), pa.array(values, kind)])
        return pa.table(
            [pa.array(names, query_kind).take(pa.array(q)), documents, pa.concat_arrays([pa.array(np.concatenate([*out_s, np.zeros(0)])), pa.nulls(len(metered), pa.float64())]), column([m[1] for m in metered], pa.int64()), column([m[2] for m in metered], pa.int64())],
            names=["query_id", "document_id", "score", "blocks", "opened"],
        )

    lists = index.lists()
    if len(wanted) <= PUSHED:
        lists = lists.where(reduce(lambda a, b: a | b, [F.col("term") == t for t in wanted]))
    else:
        # QUERY_BLOCK questions' terms; without the broadcast, all lists would be shuffled by term
        lists = lists.join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string")), "term", "left_semi")

    def met(chosen, known: dict) -> DataFrame:
        floors = [known.get(q) for q in questions.tolist()]
        shared = spark.sparkContext.broadcast((np.array([-np.inf if f is None else f[0] for f in floors]), [f and f[1] for f in floors]))
        own, other = (df.where(chosen).groupBy("segment", "shard") for df in (lists, index.shards()))
        return own.cogroup(other).applyInArrow(lambda left, right: meet(left, right, *shared.value), schema)

    shards = index.n_places / SHARD_DOCS
    if k is None or shards < SAMPLED:
        return met(F.lit(True), {})
    # with the k-th best of some shards, most blocks of the others stay closed, and little of what they find is given out
    one_of = lambda n: F.pmod(F.xxhash64("segment", "shard"), F.lit(n)) == 0
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))
    steps = [SAMPLED]
    while shards / steps[0] / STEP >= SAMPLED:
        steps.insert(0, steps[0] * STEP)
    found, known, before = [], {}, F.lit(False)
    for n in steps:
        found.append(stored(met(one_of(n) & ~before, known), "sample"))
        last = reduce(DataFrame.unionByName, found).where("document_id is not null").withColumn("r", place).where(F.col("r") == k)
        known = {r["query_id"]: (r["score"], r["document_id"]) for r in last.collect()}  # a row for each question of a block
        before = one_of(n)
    return reduce(DataFrame.unionByName, [*found, met(~before, known)])


def scores(asked: DataFrame, index: Postings, k: int | None = None) -> DataFrame:
    """(query_id, document_id, score): the k best of each question (query_id, term), ties to the smaller document, or all."""
    found = search(asked, index, k, meters=False).where("document_id is not null").select("query_id", "document_id", "score")
    if k is None:
        return found
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def opened_share(asked: DataFrame, index: Postings, k: int) -> DataFrame:
    """(query_id, blocks, opened): blocks of a question's terms, and those that the search for its k best opened."""
    return search(asked, index, k).where("document_id is null").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("opened").alias("opened"))
