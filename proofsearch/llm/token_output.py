"""Token-ID / binary output: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in the whole corpus' counts (0: the most frequent), so that the common
ones need one byte. A segment keeps the control bytes (two bits for each of four values: its number of data
bytes less one) apart from the data bytes; the decoder looks up each control byte's lengths in a numpy table
and gathers all values at once, with no loop over tokens. Ids may have up to 32 bits.

A segment file, little-endian::

    b"PSVB" u32 version | i64 part, segment, tokens before it in its part, documents, tokens
    i64 doc_id per document | u8 1 if the doc_id is null, per document | u32 tokens per document
    control bytes | data bytes | u32 crc32 of all before | b"\\n"

and `ranks/` holds the ids in rank order. Parts ascend by doc_id, segments within a part too. Files go
through Spark's own writer and reader, so any store that Spark knows will do, and a task that is run
again replaces what it wrote.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import doc_columns, materialise, shared_path, tune
from .tokens import batched, binary_rows, one_array, unit_tokenizer, values_of

MAGIC, VERSION = b"PSVB", 2
HEADER = struct.Struct("<4sI5q")
#: Tokens from which on a segment ends (at a batch's end), and of a part of the range partitioning.
SEGMENT_TOKENS, PART_TOKENS = 4_000_000, 16_000_000
END_ID = 2
#: Data bytes of a control byte's four values.
LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3).astype(np.int32) + 1
TOTALS = LENGTHS.sum(axis=1, dtype=np.int32)
#: Values that are coded at once, a multiple of four.
PART = 1 << 16


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2^32."""
    control, data = [], []
    for k in range(0, len(ranks), PART):  # parts that stay in the processor's cache
        own = ranks[k : k + PART]
        width = 2 if own.max() < 1 << 16 else 4
        raw = own.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
        more = sum(((own >= 1 << bits).astype(np.uint8) for bits in (16, 24) if width == 4), (own > 255).astype(np.uint8))
        codes = np.zeros(-(-len(own) // 4) * 4, np.uint8)
        codes[: len(own)] = more
        control.append((codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes())
        keep = np.ones((len(own), width), bool)
        for byte in range(1, width):
            keep[:, byte] = more >= byte
        data.append(raw.reshape(-1)[keep.reshape(-1)].tobytes())
    return b"".join(control), b"".join(data)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks back, by table lookup of each control byte."""
    c, raw = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    out, start = np.empty(n, np.uint32), 0
    for k in range(0, n, PART):
        size = min(PART, n - k)
        length = LENGTHS[c[k // 4 : (k + PART) // 4]].reshape(-1)[:size]
        ends = np.cumsum(length, dtype=np.int32)
        at, here = ends - length, raw[start : start + int(ends[-1])]
        part = here[at].astype(np.uint32)
        for byte in range(1, int(length.max())):
            longer = np.flatnonzero(length > byte)
            part[longer] |= here[at[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
        out[k : k + size], start = part, start + int(ends[-1])
    return out


def pack_segment(part: int, number: int, before: int, doc_ids: pa.Array, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """A segment of documents: their ids (null or not), how many tokens each has, and all tokens' ranks."""
    control, data = encode_ranks(ranks)
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    body = b"".join((HEADER.pack(MAGIC, VERSION, part, number, before, len(lengths), int(lengths.sum())), ids.tobytes(), nulls.tobytes(), lengths.astype("<u4").tobytes(), control, data))
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_segment(raw: bytes, id_of: np.ndarray) -> tuple[int, int, pa.Array, np.ndarray, np.ndarray]:
    """part, tokens before the segment in its part, doc_ids, tokens of each, all ids."""
    raw = raw[:-1] if raw.endswith(b"\n") and len(raw) > HEADER.size + 4 and zlib.crc32(memoryview(raw)[:-5]) == struct.unpack("<I", raw[-5:-1])[0] else raw
    body, crc = memoryview(raw)[:-4], struct.unpack("<I", raw[-4:])[0]
    if len(body) < HEADER.size or zlib.crc32(body) != crc:
        raise ValueError("not a whole segment of this format")
    magic, version, part, _, before, docs, tokens = HEADER.unpack_from(body)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a whole segment of this format")
    at = HEADER.size
    doc_ids = np.frombuffer(body, "<i8", docs, at)
    nulls = np.frombuffer(body, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(body, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    controls = -(-(tokens % PART) // 4) + tokens // PART * (PART // 4)
    ranks = decode_ranks(body[at : at + controls], body[at + controls :], tokens)
    return part, before, pa.array(doc_ids, mask=nulls.astype(bool)), lengths, id_of[ranks]


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID, specials: bool = False) -> DataFrame:
    """doc_id and ids (unsigned bytes) of every row; a null or empty text has the end id alone.

    Each task adds a row with its counts of ids (in `counts`; ids is null there), so no second pass counts them.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = unit_tokenizer(tokenizer, True, specials)
        total = np.zeros(max(tok.bpe.size, end_id + 1), np.int64)
        for b in batched(batches):
            flat, size = tok.flat(one_array(b["text"]), end_id)
            total += np.bincount(flat, minlength=len(total))
            yield pa.record_batch([one_array(b["doc_id"]), binary_rows(flat, size), pa.nulls(len(size), pa.binary())], schema=TOKENS)
        seen = np.flatnonzero(total)
        packed = seen.astype("<u4").tobytes() + total[seen].astype("<i8").tobytes()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], schema=TOKENS)

    return doc_columns(docs, "doc_id", "text").mapInArrow(encode, "doc_id long, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, from the rows of counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["counts"].to_pylist():
                n = len(raw) // 12
                yield pa.record_batch({"id": pa.array(np.frombuffer(raw, "<u4", n).astype(np.int64)), "n": pa.array(np.frombuffer(raw, "<i8", n, 4 * n))})

    return tokens.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS, specials: bool = False) -> None:
    """Writes every document's ids to `path`, in ascending doc_id order (null ids first, then equal ids by their tokens)."""
    spark = docs.sparkSession
    tune(spark)
    tokens = materialise(token_table(docs, tokenizer, end_id, specials), "token-ids")
    # The vocabulary bounds this
    ranked = id_counts(tokens).orderBy(F.desc("n"), "id").collect()
    id_of = np.array([r["id"] for r in ranked], "<u4")
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, "<u4")
    rank_of[id_of] = np.arange(len(id_of), dtype="<u4")
    kind = np.dtype("<u2" if unit_tokenizer(tokenizer, True, specials).bpe.size <= 1 << 16 else "<u4")
    if len(rank_of) <= 1 << 16:
        rank_of = rank_of.astype("<u2")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple] = []

        def segment() -> pa.RecordBatch:
            doc_ids, lengths, ranks = (list(x) for x in zip(*held))
            raw = pack_segment(part, number, before, pa.concat_arrays(doc_ids), np.concatenate(lengths), np.concatenate(ranks))
            return pa.record_batch({"segment": pa.array([raw], pa.binary())})

        for b in batches:
            flat, lengths = values_of(b["ids"], kind)
            held.append((b["doc_id"], lengths, rank_of[flat]))
            size += len(flat)
            if size >= segment_tokens:
                yield segment()
                number, before, size, held = number + 1, before + size, 0, []
        if held:
            yield segment()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sum(r["n"] for r in ranked) / PART_TOKENS))
    first = F.col("doc_id").asc_nulls_first()
    made = tokens.where("ids IS NOT NULL").select("doc_id", "ids").repartitionByRange(n, first).sortWithinPartitions(first, "ids").mapInArrow(segments, "segment binary")
    one = {"maxRecordsPerFile": 1}
    made.select(F.col("segment").cast("string")).write.options(**one).text(f"{path}/segments")
    spark.createDataFrame([(id_of.tobytes(),)], "ranks binary").coalesce(1).select(F.col("ranks").cast("string")).write.options(**one).text(f"{path}/ranks")


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids of every document in the files at `path`."""
    found = spark.read.format("binaryFile").load(f"{path}/ranks").select("content").collect()
    id_of = np.frombuffer(b"".join(bytes(r["content"])[:-1] for r in found), "<u4")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["content"]:
                part, before, doc_ids, lengths, ids = unpack_segment(raw.as_buffer().to_pybytes(), id_of)
                ends = np.cumsum(lengths)
                whole = memoryview(ids).cast("B")
                crc = [zlib.crc32(whole[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                out = {"part": pa.array(np.full(len(lengths), part)), "doc_id": doc_ids, "before": pa.array(before + ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.record_batch(out | {"ids": binary_rows(ids, lengths)} if with_ids else out)

    schema = "part long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = spark.read.format("binaryFile").load(f"{path}/segments").select("content").mapInArrow(decode, schema)
    rows = rows if with_ids else materialise(rows, "decoded")
    # one row for each part of the range partitioning, so this window holds few rows at any size
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = parts.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    out = rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None, specials: bool = False) -> DataFrame:
    """Writes the files and returns what they hold of each document: doc_id, start, n_tokens, ids_crc32.

    Nulls: a null text is empty (its row holds the end id alone); a null doc_id comes first. Equal
    doc_ids keep one row each, ordered by their ids. An empty table gives no rows. Very long texts are one
    row like others. Other columns are ignored. Strings of the vocabulary's special tokens are ordinary text,
    as the vocabulary's own notes say, unless `specials` is set.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    write_tokens(docs, path, tokenizer, end_id, specials=specials)
    return read_tokens(spark, path, with_ids=False)
