"""From documents to what retrieval reads: passages, an index of postings and hashed vectors, titles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import postings
from .postings import BUCKETS, CHAR_WEIGHT, WORD_WEIGHT

#: Weight of a pair of words in the hashed vectors, if asked for.
BIGRAM_WEIGHT = 0.7


def passages(documents: DataFrame, max_tokens: int = 120) -> DataFrame:
    """(document_id, ordinal, passage_id, text): sentences packed into chunks; the whole text if that gives none."""
    chunks = T.chunk_text(F.col("text"), max_tokens)
    chunks = F.when(F.size(chunks) > 0, chunks).otherwise(F.array(F.trim("text")))
    out = documents.select("document_id", F.posexplode(chunks).alias("ordinal", "text")).where("text <> ''")
    return out.select("document_id", "ordinal", F.concat(F.col("document_id").cast("string"), F.lit("#"), F.col("ordinal").cast("string")).alias("passage_id"), "text")


def term_rows(documents: DataFrame, *keep: str) -> DataFrame:
    """A row for each content word."""
    raw = documents.select(*keep, F.explode(T.words(F.col("text"))).alias("w")).where(T.is_content(F.col("w")))
    return raw.select(*keep, T.stem(F.col("w")).alias("term"))


@dataclass(frozen=True)
class Index:
    """What searches read of a corpus: a version of its postings, with the documents' hashed vectors."""

    held: postings.Postings

    @property
    def spark(self):
        return self.held.spark

    @property
    def vectors(self) -> DataFrame:
        return self.held.vectors()


def counted_terms(documents: DataFrame) -> DataFrame:
    """(document_id, term, n): content words of each document, counted. Words are counted before they are stemmed."""
    raw = documents.select("document_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("document_id", "w").agg(F.count(F.lit(1)).alias("n"))
    kept = raw.where(T.is_content(F.col("w"))).select("document_id", T.stem(F.col("w")).alias("term"), "n")
    return kept.groupBy("document_id", "term").agg(F.sum("n").alias("n"))


def counted_words(documents: DataFrame) -> DataFrame:
    """(document_id, words, counts): different content words of each document, whose rows meet once; words never become rows."""
    id_type = "string" if dict(documents.dtypes)["document_id"] == "string" else "bigint"
    own = documents.select(F.col("document_id").cast(id_type).alias("document_id"), T.words(F.col("text")).alias("words"))
    own = own.groupBy("document_id").agg(F.flatten(F.collect_list("words")).alias("words")).withColumn("shard", F.lit(0))
    return postings.counted(own, id_type).drop("shard")


def build_index(documents: DataFrame) -> Index:
    """Postings and vectors of documents (document_id, text), each read once."""
    return Index(postings.build(documents.select("document_id", "text")))


def refreshed(index: Index, gone: DataFrame | None, new: DataFrame | None) -> Index:
    """The next version of an index: without the documents `gone` (document_id) and with `new` ones, which replace those of
    their id. Only the new texts are read, and what is written grows with the change."""
    return Index(postings.updated(index.held, gone, new))


def as_index(corpus: DataFrame | Index) -> Index:
    """An index as it is; one is built of documents."""
    return corpus if isinstance(corpus, Index) else build_index(corpus)


def bucket(feature: Column) -> Column:
    """A hash bucket that SQL engines agree on."""
    return (F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def hashed_features(documents: DataFrame) -> DataFrame:
    """(document_id, bucket, w): a sparse non-negative vector over words and their trigrams.

    A feature weighs its base times 1 + ln of its weighted count where that is one or more, else the count;
    features that share a bucket add up.
    """
    counted = counted_words(documents)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = pc.dictionary_encode(b["words"].flatten())
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["words"]).to_numpy().astype(np.int64))
            at, held, w = postings.hashed(row, coded.indices.to_numpy().astype(np.int64), b["counts"].flatten().to_numpy(), coded.dictionary.to_pylist(), b.num_rows)
            yield pa.record_batch([b["document_id"].take(pa.array(at)), pa.array(held.astype(np.int32)), pa.array(w)], names=["document_id", "bucket", "w"])

    kind = dict(documents.dtypes)["document_id"]
    found = counted.mapInArrow(weigh, f"document_id {dict(counted.dtypes)['document_id']}, bucket int, w double")
    return found.withColumn("document_id", F.col("document_id").cast(kind))


def vector(rows: DataFrame) -> DataFrame:
    """Hashed vectors of (document_id, term) rows."""
    return weighed(rows.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("n")))


def weighed(counts: DataFrame, bigrams: DataFrame | None = None) -> DataFrame:
    """Hashed vectors of counted terms (document_id, term, n), and of counted pairs of words where such are given."""
    words = counts.select("document_id", F.concat(F.lit("w:"), "term").alias("feature"), (F.col("n") * WORD_WEIGHT).alias("tf"))
    chars = counts.select("document_id", F.explode(T.char_features(F.col("term"))).alias("c"), "n").groupBy("document_id", F.concat(F.lit("c:"), "c").alias("feature")).agg((F.sum("n") * CHAR_WEIGHT).alias("tf"))
    rows = words.unionByName(chars)
    if bigrams is not None:
        rows = rows.unionByName(bigrams.select("document_id", F.concat(F.lit("b:"), "term").alias("feature"), (F.col("n") * BIGRAM_WEIGHT).alias("tf")))
    weight = F.when(F.col("tf") >= 1, 1 + F.ln("tf")).otherwise(F.col("tf"))
    return rows.select("document_id", bucket(F.col("feature")).alias("bucket"), weight.alias("w")).groupBy("document_id", "bucket").agg(F.sum("w").alias("w"))


def counted_bigrams(documents: DataFrame) -> DataFrame:
    """(document_id, term, n): pairs of content words in a row."""
    w = documents.select("document_id", T.content_words(F.col("text")).alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    return w.select("document_id", F.explode(pairs).alias("term")).groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("n"))


def titles(documents: DataFrame) -> DataFrame:
    """(document_id, key, n): title words, where the title can be cited."""
    key = T.title_key(F.col("title"))
    return documents.select("document_id", key.alias("key")).where(F.size("key") > 0).select("document_id", "key", F.size("key").alias("n"))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|title)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))
