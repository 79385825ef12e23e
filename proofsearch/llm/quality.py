"""Quality rules with an isolation forest on rule statistics.

Each text's rule statistics (word, symbol, line and repetition counts) are computed over the whole text.
An isolation forest, each of whose trees draws its few rows from all good ones, isolates texts by random splits of those
statistics; a short mean path marks an anomaly. Splits are drawn from a box somewhat wider than the rows', so
that a statistic which is the same in all good rows (no symbols) isolates a text that differs in it. The score
from which a text is rejected is calibrated on all labelled rows: the highest catch of rows
labelled as poor that loses at most GOOD_LOSS of the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import discard, doc_columns, fresh, materialise, tune

TREES, TREE_ROWS = 100, 256
GOOD_LOSS = 0.002
#: How far a tree's box reaches beyond its rows: a share of the sample's range, and this much at least.
PAD, LEAST_PAD = 0.1, 0.05
#: The fixed rules: fewer words, or a larger share of repeated words, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]").findall
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The statistics named in COUNTS, of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space
    if not words:
        return 0, 0, len(SYMBOLS(text)), 0, 0
    spaces = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else [raw]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first time included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]  # keeps keys small for any vocabulary
    key = pair[:-1] * len(ids) + at[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(key)] |= twice
    return int(hit.sum())


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < LEAST_WORDS) | (100 * c[:, 4] > MOST_REPEATED * c[:, 0])


def rule_statistics(c: np.ndarray) -> np.ndarray:
    """Mean word length, symbols a word, shares of repeated lines and words, log of the number of words; shares are
    drawn to usual values where words are few."""
    c = c.astype(float)
    n = c[:, 0]
    return np.column_stack([(c[:, 1] + 5 * 200) / (n + 200), np.minimum(c[:, 2] / np.maximum(n, 1), 1), c[:, 3] / (n + 50), c[:, 4] / (n + 50), np.log1p(n)])


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as flat arrays: split column (-1: leaf), split value, left child, right child, path length at the leaf."""

    trees: list[tuple[np.ndarray, ...]]
    rows: int

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 11) -> IsolationForest:
        r = np.random.default_rng(seed)
        size = min(TREE_ROWS, len(x))
        if size < 2:
            return cls([], size)
        pad = np.maximum(PAD * (x.max(axis=0) - x.min(axis=0)), LEAST_PAD)
        return cls([cls._tree(x[r.choice(len(x), size, replace=False)], pad, r) for _ in range(TREES)], size)

    @classmethod
    def grown(cls, drawn: np.ndarray, extent: np.ndarray, seed: int = 11) -> IsolationForest:
        """Of each tree's own rows; `extent` is the range of each statistic over all rows."""
        r = np.random.default_rng(seed)
        if drawn.shape[1] < 2:
            return cls([], drawn.shape[1])
        pad = np.maximum(PAD * extent, LEAST_PAD)
        return cls([cls._tree(x, pad, r) for x in drawn], drawn.shape[1])

    @staticmethod
    def _tree(x: np.ndarray, pad: np.ndarray, r: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit, nodes = int(np.ceil(np.log2(len(x)))), []

        def grow(rows: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, me, me, depth + float(_average_path(len(rows)))])
            if depth < limit and len(rows) > 1:
                column = int(r.integers(x.shape[1]))
                value = float(r.uniform(low[column], high[column]))
                left, below, above = rows[:, column] <= value, high.copy(), low.copy()
                below[column] = above[column] = value
                nodes[me][:4] = [column, value, grow(rows[left], depth + 1, low, below), grow(rows[~left], depth + 1, above, high)]
            return me

        grow(x, 0, x.min(axis=0) - pad, x.max(axis=0) + pad)
        c = list(zip(*nodes))
        return np.array(c[0]), np.array(c[1]), np.array(c[2]), np.array(c[3]), np.array(c[4])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row in (0, 1): 2 to the power of minus its mean path over the usual one."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for column, value, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := column[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(column[at], 0)] <= value[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_average_path(self.rows)), 1e-9))


@dataclass
class QualityModel:
    forest: IsolationForest
    cut: float

    def verdict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """failed the base rules, anomaly, kept."""
        failed, score = base_failed(c), self.forest.score(rule_statistics(c))
        return failed, score, ~failed & (score < self.cut)


def _drawn(rows: DataFrame) -> np.ndarray:
    """TREE_ROWS rows of (doc_id, COUNTS) for each tree, those of the smallest hash of tree and doc_id: trees by rows by
    statistics. A task hands on its own smallest, and what is collected is as large for any table."""
    seeds = np.random.default_rng(11).integers(1, 1 << 62, TREES).astype(np.uint64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, kept = np.zeros((0, TREES), np.uint64), np.zeros((0, 1 + len(COUNTS)), np.int64)
        for b in batches:
            if not len(b):
                continue
            rank = np.concatenate([rank, np.stack([pd.util.hash_array(b["doc_id"].to_numpy().view(np.uint64) ^ s) for s in seeds], axis=1)])
            kept = np.concatenate([kept, b[["doc_id", *COUNTS]].to_numpy(np.int64)])
            if len(kept) > TREE_ROWS:
                own = np.unique(np.argpartition(rank, TREE_ROWS - 1, axis=0)[:TREE_ROWS])
                rank, kept = rank[own], kept[own]
        if len(kept):
            size = min(TREE_ROWS, len(kept))
            at = np.argpartition(rank, size - 1, axis=0)[:size].T
            tree = np.repeat(np.arange(TREES), size)
            yield pd.DataFrame(dict(zip(["doc_id", *COUNTS], kept[at.reshape(-1)].T)) | {"tree": tree, "rank": rank[at.reshape(-1), tree].view(np.int64)})

    each = rows.mapInPandas(draw, ", ".join(f"{n} long" for n in ("doc_id", *COUNTS, "tree", "rank")))
    place = F.row_number().over(W.partitionBy("tree").orderBy("rank", "doc_id"))
    found = each.withColumn("place", place).where(F.col("place") <= TREE_ROWS).orderBy("tree", "place").toPandas()  # TREES times TREE_ROWS rows
    return rule_statistics(found[COUNTS].to_numpy(np.int64)).reshape(TREES, -1, 5) if len(found) else np.zeros((TREES, 0, 5))


def _nth(scores: DataFrame, n: int) -> float:
    """The n-th smallest (from 0) of positive doubles, exactly: their bits are as ordered as they are, and are counted 16 at a time."""
    bits = 0
    for shift in (48, 32, 16, 0):
        own = scores if shift == 48 else scores.where(F.shiftrightunsigned("bits", shift + 16) == bits)
        counted = own.groupBy(F.shiftrightunsigned("bits", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").toPandas()  # 65,536 rows at most
        k = int(np.searchsorted(np.cumsum(counted["n"].to_numpy()), n, "right"))
        n -= int(counted["n"].to_numpy()[:k].sum())
        bits = int(counted["b"].to_numpy()[k])
    return float(np.array([bits], np.int64).view(np.float64)[0])


def fit_rows(rows: DataFrame) -> QualityModel:
    """A forest whose trees draw from all good rows of (doc_id, good, COUNTS), and the cut that all rows' labels give."""
    kinds = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = rows.where("good")

    def box(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = rule_statistics(b[COUNTS].to_numpy(np.int64))
            if len(x):
                yield pd.DataFrame(np.stack([x.min(axis=0), x.max(axis=0)]).reshape(1, -1), columns=[f"{e}{i}" for e in ("low", "high") for i in range(5)])

    ends = good.select(*COUNTS).mapInPandas(box, ", ".join(f"{e}{i} double" for e in ("low", "high") for i in range(5)))
    r = ends.agg(*[F.min(f"low{i}") for i in range(5)], *[F.max(f"high{i}") for i in range(5)]).first()
    if r[0] is None:
        return QualityModel(IsolationForest([], 0), 1.0)
    forest = IsolationForest.grown(_drawn(good), np.array(r[5:]) - np.array(r[:5]))
    if len(kinds) < 2 or not forest.trees:
        return QualityModel(forest, 1.0)
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.score(rule_statistics(b[COUNTS].to_numpy(np.int64)))
            yield pd.DataFrame({"good": b["good"].to_numpy(bool), "score": s, "bits": s.view(np.int64)})

    scores = materialise(rows.select("good", *COUNTS).mapInPandas(score, "good boolean, score double, bits long"), "scores")
    # a row is rejected from the cut on; what is lost of good rows decides how low it may be
    floor = _nth(scores.where("good").select("bits"), int(np.ceil((kinds[True] - 1) * (1 - GOOD_LOSS))))
    least = scores.where(~F.col("good") & (F.col("score") > F.lit(floor))).agg(F.min("score")).first()[0]
    discard(scores)
    return QualityModel(forest, 1.0 if least is None else (floor + least) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model of all labelled rows that pass the base rules; a row with several labels counts as good if one says so, of rows of
    one id the one of the smallest counts is taken."""
    tune(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = np.array([counts(t) for t in b["text"]], np.int64).reshape(-1, 5)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(np.int64)} | dict(zip(COUNTS, c.T)))

    # counts travel to the labels, texts stay where they are
    counted = doc_columns(docs, "doc_id", "text").where("doc_id is not null").mapInPandas(count, ", ".join(f"{n} long" for n in ("doc_id", *COUNTS)))
    first = counted.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "c.*")
    passed = (F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words"))
    rows = materialise(first.where(passed).join(marks, "doc_id"), "labelled")
    model = fit_rows(rows)
    discard(rows)
    return model


def quality(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly, kept of every row.

    A null or wordless text has no words and fails the base rules. Without labels of both kinds the base
    rules alone decide. Each row is judged for itself, so repeated rows agree; a null doc_id is kept as it
    is. An empty table gives no rows. Other columns are ignored.
    """
    tune(docs.sparkSession)
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = np.array([counts(t) for t in b["text"]], np.int64).reshape(-1, 5)
            failed, score, kept = shared.value.verdict(c)
            yield pd.DataFrame(dict(zip(COUNTS, c.T)) | {"doc_id": b["doc_id"].to_numpy(), "base_failed": failed, "anomaly": score, "kept": kept})

    rows = doc_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    out = rows.mapInPandas(judge, "doc_id string, " + ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_good(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """`docs` without rows that the base rules or the forest reject; all columns as they were.

    Nulls, empty and wordless texts fail the base rules; repeated rows, equal or null ids fare alike, as texts alone
    decide; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.verdict(np.array([counts(t) for t in texts], np.int64).reshape(-1, 5))[2])

    name = fresh(docs, "good")
    return docs.withColumn(name, good(F.col("text").cast("string"))).where(F.col(name)).drop(name)
