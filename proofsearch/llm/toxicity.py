"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - theta_k), with one weight vector for all thresholds theta_0 < theta_1 < ...
and the expected severity sum_k P(grade > k). Features are hashed words and word beginnings, present or
not, as far as they tell the labels apart. Grades: 0 for rows labelled clean; rows labelled toxic are graded
1 to 3 by how many features they have that the labels mark as toxic, cut at the sample's terciles.

The model is fitted on a bounded sample of labelled rows: the SAMPLE_DOCS with the smallest hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, doc_columns, fresh, materialise, tune

SAMPLE_DOCS = 16_000
HASH_BITS = 20
#: Word beginnings that are features besides whole words.
BEGINNINGS = (3, 4, 5, 6)
GRADES = 3
#: Features enter the model if their log odds between toxic and clean rows are so many standard errors from 0.
LEAST_Z = 4.0
#: Of sampled clean rows, at most this share may be rejected when the cut is set.
CLEAN_LOSS = 0.001
WORDS = regex.compile(r"\p{L}+").findall


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text, each once, sorted."""
    if not text:
        return np.zeros(0, np.int32)
    words = set(WORDS(text.lower()))
    units = words | {f"{w[:n]}~" for w in words for n in BEGINNINGS if len(w) > n}
    mask = (1 << HASH_BITS) - 1
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(u) & mask for u in units), np.int32, len(units)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class OrdinalModel:
    """Shared weights, ordered thresholds, and the expected severity from which a text is rejected."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def severity(self, x: np.ndarray) -> tuple[int, float]:
        """Most likely grade and expected severity (0 to GRADES)."""
        above = _logistic(float(self.weights[x].sum()) - self.thresholds)
        mass = np.append(1.0, above) - np.append(above, 0.0)
        return int(np.argmax(mass)), float(above.sum())


def telling(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The log odds, in standard errors, of each feature between toxic and clean rows; `seen` counts it in the `n` clean and `n` toxic rows."""
    c, t = seen
    odds = np.log((t + 0.5) / (n[1] - t + 0.5)) - np.log((c + 0.5) / (n[0] - c + 0.5))
    return np.where(t + c > 2, odds / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)), 0.0)


def fit_weights(kept: list[np.ndarray], hits: np.ndarray, toxic: np.ndarray, epochs: int = 200, l2: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by full-batch steps with per-weight rates, over the telling features `kept` of each row; `hits` of them mark it as toxic."""
    cuts = np.quantile(hits[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    y = np.where(toxic == 1, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    n = len(kept)
    used, column = np.unique(np.concatenate(kept), return_inverse=True)
    row = np.repeat(np.arange(n), [len(r) for r in kept])
    w, theta = np.zeros(len(used)), np.linspace(1.5, 4.0, GRADES)
    seen, seen_t = np.full(len(used), 1e-8), np.full(GRADES, 1e-8)
    above = y[:, None] > np.arange(GRADES)
    for _ in range(epochs):
        score = np.bincount(row, w[column], n)
        slope = _logistic(score[:, None] - theta) - above  # of each threshold's log likelihood; they share the weights
        g = np.bincount(column, slope.sum(axis=1)[row], len(used)) / n + l2 * w
        g_t = -slope.sum(axis=0) / n
        seen, seen_t = seen + g * g, seen_t + g_t * g_t
        w -= 0.1 * g / np.sqrt(seen)
        theta = np.sort(theta - 0.1 * g_t / np.sqrt(seen_t))
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, theta, 0.0)


def set_cut(model: OrdinalModel, severity: np.ndarray, toxic: np.ndarray) -> OrdinalModel:
    """Between clean and toxic rows, or as low as CLEAN_LOSS allows."""
    clean = float(np.quantile(severity[toxic == 0], 1 - CLEAN_LOSS, method="higher"))
    low = float(np.quantile(severity[toxic == 1], CLEAN_LOSS, method="lower"))
    model.cut = (clean + low) / 2 if low > clean else clean + 1e-6
    return model


def fit(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """A model of the labelled rows; a row with several labels counts as toxic if one says so.

    Features of the sample stay on the executors: how often each occurs comes to the driver, then the telling ones of each row
    and last each row's severity.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sample is bounded, so it may be broadcast
    sample = marks.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = doc_columns(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [features(t).astype("<i4").tobytes() for t in b["text"]], "toxic": (b["toxic"] > 0).astype(int)})

    found = rows.mapInPandas(extract, "doc_id long, x binary, toxic int").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("toxic").alias("toxic"))
    found = materialise(found, "toxicity-sample")
    size = 1 << HASH_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, size), np.int32)
        for b in batches:
            for x, y in zip(b["x"], b["toxic"], strict=True):
                seen[y, np.frombuffer(x, "<i4")] += 1  # a row has each feature once
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"feature": at.astype(np.int32), "clean": seen[0, at], "toxic": seen[1, at]})

    n = np.zeros(2, np.int64)
    for r in found.groupBy("toxic").count().collect():
        n[r["toxic"]] = r["count"]
    if not n.all():
        discard(found)
        return OrdinalModel(np.zeros(size, np.float32), np.arange(GRADES) + 20.0, float(GRADES) / 2)
    counted = found.mapInPandas(count, "feature int, clean int, toxic int").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # at most a row for each of 2^HASH_BITS features
    counted = counted.where("clean + toxic > 2").toPandas()
    z = telling(counted[["clean", "toxic"]].to_numpy().T, n)
    sign = np.zeros(size, np.int8)
    sign[counted["feature"].to_numpy()] = np.where(z > LEAST_Z, 1, np.where(z < -LEAST_Z, -1, 0))
    shared_sign = docs.sparkSession.sparkContext.broadcast(sign)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [(x, shared_sign.value[x]) for x in (np.frombuffer(x, "<i4") for x in b["x"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [x[s != 0].tobytes() for x, s in own], "hits": [int((s > 0).sum()) for _, s in own], "toxic": b["toxic"]})

    kept = found.mapInPandas(keep, "doc_id long, x binary, hits int, toxic int").toPandas().sort_values("doc_id")
    model = fit_weights([np.frombuffer(x, "<i4") for x in kept["x"]], kept["hits"].to_numpy(), kept["toxic"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"severity": [shared.value.severity(np.frombuffer(x, "<i4"))[1] for x in b["x"]], "toxic": b["toxic"]})

    judged = found.mapInPandas(judge, "severity double, toxic int").toPandas()
    discard(found)
    return set_cut(model, judged["severity"].to_numpy(), judged["toxic"].to_numpy())


def grader(docs: DataFrame, model: OrdinalModel):
    """A column function: text to struct(grade, severity)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("grade int, severity double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.severity(features(t)) for t in texts], columns=["grade", "severity"])

    return judge


def toxicity(docs: DataFrame, labels: DataFrame, model: OrdinalModel | None = None) -> DataFrame:
    """doc_id, grade (0 to 3), severity (expected grade), toxic, kept of every row.

    A null or empty text has no features and is kept; without labels of both kinds every row is. Each row
    is judged for itself, so repeated rows agree; a null doc_id is kept as it is. An empty table gives no
    rows. Other columns are ignored.
    """
    tune(docs.sparkSession)
    model = model or fit(docs, labels)
    p = doc_columns(docs, "doc_id", "text").select("doc_id", grader(docs, model)("text").alias("p")).select("doc_id", "p.grade", "p.severity")
    return p.withColumn("toxic", F.col("severity") >= model.cut).withColumn("kept", ~F.col("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, model: OrdinalModel | None = None) -> DataFrame:
    """`docs` without rows whose expected severity reaches the model's cut; all columns as they were.

    Null and empty texts have no features and stay; repeated rows, equal or null ids fare alike, as texts alone decide;
    a severity of just the cut goes; an empty table gives no rows. Texts of any length are read whole.
    """
    tune(docs.sparkSession)
    model = model or fit(docs, labels)
    name = fresh(docs, "toxicity")
    judged = docs.withColumn(name, grader(docs, model)(F.col("text").cast("string")))
    return judged.where(F.col(f"{name}.severity") < model.cut).drop(name)
