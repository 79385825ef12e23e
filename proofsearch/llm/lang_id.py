"""Language ID by word-first backoff.

A word that the model knows is scored by its log frequency in each language; an unseen one by its
character n-grams, the longest known first: at each place of the word the longest n-gram that the model
knows gives the score, down to single letters. A text's score is the mean over its words, and the
languages' posterior at that mean decides. A run of letters too long for a word counts by its n-grams.

The model is fitted on a bounded sample of rows with a language (SAMPLE_DOCS for each, chosen by a hash
of the row), and is itself bounded: each language's most frequent words and n-grams in that sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import doc_columns, fresh, hash01, materialise, tune

#: Labelled rows read for each language.
SAMPLE_DOCS = 2_000
#: The table of languages is broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_LANGS = 10_000
#: The model's size for each language: known words, and known n-grams of each length.
MODEL_WORDS, MODEL_GRAMS, LONGEST_GRAM = 15_000, 10_000, 4
#: What a score of a whole word or n-gram weighs less at each step of backoff.
BACKOFF = 0.4
#: Words of a text that weigh as independent evidence, at most, in the posterior.
EVIDENCE = 12.0
#: An unseen run of more letters is no word: each of its n-grams weighs as a word does, and its score is not kept.
RUN = 40
#: Scores of unseen words kept by a worker.
CACHE_WORDS = 300_000
UNKNOWN = "und"
#: Runs of letters (and of the few numerals that are no digits).
LETTERS = re.compile(r"[^\W\d_]+").findall


@dataclass
class BackoffModel:
    """Log frequencies by language of words, and of n-grams by length, each less its mean over the languages."""

    langs: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]], langs: list[str]) -> BackoffModel:
        """From (unit, language, count); a unit is a word, or "n:" with n-gram."""
        at = {lang: k for k, lang in enumerate(langs)}
        tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST_GRAM + 1)]
        for unit, lang, n in counts:
            level, key = (int(unit[0]), unit[2:]) if unit[1:2] == ":" else (0, unit)
            tables[level].setdefault(key, np.zeros(len(langs)))[at[lang]] += n
        out = []
        for level, t in enumerate(tables):
            total = sum(t.values(), np.zeros(len(langs))) + 0.5 * max(len(t), 1)
            weight = (1 - BACKOFF) ** (LONGEST_GRAM - level) if level else 1.0
            logs = {k: np.log((v + 0.5) / total) for k, v in t.items()}
            out.append({k: weight * (v - v.mean()) for k, v in logs.items()})
        return cls(langs, out[0], out)


class Scores(dict):
    """Row numbers of words in a table of their scores; a word is scored when it is first asked for."""

    def __init__(self, model: BackoffModel) -> None:
        self.model = model
        self.known = np.array(list(model.words.values()) or np.zeros((0, len(model.langs))))
        self.gram_at = [{g: k for k, g in enumerate(t)} for t in model.grams]
        offsets = np.cumsum([0, *map(len, model.grams)])
        self.gram_at = [{g: int(o) + k for g, k in t.items()} for t, o in zip(self.gram_at, offsets)]
        self.gram_scores = np.array([v for t in model.grams for v in t.values()] or np.zeros((0, len(model.langs))))
        self.table = np.zeros((0, 0))
        self.empty()

    def empty(self) -> None:
        """Only the model's own words."""
        self.clear()
        self.update((w, k) for k, w in enumerate(self.model.words))
        self.table = np.zeros((len(self.known) + CACHE_WORDS, len(self.model.langs)))
        self.table[: len(self.known)] = self.known

    def backed_off(self, word: str) -> list[int]:
        """Rows of the longest known n-gram at each place of a word."""
        padded = f"<{word}>"
        found, at, end = [], 0, len(padded)
        while at < end:
            for n in range(min(LONGEST_GRAM, end - at), 0, -1):
                if (k := self.gram_at[n].get(padded[at : at + n])) is not None:
                    found.append(k)
                    at += n
                    break
            else:
                at += 1
        return found

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if found := self.backed_off(word):
            self.table[row] = self.gram_scores.take(found, axis=0).sum(axis=0) / len(found)
        self[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its posterior; `und` and 0 without a letter, or without a model."""
        if not text or not self.model.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        words = LETTERS(text.lower())
        if len(self) > len(self.known) + CACHE_WORDS:
            self.empty()
        if not words:
            return UNKNOWN, 0.0
        runs: list[str] = []
        if max(map(len, words)) > RUN:
            runs = [w for w in words if len(w) > RUN and w not in self]
            words = [w for w in words if len(w) <= RUN or w in self]
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total, n = self.table.take(rows, axis=0).sum(axis=0), len(rows)
        for run in runs:
            found = self.backed_off(run)
            total, n = total + self.gram_scores.take(found, axis=0).sum(axis=0) if found else total, n + max(1, len(found))
        mean = total / n
        p = np.exp((mean - mean.max()) * min(n, EVIDENCE))
        p /= p.sum()
        best = int(np.argmax(p))  # ties to the first of the sorted languages
        return self.model.langs[best], float(p[best])


_OPEN: dict[int, Scores] = {}


def scores(key: int, model: BackoffModel) -> Scores:
    """One for each Python worker and model: later tasks find its words scored."""
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Scores(model)
    return _OPEN[key]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame) -> BackoffModel:
    """A model of text and lang of rows that are not held out."""
    rows = doc_columns(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(SAMPLE_DOCS)) / F.count(F.lit(1))).alias("share"))
    few = share.count() <= BROADCAST_LANGS
    sample = rows.join(F.broadcast(share) if few else share, "lang").where(hash01(F.lit("lang-id"), "doc_id", "text") < F.col("share")).select("lang", "text")

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_lang: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                by_lang.setdefault(lang, Counter()).update(LETTERS(text.lower()))
        for lang, words in by_lang.items():
            found = Counter(words)
            for w, n in words.items():
                p = f"<{w}>"
                for k in range(1, LONGEST_GRAM + 1):
                    for i in range(len(p) - k + 1):
                        found[f"{k}:{p[i : i + k]}"] += n
            if found:
                yield pd.DataFrame({"unit": list(found), "lang": [lang] * len(found), "n": list(found.values())})

    counted = sample.mapInPandas(units, "unit string, lang string, n long").groupBy("unit", "lang").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "unit-counts")
    level = F.when(F.substring("unit", 2, 1) == ":", F.substring("unit", 1, 1).try_cast("int")).otherwise(0)
    # a language's units are bounded by its sample
    rank = F.row_number().over(W.partitionBy("level", "lang").orderBy(F.desc("n"), "unit"))
    ranked = counted.withColumn("level", level).withColumn("rank", rank)
    top = ranked.where(F.col("rank") <= F.when(F.col("level") == 0, MODEL_WORDS).otherwise(MODEL_GRAMS)).where(F.col("rank") <= max(MODEL_WORDS, MODEL_GRAMS)).select("unit").distinct()
    # bounded by the model's size times the languages
    found = [(r["unit"], r["lang"], r["n"]) for r in counted.join(top, "unit").select("unit", "lang", "n").collect()]
    return BackoffModel.fit(sorted(found), sorted({lang for _, lang, _ in found}))


def predictor(docs: DataFrame, model: BackoffModel):
    """A column function: text to struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = int(shared._jbroadcast.id())

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = scores(number, shared.value)
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: BackoffModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text, or one without a letter, is `und` with score 0; so is every text where no row has a
    language to learn from. Ties go to the first language in order. Each row is predicted for itself, so
    repeated rows agree; a null doc_id is kept. Texts of any length are read whole. An empty table gives no rows.
    Other columns are ignored.
    """
    tune(docs.sparkSession)
    model = model or fit(docs)
    rows = doc_columns(docs, "doc_id", "text")
    p = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(docs, model)("text").alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known_languages(docs: DataFrame, least: float = 0.5, model: BackoffModel | None = None) -> DataFrame:
    """`docs` without rows of no language (`und`) or of a posterior under `least`; all columns as they were.

    Null and letterless texts go, as `und`; equal rows fare alike; an empty table gives no rows. Ties of languages go to
    the first in order, which does not matter here. Texts of any length are read whole.
    """
    tune(docs.sparkSession)
    model = model or fit(docs)
    name = fresh(docs, "lang")
    tagged = docs.withColumn(name, predictor(docs, model)(F.col("text").cast("string")))
    return tagged.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
