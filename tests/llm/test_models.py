"""Toxicity, language ID and quality: held-out accuracy, brute-force counts, edges."""

import random
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofsearch.llm import lang_id, quality, toxicity
from proofsearch.llm.base import table

BAD = "arg bok cuz dree elk fump gry hosk ibex jub kolt lurm".split()
SCHEMA = "doc_id long, text string, lang string, source string, severity string, n_words long"
LABELS = "doc_id long, toxic int, quality int"


def labelled(n=2500, seed=0):
    """Clean texts, and texts with a few marked words: more of them, more severe."""
    r = random.Random(seed)
    plain = [a + b + c for a in "stmn" for b in "aeiou" for c in "rtlnskpdg"]
    bad = BAD
    rows, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.3)
        w = [r.choice(plain) for _ in range(r.randint(30, 80))]
        for _ in range(toxic * r.randint(1, 12)):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), "en", "src0", "s", 1))
        labels.append((i, toxic, 1))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    d = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(d, spark.createDataFrame([x for x in labels if x[0] < 2000], LABELS))
    assert (np.diff(model.thresholds) >= 0).all()
    out = {r.doc_id: r for r in toxicity.toxicity(d, None, model).collect()}
    truth = {i: t for i, t, _ in labels if i >= 2000}
    assert np.mean([out[i].toxic for i, t in truth.items() if t]) > 0.9
    assert np.mean([out[i].toxic for i, t in truth.items() if not t]) < 0.02
    assert all(0 <= r.severity <= toxicity.GRADES and r.kept == (not r.toxic) for r in out.values())
    counts = {i: len(set(BAD) & set(rows[i][1].split())) for i, t in truth.items() if t}
    few, many = [out[i].severity for i, c in counts.items() if c <= 3], [out[i].severity for i, c in counts.items() if c >= 7]
    assert np.mean(many) > np.mean(few) + 0.5
    kept = toxicity.keep_clean(d, None, model)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in out.values())


def test_toxicity_fit_sends_no_features_to_the_driver(spark, monkeypatch):
    rows, labels = labelled(1000)
    rows = [(i, text + " " + " ".join(f"w{''.join(chr(97 + int(c)) for c in str(j * 1000 + i))}" for j in range(100)), *rest) for i, text, *rest in rows]
    d, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    held = sum(toxicity.features(r[1]).nbytes for r in rows)
    kind, sent = type(d), []
    whole = kind.toPandas

    def spied(self):
        out = whole(self)
        sent.append(int(sum(len(v) if isinstance(v, bytes) else 8 for c in out for v in out[c])))
        return out

    monkeypatch.setattr(kind, "toPandas", spied)
    model = toxicity.fit(d, marks)
    assert sent and max(sent) < held / 4
    # the cut is that of the rows' own severities
    truth = {i: t for i, t, _ in labels}
    severity = {t: [model.severity(toxicity.features(r[1]))[1] for r in rows if truth[r[0]] == t] for t in (0, 1)}
    clean, low = np.quantile(severity[0], 1 - toxicity.CLEAN_LOSS, method="higher"), np.quantile(severity[1], toxicity.CLEAN_LOSS, method="lower")
    assert model.cut == ((clean + low) / 2 if low > clean else clean + 1e-6)


def test_toxicity_edges(spark):
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", "x", 0), (1, "fine " * 30_000, "en", "s", "x", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (None, 1, 0), (2, None, None)], LABELS)
    out = toxicity.toxicity(d, labels).collect()
    assert len(out) == 3 and all(r.kept for r in out)
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = lang_id.identify(docs).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_backoff_prefers_known_words():
    model = lang_id.BackoffModel.fit([("hello", "en", 50), ("bonjour", "fr", 50), ("1:h", "en", 9), ("1:b", "fr", 9), ("3:jou", "fr", 9), ("3:ell", "en", 9)], ["en", "fr"])
    s = lang_id.Scores(model)
    assert s.predict("hello")[0] == "en" and s.predict("BONJOUR bonjour")[0] == "fr"
    assert s.predict("journal")[0] == "fr" and s.predict("sell")[0] == "en"
    assert s.predict("²³ 12 !") == ("und", 0.0) and s.predict(None) == ("und", 0.0) and s.predict("zzz")[0] == "en"


def test_language_edges(spark):
    rows = [(None, None, None, None, None, None), (1, "12 !", "en", "s", "x", 0), (2, "the words of this text", "en", "s", "x", 0), (2, "the words of this text", "en", "s", "x", 0), (3, "les mots de ce texte", "fr", None, "x", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = [(r.doc_id, r.lang_pred) for r in lang_id.identify(d).collect()]
    assert len(out) == 5 and (None, "und") in out and (1, "und") in out
    assert lang_id.keep_known_languages(d, 0.0).columns == d.columns
    assert lang_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert all(r.lang_pred == "und" for r in lang_id.identify(d.withColumn("lang", d.lang.substr(1, 0)).where("doc_id = 1")).collect())


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x0b\x85\xa0", max_size=60))
def test_counts_match_brute_force(text):
    assert quality.counts(text) == brute(text)


def test_quality_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.kept and r.base_failed)
    passed = [r for r in rows if not r.base_failed and r.doc_id in truth]
    assert np.mean([r.kept for r in passed if truth[r.doc_id]]) > 0.97


def test_path_lengths_match_brute_force():
    r = np.random.default_rng(5)
    x = np.abs(r.normal(size=(400, 5))) * [1, 0, 1, 2, 3]
    forest = quality.IsolationForest.fit(x)
    new = np.abs(r.normal(size=(30, 5))) * 2

    def path(tree, row):
        column, value, left, right, length = tree
        at = 0
        while column[at] >= 0:
            at = left[at] if row[column[at]] <= value[at] else right[at]
        return length[at]

    def usual(n):  # mean path of an unsuccessful search among n
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    want = [2 ** -(np.mean([path(t, row) for t in forest.trees]) / usual(256)) for row in new]
    assert np.allclose(forest.score(new), want)
    # each leaf's length: its depth, and the mean path of the rows that fall there
    tree = forest.trees[0]
    assert len(tree[0]) == 2 * (tree[0] < 0).sum() - 1 and (tree[4][tree[0] < 0] <= 8 + usual(256)).all()
    # a column that is the same in all rows tells a text that differs there
    assert forest.score(np.array([[0.5, 1.0, 0.5, 1, 1]]))[0] > forest.score(np.array([[0.5, 0.0, 0.5, 1, 1]]))[0]


def test_poor_texts_are_caught_by_labels_of_others(spark):
    """Held out: a model of one half of the labels judges the other."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").where("quality is not null")
    model = quality.fit(table(spark, sf, "documents"), labels.where("doc_id % 2 = 0"))
    judged = quality.quality(table(spark, sf, "documents").join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi"), labels, model)
    rows = [(r.kept, r.quality) for r in judged.where("not base_failed").join(labels, "doc_id").collect()]
    caught, lost = [not k for k, q in rows if q == 0], [not k for k, q in rows if q == 1]
    assert np.mean(caught) > 0.95 and np.mean(lost) < 0.005


def test_keep_good(spark):
    rows = [(None, None, None, None, "x", 1), (1, "", "en", "s", "x", 1), (2, " ".join(map(str, range(80))), "en", "s", "x", 1), (2, " ".join(map(str, range(80))), "en", "s", "x", 1)]
    d, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)
    kept = quality.keep_good(d, none)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert quality.keep_good(d.limit(0), none).count() == 0


def test_forest_isolates_outliers_and_edges(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 3))
    forest = quality.IsolationForest.fit(x)
    assert forest.score(np.array([[9.0, 9, 9]]))[0] > forest.score(x).max() - 0.05 > forest.score(np.zeros((1, 3)))[0]
    rows = [(None, None, None, None, None, None), (1, " ", "en", "s", "x", 0), (1, "a b c " * 30_000, "en", "s", "x", 1), (2, " ".join(map(str, range(80))), "en", "s", "x", 1)]
    out = quality.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).collect()
    assert Counter((x.doc_id, x.base_failed, x.kept) for x in out) == Counter({(None, True, False): 1, (1, True, False): 2, (2, False, True): 1})
    assert quality.quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_result_does_not_depend_on_partitions(spark, operator):
    rows, labels = labelled(200, 3)
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    assert sorted(operator(d, lab).collect()) == sorted(operator(d.repartition(5), lab.repartition(3)).collect())


def test_long_runs_count_whole():
    model = lang_id.BackoffModel.fit([(f"1:{c}", lang, n) for c, a, b in (("p", 50, 50), ("x", 50, 2), ("y", 2, 50)) for lang, n in (("aa", a), ("bb", b))], ["aa", "bb"])
    own = lang_id.Scores(model)
    lang, score = own.predict("p" * 40 + "y" * 400)
    assert lang == "bb" and score > 0.9
    assert own.predict("p" * 40 + "x" * 400)[0] == "aa" and not any(len(w) > lang_id.RUN for w in own)


def test_long_runs_are_learned_whole(spark):
    rows = [(i, "m" * 45 + ("tuktuk" if i % 2 else "zorzor") * 5, "aa" if i % 2 else "bb") for i in range(60)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"tukt", "zorz"} <= set(model.grams[4])


def test_quality_is_fitted_on_all_labelled_rows(spark, monkeypatch):
    """Every tree draws its own rows from all good ones, and the cut is the exact quantile of all of them."""
    r = np.random.default_rng(4)
    data = [(i, bool(i % 9), int(r.integers(60, 900)), int(r.integers(300, 4000)), int(r.integers(0, 30)), int(r.integers(0, 9)), int(r.integers(0, 20))) for i in range(12_000)]
    rows = spark.createDataFrame(data, "doc_id long, good boolean, " + ", ".join(f"{n} long" for n in quality.COUNTS)).repartition(5)
    drawn = quality._drawn(rows)
    assert drawn.shape == (quality.TREES, quality.TREE_ROWS, 5)
    x = quality.rule_statistics(np.array([d[2:] for d in data]))
    assert len({tuple(v) for v in drawn.reshape(-1, 5)}) > 10_000  # more than any one sample of the rows that was read before
    model = quality.fit_rows(rows)
    good = np.array([d[1] for d in data])
    score = model.forest.score(x)
    floor = float(np.quantile(score[good], 1 - quality.GOOD_LOSS, method="higher"))
    above = score[~good][score[~good] > floor]
    assert model.cut == pytest.approx((floor + above.min()) / 2 if len(above) else 1.0)
    again = quality.fit_rows(rows.repartition(3))
    assert again.cut == pytest.approx(model.cut)
