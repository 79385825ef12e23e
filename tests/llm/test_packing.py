import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofsearch.llm import packing
from proofsearch.llm.base import table
from proofsearch.llm.queries import tokenizer_path

WINDOW = 64


def check(lengths, pieces, window):
    by_doc, by_sequence = {}, {}
    for d, start, k, s, offset in pieces:
        assert k > 0
        by_doc.setdefault(d, []).append((start, k))
        by_sequence.setdefault(s, []).append((offset, k))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(by_doc.get(d, [])):
            assert start == at
            at += k
        assert at == n
    for own in by_sequence.values():
        at = 0
        for offset, k in sorted(own):
            assert offset == at
            at += k
        assert at == window or at < window and at & (at - 1) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=30), st.integers(0, 5))
def test_pieces_cover_every_id_once_without_padding(lengths, seed):
    r = np.random.default_rng(seed)
    docs = [np.append(r.integers(10, 60, n - 1), 1).astype("<u2") for n in lengths]
    check(lengths, packing.pack_shard(docs, WINDOW), WINDOW)


def test_neighbours_match_brute_force_bm25():
    r = np.random.default_rng(0)
    docs = [r.integers(0, 40, r.integers(1, 20)) for _ in range(30)]
    index = packing.Bm25Shard(docs)
    used = np.zeros(30, bool)
    used[3] = True
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(40)}
    for seed in (0, 7, 11):
        terms = sorted((df[t], t) for t in set(docs[seed].tolist()) if df[t] > 1)[: packing.QUERY_TERMS]
        score = {}
        for n, d in enumerate(docs):
            for _, t in terms:
                tf = int((d == t).sum())
                if tf and not used[n]:
                    idf = np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5))
                    score[n] = score.get(n, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        want = sorted(score, key=lambda n: (-round(score[n], 9), n))
        assert index.neighbours(seed, used).tolist() == want


def test_neighbours_share_a_window():
    a, b, c = np.arange(100, 130), np.arange(200, 230), np.arange(300, 330)
    docs = [np.append(x, 1).astype("<u2") for x in (a, b, c, a, b, c)]
    pieces = packing.pack_shard(docs, 62)
    together = {frozenset(p[0] for p in pieces if p[3] == s) for s in {p[3] for p in pieces}}
    assert together == {frozenset({0, 3}), frozenset({1, 4}), frozenset({2, 5})}


def test_whole_table_against_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    docs = table(spark, sf, "documents")
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    for r in rows:
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    keys = sorted(ids)
    at = {k: n for n, k in enumerate(keys)}
    check([len(ids[k]) for k in keys], [(at[r.doc_id], r.start, r.length, r.sequence_id, r.offset) for r in rows], 2048)


def test_edges(spark):
    schema = "doc_id long, text string, start string"
    rows = [(None, None, "a"), (1, "", None), (1, "same text", "b"), (1, "same text", "b"), (2, "x " * 5000, "c")]
    out = packing.pack(spark.createDataFrame(rows, schema), tokenizer_path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in out) == 1 + 1 + 3 + 3 + 5001
    assert {r.doc_id for r in out} == {None, 1, 2}
    assert packing.pack(spark.createDataFrame([], schema), tokenizer_path("word_bpe_49k.json")).count() == 0
    with pytest.raises(Exception, match="(?i)no such file|not found|os error"):
        packing.pack(spark.createDataFrame(rows, schema), "/nowhere.json").count()


@pytest.mark.parametrize("doc_id", [None, "7"])
def test_rows_of_one_id_are_dealt_over_shards(spark, monkeypatch, doc_id):
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    rows = [(doc_id, 1, np.arange(20, dtype="<u2").tobytes())] * 2000
    tokens = spark.createDataFrame(rows, "doc_id string, chars long, ids binary").repartition(3)
    sizes = [r["count"] for r in packing.dealt(tokens, packing._corpus(tokens)).groupBy("shard").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 20 and max(sizes) <= 200


def test_wide_vocabulary_is_refused(spark, tmp_path):
    with open(tokenizer_path("word_bpe_49k.json")) as f:
        wide = json.load(f)
    at = max(wide["model"]["vocab"].values()) + 1
    wide["model"]["vocab"].update({f"\u2460{k}": at + k for k in range(20_000)})
    (tmp_path / "wide.json").write_text(json.dumps(wide))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="two bytes"):
        packing.pack(docs, str(tmp_path / "wide.json")).count()


def related(groups, size, seed=0):
    """Documents of `size` to a group, each of words of the group's own and of common ones."""
    r = np.random.default_rng(seed)
    common = np.arange(10, 400)
    own = [np.arange(1000 + 20 * g, 1020 + 20 * g) for g in range(groups)]
    docs = [np.concatenate([r.choice(own[g], 12, False), r.choice(common, 30)]).astype("<u2") for g in range(groups) for _ in range(size)]
    return docs, np.repeat(np.arange(groups), size)


def test_related_documents_meet_in_whatever_shards(spark, monkeypatch):
    """Recall of each document's best neighbour over the whole table, within its shard."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    docs, _ = related(100, 4)
    docs += docs[:200]  # copies
    rows = [(str(k), 1, d.tobytes()) for k, d in enumerate(docs)]
    tokens = spark.createDataFrame(rows, "doc_id string, chars long, ids binary").repartition(3)
    corpus = packing._corpus(tokens)
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    assert (corpus.n, corpus.mean) == (600, 42.0) and (corpus.df == df).all()
    shard = {int(r.doc_id): r.shard for r in packing.dealt(tokens, corpus).collect()}
    sizes = np.bincount(list(shard.values()))
    assert len(shard) == 600 and len(sizes) >= 15 and sizes.max() <= 60
    # a copy is always where the text is
    assert all(shard[k] == shard[400 + k] for k in range(200))
    whole = packing.Bm25Shard(docs[:400], corpus)
    best = [whole.neighbours(k, np.arange(400) == k)[0] for k in range(400)]
    # by a hash of the id it would be 1 of 15
    assert np.mean([shard[k] == shard[b] for k, b in enumerate(best)]) > 0.3


def test_seed_asks_with_all_its_terms_and_whole_table_weights():
    r = np.random.default_rng(1)
    docs = [np.arange(60), np.arange(30, 61), *[np.append(np.arange(30), 60 + k) for k in range(1, 4)]]
    corpus = packing.Corpus(1000, 40.0, np.append(r.integers(2, 500, 70), np.zeros(10, int)))
    got = packing.Bm25Shard(docs, corpus).neighbours(0, np.arange(5) == 0)
    idf = np.log1p((1000 - corpus.df + 0.5) / (corpus.df + 0.5))
    score = {n: sum(idf[t] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(d) / 40)) for t in d if t < 60) for n, d in enumerate(docs) if n}
    assert got.tolist() == sorted(score, key=lambda n: (-round(score[n], 9), n))


def test_counts_and_keys_of_flat_ids():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 90, k).astype("<u2") for k in (0, 7, 0, 0, 300, 1, 0)] + [np.array([65535, 65535, 0], "<u2")]
    flat, size = np.concatenate(docs), np.array([len(d) for d in docs])
    assert packing.pairs_of(flat, size).tolist() == [t for d in docs for t in np.unique(d)]
    assert not len(packing.pairs_of(flat[:0], size[:0]))
    df = np.zeros(packing.IDS, np.int64)
    df[:60] = 3  # ids from 60 on are of one document
    order, place = draws = packing.Corpus(40, 30.0, df).draws()
    for j, got in enumerate(packing.keys(flat, size, draws)):
        want = [min(d[d < 60].tolist(), key=order[j].tolist().index, default=packing.IDS) for d in docs]
        assert got.tolist() == want
        assert (place[j][60:] == packing.IDS).all() and sorted(place[j][:60]) == list(range(60))
    assert packing.keys(flat[:0], size[:1], draws).tolist() == [[packing.IDS]] * 2


@pytest.mark.parametrize("dense", [0, 4, 10**9])
def test_rows_of_weights_give_the_same_neighbours(dense, monkeypatch):
    r = np.random.default_rng(6)
    docs = [(r.zipf(1.4, r.integers(0, 80)) % 200).astype("<u2") for _ in range(60)]
    want = [packing.Bm25Shard(docs).neighbours(k, np.zeros(60, bool)).tolist() for k in range(60)]
    monkeypatch.setattr(packing, "DENSE", dense)
    assert [packing.Bm25Shard(docs).neighbours(k, np.zeros(60, bool)).tolist() for k in range(60)] == want
