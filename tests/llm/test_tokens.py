import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofsearch.llm import token_output as O
from proofsearch.llm.base import shared_path, table
from proofsearch.llm.queries import tokenizer_path
from proofsearch.llm.tokens import unit_tokenizer

KINDS = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ODD = ["a  b", " x", "x \n\n y", " ", "\t\t", "it's don't 'S", " " * 300, "a" * 3000 + " b", "<|endoftext|> x", "e\u0301 \u0301x", "a\xa0b\u2003c\x1cd \x85e\u3000f", "\n\n\n a\n", "x\u200b y", "\u0130 ΑΣ", "a\n \nb", "a\n b \nc", "a\n\n b", "Ab, ÉCOLE. straße; ab.,", "µª º", "12.5% a1b2"]


@pytest.mark.parametrize("name,keeps", KINDS)
def test_units_give_the_tokenizers_ids(name, keeps, spark, sf):
    t = unit_tokenizer(tokenizer_path(name), keeps)
    texts = ODD + [r.text for r in table(spark, sf, "documents").limit(60).collect()]
    for text, ids in zip(texts, t.ids(texts), strict=True):
        assert ids.tolist() == t.bpe.whole.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("specials", [False, True])
@pytest.mark.parametrize("name,keeps", KINDS)
def test_any_text(name, keeps, specials):
    """50,000 random texts for each vocabulary, over all white space, marks and added tokens, against the plain library."""
    t, r = unit_tokenizer(tokenizer_path(name), keeps, specials), random.Random(f"{name}{specials}")
    space = [chr(c) for c in (9, 10, 11, 12, 13, 32, 32, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    other = [*"aAbz\x1c\x1f'stv.,!?12|#<>", "\u200b", "\ufeff", "\u0301", "\u0130", "\u212a", "\u03a3", "\u4e2d", "\xe9", "\xdf", "\U0001f600", "<|endoftext|>", "<|startoftext|>", " the", "'s", "n't", "abc"]
    texts = ["".join(r.choices(space + other, k=r.randint(0, 25))) for _ in range(25_000)] + ["".join(r.choices([*space, "a"], k=r.randint(0, 6))) for _ in range(25_000)]
    want = t.bpe.whole.encode_batch(texts, add_special_tokens=False)
    for k in range(0, len(texts), 5_000):
        for text, got, e in zip(texts[k : k + 5_000], t.ids(texts[k : k + 5_000]), want[k : k + 5_000], strict=True):
            assert got.tolist() == e.ids, ascii(text)


def test_words_with_marks_after_them():
    """50,000 texts of Latin words, marks and what looks like them, in one call, against the plain library."""
    t, r = unit_tokenizer(tokenizer_path("word_bpe_49k.json"), False), random.Random(3)
    words = ["The", "\xc9t\xe9", "stra\xdfe", "\xd7", "\xf7x", "na\xefve", "\u212aelvin", "\u0130", "it's", "a1", "x" * 99, "y" * 100, "z" * 101, "", "\u0153uvre", "\xffa", "A\u0301"]
    marks = ["", "", "%%%", "...", "'", "!?", "###", "\u2026", "$", "-", "<", "1", "\\"]
    texts = [r.choice([" ", "\n", "  "]).join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 6))) for _ in range(50_000)]
    for text, got, e in zip(texts, t.ids(texts), t.bpe.whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids, ascii(text)


def test_special_tokens_are_text_unless_asked_for():
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    text = "a <|endoftext|> b<|endoftext|>"
    assert unit_tokenizer(path, True, True).ids([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    plain.encode_special_tokens = True
    assert unit_tokenizer(path, True).ids([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 65535), st.integers(0, 2**32 - 1)), max_size=70))
def test_code_round_trip(ranks):
    a = np.array(ranks, np.uint32)
    control, data = O.encode_ranks(a)
    assert len(control) == (len(a) + 3) // 4 and len(data) == sum(max(1, (x.bit_length() + 7) // 8) for x in ranks)
    assert O.decode_ranks(control, data, len(a)).tolist() == ranks


def test_damaged_segments_are_refused():
    rank = np.arange(1 << 16, dtype=np.uint32)
    raw = O.pack_segment(0, 0, 0, pa.array([5, None], pa.int64()), np.array([3, 1]), np.array([1, 2, 300, 7]))
    part, before, ids, lengths, all_ids = O.unpack_segment(raw + b"\n", rank)
    assert (part, before, ids.to_pylist(), lengths.tolist(), all_ids.tolist()) == (0, 0, [5, None], [3, 1], [1, 2, 300, 7])
    for bad in (raw[:40] + b"x" + raw[41:], b"", raw[:20]):
        with pytest.raises((ValueError, struct.error)):
            O.unpack_segment(bad, rank)


def test_files_hold_the_whole_table(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    docs = table(spark, sf, "documents")
    path = shared_path(spark, "tokens-test")
    rows = O.token_output(docs, tokenizer_path("byte_bpe_50k.json"), path=path).orderBy("start").collect()
    at = 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert O.read_tokens(spark, path).where("octet_length(ids) <> 4 * n_tokens").count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, part string, start long"
    rows = [(2, "b", "x", 1), (None, None, None, None), (2, "a", "x", 1), (2, "a", "x", 1), (1, "", "", 0)]
    out = O.token_output(spark.createDataFrame(rows, schema), tokenizer_path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in out] == [(None, 1), (1, 1), (2, 2), (2, 2), (2, 2)]
    assert [r.start for r in out] == [0, 1, 2, 4, 6]
    assert O.token_output(spark.createDataFrame([], schema), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_code_over_many_parts():
    r = np.random.default_rng(0)
    for n in (O.PART - 1, O.PART, O.PART + 1, 3 * O.PART + 5):
        a = np.where(r.random(n) < 0.5, r.integers(0, 256, n), r.integers(0, 65536, n)).astype(np.uint32)
        a[r.integers(0, n, 9)] = 1 << 24
        control, data = O.encode_ranks(a)
        assert (O.decode_ranks(control, data, n) == a).all()
