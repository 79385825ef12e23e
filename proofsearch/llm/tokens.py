"""Exact token ids of whole texts, by way of bounded caches.

A byte-pair tokenizer never merges across the places where its pre-tokenizer splits, and the public
vocabularies split at white space. So a text is cut into chunks at spaces, and its ids are its chunks'
ids in order. Arrow cuts a batch of texts and numbers its different chunks; Python looks each of those up
once a batch (of a vocabulary without spaces, the different words and marks in them), and numpy puts the ids together. A chunk that is new is cut into runs of letters and runs of
marks, again as the pre-tokenizer cuts, whose ids come from the library's merges and are cached too; a chunk
of anything else goes through the whole tokenizer, and so does a text whose white space the cut would change.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizers' pattern \s knows it, for a character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
#: Chunks and parts kept in the caches; one is emptied when it is full.
CACHE_CHUNKS, CACHE_PARTS = 500_000, 400_000
#: What is longer is encoded and not kept.
LONG = 100
#: Bytes of text that are cut at once; a longer text is cut by itself.
CUT_BYTES = 24 << 20
#: Marks that often end a word.
ENDS = frozenset(".,;:!?")
#: The ASCII marks, but for the apostrophe.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Runs that the pre-tokenizers of both vocabularies keep whole: Latin letters, marks (no apostrophe), one line end.
LATIN = "[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]"
LETTERS = "".join(re.findall(LATIN, "".join(map(chr, range(256)))))
PARTS = re.compile(f" ?{LATIN}+| ?[!-&(-/:-@\\[-`{{-~]+|\\n(?![{SPACE}])").findall


def _byte_chars() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


class Bpe:
    """A vocabulary file of the tokenizers library, and the cache of parts.

    `specials`: whether the strings of the file's special tokens are read as those tokens; else they are ordinary text.
    """

    def __init__(self, path: str, specials: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not specials
        added = [t for t in json.loads(self.whole.to_str())["added_tokens"] if specials or not t["special"]]
        if any(not t["content"] or set(t["content"]) & WHITE or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that hold or take in white space are not supported")
        #: A chunk with one of these goes through the whole tokenizer.
        self.added = tuple(t["content"] for t in added) + tuple(t["content"].lower() for t in added if t["normalized"])
        self.size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.merge = self.whole.model.tokenize
        self.parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def pieces(self, chunk: str, lower: bool) -> bytes:
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isascii() and body.isalpha() and len(chunk) <= LONG:
            parts = [chunk]
        elif body[-1:] in ENDS and body[:-1].isascii() and body[:-1].isalpha() and len(chunk) <= LONG:
            parts = [chunk[:-1], chunk[-1]]
        else:
            parts = PARTS(chunk)
            if len(chunk) > LONG or "".join(parts) != chunk or any(s in chunk for s in self.added):
                return self.encode(chunk)
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        out = b""
        for p in parts:
            if lower:
                p = p.lower()
            if (ids := self.parts.get(p)) is None:
                tokens = self.merge(p.encode().decode("latin-1").translate(BYTE_CHARS))
                ids = self.parts[p] = array(self.code, [t.id for t in tokens]).tobytes()
            out += ids
        return out


class SpacedChunks(dict):
    """Ids of chunks after a space that belongs to them (byte-level vocabularies); None where the cut is in white space."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes | None:
        # a cut before a chunk's space ends the white space before it, which the whole text may not
        out = None if not chunk or chunk[0] in WHITE else self.bpe.pieces(" " + chunk, False)
        if len(chunk) <= LONG:
            self[chunk] = out
        return out


class PlainParts(dict):
    """Ids of runs of Latin letters in lower case, and of ASCII marks."""

    def __init__(self, bpe: Bpe) -> None:
        self.merge, self.code = bpe.merge, bpe.code

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_CHARS)
        if not part:
            return b""
        out = self[part] = array(self.code, [t.id for t in self.merge(shown)]).tobytes()
        return out


class BareChunks(dict):
    """Ids of chunks between white space that the vocabulary drops, in lower case.

    Most chunks are Latin letters with or without marks after them. Arrow takes these apart, so Python sees each
    different run of letters or marks once a batch, and not each chunk; an added token that could be in them forbids that.
    """

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.parts = bpe, PlainParts(bpe)
        self.simple = not any(re.fullmatch(f"{LATIN}*[{re.escape(MARKS)}]*", t) for t in bpe.added)

    def __missing__(self, chunk: str) -> bytes:
        out = self.bpe.pieces(chunk, True)
        if len(chunk) <= LONG:
            self[chunk] = out
        return out

    def known(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of different chunks, in some order, and the place of each chunk there."""
        stems = pc.ascii_rtrim(chunks, MARKS)
        short = pc.less_equal(pc.utf8_length(chunks), LONG if self.simple else -1)
        plain = pc.and_(pc.match_substring_regex(stems, f"^{LATIN}+$"), short)
        ids = pc.binary_join_element_wise(
            self._of_parts(pc.utf8_lower(stems.filter(plain))),
            self._of_parts(pc.utf8_ltrim(chunks.filter(plain), LETTERS)),
            pa.scalar(b"", pa.large_binary()),
        )
        others = list(map(self.__getitem__, chunks.filter(pc.invert(plain)).to_pylist()))
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        place = np.where(is_plain, np.cumsum(is_plain) - 1, len(ids) + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([ids, pa.array(others, pa.large_binary())]), place

    def _of_parts(self, parts: pa.Array) -> pa.Array:
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        coded = parts.dictionary_encode()
        ids = list(map(self.parts.__getitem__, coded.dictionary.to_pylist()))
        return pa.array(ids, pa.large_binary()).take(coded.indices)


class UnitTokenizer:
    """Ids of whole texts; `keeps_space` says whether a space belongs to the token after it."""

    def __init__(self, path: str, keeps_space: bool, specials: bool = False) -> None:
        self.bpe, self.keeps_space = Bpe(path, specials), keeps_space
        self.kind = self.bpe.kind
        self.chunks = (SpacedChunks if keeps_space else BareChunks)(self.bpe)

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has; a null text has none, and `end_id` ends each text."""
        texts = texts.fill_null("")
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        cut = pc.split_pattern(texts, " ") if self.keeps_space else pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        at = cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        which = coded.indices.to_numpy()
        if self.keeps_space:
            known, which = self._first_and_odd(texts, list(map(self.chunks.__getitem__, coded.dictionary.to_pylist())), which, at)
            known = pa.array(known, pa.large_binary())
        else:
            known, place = self.chunks.known(coded.dictionary)
            which = place[which]
        if end_id is not None:
            known = pa.concat_arrays([known, pa.array([np.array([end_id], self.kind).tobytes()], pa.large_binary())])
            which, at = np.insert(which, at[1:], len(known) - 1), at + np.arange(len(at))
        got = known.take(pa.array(which))
        flat, size = values_of(got, self.kind)
        ends = np.concatenate([[0], np.cumsum(size)])
        return flat, np.diff(ends[at])

    def _first_and_odd(self, texts: pa.Array, known: list, which: np.ndarray, at: np.ndarray) -> tuple[list, np.ndarray]:
        """Chunk numbers with those of first chunks, which no space precedes, and of texts that are encoded as a whole."""
        n = len(known)
        odd = np.fromiter((k is None for k in known), bool, n)
        first = at[:-1]
        hit = odd[which]
        hit[first] = False
        whole = np.add.reduceat(hit, first, dtype=np.int64) > 0 if len(first) else np.zeros(0, bool)
        empty = len(known)
        known = [k or b"" for k in known]
        known.append(b"")
        which = which.copy()
        if whole.any():
            which[np.repeat(whole, np.diff(at))] = empty
        for k, text in enumerate(texts):
            text = text.as_py()
            which[first[k]] = len(known)
            known.append(self.bpe.encode(text) if whole[k] else self.bpe.pieces(text.split(" ", 1)[0], False))
        return known, which

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        flat, size = self.flat(pa.array(list(texts), pa.string()))
        return np.split(flat, np.cumsum(size)[:-1]) if len(size) else []


_OPEN: dict[tuple[str, bool, bool], UnitTokenizer] = {}


def unit_tokenizer(path: str, keeps_space: bool, specials: bool = False) -> UnitTokenizer:
    """One for each Python worker: later tasks of the worker find its caches filled."""
    key = (path, keeps_space, specials)
    if key not in _OPEN:
        _OPEN[key] = UnitTokenizer(*key)
    return _OPEN[key]


def batched(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.Table]:
    """Batches put together until they hold CUT_BYTES of `column`."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= CUT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A combined column as an array."""
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def binary_rows(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """One binary value for each run of `size` values, without a copy."""
    ends = np.concatenate([[0], np.cumsum(size)]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def values_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, and how many each row has."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)
    return flat, np.diff(at) // kind.itemsize
