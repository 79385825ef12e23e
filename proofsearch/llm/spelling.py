"""Spelling variants: each word's distance-one neighbours, found by automata in tries, and the form it most likely stands for.

Words are counted over whole texts, partly within each task and then by word. The vocabulary is dealt by range and
sorted, and each range becomes compact trie shards of bounded size: inner nodes hold a bitmap of their children's
letters and the number of the first child; a child that leads to one word alone is a leaf, whose rest is compared as
a whole. Shards are broadcast in rounds of bounded size, so a larger vocabulary means more rounds, not more memory.
Against every shard each word runs its Levenshtein automaton of distance one depth-first: the exact path goes down
letter by letter, and where it is left by an edit, the rest must follow without another. Of all edits that lead to the
same neighbour, only the one at the first letter that differs is followed, so no neighbour is met twice. The words of
a batch go down together, as numpy arrays of (word, place, node). What is accepted is reduced in the task to the
number of neighbours and the best of them, and these are reduced over the rounds by word. Roots come from pointer
jumping over the forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import discard, doc_columns, materialise, tidy, tune

#: Words and bytes of words in a shard; a single longer word makes a shard of its own.
SHARD_WORDS, SHARD_BYTES = 1 << 17, 8 << 20
#: Bytes of shards that are broadcast at once.
ROUND_BYTES = 96 << 20
#: Words that go down a trie together, and children that are looked at in one step.
BATCH, STEP = 1 << 14, 1 << 20
#: Different words that a task counts before it hands them on.
COUNTED = 400_000
#: A word's form is its best neighbour if that is so many times as frequent.
RATIO = 10
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


# Words and their counts


def run_counts(docs: DataFrame, least: int = 7, noise: int = 31) -> DataFrame:
    """word, n: runs of Latin letters with A-Z in lower case, after deletions that a digest of id and run draws (none if `noise` is 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least).findall
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for d, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                text = t.as_py()
                if not text:
                    continue
                # one byte a code point; what lies beyond is no letter here
                own = Counter(runs(text.encode("latin-1", "replace").lower()))
                if not noise:
                    total.update(own)
                    continue
                began = zlib.crc32(f"{'' if d is None else d}:".encode())
                for run, n in own.items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), began)
                    if h % noise == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    total[run] += n
            if len(total) >= COUNTED:
                yield out()
                total.clear()
        if total:
            yield out()

    tune(docs.sparkSession)
    parts = doc_columns(docs, "doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# Tries


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points in a row, and where each word begins (with the end)."""
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=ends[1:])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), ends


class Shard:
    """A trie over sorted, different words."""

    FIELDS = ("alphabet", "buf", "ends", "n", "label", "ref", "leaf_at", "bits", "first", "one", "last", "stop")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.columns = self.bits.shape[1]

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Shard:
        flat, ends = code_points(words)
        alphabet = np.unique(flat)
        buf = np.searchsorted(alphabet, flat).astype(np.uint8 if len(alphabet) < 256 else np.uint32)
        length = np.diff(ends)
        # letters that each word shares with the one before it
        shared, going, d = np.zeros(len(words) + 1, np.int64), np.arange(1, len(words)), 0
        while len(going):
            going = going[(length[going] > d) & (length[going - 1] > d)]
            going = going[buf[ends[going] + d] == buf[ends[going - 1] + d]]
            d += 1
            shared[going] = d
        deepest = np.maximum(shared[:-1], shared[1:])  # the deepest inner node on a word's path
        columns = max(1, -(-len(alphabet) // 64))
        label, ref, one, last, stops, first_child, parents = [], [], [], [], [], [], []
        inner_total = 1
        active, owner = np.arange(len(words)), np.zeros(len(words), np.int64)  # words below inner nodes of depth d, and these nodes
        stops.append(np.full(1, -1, np.int64))
        if len(words) and length[0] == 0:
            stops[0][0] = 0
        d = 0
        while len(active):
            keep = (length[active] > d) & (deepest[active] >= d)
            active, owner = active[keep], owner[keep]
            if not len(active):
                break
            new = shared[active] <= d
            new[0] = True
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            inner = deepest[active[heads]] > d
            number = np.full(len(heads), -1, np.int64)
            number[inner] = inner_total + np.arange(inner.sum())
            label.append(buf[ends[active[heads]] + d].astype(np.int64))
            ref.append(np.where(inner, number, ~active[heads]))
            parents.append(owner[heads])
            mine = np.full(int(inner.sum()), -1, np.int64)
            whole = (length[active[heads]] == d + 1) & inner  # the first word of a group ends at its node
            mine[number[whole] - inner_total] = active[heads][whole]
            stops.append(mine)
            inner_total += int(inner.sum())
            owner = number[group]
            active, owner = active[owner >= 0], owner[owner >= 0]
            d += 1
        label, ref, parents, stop = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (label, ref, parents, stops))
        # children of a node are next to each other and sorted by letter
        one = np.searchsorted(parents, np.arange(inner_total), "left")
        last = np.searchsorted(parents, np.arange(inner_total), "right")
        bits = np.zeros((inner_total, columns), np.uint64)
        np.bitwise_or.at(bits, (parents, label >> 6), BITS[label & 63])
        held = np.bitwise_count(bits).astype(np.int64)
        first_child = one[:, None] + np.cumsum(held, axis=1) - held
        small = lambda a: a.astype(np.int32)
        return cls({"alphabet": alphabet, "buf": buf, "ends": ends, "n": np.array(counts, np.int64), "label": label.astype(buf.dtype), "ref": small(ref), "leaf_at": small(deepest + 1), "bits": bits, "first": small(first_child), "one": small(one), "last": small(last), "stop": small(stop)})

    def dump(self) -> bytes:
        """All arrays in a row, behind their kinds and shapes."""
        head, body = [], []
        for name in self.FIELDS:
            a = np.ascontiguousarray(getattr(self, name))
            head.append(f"{a.dtype.str} {'x'.join(map(str, a.shape))}")
            raw = a.tobytes()
            body += [raw, bytes(-len(raw) % 8)]
        top = ";".join(head).encode()
        top += b" " * (-(len(top) + 8) % 8)
        return len(top).to_bytes(8, "little") + top + b"".join(body)

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        """The same over the bytes, without a copy."""
        size = int.from_bytes(raw[:8], "little")
        at, arrays = 8 + size, {}
        for name, kind in zip(cls.FIELDS, raw[8 : 8 + size].decode().split(";"), strict=True):
            dtype, shape = kind.split()
            shape = tuple(map(int, shape.split("x")))
            n = int(np.prod(shape))
            arrays[name] = np.frombuffer(raw, dtype, n, at).reshape(shape)
            at += -(-n * np.dtype(dtype).itemsize // 8) * 8
        return cls(arrays)

    def word(self, k: int) -> str:
        return "".join(map(chr, self.alphabet[self.buf[self.ends[k] : self.ends[k + 1]]].tolist()))

    def codes(self, flat: np.ndarray) -> np.ndarray:
        """Letters as this shard numbers them, -1 for those it doesn't have."""
        if not len(self.alphabet):
            return np.full(len(flat), -1, np.int32)
        at = np.searchsorted(self.alphabet, flat)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == flat, at, -1).astype(np.int32)

    def child(self, inner: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each inner node for a letter, -1 if there is none."""
        known = code >= 0
        c = np.where(known, code, 0)
        column, bit = c >> 6, (c & 63)
        bits = self.bits[inner, column]
        found = known & ((bits & BITS[bit]) != 0)
        return np.where(found, self.first[inner, column] + np.bitwise_count(bits & (BITS[bit] - np.uint64(1))), -1)

    def neighbours(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word of this shard) of all pairs that one edit parts."""
        code = self.codes(flat)
        padded = np.append(code, np.int32(-2))  # a place after the last letter, for lookups that are masked anyway
        start, length = ends[:-1], np.diff(ends)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not len(self.n):
            return found[0]

        def finish(row: np.ndarray, place: np.ndarray, word: np.ndarray, at: np.ndarray) -> None:
            """Accepts leaves whose rest from letter `at` is the row's rest from `place`."""
            same = length[row] - place == self.ends[word + 1] - self.ends[word] - at
            row, place, word, at = row[same], place[same], word[same], at[same]
            a, b, left = start[row] + place, self.ends[word] + at, length[row] - place
            ok, going, j = np.ones(len(row), bool), np.arange(len(row)), 0
            while len(going := going[left[going] > j]):
                equal = code[a[going] + j] == self.buf[b[going] + j]
                ok[going[~equal]] = False
                going, j = going[equal], j + 1
            found.append((row[ok], word[ok]))

        def follow(row: np.ndarray, place: np.ndarray, node: np.ndarray) -> None:
            """From child nodes, an edit being spent, down to the words that end as the rows do."""
            while len(row):
                ref = self.ref[node]
                leaf = ref < 0
                if leaf.any():
                    word = ~ref[leaf]
                    finish(row[leaf], place[leaf], word, self.leaf_at[word].astype(np.int64))
                    row, place, ref = row[~leaf], place[~leaf], ref[~leaf]
                row, place, node = step(row, place, ref)

        def step(row: np.ndarray, place: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """From inner nodes by the next letter; rows that end there are accepted."""
            over = place == length[row]
            if over.any():
                stop = self.stop[inner[over]]
                found.append((row[over][stop >= 0], stop[stop >= 0].astype(np.int64)))
                row, place, inner = row[~over], place[~over], inner[~over]
            node = self.child(inner, code[start[row] + place]) if len(row) else np.zeros(0, np.int64)
            on = node >= 0
            return row[on], place[on] + 1, node[on]

        def leave(row: np.ndarray, inner: np.ndarray, depth: int) -> None:
            """The edits at letter `depth`, the exact path having reached these inner nodes."""
            here, more = padded[start[row] + depth], length[row] > depth
            # without this letter: the next one differs from it, or there is none
            after = padded[np.minimum(start[row] + depth + 1, len(code))]
            cut = more & ((length[row] == depth + 1) | (after != here) | (here < 0))
            follow(*step(row[cut], np.full(int(cut.sum()), depth + 1), inner[cut]))
            # another letter before it, or in its place
            many = (self.last[inner] - self.one[inner]).astype(np.int64)
            each = np.repeat(np.arange(len(row)), many)
            node = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.one[inner][each]
            other = ~more[each] | (self.label[node] != here[each])
            each, node = each[other], node[other]
            follow(row[each], np.full(len(each), depth), node)
            each, node = each[more[each]], node[more[each]]
            follow(row[each], np.full(len(each), depth + 1), node)

        row, inner, depth = np.arange(len(length)), np.zeros(len(length), np.int64), 0
        while len(row):
            # depth-first: what leaves the exact path here is followed to its end before the path goes on
            widths = np.cumsum((self.last[inner] - self.one[inner]).astype(np.int64))
            cuts = np.searchsorted(widths, np.arange(STEP, widths[-1], STEP), "right")
            for part in np.split(np.arange(len(row)), cuts):
                leave(row[part], inner[part], depth)
            on = length[row] > depth
            row, inner = row[on], inner[on]
            node = self.child(inner, code[start[row] + depth]) if len(row) else np.zeros(0, np.int64)
            row, node = row[node >= 0], node[node >= 0]
            depth += 1
            ref = self.ref[node]
            for r, word in zip(row[ref < 0].tolist(), (~ref[ref < 0]).tolist(), strict=True):
                # a leaf on the exact path holds one word, mostly the row's own
                if one_edit(code[start[r] + depth : ends[r + 1]], self.buf[self.ends[word] + depth : self.ends[word + 1]]):
                    found.append((np.array([r]), np.array([word])))
            row, inner = row[ref >= 0], ref[ref >= 0].astype(np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = min(len(a), len(b))
    differs = np.flatnonzero(a[:k] != b[:k])
    p = int(differs[0]) if len(differs) else k
    if len(a) == len(b):
        return p < k and np.array_equal(a[p + 1 :], b[p + 1 :])
    return np.array_equal(a[p + 1 :], b[p:]) if len(a) > len(b) else np.array_equal(a[p:], b[p + 1 :])


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[str], list[int]]]:
    """Words and counts in lists of about `rows`."""
    words, counts = [], []
    for b in batches:
        words += b["word"].to_pylist()
        counts += b["n"].to_pylist()
        if len(words) >= rows:
            yield words, counts
            words, counts = [], []
    if words:
        yield words, counts


# The operator


def trie_shards(words: DataFrame, total: int) -> DataFrame:
    """low (first word), size (bytes), trie of each shard; `words` has word, n."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            raw = Shard.build(held, counts).dump()
            return pa.record_batch([pa.array([held[0]]), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], names=["low", "size", "trie"])

        for own, n in batches_of(batches, 1):
            for w, k in zip(own, n, strict=True):
                if held and (len(held) >= SHARD_WORDS or size + len(w) > SHARD_BYTES):
                    yield out()
                    held, counts, size = [], [], 0
                held.append(w)
                counts.append(k)
                size += len(w)
        if held:
            yield out()

    dealt = words.repartitionByRange(max(1, -(-total // SHARD_WORDS)), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(build, "low string, size long, trie binary")


def rounds(sizes: list[tuple[str, int]]) -> Iterator[list[str]]:
    """First words of the shards that are broadcast together."""
    held, total = [], 0
    for low, size in sizes:
        if held and total + size > ROUND_BYTES:
            yield held
            held, total = [], 0
        held.append(low)
        total += size
    if held:
        yield held


def met(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """word, n, n_near, best_n, best: what each word meets in these shards."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Shard.load(raw) for raw in shared.value]
        for own, counts in batches_of(batches, BATCH):
            flat, ends = code_points(own)
            many, best_n, best = np.zeros(len(own), np.int64), np.full(len(own), -1, np.int64), [None] * len(own)
            for s in shards:  # ascending, so that of equal counts the first stays
                row, word = s.neighbours(flat, ends)
                if not len(row):
                    continue
                many += np.bincount(row, minlength=len(own))
                order = np.lexsort((word, -s.n[word], row))
                row, word = row[order], word[order]
                top = np.flatnonzero(np.diff(row, prepend=-1))
                for r, w in zip(row[top].tolist(), word[top].tolist(), strict=True):
                    if s.n[w] > best_n[r]:
                        best_n[r], best[r] = s.n[w], s.word(w)
            yield pa.record_batch([pa.array(own, pa.string()), pa.array(counts, pa.int64()), pa.array(many), pa.array(best_n, mask=best_n < 0), pa.array(best, pa.string())], names=["word", "n", "n_near", "best_n", "best"])

    return words.mapInArrow(search, "word string, n long, n_near long, best_n long, best string")


def with_roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form: pointers jump until none moves."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(links)
        moved = new.where("moved").limit(1).count()
        links = new
        if not moved:
            return links.select("word", "root")


def spelling_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `counts` (word, n), which are different and not null.

    A word's form is its neighbour with the largest n (ties: the smallest word) if that is `ratio` times its own n,
    else null; root follows the forms to the last, and is the word itself without one. Neighbours are all words at
    distance one, without any cap; words may be of any length, from any alphabet. No words give no rows.
    """
    spark = counts.sparkSession
    words = materialise(counts.select("word", F.col("n").cast("long").alias("n")), "words")
    total = words.count()
    shards = materialise(trie_shards(words, total), "tries")
    # one small row a shard
    sizes = sorted((r["low"], r["size"]) for r in shards.select("low", "size").collect())
    found = None
    for lows in rounds(sizes):
        # a round is bounded by ROUND_BYTES
        tries = {r["low"]: bytes(r["trie"]) for r in shards.where(F.col("low").isin(lows)).collect()}
        own = met(words, [tries[low] for low in lows])
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "word string, form string, root string, n long, n_near long, form_n long")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("b")
    reduced = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    better = -F.col("b.less") >= ratio * F.col("n")
    reduced = materialise(reduced.select("word", "n", "n_near", F.when(better, F.col("b.best")).alias("form"), F.when(better, -F.col("b.less")).alias("form_n")), "near")
    tidy(spark)
    roots = with_roots(reduced.where("form is not null"))
    out = reduced.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = RATIO, noise: int = 31) -> DataFrame:
    """`spelling_variants` of the words of documents: those of at least `least` letters that occur so often.

    A null text has no words; a null id draws deletions as an empty one; repeated rows count each time. Texts are
    read whole. Other columns are ignored.
    """
    return spelling_variants(run_counts(docs, least, noise).where(F.col("n") >= occurrences), ratio)


def oracle() -> str:
    """The same by deletion: words that are equal without one letter of one or both, at one place."""
    steps = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, {})"
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: {steps.format('i')}) AS crcs),
u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM u WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM g),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, v: xor(c >> 8, crcs[xor(c & 255, v) + 1]), 4294967295), 4294967295) AS h FROM b, t),
w AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.cut = w.word UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.cut = w.word),
r AS (SELECT word, n, count(*) AS n_near, arg_min({{'f': near, 'k': near_n}}, {{'a': -near_n, 'b': near}}) AS best FROM p GROUP BY ALL),
f AS MATERIALIZED (SELECT word, best.f AS form, best.k AS form_n, n_near FROM r),
o AS MATERIALIZED (SELECT w.word, w.n, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n, coalesce(n_near, 0) AS n_near FROM w LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at FROM o UNION ALL SELECT c.word, o.form FROM c JOIN o ON c.at = o.word WHERE o.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN o ON c.at = o.word WHERE o.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM o JOIN e USING (word)"""
