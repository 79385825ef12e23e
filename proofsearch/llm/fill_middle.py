"""Fill-in-middle: documents are cut into prefix, middle and suffix, and written in an order that a model can learn to fill.

The cuts fall between units (code points, words or lines), at ranks that a digest of the document's id gives. One
Aho-Corasick automaton scans a text for events: the ASCII characters at which the class of units changes (white
space for words, the line end for lines, none for code points) and the sentinels of the output format. Between two
events the number of units is known by arithmetic: each code point is one, or all of the gap is one. So the sparse
list of segments that the events leave is all that the lookup of a rank needs; units are never listed.

A text that holds a sentinel stays as it is, so an output can be taken apart again without any doubt.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import doc_columns, tune
from .tokens import batched, one_array

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: ASCII characters at which units change, for each kind of unit.
TURNS = {"char": "", "word": " \t\n\r\x0b\x0c", "line": "\n"}
OUTPUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


@dataclass(frozen=True)
class Fim:
    """`units`: char, word (a run of white space or of anything else) or line; the others are percentages."""

    units: str = "char"
    plain_percent: int = 10
    spm_percent: int = 20
    salt: str = "1:"


class EventScan:
    """Segments of a text between events, and ranks of units in it."""

    def __init__(self, units: str) -> None:
        import ahocorasick

        self.each = units == "char"
        self.line = units == "line"
        self.automaton = ahocorasick.Automaton()
        for c in TURNS[units]:
            self.automaton.add_word(c, (0, 1))
        for s in SENTINELS:
            self.automaton.add_word(s, (1, len(s)))
        self.automaton.make_automaton()

    def segments(self, text: str) -> tuple[list[int], list[int], bool]:
        """Places where segments begin, units before each (both end with the whole text's), and whether a sentinel was met."""
        starts, before, units, open_at, white_to, marked = [], [], 0, 0, -1, False
        for end, (mark, _) in self.automaton.iter(text):
            if mark:
                marked = True
                continue
            if self.line:
                starts.append(open_at)
                before.append(units)
                units += 1
                open_at = end + 1
                continue
            if end > open_at and white_to < end:  # the gap before this event is one unit
                starts.append(open_at)
                before.append(units)
                units += 1
            if white_to < end:  # the event begins a unit of its class
                starts.append(end)
                before.append(units)
                units += 1
            white_to = open_at = end + 1
        if open_at < len(text):
            starts.append(open_at)
            before.append(units)
            units += len(text) - open_at if self.each else 1
        return [*starts, len(text)], [*before, units], marked

    def place(self, starts: list[int], before: list[int], rank: int) -> int:
        """Code points in the first `rank` units."""
        k = bisect_right(before, rank) - 1
        return starts[k] + (rank - before[k] if self.each else 0)


def draws(doc_id: int | None, salt: str) -> list[int]:
    """The first four numbers of the digest of a document's id; a null id counts as an empty one."""
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(text: str, doc_id: int | None, scan: EventScan, fim: Fim) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    starts, before, marked = scan.segments(text)
    n = before[-1]
    h1, h2, h3, h4 = draws(doc_id, fim.salt)
    if not text or marked or h3 % 100 >= 100 - fim.plain_percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = scan.place(starts, before, low), scan.place(starts, before, high)
    p, s, m = SENTINELS
    if h4 % 100 < fim.spm_percent:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def fill_in_middle(docs: DataFrame, fim: Fim | None = None) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of every row.

    A null text counts as empty and stays plain; so does a text that holds a sentinel. Equal ids with equal texts
    give equal rows; a null id draws as an empty one. Texts of any length are cut whole, with memory for one at a
    time beside its batch. Both cuts may fall on one place, or at an end: parts may be empty. An empty table gives
    no rows; other columns are ignored. Nothing is shuffled.
    """
    fim = fim or Fim()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = EventScan(fim.units)
        for b in batched(batches):
            ids, texts = one_array(b["doc_id"]).to_pylist(), one_array(b["text"])
            rows = [rearranged(t.as_py() or "", d, scan, fim) for d, t in zip(ids, texts, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], schema=OUTPUT)

    tune(docs.sparkSession)
    return doc_columns(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""
    p, s, m = (F.lit(x) for x in SENTINELS)
    part = lambda c, at, k: F.split_part(c, at, F.lit(k))
    head = lambda c: F.substr(c, F.lit(len(SENTINELS[0]) + 1))
    middle = part(output, m, 2)
    shown = part(output, m, 1)
    psm = F.concat(head(part(shown, s, 1)), middle, part(shown, s, 2))
    spm = F.concat(part(shown, p, 2), middle, head(part(shown, p, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cut: DataFrame) -> DataFrame:
    """The result of `fill_in_middle` with digests of output and restored text in place of the output."""
    text = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def oracle() -> str:
    """The same with code points as units, by plain cuts."""
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o"""
