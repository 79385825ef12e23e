"""Personal data: patterns find protected entities, and corpus co-occurrence the terms that reveal them.

An entity is one e-mail address, IP address, card or phone number. What a term t tells of an entity e is their
pointwise mutual information, log2(p(e, t) / (p(e) p(t))), with p over all documents and the pair counted where t
stands within WINDOW code points of e; what there is to tell is the information of e, -log2 p(e). A term that
tells at least the share DISCLOSED of it, in no fewer than SUPPORT different surroundings, reveals the entity and is
taken out wherever it stands in the corpus: generalised to its first letters if these tell less than the share, and
removed otherwise. A term that also stands elsewhere has a smaller share, so ordinary words stay.

One scan of the texts counts everything, partly within each task. A bitmap of the revealing terms, of bounded size,
tells a second scan where they may stand, and a join by the term where they do. All rows with one text
share one result, which its digest carries.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import doc_columns, materialise, tune

#: The kinds in the order in which spans at one place are listed; terms come last.
KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
#: Share of an entity's information that a term may tell, and different surroundings that show it.
DISCLOSED, SUPPORT = 0.9, 3
#: Code points on each side of an entity whose whole words count as near it; shorter words tell nothing.
WINDOW, LEAST = 64, 4
#: Letters that a generalised term keeps.
KEPT = 3
#: Different terms that a task counts before it hands them on.
COUNTED = 400_000
#: Bits of the map of revealing terms: sixteen a term, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 29
WORD = re.compile("[A-Za-zÀ-ÿ]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# no match begins within a run of digits, so each run is tried once
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


# Base patterns


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, leftmost and apart; a run of letters is read back once from its @."""
    free = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        while at > free and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            yield at, m.end()
            free = m.end()
        else:
            free = max(free, m.start() + 1)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of all base matches, in the order in which they are listed."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """One name for all spellings: addresses in lower case, numbers by their digits."""
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else NO_DIGIT.sub('', value)}"


def near(text: str, a: int, b: int) -> set[str]:
    """Whole words within WINDOW code points of a span, in lower case."""
    out = set()
    # one code point more, to see whether a word is cut
    left, right = max(0, a - WINDOW - 1), min(len(text), b + WINDOW + 1)
    for m in WORD.finditer(text, left, right):
        s, e = m.span()
        if e - s >= LEAST and s >= a - WINDOW and e <= b + WINDOW and (e <= a or s >= b):
            out.add(m.group().lower())
    return out


def bit_of(term: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(term) & (bits - 1)


# Scans

SCAN = pa.schema(
    [("kind", pa.string()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n_chars", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))), ("entity", pa.string()), ("term", pa.string()), ("around", pa.int64()), ("n", pa.int64())]
)
SCAN_DDL = "kind string, doc_id long, digest binary, n_chars long, spans array<struct<start: long, kind: long, end: long>>, entity string, term string, around long, n long"


def scan(docs: DataFrame) -> DataFrame:
    """Three kinds of rows: `row` of a document with its base spans, `near` of an entity and a term (or, with a null term, of the entity), `count` of a term in n documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows(kind: str, many: int, **columns: pa.Array) -> pa.RecordBatch:
            held = {"kind": pa.array([kind] * many, pa.string()), **columns}
            return pa.record_batch([held.get(f.name, pa.nulls(many, f.type)).cast(f.type) for f in SCAN], schema=SCAN)

        def counts() -> pa.RecordBatch:
            return rows("count", len(seen), term=pa.array(list(seen), pa.string()), n=pa.array(list(seen.values()), pa.int64()))

        for b in batches:
            digests, spans, size, pairs = [], [], [], []
            for value in b["text"]:
                text = value.as_py() or ""
                digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                own = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": e} for a, k, e in own])
                size.append(len(text))
                words = {w.lower() for w in WORD.findall(text) if len(w) >= LEAST}
                seen.update(words)
                seen.update({w[:KEPT] + "*" for w in words})
                mine: dict[tuple[str, str | None], int] = {}
                for a, k, e in own:
                    name = entity(k, text[a:e])
                    around = xxhash.xxh64_intdigest(f"{text[max(0, a - WINDOW) : a]}\0{text[e : e + WINDOW]}") - (1 << 63)
                    mine[name, None] = 0
                    for w in near(text, a, e):
                        for term in (w, w[:KEPT] + "*"):
                            mine.setdefault((name, term), around)
                pairs += [(name, term, around) for (name, term), around in mine.items()]
            yield rows("row", len(size), doc_id=b["doc_id"], digest=pa.array(digests, pa.binary()), n_chars=pa.array(size, pa.int64()), spans=pa.array(spans, SCAN.field("spans").type))
            if pairs:
                e, t, a = zip(*pairs, strict=True)
                yield rows("near", len(pairs), entity=pa.array(e, pa.string()), term=pa.array(t, pa.string()), around=pa.array(a, pa.int64()))
            if len(seen) >= COUNTED:
                yield counts()
                seen.clear()
        if seen:
            yield counts()

    return doc_columns(docs, "doc_id", "text").mapInArrow(read, SCAN_DDL)


def disclosing(scanned: DataFrame, documents: int) -> DataFrame:
    """entity, term, share of every pair whose term tells at least DISCLOSED of the entity's information."""
    near_rows = scanned.where("kind = 'near'")
    entities = near_rows.where("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # surroundings first, so that copies of one are one row before the pairs come together
    each = near_rows.where("term is not null").groupBy("entity", "term", "around").agg(F.count(F.lit(1)).alias("n"))
    pairs = each.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
    terms = scanned.where("kind = 'count'").groupBy("term").agg(F.sum("n").alias("n_t"))
    total = F.lit(float(documents))
    told = F.log2(F.col("n_et") * total / (F.col("n_e").cast("double") * F.col("n_t")))
    share = F.round(told / F.log2(total / F.col("n_e")), 9)
    # an entity in every document has no information left to protect
    known = pairs.join(entities, "entity").where(F.col("n_e") < documents).join(terms, "term")
    return known.select("entity", "term", share.alias("share")).where(F.col("share") >= DISCLOSED)


def revealing_terms(pairs: DataFrame) -> DataFrame:
    """term and whether it is to be removed: its first letters tell too much of one of the entities as well."""
    words = pairs.where(~F.endswith("term", F.lit("*"))).select("entity", "term", F.concat(F.substring("term", 1, KEPT), F.lit("*")).alias("general"))
    wide = pairs.where(F.endswith("term", F.lit("*"))).select("entity", F.col("term").alias("general"), F.lit(True).alias("told"))
    return words.join(wide, ["entity", "general"], "left").groupBy("term").agg(F.coalesce(F.max("told"), F.lit(False)).alias("removed"))


def bitmap(terms: DataFrame, n: int) -> np.ndarray:
    """One byte for eight bits; a term sets one. Parts are put together by task, so the driver gets no terms."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: set[int] = set()
        for b in batches:
            places.update(bit_of(t, bits) for t in b["term"].to_pylist())
        at = np.fromiter(places, np.int64, len(places))
        yield pa.record_batch([pa.array(at >> 6), pa.array(at & 63)], names=["slot", "bit"])

    words = terms.select("term").mapInArrow(mark, "slot long, bit long").groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, int(bit))")).alias("held"))
    out = np.zeros(bits >> 6, np.int64)
    # bounded by MOST_BITS / 64 rows, and by the terms
    for r in words.toLocalIterator():
        out[r["slot"]] = r["held"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """digest and spans (start, kind, end, removed) of every text that holds a revealing term outside its base spans."""
    n = terms.count()
    if not n:
        return docs.sparkSession.createDataFrame([], "digest binary, terms array<struct<start: long, kind: long, end: long, removed: boolean>>")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(terms, n))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        may: dict[str, bool] = {}
        for b in batches:
            out: list[tuple[bytes, str, int, int]] = []
            for value in b["text"]:
                text = value.as_py() or ""
                found = []
                for m in WORD.finditer(text):
                    w = m.group()
                    if len(w) < LEAST:
                        continue
                    if w not in may:
                        if len(may) >= COUNTED:
                            may.clear()
                        may[w] = bool(held[bit_of(w.lower(), len(held))])
                    if may[w]:
                        found.append((w.lower(), m.start(), m.end()))
                if not found:
                    continue
                base = base_spans(text)
                ends = [*np.maximum.accumulate([e for _, _, e in base]).tolist()] if base else []
                digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
                for w, s, e in found:
                    k = bisect_left(base, (e, -1, -1))  # spans that begin before the word ends
                    if not k or ends[k - 1] <= s:
                        out.append((digest, w, s, e))
            if out:
                d, w, s, e = zip(*out, strict=True)
                yield pa.record_batch([pa.array(d, pa.binary()), pa.array(w, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["digest", "term", "start", "end"])

    places = doc_columns(docs, "text").mapInArrow(look, "digest binary, term string, start long, end long")
    met = places.join(terms, "term").select("digest", F.struct("start", F.lit(TERM).cast("long").alias("kind"), "end", "removed").alias("s"))
    # a group is bounded by one text's words: copies fall together
    return met.groupBy("digest").agg(F.collect_set("s").alias("terms"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), base (start, kind, end) and terms (and removed) of every row, both sorted.

    A null text counts as empty; a null id is kept. Rows with one text have one result, and each counts for the
    statistics. Texts of any length are read whole. Terms within a base span are left to it. In a table whose entities
    stand in fewer than SUPPORT surroundings, or in every document, no term is revealing. An empty table gives no
    rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    scanned = materialise(scan(docs), "scanned")
    rows = scanned.where("kind = 'row'").select("doc_id", "digest", F.col("spans").alias("base"))
    terms = materialise(revealing_terms(disclosing(scanned, rows.count())), "revealing")
    spans = materialise(term_spans(docs, terms), "term_spans")
    own = F.array_sort(F.coalesce("terms", F.array().cast("array<struct<start: long, kind: long, end: long, removed: boolean>>")))
    return rows.join(spans, "digest", "left").select("doc_id", "digest", "base", own.alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row: entities become their kind in brackets, terms their first letters and a star, or [...].

    Spans that overlap go as one, by the first. Rows as `find_personal_data` has them; a null text gives an empty one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, base, terms in zip(b["text"], b["base"].to_pylist(), b["terms"].to_pylist(), strict=True):
                text, parts, at = value.as_py() or "", [], 0
                for s in sorted([*(base or []), *(terms or [])], key=lambda s: (s["start"], s["kind"], s["end"])):
                    if s["start"] >= at:
                        shown = f"[{KINDS[s['kind']].upper()}]" if s["kind"] < TERM else "[...]" if s["removed"] else text[s["start"] : s["start"] + KEPT] + "*"
                        parts += [text[at : s["start"]], shown]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]))
            yield pa.record_batch([b["doc_id"], pa.array(out, pa.string())], names=["doc_id", "text"])

    tune(docs.sparkSession)
    found = find_personal_data(docs).select("digest", "base", "terms").dropDuplicates(["digest"])
    keyed = doc_columns(docs, "doc_id", "text").mapInArrow(_with_digest, "doc_id long, text string, digest binary")
    return keyed.join(found, "digest").select("doc_id", "text", "base", "terms").mapInArrow(cut, "doc_id long, text string")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [hashlib.blake2b((t.as_py() or "").encode(), digest_size=16).digest() for t in b["text"]]
        yield pa.record_batch([b["doc_id"], b["text"], pa.array(own, pa.binary())], names=["doc_id", "text", "digest"])


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans, of every row of `find_personal_data`."""
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", plain))).alias("spans"))


def oracle() -> str:
    """The same by listing places: what lies between matches gives where they begin."""
    digits = "regexp_replace({}, '[^0-9]', '', 'g')"
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    places = lambda pattern: f"list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{'v': regexp_extract_all(t, '{pattern}')[i], 's': length(array_to_string(regexp_split_to_array(t, '{pattern}')[1:i], '')) + length(array_to_string(regexp_extract_all(t, '{pattern}')[1:i-1], ''))}})"
    luhn_sum = f"list_sum(list_transform(range(length({digits.format('v')})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({digits.format('v')})[i + 1]::INT ELSE (2 * reverse({digits.format('v')})[i + 1]::INT) % 10 + (2 * reverse({digits.format('v')})[i + 1]::INT) // 10 END))"
    right = [
        "true",
        "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        f"length({digits.format('v')}) BETWEEN 12 AND 19 AND coalesce({luhn_sum} % 10 = 0, false)",
        f"length({digits.format('v')}) BETWEEN 9 AND 15",
    ]
    found = "\n  UNION ALL ".join(f"SELECT r, {k} AS kind, x.v AS v, x.s::BIGINT AS s, x.s + length(x.v) AS e FROM (SELECT r, unnest({places(p)}) AS x FROM d WHERE regexp_matches(t, '{p}'))" for k, p in enumerate(patterns))
    checks = " ".join(f"WHEN {k} THEN {test}" for k, test in enumerate(right))
    letters = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT * FROM ({found})),
b AS MATERIALIZED (SELECT *, CASE kind WHEN 0 THEN 'email:' || lower(v) WHEN 1 THEN 'ip:' || v WHEN 2 THEN 'card:' || {digits.format('v')} ELSE 'phone:' || {digits.format('v')} END AS entity FROM m WHERE CASE kind {checks} END),
wl AS (SELECT r, unnest(regexp_extract_all(t, '{letters}')) AS w, unnest(regexp_split_to_array(t, '{letters}')[1:-2]) AS gap, generate_subscripts(regexp_extract_all(t, '{letters}'), 1) AS i FROM d),
w AS MATERIALIZED (SELECT r, lower(w) AS w, e - length(w) AS s, e FROM (SELECT *, (sum(length(w) + length(gap)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e FROM wl) WHERE length(w) >= {LEAST}),
t AS (SELECT term, count(DISTINCT r) AS n_t FROM (SELECT r, w AS term FROM w UNION ALL SELECT r, substr(w, 1, {KEPT}) || '*' FROM w) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
ents AS (SELECT entity, count(DISTINCT r) AS n_e FROM b GROUP BY entity),
a AS (SELECT b.r, b.entity, b.s AS place, w.w, substr(d.t, greatest(b.s - {WINDOW}, 0) + 1, least({WINDOW}, b.s)) || chr(1) || substr(d.t, b.e + 1, {WINDOW}) AS around
  FROM b JOIN d USING (r) JOIN w ON w.r = b.r AND w.s >= b.s - {WINDOW} AND w.e <= b.e + {WINDOW} AND (w.e <= b.s OR w.s >= b.e)),
q AS (SELECT r, entity, term, arg_min(around, place) AS around FROM (SELECT r, entity, place, around, w AS term FROM a UNION ALL SELECT r, entity, place, around, substr(w, 1, {KEPT}) || '*' FROM a) GROUP BY ALL),
p AS (SELECT entity, term, count(*) AS n_et FROM q GROUP BY ALL HAVING count(DISTINCT around) >= {SUPPORT}),
k AS (SELECT entity, term FROM p JOIN ents USING (entity) JOIN t USING (term), n WHERE n_e < n AND round(log2(n_et * n / (n_e::DOUBLE * n_t)) / log2(n / n_e), 9) >= {DISCLOSED}),
y AS (SELECT DISTINCT term FROM k WHERE term NOT LIKE '%*'),
z AS (SELECT r, 4 AS kind, s, e FROM w WHERE w IN (SELECT term FROM y) AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = w.r AND b.s < w.e AND b.e > w.s)),
names AS (SELECT ['email', 'ip', 'card', 'phone', 'term'] AS names),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  string_agg(names[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS l FROM b, names GROUP BY r),
f AS (SELECT r, string_agg(names[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS l FROM (SELECT r, kind, s, e FROM b UNION ALL SELECT * FROM z), names GROUP BY r)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(g.l, '')) AS base_sha256, coalesce(f.l, '') AS spans
FROM d LEFT JOIN g USING (r) LEFT JOIN f USING (r)"""
