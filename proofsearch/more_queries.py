"""More operators as queries over the driver's tables: verification, answers, evaluation, sources, folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .functions import units as U
from .operators import answers, corpus, evaluation, graph, planner, postings, reason, retrieval, settings, state, verify
from .queries import _BM25, _CLAIMS, _GROUPS, _HYBRID, _REACH, _RESOLVED, _VECTOR, SQL, _requests, claims, doc_index, docs, gold_documents, items, long, query, table
from .sources import documents as sources
from .sources.storage import shared_folder, stored
from .streaming import answers as live

#: Passages in SQL: sentences packed one after another.
_PASSAGES = f"""WITH RECURSIVE s AS (SELECT doc_id, i, s, {T.sql.tokens('s')} AS t FROM (SELECT doc_id, unnest({T.sql.sentences('text')}) AS s, generate_subscripts({T.sql.sentences('text')}, 1) AS i FROM documents)),
r AS (SELECT doc_id, i, 0 AS chunk, t AS n FROM s WHERE i = 1 UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN r.n > 0 AND r.n + s.t > 120 THEN chunk + 1 ELSE chunk END, CASE WHEN r.n > 0 AND r.n + s.t > 120 THEN s.t ELSE r.n + s.t END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
SELECT doc_id AS document_id, chunk::INT AS ordinal, doc_id || '#' || chunk AS passage_id, string_agg(s, ' ' ORDER BY i) AS text FROM r JOIN s USING (doc_id, i) GROUP BY doc_id, chunk"""
SQL["passage_chunks"] = _PASSAGES

SQL["event_frames"] = """SELECT user_id AS query_id, event_id AS ordinal, 'event: ' || event_type || chr(10) || 'data: {"value":' || value || '}' || chr(10) || chr(10) AS frame FROM events"""

SQL["cache_hits"] = f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, id, i, t AS miss, false AS hit FROM e WHERE i = 1 UNION ALL
  SELECT e.key, e.id, e.i, CASE WHEN e.t - miss < {6 * 3600} THEN miss ELSE e.t END, e.t - miss < {6 * 3600} FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
SELECT key, id, hit FROM r"""

SQL["breaker_state"] = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch(ts)::DOUBLE AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, 0::BIGINT AS i, 0 AS bad, NULL::DOUBLE AS since, NULL::BIGINT AS id, NULL::VARCHAR AS state FROM (SELECT DISTINCT key FROM e) UNION ALL
  SELECT key, i, CASE WHEN now = 'open' THEN bad WHEN failed THEN bad + 1 ELSE 0 END, CASE WHEN now = 'open' THEN since WHEN failed AND (bad + 1 >= 2 OR now = 'half-open') THEN t END, id, now
  FROM (SELECT r.key, e.i, bad, since, e.id, failed, t, CASE WHEN since IS NULL THEN 'closed' WHEN t - since >= 86400 THEN 'half-open' ELSE 'open' END AS now FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1))
SELECT key, id, state FROM r WHERE i > 0"""

SQL["property_graph"] = f"""WITH {_RESOLVED} SELECT 'entity' AS kind, count(DISTINCT entity)::BIGINT AS n FROM c UNION ALL SELECT 'source', count(DISTINCT source_id) FROM c UNION ALL SELECT 'claim', count(DISTINCT query_id || '-' || ordinal) FROM c
UNION ALL SELECT 'ABOUT', count(DISTINCT query_id || '-' || ordinal) FROM c UNION ALL SELECT 'FROM', count(DISTINCT query_id || '-' || ordinal || '/' || source_id) FROM c
UNION ALL SELECT 'search', count(*) FROM (SELECT DISTINCT query_id FROM c WHERE query_id % 2 = 0) UNION ALL SELECT 'FOUND', count(DISTINCT query_id) FROM c WHERE query_id % 2 = 0
UNION ALL SELECT 'CONTRADICTION', count(*) FROM s WHERE state <> 'consistent'"""

SQL["multi_query"] = f"""WITH parts AS (SELECT DISTINCT query_id, query FROM (SELECT item_id AS query_id, unnest({T.sql.sentences('text')}) AS query FROM benchmark)),
keyed AS (SELECT query_id AS item, query, row_number() OVER () + 1000000 AS key FROM parts),
asked AS MATERIALIZED (SELECT item_id AS item_id, text FROM benchmark UNION ALL SELECT key, query FROM keyed), {_BM25}, {_REACH}, {_HYBRID},
cut AS (SELECT * FROM hybrid WHERE rank <= 15),
b AS (SELECT query_id, doc_id AS document_id, round(score + 1e-9, 6) AS score, 0 AS batch FROM cut WHERE query_id < 1000000
  UNION ALL SELECT item, doc_id, round(score * 0.5 + 1e-9, 6), 1 FROM cut JOIN keyed ON key = query_id),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, batch) AS r FROM b) WHERE r = 1)
SELECT query_id, document_id, score, batch::BIGINT AS batch, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, batch, document_id) AS rank FROM d) WHERE rank <= 15""".replace("FROM benchmark), n", "FROM asked), n").replace("AS term FROM benchmark", "AS term FROM asked").replace("<= 20)", "<= 60)")


# ---- verification ----------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT doc_id, unnest({T.sql.sentences('text')}) AS quote, generate_subscripts({T.sql.sentences('text')}, 1) AS i FROM documents),
c AS (SELECT doc_id, i, doc_id + CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS passage_id, CASE WHEN i % 4 = 0 THEN 'absent' ELSE coalesce({T.sql.words('quote')}[1], '') END AS value, quote, len(list_filter({T.sql.words('quote')}, lambda w: true)) AS n FROM s WHERE i <= 12),
v AS (SELECT *, list_filter({T.sql.words('value')}, lambda w: length(w) > 1 OR regexp_matches(w, '^[0-9]$')) AS vw, {T.sql.words('quote')} AS qw FROM c WHERE trim(value) <> ''),
k AS (SELECT v.*, trim(regexp_replace({T.sql.normalize('quote')}, '\\s+', ' ', 'g')) AS q, trim(regexp_replace({T.sql.normalize('d.text')}, '\\s+', ' ', 'g')) AS t FROM v JOIN documents d ON d.doc_id = passage_id WHERE len(vw) > 0 AND len(list_filter(vw, lambda w: NOT list_contains(qw, w))) = 0)
SELECT doc_id, i::INT AS i, passage_id, value FROM k WHERE q <> '' AND contains(t, q)""")
def claim_acceptance(spark, sf):
    d = docs(spark, sf)
    s = d.select("document_id", F.posexplode(T.split_sentences(F.col("text"))).alias("at", "quote")).where("at < 12").withColumn("i", F.col("at") + 1)
    value = F.when(F.col("i") % 4 == 0, "absent").otherwise(F.coalesce(F.try_element_at(T.words(F.col("quote")), F.lit(1)), F.lit("")))
    proposed = s.select(F.col("document_id").alias("doc_id"), "i", (F.col("document_id") + (F.col("i") % 3 == 0).cast("int")).alias("passage_id"), F.lit("it").alias("subject"), value.alias("value"), "quote")
    return verify.accepted_claims(proposed, d.withColumnRenamed("document_id", "passage_id")).select("doc_id", "i", "passage_id", "value")


@query(f"""WITH {_CLAIMS}, q AS (SELECT entity, source_id, max(reliability) AS r, bool_and(value <= 9) AS q FROM c GROUP BY ALL), s AS (SELECT entity, 1 - product(1 - r) AS support, bool_and(q) AS q FROM q GROUP BY entity)
SELECT entity, CASE WHEN NOT q THEN 'unverified' WHEN support < 0.6 THEN 'unverified' ELSE 'fact' END AS status, round(CASE WHEN q THEN support ELSE 0 END + 1e-9, 6) AS confidence FROM s""")
def claim_set_status(spark, sf):
    return verify.claim_set_status(claims(spark, sf).withColumn("quote_found", F.col("value") <= 9), ["entity"])


@query(f"""WITH {_RESOLVED}, k(attribute, comparator, bound) AS (VALUES ('discount', 'le', 5.0::DOUBLE), ('price', 'ge', 3.0)),
e AS (SELECT DISTINCT query_id, entity FROM g),
v AS (SELECT e.query_id, e.entity, k.attribute, comparator, bound, bool_and(ok) AS a, bool_or(ok) AS o FROM e CROSS JOIN k LEFT JOIN (SELECT g.query_id, g.entity, g.attribute, CASE WHEN g.attribute = 'discount' THEN g.value <= 5 + 1e-9 END AS ok FROM g JOIN s USING (query_id, entity, attribute) WHERE state = 'open' OR g.value = s.value) x ON x.query_id = e.query_id AND x.entity = e.entity AND x.attribute = k.attribute GROUP BY ALL),
st AS (SELECT query_id, entity, attribute, CASE WHEN state = 'open' THEN 'uncertain' WHEN support < 0.6 THEN 'unverified' ELSE 'inference' END AS status, round(CASE WHEN state = 'open' THEN margin ELSE support END, 6) AS confidence FROM s)
SELECT v.entity, v.attribute, CASE WHEN a IS NULL THEN 'price ≥ 3 % : non vérifiable' WHEN a THEN 'Respecte discount ≤ 5 %' WHEN NOT o THEN 'Ne respecte pas discount ≤ 5 %' ELSE 'Respect incertain de discount ≤ 5 %' END AS text,
  CASE WHEN a IS NULL THEN 'unverified' ELSE status END AS status, CASE WHEN a IS NULL THEN 0.0 ELSE confidence END::DOUBLE AS confidence FROM v LEFT JOIN st ON st.query_id = v.query_id AND st.entity = v.entity AND st.attribute = v.attribute""")
def constraint_claims(spark, sf):
    g = graph.exact_groups(claims(spark, sf))
    bounds = spark.createDataFrame([("discount", "le", 5.0), ("price", "ge", 3.0)], "attribute string, comparator string, bound double")
    verdicts = graph.constraint_verdicts(g, g.select("query_id").distinct().join(F.broadcast(bounds))).withColumn("unit", F.lit("%"))  # two rows
    return verify.constraint_claims(verdicts, reason.attribute_status(graph.resolve(g))).select("entity", "attribute", "text", "status", "confidence")


@query(f"""WITH {_RESOLVED} SELECT c.query_id, l_partkey AS quote, ['consistent', 'disputed', 'contradicted'][max(CASE WHEN state = 'resolved' AND c.value <> s.value THEN 2 WHEN state = 'open' THEN 1 ELSE 0 END) + 1] AS state
FROM c JOIN s ON s.query_id = c.query_id AND s.entity = c.entity GROUP BY c.query_id, l_partkey""")
def sentence_consistency(spark, sf):
    c = claims(spark, sf).withColumn("passage_id", F.col("query_id")).withColumn("quote", F.col("part"))
    return verify.sentence_consistency(c, graph.resolve(graph.exact_groups(c))).select("query_id", "quote", "state")


@query(f"""WITH {_RESOLVED}, st AS (SELECT s.entity, CASE WHEN state = 'open' THEN 1 WHEN support < 0.6 THEN 2 ELSE 0 END AS code, round(CASE WHEN state = 'open' THEN margin ELSE support END, 6) AS confidence, (SELECT list_sort(list(DISTINCT source_id)) FROM c WHERE c.entity = s.entity) AS src FROM s)
SELECT o_custkey AS customer, ['inference', 'uncertain', 'unverified'][max(code) + 1] AS status, min(confidence) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(src)))), ',') AS sources FROM st JOIN orders ON o_orderkey = entity GROUP BY o_custkey""")
def inference_sources(spark, sf):
    c = claims(spark, sf)
    held = c.groupBy("entity").agg(F.collect_set("source_id").alias("sources"))
    s = reason.attribute_status(graph.resolve(graph.exact_groups(c))).join(held, "entity")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("customer"))
    return verify.infer(s.join(o, "entity"), ["customer"]).select("customer", "status", "confidence", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("""WITH d AS (SELECT conv_id, turn, text, regexp_extract_all(regexp_replace(text, '([0-9])[ \xa0\u202f]([0-9]{3})(\\b)', '\\1\\2', 'g'), '[0-9]+(?:[.,][0-9]+)?') AS n FROM conversations),
k AS (SELECT conv_id, list_distinct(flatten(list(list_transform(n, lambda x: replace(x, ',', '.'))))) AS known FROM d WHERE turn % 2 = 0 GROUP BY conv_id)
SELECT conv_id AS query_id, turn AS rank, len(list_filter(n, lambda x: NOT list_contains(coalesce(known, []), replace(x, ',', '.')))) = 0 AS supported FROM d LEFT JOIN k USING (conv_id) WHERE turn % 2 = 1""")
def written_answers(spark, sf):
    """Odd turns as answers written from what the even ones say."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    written = c.where("rank % 2 = 1").withColumnRenamed("text", "answer")
    said = c.where("rank % 2 = 0").select("query_id", "text")
    return verify.written_answers(written, written.select("query_id", "rank").join(said, "query_id")).select("query_id", "rank", "supported")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE WHEN p_size % 3 = 1 THEN p_size + 0.5 END AS value FROM part""")
def free_quantities(spark, sf):
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(",5"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" or so")))
    return p.select(F.col("p_partkey").alias("id"), verify.free_quantity(raw)["value"].alias("value"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS value, CASE p_size % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'GB' WHEN 2 THEN '' END AS unit FROM part""")
def free_quantities_with_units(spark, sf):
    p = table(spark, sf, "part")
    size, kind = F.col("p_size").cast("string"), F.col("p_size") % 4
    raw = F.when(kind == 0, F.concat(size, F.lit(" Go"))).when(kind == 1, F.concat(F.lit("environ "), size, F.lit(" To"))).when(kind == 2, F.concat(size, F.lit(",5"))).otherwise(F.concat(size, F.lit(" or so")))
    q = verify.free_quantity(raw)
    return p.select(F.col("p_partkey").alias("id"), q["value"].alias("value"), q["unit"].alias("unit"))


@query("""SELECT p_partkey AS id, p_name || '’s box – "' || p_type || '" isn''t [' || p_size || '], it''s (' || p_brand || ')?' AS text FROM part""".replace("’", "''"))
def detokenised_marks(spark, sf):
    """Dashes, shortened words and brackets as a tokenizer of treebanks writes them."""
    raw = F.concat("p_name", F.lit(" 's box -- ``"), "p_type", F.lit("'' is n't -LSB- "), F.col("p_size").cast("string"), F.lit(" -RSB- , it 's -LRB- "), "p_brand", F.lit(" -RRB- ?"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), sources.detokenize(raw).alias("text"))


@query("""SELECT event_id, user_id AS query_id, ((regexp_extract('so: ' || props || ' end', '(?s)\\{.*\\}')) ->> 'k')::BIGINT AS k FROM events""")
def provider_parse(spark, sf):
    said = F.concat(F.lit("so: "), "props", F.lit(" end"))
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("query_id"), F.from_json(T.json_block(said), "k long")["k"].alias("k"))


# ---- graph -----------------------------------------------------------------------------------------


@query(f"WITH {_RESOLVED}, t AS (SELECT query_id, count(DISTINCT entity)::BIGINT AS n_entities, count(*)::BIGINT AS n_claims, count(DISTINCT source_id)::BIGINT AS n_sources, array_to_string(list(query_id || '-' || ordinal ORDER BY ordinal)[1:3], ' ') AS claims FROM c GROUP BY query_id) SELECT t.*, (SELECT count(*) FROM s WHERE s.query_id = t.query_id AND state <> 'consistent')::BIGINT AS n_conflicts FROM t")
def graph_export(spark, sf):
    c = claims(spark, sf)
    out = graph.exported(c, graph.resolve(graph.exact_groups(c)), 3)
    return out.withColumn("claims", F.array_join("claims", " "))


@query("""SELECT query_id, entity, label FROM (SELECT replace(p_brand, 'Brand#', '')::BIGINT AS query_id, p_type AS entity, p_name AS label, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY length(p_name) DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def entity_labels(spark, sf):
    p = table(spark, sf, "part").select(F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("long").alias("query_id"), F.col("p_type").alias("entity"), F.col("p_name").alias("label"), F.col("p_partkey").alias("ordinal"))
    return graph.entity_labels(p)


@query(f"WITH {_CLAIMS} SELECT c.query_id, ordinal::BIGINT AS ordinal, value FROM c WHERE query_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND value >= 5")
def entity_claims(spark, sf):
    c = claims(spark, sf).withColumn("kind", F.when(F.col("value") >= 5, "fact").otherwise("requirement"))
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("entity"), F.lit("discount").alias("attribute"))
    return graph.claims_for(c, wanted).select("query_id", "ordinal", "value")


@query(f"""WITH {_CLAIMS}, q AS (SELECT query_id, CASE WHEN value >= 5 THEN 'ge' ELSE 'le' END AS comparator, value, source_id, max(reliability) AS r FROM c GROUP BY ALL)
SELECT query_id, comparator, value, round(1 - product(1 - r) + 1e-9, 6) AS confidence FROM q GROUP BY query_id, comparator, value""")
def requirement_merge(spark, sf):
    c = claims(spark, sf).withColumn("kind", F.lit("requirement")).withColumn("comparator", F.when(F.col("value") >= 5, "ge").otherwise("le"))
    return graph.requirements(c).select("query_id", "comparator", "value", "confidence")


@query("""WITH p AS (SELECT replace(p_brand, 'Brand#', '')::BIGINT AS query_id, p_type AS entity, lower(p_name) AS value, p_partkey AS source_id, 0.3 + 0.06 * (p_partkey % 10) AS r FROM part),
g AS (SELECT query_id, entity, value, round(1 - product(1 - r) + 1e-9, 6) AS support, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY query_id, entity) AS k, lead(support) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY query_id, entity ORDER BY support DESC, n DESC, value))
SELECT query_id, entity, CASE WHEN k = 1 OR entity NOT LIKE '%STEEL%' THEN 'consistent' WHEN round(support - coalesce(nxt, 0) + 1e-9, 6) >= 0.25 THEN 'resolved' ELSE 'open' END AS state FROM o WHERE r = 1""")
def text_conflicts(spark, sf):
    """Names as text values: `capital` has a single one and conflicts, `colour` has many."""
    p = table(spark, sf, "part")
    attribute = F.when(F.col("p_type").like("%STEEL%"), "capital").otherwise("colour")
    c = p.select(F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("long").alias("query_id"), F.col("p_type").alias("entity"), attribute.alias("attribute"), F.lower("p_name").alias("value_text"), F.col("p_partkey").alias("source_id"), (0.3 + 0.06 * (F.col("p_partkey") % 10)).alias("reliability"))
    by_source = c.groupBy(*graph.KEYS, "value_text", "source_id").agg(F.max("reliability").alias("r"))
    g = by_source.groupBy(*graph.KEYS, "value_text").agg(T.settled(graph.noisy_or(F.col("r"))).alias("support"), F.count(F.lit(1)).alias("n_sources"))
    return graph.resolve(g).select("query_id", "entity", "state")


# ---- answers ---------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_partkey AS p, l_suppkey AS source_id, max(0.3 + 0.067 * (l_suppkey % 10)) AS r, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY ALL),
l AS (SELECT p, list(source_id ORDER BY r DESC, o, source_id) AS ids FROM s GROUP BY p)
SELECT p AS part, array_to_string(ids, ',') AS sources, array_to_string(list_transform(ids[1:3], lambda x: 'S' || x), ', ') || CASE WHEN len(ids) > 3 THEN ' et ' || (len(ids) - 3) || ' autre(s)' ELSE '' END AS names FROM l""")
def source_order(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("source_id"), (0.3 + 0.067 * (F.col("l_suppkey") % 10)).alias("reliability"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    out = answers.ordered_sources(li.withColumn("title", F.concat(F.lit("S"), F.col("source_id").cast("string"))), ["part"])
    return out.select("part", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "names")


@query("""SELECT p_partkey, p_name || ' (' || lower(p_type) || ') : size ' || p_size || ', ' || p_brand || '.' || CASE WHEN p_size >= 10 THEN ' Respecte size ≥ 10.' ELSE ' À confirmer : Ne respecte pas size ≥ 10.' END AS answer FROM part""")
def entity_answers(spark, sf):
    p = table(spark, sf, "part")
    claim = lambda text, status: F.struct(text.alias("text"), status.alias("status"))
    fits = F.col("p_size") >= 10
    said = F.array(
        claim(F.concat(F.lit("type : "), F.lower("p_type")), F.lit("fact")),
        claim(F.concat(F.lit("size : "), F.col("p_size").cast("string")), F.lit("fact")),
        claim(F.concat(F.lit("valeur : "), "p_brand"), F.lit("fact")),
        claim(F.when(fits, "Respecte size ≥ 10").otherwise("Ne respecte pas size ≥ 10"), F.when(fits, "inference").otherwise("unverified")),
    )
    return p.select("p_partkey", answers.entity_answer(F.col("p_name"), said).alias("answer"))


@query("""WITH s AS (SELECT l_partkey AS p, list(DISTINCT 'S' || l_suppkey ORDER BY 'S' || l_suppkey) AS names FROM lineitem GROUP BY 1)
SELECT p_partkey, p_name || ' : ' || p_size || CASE WHEN names IS NULL THEN '.' ELSE ' (' || array_to_string(names[1:2], ', ') || ').' END AS answer FROM part LEFT JOIN s ON p = p_partkey""")
def value_answers(spark, sf):
    names = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))).alias("names"))
    p = table(spark, sf, "part").join(names, "p_partkey", "left")
    return p.select("p_partkey", answers.value_answer(F.concat("p_name", F.lit(" : "), F.col("p_size").cast("string")), F.coalesce("names", F.array().cast("array<string>"))).alias("answer"))


@query("""WITH a AS (SELECT replace(p_brand, 'Brand#', '')::BIGINT AS query_id, p_name, p_size, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part),
t AS (SELECT query_id, string_agg(rank || '. ' || p_name || ' (fiabilité ' || p_size || ' %, lecture « ' || p_type || ' »)' || chr(10) || '   ' || p_name || '.' || chr(10) || '   [fact] size : ' || p_size || chr(10) || '   Sources : A, B, C', chr(10) || chr(10) ORDER BY rank) AS lines FROM a WHERE rank <= 3 GROUP BY query_id)
SELECT q.query_id, CASE WHEN q.query_id % 5 = 0 THEN 'Requête refusée : no reason.' WHEN lines IS NULL THEN 'none' ELSE 'Réponses vérifiées pour « q' || q.query_id || ' » :' || chr(10) || chr(10) || lines END AS text FROM (SELECT DISTINCT query_id FROM a) q LEFT JOIN t USING (query_id)""")
def answer_summary(spark, sf):
    p = table(spark, sf, "part").withColumn("query_id", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("p_size"), "p_partkey"))
    told = p.withColumn("rank", rank).where("rank <= 3").select(
        "query_id", "rank", F.col("p_name").alias("title"), F.concat("p_name", F.lit(".")).alias("answer"), F.col("p_size").alias("reliability_pct"), F.col("p_type").alias("label"),
        F.array(F.struct(F.concat(F.lit("size : "), F.col("p_size").cast("string")).alias("text"), F.lit("fact").alias("status"))).alias("claims"), F.array(*map(F.lit, "ABCD")).alias("sources"),
    )
    asked = p.select("query_id").distinct().select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"), (F.col("query_id") % 5 == 0).alias("blocked"), F.lit("no reason").alias("reason"))
    return answers.summary(told, asked)


@query("""SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1""")
def last_user_text(spark, sf):
    return answers.last_user_text(table(spark, sf, "conversations"), "conv_id", "turn")


# ---- evaluation ------------------------------------------------------------------------------------

_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60)))"
_RANKINGS = f"""{_BM25}, {_REACH}, {_HYBRID}, {_GOLD},
ranked AS (SELECT 'bm25' AS system, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 5 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hybrid WHERE rank <= 5),
hits AS (SELECT s.system, g.query_id, count(*) AS n, count(*) FILTER (r.rank <= 2) AS h2, count(*) FILTER (r.rank <= 5) AS h5, min(r.rank) AS first FROM gold g CROSS JOIN (VALUES ('bm25'), ('hybrid')) s(system) LEFT JOIN ranked r ON r.system = s.system AND r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY ALL),
m AS (SELECT system, query_id, unnest(['recall@2', 'recall@5', 'all@2', 'all@5', 'mrr@10']) AS metric, unnest([round(h2 / n, 6), round(h5 / n, 6), (h2 = n)::INT, (h5 = n)::INT, round(coalesce(1.0 / first, 0), 6)])::DOUBLE AS value FROM hits)"""


def _gold(spark, sf):
    return gold_documents(items(spark, sf), docs(spark, sf))


def _rankings(spark, sf):
    b, index = items(spark, sf), doc_index(spark, sf)
    lex = retrieval.ranked(retrieval.bm25(b, index, k=5), "score", "rank", 5).select(F.lit("bm25").alias("system"), "query_id", "document_id", "rank")
    return stored(lex.unionByName(retrieval.hybrid(b, index, 5).select(F.lit("hybrid").alias("system"), "query_id", "document_id", "rank")), "rankings")


@query(f"WITH {_RANKINGS} SELECT * FROM m")
def evaluation_rows(spark, sf):
    return evaluation.retrieval_rows(_rankings(spark, sf), _gold(spark, sf)).select("system", "query_id", "metric", "value")


@query(f"WITH {_RANKINGS} SELECT a.metric, a.system, count(*)::BIGINT AS n, round(avg(a.value), 6) AS mean, round(avg(a.value - b.value), 6) AS difference FROM m a JOIN m b ON b.system = 'bm25' AND b.query_id = a.query_id AND b.metric = a.metric WHERE a.query_id % 7 <> 0 GROUP BY a.metric, a.system")
def evaluation_summary(spark, sf):
    rows = evaluation.retrieval_rows(_rankings(spark, sf), _gold(spark, sf))
    return evaluation.collected(rows, items(spark, sf).where("query_id % 7 = 0"))


@query(f"""WITH {_BM25}, {_REACH}, {_GOLD},
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS bm25_rank FROM bm25) WHERE bm25_rank <= 40),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reach DESC, doc_id) AS vector_rank FROM reach WHERE reach >= 0.12) WHERE vector_rank <= 40),
b2 AS (SELECT query_id, doc_id, score AS bm25, bm25_rank, reach FROM lex FULL JOIN vec USING (query_id, doc_id) WHERE bm25_rank IS NOT NULL OR reach >= 0.3),
h AS (SELECT w, query_id, doc_id, row_number() OVER (PARTITION BY w, query_id ORDER BY score DESC, bm25_rank NULLS LAST, doc_id) AS rank FROM (SELECT w, query_id, doc_id, bm25_rank,
  round((coalesce(bm25 / nullif(max(bm25) OVER (PARTITION BY w, query_id), 0), 0) + w * coalesce(reach / nullif(max(reach) OVER (PARTITION BY w, query_id), 0), 0)) / (1 + w), 6) AS score FROM b2, (VALUES (1.0::DOUBLE), (0.25), (0.1), (0.0)) x(w))),
x AS (SELECT w, g.query_id, count(*) AS n, count(*) FILTER (rank <= 2) AS h2, count(*) FILTER (rank <= 5) AS h5, min(CASE WHEN rank <= 10 THEN rank END) AS first FROM gold g CROSS JOIN (VALUES (1.0::DOUBLE), (0.25), (0.1), (0.0)) x(w) LEFT JOIN h USING (w, query_id, doc_id) GROUP BY ALL),
m AS (SELECT w, unnest(['recall@2', 'recall@5', 'all@2', 'all@5', 'mrr@10']) AS metric, unnest([round(h2 / n, 6), round(h5 / n, 6), (h2 = n)::INT, (h5 = n)::INT, round(coalesce(1.0 / first, 0), 6)])::DOUBLE AS value FROM x)
SELECT w::VARCHAR AS vector_weight, metric, round(100 * avg(value), 1) AS mean FROM m GROUP BY ALL""")
def param_grid(spark, sf):
    b, index = items(spark, sf), doc_index(spark, sf)
    # fusion reads 40 of each list, once for each weight
    return evaluation.grid(stored(retrieval.bm25(b, index, k=40), "lexical"), stored(retrieval.reach(b, index, retrieval.PARAMS.least_reach, 40), "vectors"), _gold(spark, sf))


@query(f"""WITH parts AS (SELECT DISTINCT query_id, query FROM (SELECT item_id AS query_id, unnest({T.sql.sentences('text')}) AS query FROM benchmark)),
keyed AS (SELECT query_id AS item, query, row_number() OVER () + 1000000 AS key FROM parts),
asked AS MATERIALIZED (SELECT item_id AS item_id, text FROM benchmark UNION ALL SELECT key, query FROM keyed), {_BM25}, {_REACH},
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS bm25_rank FROM bm25) WHERE bm25_rank <= 60),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reach DESC, doc_id) AS vector_rank FROM reach WHERE reach >= 0.12) WHERE vector_rank <= 60),
c AS (SELECT query_id AS key, doc_id, bm25_rank, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0) AS b, coalesce(reach / nullif(max(reach) OVER (PARTITION BY query_id), 0), 0) AS v
  FROM (SELECT query_id, doc_id, score, bm25_rank, reach FROM lex FULL JOIN vec USING (query_id, doc_id) WHERE bm25_rank IS NOT NULL OR reach >= 0.3)),
h AS (SELECT key, wt, doc_id, score FROM (SELECT key, wt, doc_id, score, row_number() OVER (PARTITION BY key, wt ORDER BY score DESC, bm25_rank NULLS LAST, doc_id) AS r
  FROM (SELECT c.*, wt, round((b + wt * v) / (1 + wt), 6) AS score FROM c, (VALUES (1.0::DOUBLE), (0.25), (0.1), (0.0)) x(wt))) WHERE r <= 15),
e AS (SELECT coalesce(k.item, h.key) AS query_id, wt, s, doc_id, round(score * CASE WHEN k.item IS NULL THEN 1.0::DOUBLE ELSE s END + 1e-9, 6) AS score, CASE WHEN k.item IS NULL THEN 0 ELSE 1 END AS batch FROM h LEFT JOIN keyed k ON k.key = h.key, (VALUES (1.0::DOUBLE), (0.5)) y(s)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, wt, s, doc_id ORDER BY score DESC, batch) AS own FROM e) WHERE own = 1),
m AS (SELECT * FROM (SELECT query_id, wt, s, doc_id, score, row_number() OVER (PARTITION BY query_id, wt, s ORDER BY score DESC, batch, doc_id) AS r FROM o) WHERE r <= 15),
l AS (SELECT a.doc_id, b.doc_id AS cited FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
t AS (SELECT query_id, wt, s, doc_id, max(own) AS own, max(citing) AS citing FROM (SELECT query_id, wt, s, doc_id, score AS own, NULL::DOUBLE AS citing FROM m UNION ALL SELECT query_id, wt, s, cited, NULL, score FROM m JOIN l USING (doc_id) WHERE r <= 2) GROUP BY query_id, wt, s, doc_id),
u AS (SELECT *, CASE WHEN citing IS NOT NULL THEN round(coalesce(own, 0) + g * citing + 1e-9, 6) END AS boosted FROM t, (VALUES (0.0::DOUBLE), (0.5), (1.0)) z(g)),
f AS (SELECT * FROM (SELECT query_id, wt, s, g, doc_id, row_number() OVER (PARTITION BY query_id, wt, s, g ORDER BY greatest(coalesce(own, -1), coalesce(boosted, -1)) DESC, CASE WHEN own >= coalesce(boosted, -1) THEN 0 ELSE 1 END, doc_id) AS rank FROM u) WHERE rank <= 5),
lines AS (SELECT doc_id, ' ' || array_to_string({T.sql.words('text')}, ' ') || ' ' AS line FROM documents), sought AS (SELECT item_id, ' ' || array_to_string({T.sql.words('text')}, ' ') || ' ' AS line FROM benchmark WHERE len({T.sql.words('text')}) > 0),
gold AS (SELECT item_id AS query_id, doc_id FROM sought JOIN lines ON contains(lines.line, sought.line)),
x AS (SELECT gold.query_id, p.wt, p.s, p.g, count(*) AS n, count(*) FILTER (rank <= 2) AS h2, count(*) FILTER (rank <= 5) AS h5, min(rank) AS first FROM gold CROSS JOIN (SELECT DISTINCT wt, s, g FROM f) p LEFT JOIN f ON f.query_id = gold.query_id AND f.doc_id = gold.doc_id AND f.wt = p.wt AND f.s = p.s AND f.g = p.g GROUP BY ALL),
r AS (SELECT wt, s, g, unnest(['recall@2', 'recall@5', 'all@2', 'all@5', 'mrr@10']) AS metric, unnest([round(h2 / n, 6), round(h5 / n, 6), (h2 = n)::INT, (h5 = n)::INT, round(coalesce(1.0 / first, 0), 6)])::DOUBLE AS value FROM x)
SELECT wt AS vector_weight, s AS secondary, g AS link_boost, metric, round(100 * avg(value), 1) AS mean FROM r GROUP BY ALL""".replace("FROM benchmark), n", "FROM asked), n").replace("AS term FROM benchmark", "AS term FROM asked"))
def settings_grid(spark, sf):
    """24 settings; each document cites the next one, and gold documents hold an item's words in a row."""
    b, d = items(spark, sf), docs(spark, sf)
    parts = b.select("query_id", F.explode(T.split_sentences(F.col("query"))).alias("query"))
    links = d.select(F.col("document_id").alias("text_id"), (F.col("document_id") + 1).alias("document_id")).join(d.select("document_id"), "document_id", "left_semi")
    words = T.words(F.col("query"))
    held = retrieval.mentions(d.select(F.col("document_id").alias("text_id"), "text"), b.select(F.col("query_id").alias("document_id"), words.alias("key"), F.size(words).alias("n")))
    gold = stored(held.select(F.col("document_id").alias("query_id"), F.col("text_id").alias("document_id")), "gold")
    lists = settings.candidates(b, parts, doc_index(spark, sf), 5)
    return settings.report(stored(settings.rankings(lists, links, 5), "rankings"), gold)


@query("""WITH p AS (SELECT conv_id AS query_id, text AS gold, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pred, turn FROM conversations),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn DESC) AS r FROM p) WHERE r = 1)
SELECT 'answered' AS metric, count(*)::BIGINT AS n, round(avg((pred IS NOT NULL)::INT), 6) AS mean FROM l""")
def answered_rate(spark, sf):
    c = table(spark, sf, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    last = c.withColumn("pred", F.lag("text").over(w)).withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("r = 1")
    rows = evaluation.answer_rows(last.select(F.lit("lag").alias("system"), F.col("conv_id").alias("query_id"), F.col("pred").alias("answer")), last.select(F.col("conv_id").alias("query_id"), F.col("text").alias("answer")))
    return rows.where("metric = 'answered'").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT toxic::VARCHAR AS label, count(*)::BIGINT AS n FROM labels GROUP BY 1")
def label_histogram(spark, sf):
    return evaluation.histogram(table(spark, sf, "labels"), "toxic")


@query("""SELECT event_type AS system, count(*)::BIGINT AS queries, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(avg(value), 2) AS mean, round(sum(value / 1000) * 1000 / count(*), 2) AS cpu_ms,
  round(sum(value / 1000) * 15 / 3600 * 1000 / count(*), 5) AS energy_mwh, round(sum(user_id) / count(*), 1) AS tokens, CASE WHEN event_type <> 'error' THEN round(sum(value / 1e6) / count(*), 6) END::DOUBLE AS cost FROM events GROUP BY event_type""")
def meter_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("system"), F.col("value").alias("latency_ms"), (F.col("value") / 1000).alias("cpu_s"), F.col("user_id").alias("tokens"), F.when(F.col("event_type") != "error", F.col("value") / 1e6).alias("cost"))
    return evaluation.meter_summary(e, "system")


# ---- text, vectors, sources ------------------------------------------------------------------------


@query(f"""WITH qvw AS (SELECT item_id AS id, unnest({T.sql.content_words('text')}) AS term FROM benchmark), {_VECTOR.format('qv')},
n AS (SELECT id, lead(id) OVER (ORDER BY id) AS other FROM (SELECT DISTINCT id FROM qvv)),
u AS (SELECT n.id, v.bucket, v.w AS a, 0.0::DOUBLE AS b FROM n JOIN qvv v ON v.id = n.id WHERE other IS NOT NULL UNION ALL SELECT n.id, v.bucket, 0.0, v.w FROM n JOIN qvv v ON v.id = n.other),
s AS (SELECT id, bucket, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL)
SELECT id AS item_id, round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS similarity FROM s GROUP BY id""")
def weighted_jaccard(spark, sf):
    """Each item with the next one."""
    b = items(spark, sf)
    v = retrieval.query_vectors(b)
    other = b.select("query_id", F.lead("query_id").over(W.orderBy("query_id")).alias("other")).where("other IS NOT NULL")  # one row an item
    return retrieval.weighted_jaccard(v, other).select(F.col("query_id").alias("item_id"), F.col("similarity"))


@query(f"""WITH w AS (SELECT item_id, {T.sql.content_words('text')} AS ws FROM benchmark), p AS (SELECT item_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS b FROM w WHERE len(ws) > 1)
SELECT item_id, count(*)::BIGINT AS n, count(DISTINCT b)::BIGINT AS n_distinct FROM p GROUP BY item_id""")
def bigram_features(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("document_id"), "text")
    return corpus.counted_bigrams(b).groupBy(F.col("document_id").alias("item_id")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query("""SELECT p_partkey, substr(md5(p_name || '|' || p_type), 1, 16) AS document_id, substr(md5(p_name), 1, 12) AS statement_id, substr(regexp_replace(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS attribute FROM part""")
def content_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.content_id(F.col("p_name"), F.col("p_type")).alias("document_id"), T.content_id(F.col("p_name"), length=12).alias("statement_id"), T.attribute_name(F.concat_ws(" ", "p_type", "p_brand")).alias("attribute"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'ram' WHEN 2 THEN 'screen' ELSE 'colour_of_it' END AS attribute FROM part""")
def attribute_names(spark, sf):
    raw = F.element_at(F.array(F.lit("Co\xfbt"), F.lit(" M\xe9moire vive "), F.lit("Screen-Size"), F.lit("Colour of it!")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.attribute_name(raw).alias("attribute"))


@query("""SELECT p_partkey, 'EUR' AS unit, round(p_retailprice, 6) AS value, p_size::DOUBLE AS weight FROM part WHERE p_size > 0""")
def quantities(spark, sf):
    """Prices and weights that a sentence states in other units."""
    p = table(spark, sf, "part").where("p_size > 0")
    price = U.make_quantity(U.parse_number(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))), F.lit("euros"))
    weight = U.make_quantity(F.col("p_size") * 1000.0, F.lit("grammes"))
    return p.select("p_partkey", price["unit"].alias("unit"), F.round(price["value"], 6).alias("value"), weight["value"].alias("weight"))


def _sample_sql(seed: int, n: int, where: str = "true") -> str:
    return f"(SELECT doc_id FROM documents WHERE {where} ORDER BY md5('{seed}:' || doc_id), doc_id LIMIT {n})"


@query(f"SELECT doc_id, true AS test FROM {_sample_sql(1, 60)} UNION ALL SELECT doc_id, false FROM {_sample_sql(7, 100, f'doc_id NOT IN {_sample_sql(1, 60)}')}")
def sampling(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    test = sources.exact_sample(d, "doc_id", 60, 1)
    tuning = sources.tuning_sample(d, "doc_id", test, 100, 7)
    return test.withColumn("test", F.lit(True)).unionByName(tuning.withColumn("test", F.lit(False)))


@query(f"""WITH s AS (SELECT conv_id AS query_id, turn, role || turn AS title, list_filter({T.sql.sentences('text')}, lambda x: trim(x) <> '') AS ss FROM conversations)
SELECT query_id, query_id || '#' || (row_number() OVER (PARTITION BY query_id ORDER BY turn) - 1) AS document_id, title, title || '. ' || array_to_string(ss, ' ') AS text, 0.7::DOUBLE AS reliability FROM s""")
def question_documents(spark, sf):
    """Conversations as questions with a context of titled sentences."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.struct(F.concat("role", F.col("turn").cast("string")).alias("title"), T.split_sentences(F.col("text")).alias("sentences")).alias("c"))
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "c"))), lambda x: x["c"]).alias("context"))
    out = sources.hotpot_documents(rows)
    return out.select("query_id", "document_id", "title", "text", F.col("reliability").cast("double").alias("reliability"))


@query("""SELECT substr(md5(text), 1, 16) AS evidence_id, text, bool_and(role = 'assistant') AS synthetic FROM (SELECT regexp_replace(text, '\\s+', ' ', 'g') AS text, role FROM conversations) GROUP BY text""")
def evidence_pairs(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("", F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.when(F.col("role") == "assistant", sources.GENERATED)).alias("id"), F.regexp_replace("text", r"\s+", " ").alias("evidence"))
    return sources.evidence_pairs(c)


@query("""SELECT p_partkey AS id, '(' || p_name || ') "' || p_type || '", ' || p_size || '.' AS text FROM part""")
def detokenised(spark, sf):
    raw = F.concat(F.lit("-LRB- "), "p_name", F.lit(" -RRB- ``"), "p_type", F.lit("'' , "), F.col("p_size").cast("string"), F.lit(" ."))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), sources.detokenize(raw).alias("text"))


@query("""SELECT doc_id FROM documents WHERE length(text) BETWEEN 1 AND 200000 AND length(source || lang) BETWEEN 1 AND 300 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND false""")
def valid_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat("source", "lang")).otherwise("").alias("title"), "text")
    return sources.valid_documents(d).select("doc_id")


@query("""SELECT origin, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'corpus' AS origin, text FROM documents UNION ALL SELECT 'web', substr(html, 1, 2000) FROM (SELECT html, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 20, url ORDER BY page_id) AS r FROM pages WHERE regexp_matches(url, '^https?://') AND trim(html) <> '') WHERE r = 1) WHERE n <= 6) GROUP BY origin""")
def corpus_and_web(spark, sf):
    raw = table(spark, sf, "pages").select((F.col("page_id") % 20).alias("query_id"), F.col("page_id").alias("position"), "url", F.lit("t").alias("title"), F.col("html").alias("content"))
    both = sources.with_web(docs(spark, sf).withColumn("origin", F.lit("corpus")), sources.web_results(raw))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 3 AND doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, text FROM benchmark),
w AS (SELECT doc_id, unnest({T.sql.content_words('text')}) AS term FROM d)
SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, term FROM w))::BIGINT AS n_postings, (SELECT count(*) FROM w)::BIGINT AS n_terms, (SELECT count(*) FROM d)::BIGINT AS n_docs, round((SELECT count(*) FROM w) / (SELECT count(*) FROM d), 4) AS mean""")
def index_refresh(spark, sf):
    new = items(spark, sf).select(F.col("query_id").alias("document_id"), F.col("query").alias("text"))
    index = corpus.refreshed(doc_index(spark, sf), docs(spark, sf).where("document_id % 10 = 3"), new).held
    return index.terms().agg(F.sum("df").alias("n_postings")).select("n_postings", *[F.lit(n).cast("long").alias(c) for c, n in (("n_terms", index.n_terms), ("n_docs", index.n_docs))], F.round(F.lit(index.mean), 4).alias("mean"))


@query(f"""WITH kept AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 3 AND doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, text FROM benchmark),
{_BM25.replace('FROM documents', 'FROM kept')} SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25) WHERE rank <= 3""")
def index_stream(spark, sf):
    """Documents come as a stream of additions; then every tenth goes and the items of the benchmark replace or join the others."""
    base = f"{shared_folder(spark)}/index-stream-{uuid.uuid4().hex}"
    path, inbox = f"{base}/index", f"{base}/inbox"
    schema = "document_id long, text string, removed boolean"
    postings.build(spark.createDataFrame([], "document_id long, text string"), path)
    d = docs(spark, sf)
    gone = d.where("document_id % 10 = 3").select("document_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("removed"))
    new = items(spark, sf).select(F.col("query_id").alias("document_id"), F.col("query").alias("text"), F.lit(False).alias("removed"))
    for part in (d.withColumn("removed", F.lit(False)), gone.join(new, "document_id", "left_anti").unionByName(new)):
        part.write.mode("append").parquet(inbox)
        stream = postings.follow(spark.readStream.schema(schema).parquet(inbox), path, f"{base}/progress")
        stream.trigger(availableNow=True).start().awaitTermination()
    found = postings.scores(retrieval.query_terms(items(spark, sf)), postings.latest(spark, path), 3)
    ranked = retrieval.ranked(found, "score", "rank", 3)
    return ranked.select("query_id", F.col("document_id").alias("doc_id"), "score", long("rank"))


# ---- folds and stores ------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, id, i, t AS start, 1::BIGINT AS n FROM e WHERE i = 1 UNION ALL SELECT e.key, e.id, e.i, CASE WHEN e.t - start >= 86400 THEN e.t ELSE start END, CASE WHEN e.t - start >= 86400 THEN 1 ELSE n + 1 END FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
SELECT key, id, n FROM r""")
def ttl_counter(spark, sf):
    return state.ttl_counter(_requests(spark, sf), 86400)


@query("""WITH w AS (SELECT user_id AS key, ts, event_id AS id, value FROM events WHERE event_type = 'view'), x AS (SELECT user_id AS key, ts, event_id AS id FROM events WHERE event_type <> 'view'),
j AS (SELECT x.key, x.id, x.ts, max(struct_pack(ts := w.ts, id := w.id, value := w.value)) AS l FROM x LEFT JOIN w ON w.key = x.key AND w.ts <= x.ts GROUP BY ALL)
SELECT key, id, CASE WHEN epoch(ts)::DOUBLE - epoch(l.ts)::DOUBLE < 43200 THEN l.value END AS value FROM j""")
def ttl_store(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "value", "event_type")
    return state.ttl_store(e.where("event_type = 'view'").withColumn("ttl", F.lit(43200)), e.where("event_type <> 'view'"))


@query("""WITH s AS (SELECT user_id AS key, 'T' || (event_id % 4) AS interp_id, ts, event_type AS facet FROM events WHERE event_id % 2 = 0), c AS (SELECT DISTINCT user_id AS key, 'T' || (event_id % 4) AS interp_id, ts FROM events WHERE event_id % 2 = 1),
c2 AS (SELECT key, 'T' || (substr(interp_id, 2)::INT - 1) AS interp_id, ts FROM c)
SELECT c2.key, c2.interp_id, c2.ts, arg_max(s.facet, s.ts) AS facet FROM c2 LEFT JOIN s ON s.key = c2.key AND s.interp_id = c2.interp_id AND s.ts <= c2.ts AND epoch(c2.ts) - epoch(s.ts) < 86400 GROUP BY c2.key, c2.interp_id, c2.ts""")
def shown_answers(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("n"), "ts", F.col("event_type").alias("facet"))
    name = lambda n: F.concat(F.lit("T"), n.cast("string"))
    shown = e.where("n % 2 = 0").withColumn("interp_id", name(F.col("n") % 4))
    clicks = e.where("n % 2 = 1").select("key", name(F.col("n") % 4 - 1).alias("interp_id"), "ts").distinct()
    return state.shown_answers(shown, clicks)


@query(SQL["shown_answers"].replace("arg_max(s.facet, s.ts) AS facet", "arg_max(s.facet, s.ts) AS facet, count(s.key) > 0 AS known"))
def shown_answers_stream(spark, sf):
    """The same as one stream of showings and clicks in keyed state; a last row moves the watermark past all others."""
    base = f"{shared_folder(spark)}/shown-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("facet"))
    name = lambda n: F.concat(F.lit("T"), n.cast("string"))
    shown = e.where("n % 2 = 0").select("key", F.lit(0).alias("kind"), name(F.col("n") % 4).alias("interp_id"), "facet", "ts")
    clicks = e.where("n % 2 = 1").select("key", F.lit(1).alias("kind"), name(F.col("n") % 4 - 1).alias("interp_id"), F.lit(None).cast("string").alias("facet"), "ts")
    last = e.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit(-1).cast("long").alias("key"), F.lit(0).alias("kind"), F.lit("end").alias("interp_id"), F.lit("end").alias("facet"), "ts")
    shown.unionByName(clicks).unionByName(last).write.parquet(f"{base}/inbox")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    live.on_rocksdb(spark)
    try:
        stream = live.clicked(spark.readStream.schema(live.ROWS).parquet(f"{base}/inbox"))
        stream.writeStream.format("parquet").option("path", f"{base}/clicks").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(live.CLICKS).parquet(f"{base}/clicks").select("key", "interp_id", "ts", "facet", "known")


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'deep' ELSE 'auto' END AS depth FROM benchmark""")
def depth_names(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", planner.depth_of(F.when(F.col("item_id") % 3 == 0, " DeeP ").otherwise("whatever")).alias("depth"))


# ---- SQL of queries registered elsewhere -----------------------------------------------------------

SQL["near_duplicate_sentences"] = f"""WITH RECURSIVE s AS (SELECT doc_id, i, list_distinct({T.sql.content_words('s')}) AS w FROM (SELECT doc_id, unnest({T.sql.sentences('text')}) AS s, generate_subscripts({T.sql.sentences('text')}, 1) AS i FROM documents)),
r AS (SELECT doc_id, 0 AS i, []::STRUCT(id BIGINT, w VARCHAR[])[] AS kept FROM (SELECT DISTINCT doc_id FROM s) UNION ALL
  SELECT r.doc_id, s.i, CASE WHEN len(list_filter(kept, lambda k: len(list_intersect(k.w, s.w)) / greatest(len(list_distinct(list_concat(k.w, s.w))), 1) >= 0.7)) > 0 THEN kept ELSE list_append(kept, {{'id': s.i - 1, 'w': s.w}}) END
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1 WHERE len(kept) < 3),
l AS (SELECT doc_id, arg_max(kept, i) AS kept FROM r GROUP BY doc_id)
SELECT doc_id AS query_id, generate_subscripts(kept, 1)::BIGINT AS place, unnest(list_transform(kept, lambda k: k.id))::BIGINT AS id FROM l"""

SQL["chain_support"] = f"""WITH cvw AS (SELECT conv_id * 1000 + turn AS id, unnest({T.sql.content_words('text')}) AS term FROM conversations), {_VECTOR.format('cv')},
x AS (SELECT id // 1000 AS query_id, id % 1000 AS step, bucket, w, coalesce(max(w) OVER (PARTITION BY id // 1000, bucket ORDER BY id % 1000 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cvv),
s AS (SELECT query_id, step, round(1 - sqrt(sum(greatest(w - before, 0) ** 2)) / sqrt(sum(w * w)), 6) AS reach FROM x WHERE step > 0 GROUP BY query_id, step),
m AS (SELECT query_id, min(struct_pack(reach := reach, step := step)) AS m FROM s GROUP BY query_id)
SELECT query_id, m.reach AS weakest, m.step AS step, m.reach >= 0.35 AS admissible FROM m"""

SQL["entity_resolution"] = f"""WITH RECURSIVE p AS (SELECT replace(p_brand, 'Brand#', '')::BIGINT AS query_id, p_partkey AS ordinal, array_to_string(list_transform(list_filter({T.sql.words("p_name || ' ' || p_type")}, lambda w: regexp_matches(w, '[0-9]') OR (length(w) > 1 AND NOT list_contains({T.sql.stop}, w))), lambda w: {T.sql.stem('w')}), ' ') AS key FROM part),
d AS (SELECT query_id, key, list_distinct(string_split(key, ' ')) AS ws, row_number() OVER (PARTITION BY query_id ORDER BY min(ordinal)) AS i FROM p GROUP BY query_id, key),
r AS (SELECT query_id, 0::BIGINT AS i, []::STRUCT(key VARCHAR, ws VARCHAR[])[] AS leaders, NULL::VARCHAR AS key, NULL::VARCHAR AS canonical FROM (SELECT DISTINCT query_id FROM d) UNION ALL
  SELECT query_id, i, CASE WHEN hit IS NULL THEN list_append(leaders, {{'key': key, 'ws': ws}}) ELSE leaders END, key, coalesce(hit, key) FROM (SELECT r.query_id, d.i, leaders, d.key, ws, list_filter(leaders, lambda l:
    list_sort(list_filter(l.ws, lambda w: regexp_matches(w, '[0-9]'))) = list_sort(list_filter(d.ws, lambda w: regexp_matches(w, '[0-9]'))) AND (len(list_intersect(l.ws, d.ws)) = least(len(l.ws), len(d.ws)) AND least(len(l.ws), len(d.ws)) >= 2
      OR len(list_intersect(l.ws, d.ws)) / len(list_distinct(list_concat(l.ws, d.ws))) >= 0.6))[1].key AS hit FROM r JOIN d ON d.query_id = r.query_id AND d.i = r.i + 1))
SELECT p.query_id, ordinal, p.key, canonical FROM p JOIN r ON r.query_id = p.query_id AND r.key = p.key"""

SQL["rag_top_sentence"] = f"""WITH {_BM25}, top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM bm25 QUALIFY place <= 5),
d AS (SELECT doc_id, string_split(text, '.')[1] AS title, text FROM documents),
s AS (SELECT doc_id, title, unnest({T.sql.sentences('text')}) AS sentence, generate_subscripts({T.sql.sentences('text')}, 1) - 1 AS ordinal FROM d),
k AS (SELECT * FROM s WHERE regexp_replace(trim(regexp_replace({T.sql.normalize('sentence')}, '\\s+', ' ', 'g')), '[ .!?;]+$', '') <> regexp_replace(trim(regexp_replace({T.sql.normalize('title')}, '\\s+', ' ', 'g')), '[ .!?;]+$', '')),
x AS (SELECT query_id, doc_id, place, ordinal, sentence, {T.sql.content_words("(title || ' ' || sentence)")} AS ws FROM top JOIN k USING (doc_id)),
per AS (SELECT query_id, count(*) AS n_docs, avg(len(ws)) AS mean FROM x GROUP BY query_id),
tf AS (SELECT query_id, doc_id, place, ordinal, n_terms, term, count(*) AS tf FROM (SELECT query_id, doc_id, place, ordinal, len(ws) AS n_terms, unnest(ws) AS term FROM x) JOIN q USING (query_id, term) GROUP BY ALL),
sdf AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, doc_id, place, ordinal, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / mean))), 6) AS score FROM tf JOIN sdf USING (query_id, term) JOIN per USING (query_id) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, ordinal) AS r FROM sc)
SELECT b.query_id, b.doc_id AS document_id, b.ordinal::BIGINT AS ordinal, score, sentence FROM b JOIN x ON x.query_id = b.query_id AND x.doc_id = b.doc_id AND x.ordinal = b.ordinal WHERE r = 1"""
