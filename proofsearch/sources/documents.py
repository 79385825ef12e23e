"""Documents in and out: JSON folders, benchmark files, web results, upserts, reliability, sinks."""

from __future__ import annotations

from functools import reduce

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENT = "id string, title string, text string, url string, reliability double, origin string, metadata map<string,string>"
ID_PATTERN = "^[A-Za-z0-9_.-]{1,80}$"
#: Reliability of domains, the first pattern that fits; and what holds where none does.
DOMAIN_RULES = [
    (r"(^|\.)legifrance\.gouv\.fr$", 0.97),
    (r"(^|\.)service-public\.(fr|gouv\.fr)$", 0.95),
    (r"(^|\.)gouv\.fr$", 0.95),
    (r"(^|\.)europa\.eu$", 0.95),
    (r"(^|\.)who\.int$", 0.93),
    (r"(^|\.)has-sante\.fr$", 0.93),
    (r"(^|\.)(inserm|cnrs|inria|insee)\.fr$", 0.9),
    (r"(^|\.)(nature|science|thelancet|nejm|bmj)\.(com|org)$", 0.9),
    (r"(^|\.)ncbi\.nlm\.nih\.gov$", 0.9),
    (r"(^|\.)(edu|ac\.[a-z]{2})$", 0.85),
    (r"(^|\.)arxiv\.org$", 0.75),
    (r"(^|\.)wikipedia\.org$", 0.75),
    (r"(^|\.)(reddit|quora|jeuxvideo|doctissimo)\.(com|fr)$", 0.35),
    (r"forum", 0.35),
    (r"(^|\.)medium\.com$|blog", 0.45),
]
CORPUS_DEFAULT, WEB_DEFAULT = 0.7, 0.55


def load_json_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All *.json of a folder, each one object or a list; of equal ids the last file's counts, within a file the last row."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.input_file_name()).withColumn("row", F.monotonically_increasing_id())
    last = W.partitionBy("id").orderBy(F.desc("file"), F.desc("row"))
    return raw.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "file", "row")


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip."""
    return spark.read.schema(schema).json(path)


def hotpot_documents(rows: DataFrame) -> DataFrame:
    """(question id, document_id, title, text, reliability) of rows with a context of titled sentences."""
    each = rows.select(F.col("id").alias("query_id"), F.posexplode("context").alias("n", "c"))
    body = F.array_join(F.filter(F.transform("c.sentences", lambda s: F.trim(s)), lambda s: s != ""), " ")
    return each.select("query_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("n").cast("string")).alias("document_id"), F.col("c.title").alias("title"), F.concat(F.col("c.title"), F.lit(". "), body).alias("text"), F.lit(0.7).alias("reliability"))


#: What the tokenizer wrote for brackets, dashes and quotes, before what it put a space, and after what.
MARKS = [("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-LCB-", "{"), ("-RCB-", "}"), ("--", "–"), ("``", '"'), ("''", '"')]
SPACED_BEFORE = [",", ".", ";", ":", "?", "!", "'s", "'d", "n't", ")", "]"]
SPACED_AFTER = ["(", "["]


def detokenize(text: Column) -> Column:
    """Brackets, dashes and quotes restored; one space less before closing marks and shortened words, and after opening ones."""
    pairs = [*MARKS, *[(f" {m}", m) for m in SPACED_BEFORE], *[(f"{m} ", m) for m in SPACED_AFTER]]
    return F.trim(reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text))


def fever_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence of a file that holds both kinds."""
    claims = rows.where("kind = 'claim'").select("id", detokenize(F.col("claim")).alias("claim"), "label", "evidence_id")
    evidence = rows.where("kind = 'evidence'").select("id", detokenize(F.col("text")).alias("text"), "synthetic")
    return claims, evidence


def exact_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all, if fewer) in order of their key: those with the smallest seeded digest of it."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("__place", place).orderBy("__place", key).limit(n).drop("__place").orderBy(key)


def tuning_sample(rows: DataFrame, key: str, test: DataFrame, n: int, seed: int) -> DataFrame:
    """A sample of the rows that are not in the test sample."""
    return exact_sample(rows.join(test.select(key), key, "left_anti"), key, n, seed)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of moderate size, read by Spark."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()["d"]


def checked_jsonl(spark: SparkSession, path: str, schema: str, digest: str) -> DataFrame:
    """`load_jsonl` of a file whose digest must be the expected one."""
    found = file_digest(spark, path)
    if found != digest:
        raise ValueError(f"{path}: its digest is {found}, not {digest}")
    return load_jsonl(spark, path, schema)


#: Fixed value: how the id of a claim that was made from another one ends.
GENERATED = "_gen"


def evidence_pairs(pairs: DataFrame) -> DataFrame:
    """One evidence row for each text of pairs (id, evidence); an original wins over one that was generated, as its id tells."""
    made = F.endswith(F.col("id").cast("string"), F.lit(GENERATED)) if "synthetic" not in pairs.columns else F.col("synthetic")
    return pairs.groupBy(F.substring(F.md5("evidence"), 1, 16).alias("evidence_id")).agg(F.min("evidence").alias("text"), F.bool_and(made).alias("synthetic"))


def bundled_documents(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """A JSON list of documents that a package brings along; those whose id is known already are left out."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return rows if known is None else rows.join(known.select("id"), "id", "left_anti")


def with_web(corpus: DataFrame, web: DataFrame) -> DataFrame:
    """Corpus and web results as one table of documents (document_id as a string); a column that either lacks is null."""
    text = lambda df: df.withColumn("document_id", F.col("document_id").cast("string"))
    return text(corpus).unionByName(text(web), allowMissingColumns=True)


def web_results(raw: DataFrame, limit: int = 6) -> DataFrame:
    """Results (query_id, position, url, title, content) as documents: http(s) with content, each URL once, the first `limit`."""
    ok = raw.where(F.col("url").rlike("^https?://") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    once = ok.withColumn("r", F.row_number().over(W.partitionBy("query_id", "url").orderBy("position"))).where("r = 1")
    kept = once.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("position"))).where(F.col("n") <= limit)
    return kept.select("query_id", F.concat(F.lit("w_"), F.substring(F.md5("url"), 1, 16)).alias("document_id"), F.substring("title", 1, 200).alias("title"), F.substring("content", 1, 2000).alias("text"), "url", F.lit("web").alias("origin"))


def upsert(documents: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those with their key; keys must be well formed."""
    good = new.where(F.col(key).cast("string").rlike(ID_PATTERN))
    return documents.join(good.select(key), key, "left_anti").unionByName(good.select(*documents.columns))


def delete(documents: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return documents.join(keys.select(key), key, "left_anti")


def valid_documents(documents: DataFrame) -> DataFrame:
    """Title of 1 to 300 characters, text of 1 to 200,000."""
    return documents.where(F.length("title").between(1, 300) & F.length("text").between(1, 200_000))


def reliability(url: Column, declared: Column, origin: Column, extra: str | None = None) -> Column:
    """Declared, else the first rule that fits the domain (own rules of a JSON object first), else the origin's default."""
    rules = [(p, min(1.0, max(0.0, float(v)))) for p, v in (json.loads(extra) if extra else {}).items()] + DOMAIN_RULES
    for p, _ in rules:
        re.compile(p)
    host, out = T.domain_of(url), F.when(origin == "web", WEB_DEFAULT).otherwise(CORPUS_DEFAULT)
    for p, v in reversed(rules):
        out = F.when((host != "") & host.rlike(p), v).otherwise(out)
    return F.coalesce(declared, out)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON line a document; Spark's commit makes the whole write visible at once."""
    documents.write.mode("overwrite").json(path)


def write_jsonl_gz(rows: DataFrame, path: str) -> None:
    """Gzip JSON lines with columns in order of their names."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("compression", "gzip").json(path)


def event_rows(events: DataFrame) -> DataFrame:
    """Server-sent event frames of (query_id, ordinal, event, data struct)."""
    return events.select("query_id", "ordinal", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.to_json("data"), F.lit("\n\n")).alias("frame"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, by kind."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
