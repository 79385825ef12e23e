"""Evaluation: systems' rankings and answers measured question by question, collected, compared, reported."""

from __future__ import annotations

import json
import time
import tracemalloc
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics, retrieval

#: Watts of a busy core, where the machine's own meter cannot be read.
CORE_WATTS = 15.0


def distinct_titles(ranked: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, title, rank): the ranking (query_id, document_id, rank) by titles, each at its first place."""
    first = ranked.join(titles.select("document_id", "title"), "document_id").groupBy("query_id", "title").agg(F.min("rank").alias("at"))
    return first.select("query_id", "title", F.row_number().over(W.partitionBy("query_id").orderBy("at", "title")).alias("rank"))


def retrieval_rows(rankings: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (2, 5), within: int = 10) -> DataFrame:
    """(query_id, system, metric, value): recall and all-found at each cut, and reciprocal rank, of each system's ranking.

    `rankings` has (system, query_id, document_id, rank), `gold` (query_id, document_id).
    """
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = n.join(F.broadcast(rankings.select("system").distinct()))  # a handful of systems
    hits = rankings.join(gold, ["query_id", "document_id"])
    found = hits.groupBy("system", "query_id").agg(F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in cuts])
    out = asked.join(found, ["system", "query_id"], "left").na.fill(0, [f"h{k}" for k in cuts])
    rows = [F.struct(F.lit(f"recall@{k}").alias("metric"), F.round(F.col(f"h{k}") / F.col("n"), 6).alias("value")) for k in cuts]
    rows += [F.struct(F.lit(f"all@{k}").alias("metric"), (F.col(f"h{k}") == F.col("n")).cast("double").alias("value")) for k in cuts]
    rows.append(F.struct(F.lit(f"mrr@{within}").alias("metric"), F.round(F.when(F.col("first") <= within, 1 / F.col("first")).otherwise(0.0), 6).alias("value")))
    return out.select("query_id", "system", F.explode(F.array(*rows)).alias("m")).select("query_id", "system", "m.metric", "m.value")


def answer_rows(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, system, metric, value): answered, and whether the gold answer (query_id, answer) stands in the top one
    (system, query_id, answer), of all questions and of those answered; yes and no are not looked for."""
    both = answers.withColumnRenamed("answer", "prediction").join(gold.withColumnRenamed("answer", "gold"), "query_id")
    keyed = both.withColumn("id", F.concat_ws("|", "system", F.col("query_id").cast("string")))
    told = metrics.answer_f1(keyed.select("id", F.coalesce("prediction", F.lit("")).alias("prediction"), "gold")).select("id", F.col("contained").cast("double").alias("hit"))
    given = F.col("prediction").isNotNull()
    open_ = ~F.lower(F.trim("gold")).isin("yes", "no")
    rows = F.array(F.struct(F.lit("answered").alias("metric"), given.cast("double").alias("value")), F.struct(F.lit("answer_in_top").alias("metric"), F.when(open_, F.col("hit")).alias("value")), F.struct(F.lit("answer_in_top_when_answered").alias("metric"), F.when(open_ & given, F.col("hit")).alias("value")))
    return keyed.join(told, "id").select("query_id", "system", F.explode(rows).alias("m")).select("query_id", "system", "m.metric", "m.value").where("value IS NOT NULL")


def collected(rows: DataFrame, errors: DataFrame | None = None, base: str = "bm25") -> DataFrame:
    """(metric, system, n, mean, difference): values (query_id, system, metric, value) of questions without an error
    (query_id) in any system, and the mean difference from the base system over the same questions."""
    if errors is not None:
        rows = rows.join(errors.select("query_id").distinct(), "query_id", "left_anti")
    own = rows.where(F.col("system") == base).select("query_id", "metric", F.col("value").alias("base"))
    both = rows.join(own, ["query_id", "metric"], "left")
    return both.groupBy("metric", "system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.col("value") - F.col("base")) + 0.0, 6).alias("difference"))


def intervals(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(key: metric and system, mean, low, high) over seeded resamples."""
    return metrics.bootstrap(rows.withColumn("key", F.concat_ws("|", "metric", "system")), "key", "value", seed)


def grid(lexical: DataFrame, vectors: DataFrame, gold: DataFrame, weights: tuple[float, ...] = (1.0, 0.25, 0.1, 0.0), top_k: int = 10) -> DataFrame:
    """(vector_weight, metric, mean in percent): both lists are made once, and fused under each weight."""
    rankings = None
    for w in weights:  # a fixed handful of settings
        found = retrieval.fuse(lexical, vectors, top_k, retrieval.RetrievalParams(vector_weight=w)).select(F.lit(str(w)).alias("system"), "query_id", "document_id", "rank")
        rankings = found if rankings is None else rankings.unionByName(found)
    return retrieval_rows(rankings, gold).groupBy(F.col("system").alias("vector_weight"), "metric").agg(F.round(100 * F.avg("value"), 1).alias("mean"))


def histogram(rows: DataFrame, label: str) -> DataFrame:
    """(label, n)."""
    return rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def meter_summary(calls: DataFrame, by: str, watts: float = CORE_WATTS) -> DataFrame:
    """Latency percentiles, CPU, energy, tokens and cost a query of measured calls (by, latency_ms, cpu_s, tokens, cost);
    the cost is unknown as soon as one is."""
    n = F.count(F.lit(1))
    return calls.groupBy(by).agg(
        n.alias("queries"),
        F.round(F.percentile("latency_ms", 0.5), 2).alias("p50"),
        F.round(F.percentile("latency_ms", 0.95), 2).alias("p95"),
        F.round(F.avg("latency_ms"), 2).alias("mean"),
        F.round(F.sum("cpu_s") * 1000 / n, 2).alias("cpu_ms"),
        F.round(F.sum("cpu_s") * watts / 3600 * 1000 / n, 5).alias("energy_mwh"),
        F.round(F.sum("tokens") / n, 1).alias("tokens"),
        F.when(~F.bool_or(F.col("cost").isNull()), F.round(F.sum("cost") / n, 6)).alias("cost"),
    )


@dataclass
class Meter:
    """Wall clock, CPU and Python's peak memory around actions; `rows` are what `meter_summary` reads."""

    system: str
    rows: list[tuple] = field(default_factory=list)
    peak_mb: float = 0.0

    def __enter__(self) -> Meter:
        tracemalloc.start()
        self._began = time.perf_counter(), time.process_time()
        return self

    def __exit__(self, *_) -> None:
        wall, cpu = time.perf_counter() - self._began[0], time.process_time() - self._began[1]
        self.peak_mb = max(self.peak_mb, tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        self.rows.append((self.system, 1000 * wall, cpu))


def markdown(report: DataFrame) -> str:
    """A collected report, a row for each metric and system (a handful), as a table."""
    lines = ["| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    for r in report.orderBy(*report.columns[:2]).collect():
        lines.append("| " + " | ".join("" if v is None else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON and as a table in text, through Spark's writers; an existing one is replaced."""
    spark = report.sparkSession
    report.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    spark.createDataFrame([(markdown(report),)], "text string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def write_replays(events: DataFrame, path: str) -> None:
    """Events (query_id, ordinal, event, data) as JSON lines in a folder for each question, and an index of the questions."""
    events.repartition("query_id").sortWithinPartitions("query_id", "ordinal").write.mode("overwrite").partitionBy("query_id").json(f"{path}/events")
    events.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def parse_object(text: str) -> dict | None:
    """The JSON object between a text's first and last brace; None if there is none."""
    a, b = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None
