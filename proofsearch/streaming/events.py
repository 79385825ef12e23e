"""The stateful operators as streams: quotas in event-time windows, click priors in keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.state import COVARIANCE, FORGETTING, PRIOR


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream; times become TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def quota_counts(requests: DataFrame, window: str, late: str = "10 minutes") -> DataFrame:
    """(key, window_start, n): requests of each key in fixed windows; a window is given out when it can't change."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", window), "key").agg(F.count(F.lit(1)).alias("n"))
    return w.select("key", F.col("window.start").alias("window_start"), "n")


def click_priors(clicks: DataFrame) -> DataFrame:
    """(facet, prior, n) after each batch: recursive least squares in keyed state, events of a batch in time order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches, state: GroupState):
        p, cov, n = state.get if state.exists else (PRIOR, COVARIANCE, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for y in rows["y"]:
            k = cov / (FORGETTING + cov)
            p, cov, n = min(1.0, max(0.0, p + k * (y - p))), min(1e3, max(1e-4, (1 - k) * cov / FORGETTING)), n + 1
        state.update((p, cov, n))
        yield pd.DataFrame({"facet": [key[0]], "prior": [round(p, 6)], "n": [n]})

    return clicks.groupBy("facet").applyInPandasWithState(update, "facet string, prior double, n long", "p double, cov double, n long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """All that is there now, into a table in memory of that name; for files that grow, start the stream itself."""
    writer: DataStreamWriter = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = writer.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
