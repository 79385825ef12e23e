"""What the operators of this subpackage share: tables, shared storage, column names, words."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold this many rows at most, so that long texts keep a batch small.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: documents may be very long, and a batch is held in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`; where unset, a temporary one in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='proofsearch-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: work is kept once, lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what `materialise` stored, once nothing reads it any more."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of steps that are over; else they stay until the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, with texts as strings and ids as longs."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
    return docs.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in names])


def hash01(*cols: Column) -> Column:
    """A deterministic number in [0, 1) from a row's columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))
