"""Token usage as rows: an append-only sink, one that takes each batch once, and roll-ups by stage and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.plans.schemas import USAGE, USAGE_COUNTERS


def of_replies(replies: DataFrame) -> DataFrame:
    return replies.select("doc_id", "stage", "model", *[F.coalesce(c, F.lit(0)).alias(c) for c in USAGE_COUNTERS])


def zero_rows(docs: DataFrame, stage: str, model: str) -> DataFrame:
    """A row of zeros for each document that needed no call."""
    return docs.select("doc_id", F.lit(stage).alias("stage"), F.lit(model).alias("model"), *[F.lit(0).cast("long").alias(c) for c in USAGE_COUNTERS])


def by_stage(usage: DataFrame) -> DataFrame:
    """stage, model (null: all), calls and sums of the counters, with totals by stage and overall."""
    return usage.rollup("stage", "model").agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in USAGE_COUNTERS])


def append(usage: DataFrame, path: str) -> None:
    usage.write.mode("append").partitionBy("stage").parquet(path)


def _log(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def append_batch(usage: DataFrame, path: str, batch: int) -> bool:
    """Appends a batch once: whether this call did it.

    A batch's files have a folder of their own, which a later try of the same batch replaces; the batch counts from when its number is in
    the commit log, a file that is created or found. So a batch that is run again, after it was committed or after it died half
    way, leaves the totals as they are. What a reader sees of a batch is all or nothing (``committed``).
    """
    spark = usage.sparkSession
    fs, log = _log(spark, path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(log, str(int(batch)))
    if fs.exists(mark):
        return False
    usage.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")
    fs.mkdirs(log)
    return fs.createNewFile(mark)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """USAGE rows of the batches in the commit log, with batch. The log is one short name a batch."""
    fs, log = _log(spark, path)
    done = sorted(int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()) if fs.exists(log) else []
    if not done:
        return spark.createDataFrame([], T.StructType([*USAGE.fields, T.StructField("batch", T.IntegerType())]))
    return spark.read.schema(USAGE).option("basePath", path).parquet(*[f"{path}/batch={n}" for n in done])
