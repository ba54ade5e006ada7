"""Claims, turns and what is known of them as tables bucketed by document, so that checks and revision join without a shuffle.

All joins, windows and aggregations of the checks are by doc_id and something more: rows that are bucketed by doc_id alone are already
where each of them needs its rows. Spark takes that for aggregations and windows by itself; for joins it has to be told that some of the
keys will do (``colocate``), as it otherwise asks for all of them.

Buckets are whole documents. Of documents that hold a large share of all rows Spark cannot split a bucketed scan's tasks: then read the
same tables without the layout (``spark.sql.sources.bucketing.enabled`` = false), where joins are by (doc_id, turn) and skew is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Joins may stand on a part of their keys.
SOME_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def colocate(spark: SparkSession, on: bool = True) -> None:
    """Set for the session, as Spark reads it when a query is planned."""
    spark.conf.set(SOME_KEYS, str(not on).lower())


def save(df: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as table ``name``, bucketed and sorted by doc_id, one file a bucket; under ``path``, else in the warehouse."""
    writer = df.repartition(buckets, "doc_id").write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)
