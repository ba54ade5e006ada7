"""Helpers shared by the training-data operators: tables, scratch storage, connected classes."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and tab to carriage return; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
LEAST_SHARDS, DOCUMENTS_A_SHARD, BROADCAST_NODES = 1024, 16_000, 1_000_000
BYTES_A_SHARD, BATCH_BYTES = 32 << 20, 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, where executors see each other's files.

    Only a session without one on this machine alone (tests) gets a temporary one: on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnstone-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, now and not at some later time.

    Called where a large shuffle is done with.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker, by rows and by bytes.

    Set for the session, as Spark reads it when a result is computed, which is after the operator returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shard_count(docs: DataFrame) -> int:
    """Shards for text that is dealt by hashes: so many that one holds what some thousand documents, or so many bytes
    of text, send to it."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return min(1 << 22, max(LEAST_SHARDS, 1 << int(max(rows // DOCUMENTS_A_SHARD, (size or 0) // BYTES_A_SHARD)).bit_length()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns node, component.

    Alternating large-star and small-star contraction: each round rewires edges towards the smallest
    neighbour, so a hub's edges are rewritten one row at a time and no neighbourhood is collected in a task.
    Ends when a round changes nothing, after some log^2 of the nodes at most. Edges may repeat, be loops, or come in either order.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    state = None

    def least_neighbours(e: DataFrame) -> DataFrame:
        """k, m: the smallest smaller neighbour of each node that has one. Cut off, so that the joins below stand
        directly on their shuffles, where Spark splits a hub's rows; below a size, they need no shuffle."""
        low = cut(e.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
        return F.broadcast(low) if low.count() <= BROADCAST_NODES else low

    while True:
        # large star: every larger neighbour u of v is linked to v's smallest neighbour, or v itself
        star = e.join(least_neighbours(e), F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))
        e = cut(star.union(e.groupBy("u").agg(F.min("v").alias("v"))).distinct())
        # small star: every smaller neighbour of u, and u itself, is linked to the smallest of them
        star = e.join(least_neighbours(e), F.col("u") == F.col("k"))
        e = star.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        e = cut(e)
        # bit_xor and sum make a cheap, order-free digest of the edge set
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
