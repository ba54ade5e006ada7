"""Turns that were segmented elsewhere, with their place in the input as an ``ordinal``.

A transcript may give a turn twice; then the last one counts. A DataFrame has no order of its own, so the place is taken where
there still is one, at the source, and carried as a column that any later shuffle keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.operators.verify import ORDINAL
from turnstone.plans.schemas import TURNS


def from_arrays(calls: DataFrame, column: str = "turns") -> DataFrame:
    """Turns from an array of structs per document; the ordinal is the place in the array. Null and empty arrays have none."""
    each = calls.select("doc_id", F.posexplode(column).alias(ORDINAL, "_turn"))
    return each.select("doc_id", "_turn.*", F.col(ORDINAL).cast("long").alias(ORDINAL))


def from_files(spark: SparkSession, path: str, kind: str = "json", schema: T.StructType = TURNS, **options: str) -> DataFrame:
    """Turns from files (json lines, csv, parquet); the ordinal is file, start of the split in it, and the row's place there.

    Files go by name. Splits of a file, however large Spark cuts them, follow each other by their start, and rows of a split are read
    in order by one task, so the order does not depend on how many tasks read.
    """
    df = spark.read.format(kind).schema(schema).options(**options).load(path)
    if kind == "parquet":
        place = (F.lit(0).cast("long"), F.col("_metadata.row_index"))
    else:
        place = (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    ordinal = F.struct(F.col("_metadata.file_path").alias("file"), place[0].alias("split"), place[1].alias("row"))
    return df.select("*", ordinal.alias(ORDINAL))
