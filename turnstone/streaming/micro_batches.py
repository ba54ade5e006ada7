"""Streaming extension: documents and claims that arrive in files, by the batch operators.

A turn's section depends on the whole document, so segmentation runs on each micro-batch of whole documents. Checks of
claims against known turns and sentence labels work row by row and stream as they are. Batches are written under their
number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from turnstone.functions.lexicon import DEFAULT, Lexicon
from turnstone.operators import hedging, segment, verify


def _start(stream: DataFrame, each, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def segment_stream(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, lexicon: Lexicon = DEFAULT) -> StreamingQuery:
    """Turns, reports and labelled sentences of documents (doc_id, text) from parquet files that arrive in ``source``."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        turns, report = segment.segment(batch)
        for name, df in (("turns", turns), ("reports", report), ("sentences", hedging.analyze(turns, lexicon))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    return _start(spark.readStream.schema(schema).parquet(source), each, checkpoint)


def check_stream(spark: SparkSession, source: str, schema: StructType, turns: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Faithfulness of arriving claims against a table of turns, as parquet by batch; a batch that is run again replaces its rows."""

    def each(batch: DataFrame, number: int) -> None:
        verify.faithfulness(batch, turns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(spark.readStream.schema(schema).parquet(source), each, checkpoint)
