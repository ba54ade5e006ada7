"""Report export: one Markdown text per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(results: DataFrame) -> DataFrame:
    """doc_id, body from faithfulness results."""
    line = F.concat(F.lit("- ["), F.when(F.col("passed"), "x").otherwise(" "), F.lit("] "), "claim_text", F.lit(" (turn "), F.col("source_turn_number").cast("string"), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("claim_no", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\nFaithfulness: "), F.col("n_passed").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit("\n\n"))
    by = results.groupBy("doc_id").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n"), F.array_join(lines, "\n").alias("lines"))
    return by.select("doc_id", F.concat(head, "lines").alias("body"))


def write(reports: DataFrame, path: str, buckets: int = 64) -> None:
    """JSON lines (doc_id, body) in folders by a hash of doc_id: their number does not grow with the documents."""
    where = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    reports.select("doc_id", "body", where).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)
