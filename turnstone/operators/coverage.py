"""Section coverage: which sections of a transcript have claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .verify import last_turns


def section_coverage(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """doc_id, section, first_turn, covered: one row per section that a document has. Unknown turns cover nothing; of turns
    that share a number the last one's section is covered."""
    present = turns.groupBy("doc_id", "section").agg(F.min("turn_number").alias("first_turn"))
    cited = claims.select("doc_id", F.col("source_turn_number").alias("turn_number")).distinct()
    covered = last_turns(turns).join(cited, ["doc_id", "turn_number"], "left_semi").select("doc_id", "section").distinct().withColumn("_c", F.lit(True))
    return present.join(covered, ["doc_id", "section"], "left").select("doc_id", "section", "first_turn", F.coalesce("_c", F.lit(False)).alias("covered"))


def coverage(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, sections_present, sections_covered, sections_missing (in order of first appearance), passed."""
    kept = F.array_sort(F.collect_list(F.struct("first_turn", "section", "covered")))
    by = sections.groupBy("doc_id").agg(kept.alias("s"))
    names = lambda test: F.transform(F.filter("s", test), lambda x: x["section"])
    empty = F.array().cast("array<string>")
    d = docs.select("doc_id").distinct().join(by, "doc_id", "left")
    d = d.select("doc_id", *[F.coalesce(names(t), empty).alias(n) for n, t in (("sections_present", lambda x: F.lit(True)), ("sections_covered", lambda x: x["covered"]), ("sections_missing", lambda x: ~x["covered"]))])
    return d.withColumn("passed", F.size("sections_missing") == 0)
