"""Claims against the turns they cite: the extraction gate (exact) and faithfulness (normalised).

Both are one left join of claims with turns on (doc_id, turn). A missing turn fails; a null quote fails; an empty
quote is contained in any turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.text import normalized, preview

ORDINAL = "ordinal"
KEPT, NO_TURN, NO_QUOTE = "kept", "turn_missing", "quote_not_found"


def last_turns(turns: DataFrame, order: str | None = None) -> DataFrame:
    """doc_id, turn_number, section, text with one row per turn: of several that share a number the last.

    The last is by ``order``, or by the ``ordinal`` that turns carry from their source (``sources.turns``), never by where rows
    happen to lie. Turns that neither tells apart must agree; two that differ fail the query. One exchange and one sort, by the
    keys that a join with claims needs as well.
    """
    order = order or (ORDINAL if ORDINAL in turns.columns else None)
    place = F.lit(0) if order is None else F.col(order)
    t = turns.select("doc_id", "turn_number", "section", "text", place.alias("_place"), F.xxhash64("section", "text").alias("_content"))
    w = Window.partitionBy("doc_id", "turn_number").orderBy(F.col("_place").desc_nulls_last(), "_content")
    t = t.withColumns({"_no": F.row_number().over(w), "_same": F.lead("_place").over(w).eqNullSafe(F.col("_place")), "_other": F.lead("_content").over(w) != F.col("_content")})
    clash = F.coalesce(F.col("_same") & F.col("_other"), F.lit(False))
    error = F.raise_error(F.format_string("turn %s of document %s repeats, and no ordinal says which is last", F.col("turn_number").cast("string"), F.col("doc_id").cast("string")))
    return t.where("_no = 1").where(F.when(clash, error).otherwise(True)).select("doc_id", "turn_number", "section", "text")


def cited(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """Claims with turn_found, turn_section and turn_text. Of turns that share a number the last counts (``last_turns``)."""
    t = last_turns(turns).select(F.col("doc_id").alias("_doc"), F.col("turn_number").alias("_turn"), F.col("section").alias("turn_section"), F.col("text").alias("turn_text"), F.lit(True).alias("_found"))
    both = claims.join(t, (claims["doc_id"] == t["_doc"]) & (claims["source_turn_number"] == t["_turn"]), "left")
    return both.select(*claims.columns, F.coalesce("_found", F.lit(False)).alias("turn_found"), "turn_section", "turn_text")


def _status(contained: Column) -> Column:
    return F.when(~F.col("turn_found"), NO_TURN).when(F.coalesce(contained, F.lit(False)), KEPT).otherwise(NO_QUOTE)


def gate(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """Claims with status (kept, turn_missing or quote_not_found) and warning, by exact containment."""
    x = cited(claims, turns).withColumn("status", _status(F.contains("turn_text", "source_quote")))
    start = preview("claim_text")
    warning = F.when(F.col("status") == NO_TURN, F.format_string("dropped claim citing missing turn %s: %s", F.col("source_turn_number").cast("string"), start)).when(F.col("status") == NO_QUOTE, F.format_string("dropped claim whose quote is not in turn %s: %s", F.col("source_turn_number").cast("string"), start))
    return x.withColumn("warning", warning).select(*claims.columns, "status", "warning")


def kept_claims(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("status") == KEPT).drop("status", "warning")


def dropped_claims(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("status") != KEPT)


def faithfulness(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """Claims with passed and reason (null if passed), by containment after normalisation."""
    x = cited(claims, turns).withColumn("_status", _status(F.contains(normalized("turn_text"), normalized("source_quote"))))
    return x.select(*claims.columns, (F.col("_status") == KEPT).alias("passed"), F.when(F.col("_status") != KEPT, F.col("_status")).alias("reason"))


def faithfulness_rate(docs: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, total, passed, failed, rate for every document of ``docs``; the rate without claims is 1."""
    by = results.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    d = docs.select("doc_id").distinct().join(by, "doc_id", "left").select("doc_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("passed", F.lit(0)).alias("passed"))
    return d.select("doc_id", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.coalesce(F.col("passed") / F.nullif("total", F.lit(0)), F.lit(1.0)).alias("rate"))
