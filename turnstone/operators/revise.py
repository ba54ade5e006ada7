"""Revision: which claims need it and why, what became of them, and the list of claims afterwards.

Claims are matched with their check results by (doc_id, claim_no). Claims of one document with equal fields are one
value: one revision, applied to all of them. A claim whose turn is missing is discarded without a call.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.plans.schemas import ACTIONS, CLAIM_FIELDS, DIMENSIONS, HIGH_VARIANCE_SPREAD, REASONS

from .verify import cited, faithfulness

VALUE = ["doc_id", *CLAIM_FIELDS]
CORRECTED, DISCARD = ACTIONS
UNFAITHFUL, HIGH_VARIANCE = REASONS


def unmatched(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Keys that only one side has: empty when results belong to these claims."""
    key = ["doc_id", "claim_no"]
    a, b = claims.select(*key), results.select(*key)
    return a.join(b, key, "left_anti").union(b.join(a, key, "left_anti"))


def needing_revision(claims: DataFrame, results: DataFrame, consistency: DataFrame, spread: int = HIGH_VARIANCE_SPREAD) -> DataFrame:
    """Distinct claim values with reasons and contexts: unfaithful ones first, then those of high variance.

    ``results`` has a row for each claim and ``consistency`` one for each judgment claim; anything else is an error. A claim that lacks its
    row is seen by the joins that fetch the reasons; rows without a claim are counted by anti-joins, whose sums are one number each. All
    joins are by (doc_id, claim_no), and over tables bucketed by doc_id none of them shuffles.
    """
    key = ["doc_id", "claim_no"]
    ask = lambda what: F.raise_error(F.lit(f"{what} do not match the claims"))
    faithful, scored = ask("faithfulness results"), ask("consistency results")
    judged = F.coalesce(F.col("category").isin(*DIMENSIONS), F.lit(False))
    told = F.format_string("%s scores %s, median %s, range %s to %s", F.col("dimension"), F.array_join("samples", ","), F.col("median").cast("string"), F.col("low").cast("string"), F.col("high").cast("string"))
    bad = results.select(*key, F.col("passed").alias("_passed"), F.col("reason").alias("_reason"), F.lit(True).alias("_has_result"))
    wide = consistency.select(*key, (F.col("escalated") & (F.col("high") - F.col("low") >= spread)).alias("_wide"), told.alias("_told"), F.lit(True).alias("_has_scores"))
    x = claims.join(bad, key, "left").join(wide, key, "left")
    why = F.array_compact(F.array(
        F.when(F.col("_has_result").isNull(), faithful).when(~F.col("_passed"), F.struct(F.lit(0).alias("kind"), F.col("claim_no").alias("claim_no"), F.lit(UNFAITHFUL).alias("why"), F.col("_reason").alias("context"))),
        F.when(F.col("_has_scores").isNotNull() != judged, scored).when(F.col("_wide"), F.struct(F.lit(1).alias("kind"), F.col("claim_no").alias("claim_no"), F.lit(HIGH_VARIANCE).alias("why"), F.col("_told").alias("context"))),
    ))
    x = x.select(*VALUE, "claim_no", why.alias("_why"))
    for rows, error in ((bad, faithful), (wide, scored)):
        strays = rows.join(claims.select(*key), key, "left_anti").agg(F.count("*")).scalar()
        x = x.where(F.when(strays > 0, error).otherwise(True))
    by = x.select(*VALUE, F.explode("_why").alias("_why")).groupBy(*VALUE).agg(F.array_sort(F.collect_list("_why")).alias("all"), F.min("_why.claim_no").alias("first_no"))
    return by.select(*VALUE, "first_no", F.transform("all", lambda x: x["why"]).alias("reasons"), F.transform("all", lambda x: x["context"]).alias("contexts"))


def requests(flagged: DataFrame, turns: DataFrame) -> DataFrame:
    """Flagged claims with turn_found and the text of their turn; those whose turn is missing are not to be asked about."""
    return cited(flagged, turns)


def outcomes(requested: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row per flagged value: reasons, action, the corrected fields, reasoning. A claim without its turn is discarded.

    ``revisions`` (doc_id, first_no, action, claim_text, category, source_quote, confidence_flag, reasoning) has a
    row for each of ``requested`` whose turn was found. The turn number is the original's.
    """
    fields = [c for c in CLAIM_FIELDS if c != "source_turn_number"]
    new = revisions.select("doc_id", "first_no", F.col("action").alias("_action"), *[F.col(c).alias(f"new_{c}") for c in fields], F.col("reasoning").alias("_reasoning"))
    both = requested.join(new, ["doc_id", "first_no"], "left").where(~F.col("turn_found") | F.col("_action").isNotNull())
    both = both.withColumns({
        "action": F.when(F.col("turn_found"), F.col("_action")).otherwise(DISCARD),
        "reasoning": F.when(F.col("turn_found"), F.col("_reasoning")).otherwise("the cited turn does not exist"),
    })
    return both.select(*VALUE, "first_no", "reasons", "action", *[F.when(F.col("action") == CORRECTED, F.col(f"new_{c}")).alias(f"new_{c}") for c in fields], "reasoning")


def apply(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Claims in their order: untouched, replaced, or left out."""
    fields = [c for c in CLAIM_FIELDS if c != "source_turn_number"]
    c, o = claims.alias("c"), found.alias("o")
    both = c.join(o, reduce(and_, [F.col("c.doc_id") == F.col("o.doc_id"), *[F.col(f"c.{v}").eqNullSafe(F.col(f"o.{v}")) for v in CLAIM_FIELDS]]), "left").where(F.coalesce("o.action", F.lit("keep")) != DISCARD)
    new = F.col("o.action") == CORRECTED
    value = {x: F.when(new, F.col(f"o.new_{x}")).otherwise(F.col(f"c.{x}")) for x in fields} | {"source_turn_number": F.col("c.source_turn_number")}
    return both.select("c.doc_id", "c.claim_no", *[value[x].alias(x) for x in CLAIM_FIELDS], F.coalesce(new, F.lit(False)).alias("was_revised"))


def recheck(revised: DataFrame, turns: DataFrame) -> DataFrame:
    return faithfulness(revised, turns)
