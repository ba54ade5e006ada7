"""Repeated judgment scores: two samples, five where they disagree, then median and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.plans.schemas import AGREEMENT, ALL_SAMPLES, DIMENSIONS, FIRST_SAMPLES

KEY = ["doc_id", "claim_no"]


def dimension() -> Column:
    out = F.lit(None).cast("string")
    for category, name in DIMENSIONS.items():
        out = F.when(F.col("category") == category, name).otherwise(out)
    return out


def judgment_claims(claims: DataFrame) -> DataFrame:
    """Claims of the judgment categories, with their dimension."""
    return claims.where(F.col("category").isin(*DIMENSIONS)).withColumn("dimension", dimension())


def only_judgment_claims(claims: DataFrame) -> DataFrame:
    """The same, but any other category is an error."""
    return claims.withColumn("dimension", F.coalesce(dimension(), F.raise_error(F.concat(F.lit("not a judgment category: "), F.coalesce("category", F.lit("null"))))))


def unstable(samples: DataFrame) -> DataFrame:
    """Keys whose first samples differ by more than AGREEMENT: these take the remaining samples."""
    first = samples.where(F.col("sample_no") <= FIRST_SAMPLES).groupBy(*KEY).agg((F.max("score") - F.min("score")).alias("gap"))
    return first.where(F.col("gap") > AGREEMENT).select(*KEY)


def summarize(claims: DataFrame, samples: DataFrame) -> DataFrame:
    """Judgment claims with samples (those taken, in order), median, low, high, stable, escalated.

    ``samples`` may hold all ALL_SAMPLES of every claim; a stable claim takes only its first FIRST_SAMPLES.
    """
    early = F.col("sample_no") <= FIRST_SAMPLES
    top = lambda f, c: f(F.when(c, F.col("score")))
    taken = samples.where(F.col("sample_no") <= ALL_SAMPLES)
    gaps = taken.groupBy(*KEY).agg((top(F.max, early) - top(F.min, early)).alias("gap"))
    used = taken.join(gaps, KEY).where(early | (F.col("gap") > AGREEMENT))
    by = used.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_no", "score"))), lambda s: s["score"]).alias("samples"),
        F.median("score").alias("median"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.min(F.col("gap") <= AGREEMENT).alias("stable"),
    )
    j = judgment_claims(claims).select(*KEY, "claim_text", "category", "dimension")
    return j.join(by.withColumn("escalated", ~F.col("stable")), KEY)
