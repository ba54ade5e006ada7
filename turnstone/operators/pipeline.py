"""Stages of the model-backed pipeline as compositions: extract, evaluate, revise.

Model replies are materialised (``keep``, the session's checkpoint by default) before they are read twice. Every
filter stands before the call it saves: a filter above mapInPandas is not pushed below it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.plans.schemas import ALL_SAMPLES, FIRST_SAMPLES, HIGH_VARIANCE_SPREAD, STAGES

from . import consistency, coverage, model, prompts, revise, usage, verify
from .replies import ReplyStore
from .scratch import checkpointed

Keep = Callable[[DataFrame], DataFrame]

# What the model is asked, by judgment dimension.
INSTRUCTIONS = {
    "materiality": "Rate how material the stated risk is, from 1 (a routine caveat) to 5 (severe), by its wording alone.",
    "framing": "Rate the framing, from 1 (strongly hedged) to 5 (strongly confident), by its wording alone.",
}
REVISE = "Correct the claim with a verbatim quote from the given turn, or discard it. Give a one-sentence reason."


def asked(requests: DataFrame, ask: model.Model, stage: str, name: str, max_tokens: int | None, keep: Keep, store: ReplyStore | None) -> DataFrame:
    """Replies that are read twice without a second call: materialised for this run, or kept for all runs in ``store``."""
    return store.call(requests, ask, stage, name, max_tokens) if store else keep(model.call(requests, ask, stage, name, max_tokens))


@dataclass(frozen=True)
class Extraction:
    claims: DataFrame
    dropped: DataFrame
    failed: DataFrame
    usage: DataFrame


@dataclass(frozen=True)
class Evaluation:
    faithfulness: DataFrame
    rates: DataFrame
    coverage: DataFrame
    consistency: DataFrame
    usage: DataFrame


@dataclass(frozen=True)
class Revision:
    claims: DataFrame
    outcomes: DataFrame
    faithfulness: DataFrame
    rates: DataFrame
    usage: DataFrame


def extract(turns: DataFrame, ask: model.Model = model.stub, name: str = "stub", system: str = "", keep: Keep = checkpointed, max_tokens: int | None = None, strict: bool = False, store: ReplyStore | None = None) -> Extraction:
    """Claims per document, verified against their turns. Documents without turns make no call.

    A reply that is not valid fails the query if ``strict``; else its document is among ``failed``.
    """
    requests = prompts.extraction_prompts(turns).select("doc_id", F.lit(0).alias("claim_no"), F.lit(0).alias("sample_no"), F.lit(system).alias("system"), "prompt")
    replies = asked(requests, ask, STAGES["extraction"], name, max_tokens, keep, store)
    parsed = model.strict(model.parse_claims(replies)) if strict else model.parse_claims(replies)
    gated = verify.gate(model.claim_rows(parsed), turns)
    return Extraction(verify.kept_claims(gated), verify.dropped_claims(gated), parsed.where(F.col("status") != model.OK).drop("claims"), usage.of_replies(replies))


def sample(claims: DataFrame, ask: model.Model = model.stub, name: str = "stub", keep: Keep = checkpointed, store: ReplyStore | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of judgment claims in two phases, and the replies: two of each, three more where those disagree.

    A refused or invalid sample fails the query: fewer samples than asked for would pass for agreement.
    """
    judged = consistency.judgment_claims(claims)
    system = F.lit(None).cast("string")
    for dimension, text in INSTRUCTIONS.items():
        system = F.when(F.col("dimension") == dimension, text).otherwise(system)
    base = judged.select("doc_id", "claim_no", system.alias("system"), prompts.claim_prompt().alias("prompt"))
    numbered = lambda d, a, b: d.withColumn("sample_no", F.explode(F.sequence(F.lit(a), F.lit(b))))
    replies_of = lambda d: asked(d, ask, STAGES["judging"], name, None, keep, store)
    first = replies_of(numbered(base, 1, FIRST_SAMPLES))
    again = base.join(consistency.unstable(model.strict(model.parse_scores(first))), consistency.KEY, "left_semi")
    replies = first.union(replies_of(numbered(again, FIRST_SAMPLES + 1, ALL_SAMPLES)))
    return model.strict(model.parse_scores(replies)), replies


def evaluate(docs: DataFrame, claims: DataFrame, turns: DataFrame, ask: model.Model = model.stub, name: str = "stub", keep: Keep = checkpointed, store: ReplyStore | None = None) -> Evaluation:
    """All three checks, each on its own: an unfaithful judgment claim is sampled all the same."""
    scores, replies = sample(claims, ask, name, keep, store)
    results = verify.faithfulness(claims, turns)
    return Evaluation(results, verify.faithfulness_rate(docs, results), coverage.coverage(docs, coverage.section_coverage(claims, turns)), consistency.summarize(claims, scores), usage.of_replies(replies))


def correct(docs: DataFrame, claims: DataFrame, turns: DataFrame, report: Evaluation, ask: model.Model = model.stub, name: str = "stub", spread: int = HIGH_VARIANCE_SPREAD, keep: Keep = checkpointed, max_tokens: int | None = None, store: ReplyStore | None = None) -> Revision:
    """Flagged claims corrected or discarded, one call per distinct value, and faithfulness measured again."""
    flagged = keep(revise.needing_revision(claims, report.faithfulness, report.consistency, spread))
    requested = revise.requests(flagged, turns)
    wanted = requested.where("turn_found").select("doc_id", F.col("first_no").alias("claim_no"), F.lit(0).alias("sample_no"), F.lit(REVISE).alias("system"), prompts.revision_prompt().alias("prompt"))
    replies = asked(wanted, ask, STAGES["revision"], name, max_tokens, keep, store)
    parsed = model.strict(model.parse_revisions(replies)).withColumnRenamed("claim_no", "first_no")
    found = revise.outcomes(requested, parsed)
    revised = revise.apply(claims, found)
    results = revise.recheck(revised, turns)
    return Revision(revised, found, results, verify.faithfulness_rate(docs, results), usage.of_replies(replies))
