"""The model plug-in: requests as rows, replies as rows, and strict parsing of reply bodies.

A model is a function from a list of request dicts to a list of reply dicts (body, stop_reason and counters, each may
be missing); it is called in batches inside mapInPandas, so its client is made on the executor. Callers
materialise replies before they use them more than once: a recomputed stage would repeat paid calls.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.plans.schemas import ACTIONS, CATEGORIES, EXTRACTION_BODY, JUDGING_BODY, REPLIES, REPLY_CAPS, REVISION_BODY, SCORES, USAGE_COUNTERS

Model = Callable[[list[dict]], list[dict]]
OK, REFUSED, INVALID = "ok", "no_reply", "invalid_reply"


def call(requests: DataFrame, model: Model, stage: str, name: str, max_tokens: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Reply rows (REPLIES) for request rows (doc_id, claim_no, sample_no, system, prompt). Filter requests before.

    ``carry``: string columns of the requests that go along with the replies.
    """
    cap = max_tokens or REPLY_CAPS[stage]
    schema = T.StructType([*REPLIES.fields, *(T.StructField(c, T.StringType()) for c in carry)])

    def run(frames):
        for f in frames:
            asked = [r | {"stage": stage, "model": name, "max_tokens": cap} for r in f.to_dict("records")]
            got = model(asked) if asked else []
            rows = [{c: q[c] for c in carry} | {"doc_id": q["doc_id"], "claim_no": q["claim_no"], "sample_no": q["sample_no"], "stage": stage, "model": name, "body": r.get("body"), "stop_reason": r.get("stop_reason"), **{c: r.get(c) or 0 for c in USAGE_COUNTERS}} for q, r in zip(asked, got, strict=True)]
            out = pd.DataFrame(rows, columns=schema.fieldNames())
            yield out.astype({c: "int64" for c in ("doc_id", *USAGE_COUNTERS)} | {c: "Int32" for c in ("claim_no", "sample_no")})

    return requests.select("doc_id", F.col("claim_no").cast("int"), F.col("sample_no").cast("int"), "system", "prompt", *carry).mapInPandas(run, schema)


def _parsed(replies: DataFrame, schema: str, valid: Column) -> DataFrame:
    """Replies with reply (struct) and status; a reply is valid as a whole or not at all."""
    full = schema[:-1] + ", _corrupt: STRING>"
    x = replies.withColumn("reply", F.from_json("body", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("reply").isNotNull() & F.col("reply._corrupt").isNull() & F.coalesce(valid, F.lit(False))
    return x.withColumn("status", F.when(F.col("body").isNull(), REFUSED).when(good, OK).otherwise(INVALID))


def parse_claims(replies: DataFrame) -> DataFrame:
    """One row per reply: status, and claims (array) of valid ones."""
    whole = F.forall("reply.claims", lambda c: c["claim_text"].isNotNull() & F.coalesce(c["category"].isin(*CATEGORIES), F.lit(False)) & c["source_turn_number"].isNotNull() & c["source_quote"].isNotNull() & c["confidence_flag"].isNotNull())
    x = _parsed(replies, EXTRACTION_BODY, F.col("reply.claims").isNotNull() & whole)
    return x.withColumn("claims", F.when(F.col("status") == OK, F.col("reply.claims"))).drop("reply")


def claim_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == OK).select("doc_id", F.posexplode("claims").alias("claim_no", "c")).select("doc_id", "claim_no", "c.*")


def parse_scores(replies: DataFrame) -> DataFrame:
    x = _parsed(replies, JUDGING_BODY, F.col("reply.score").between(*SCORES) & F.col("reply.rationale").isNotNull())
    return x.withColumn("score", F.when(F.col("status") == OK, F.col("reply.score"))).drop("reply")


def parse_revisions(replies: DataFrame) -> DataFrame:
    """Revision replies with their fields; a correction needs all of them, a discard only its reasoning."""
    r = F.col("reply")
    full = r["claim_text"].isNotNull() & F.coalesce(r["category"].isin(*CATEGORIES), F.lit(False)) & r["source_quote"].isNotNull() & r["confidence_flag"].isNotNull()
    valid = r["reasoning"].isNotNull() & (((r["action"] == ACTIONS[0]) & full) | (r["action"] == ACTIONS[1]))
    x = _parsed(replies, REVISION_BODY, valid)
    return x.select(*[c for c in x.columns if c != "reply"], *[F.when(F.col("status") == OK, r[c]).alias(c) for c in ("action", "claim_text", "category", "source_quote", "confidence_flag", "reasoning")])


def strict(parsed: DataFrame) -> DataFrame:
    """Fails the query on the first reply that is not valid, with its stage, status and stop reason."""
    what = F.format_string("%s: %s (%s)", F.col("stage"), F.col("status"), F.coalesce("stop_reason", F.lit("unknown")))
    # as a filter, which stands whatever columns are read
    return parsed.where(F.when(F.col("status") == OK, True).otherwise(F.raise_error(what)))


def stub(requests: list[dict]) -> list[dict]:
    """A deterministic model without a network: no claims, middle scores, and discards."""
    out = []
    for q in requests:
        body = {"extraction": {"claims": []}, "eval_consistency": {"score": 3, "rationale": "stub"}, "revision": {"action": "discard", "reasoning": "stub"}}[q["stage"]]
        out.append({"body": json.dumps(body), "stop_reason": "end_turn", "input_tokens": len(q["prompt"]) // 4, "output_tokens": 16})
    return out
