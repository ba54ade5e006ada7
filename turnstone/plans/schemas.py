"""Table schemas and the constants that define results. Every table is keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
SECTIONS = PREPARED, QA = ("Prepared Remarks", "Q&A")
LABELS = HEDGED, CONFIDENT, UNMARKED = ("hedged", "confident", "unmarked")
CATEGORIES = ("financial_performance", "guidance", "risk_factors", "segment_performance", "non_gaap_vs_gaap", "hedging_tone")
DIMENSIONS = {"risk_factors": "materiality", "hedging_tone": "framing"}
STAGES = {"extraction": "extraction", "judging": "eval_consistency", "revision": "revision"}
REPLY_CAPS = {"extraction": 8192, "eval_consistency": 512, "revision": 4096}
MIN_CHARS_PER_PAGE = 50
MIN_TURNS = 2
FIRST_SAMPLES, ALL_SAMPLES, AGREEMENT = 2, 5, 1
HIGH_VARIANCE_SPREAD = 2
PREVIEW_CHARS = 60
SCORES = (1, 5)
REASONS = ("unfaithful_quote", "high_variance_judgment")
ACTIONS = ("corrected", "discard")


def _table(**fields: str) -> T.StructType:
    kinds = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


DOCUMENTS = _table(doc_id="BIGINT", source_path="STRING", page_count="INT", text="STRING")
TURNS = _table(doc_id="BIGINT", turn_number="INT", speaker_name="STRING", speaker_title="STRING", section="STRING", text="STRING")
CLAIM_FIELDS = {"claim_text": "STRING", "category": "STRING", "source_turn_number": "INT", "source_quote": "STRING", "confidence_flag": "BOOLEAN"}
CLAIMS = _table(doc_id="BIGINT", claim_no="INT", **CLAIM_FIELDS)
SAMPLES = _table(doc_id="BIGINT", claim_no="INT", sample_no="INT", score="INT")
USAGE_COUNTERS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
USAGE = _table(doc_id="BIGINT", stage="STRING", model="STRING", **dict.fromkeys(USAGE_COUNTERS, "BIGINT"))
REPLIES = _table(doc_id="BIGINT", claim_no="INT", sample_no="INT", stage="STRING", model="STRING", body="STRING", stop_reason="STRING", **dict.fromkeys(USAGE_COUNTERS, "BIGINT"))
LEXICON = _table(bucket="STRING", category="STRING", phrase="STRING", ord="INT")

#: What a reply body must hold, by stage.
EXTRACTION_BODY = "STRUCT<claims: ARRAY<STRUCT<" + ", ".join(f"{k}: {v}" for k, v in CLAIM_FIELDS.items()) + ">>>"
JUDGING_BODY = "STRUCT<score: INT, rationale: STRING>"
REVISION_BODY = "STRUCT<action: STRING, claim_text: STRING, category: STRING, source_quote: STRING, confidence_flag: BOOLEAN, reasoning: STRING>"
