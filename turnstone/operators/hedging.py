"""Sentence labels from the phrase lexicon: hedged if any hedge, else confident if any sure phrase, else unmarked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions import phrase_index
from turnstone.functions.lexicon import DEFAULT, HEDGING, SURE, Lexicon, matches
from turnstone.functions.text import sentences, strip
from turnstone.plans.schemas import CONFIDENT, HEDGED, UNMARKED

from .scratch import checkpointed


def classify(df: DataFrame, column: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``df`` with hedge_matches, confident_matches (phrase, category) and label; the text itself is stripped."""
    d = df.withColumn(column, strip(column))
    d = d.withColumns({"hedge_matches": matches(column, lexicon.hedging), "confident_matches": matches(column, lexicon.confident)})
    return d.withColumn("label", F.when(F.size("hedge_matches") > 0, HEDGED).when(F.size("confident_matches") > 0, CONFIDENT).otherwise(UNMARKED))


def classify_indexed(df: DataFrame, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """``classify`` by a lexicon of any size, as a table of LEXICON rows: phrases are found by joins, not by one pattern."""
    d = df.withColumns({column: strip(column), "_row": F.monotonically_increasing_id()})
    # the number of a row must be the same for both readers of the texts
    d = checkpointed(d)
    # the lexicon is measured, and read by two joins
    phrases = checkpointed(phrase_index.index(lexicon))
    found = phrase_index.matches(d, "_row", column, phrases, (HEDGING, SURE)).drop("_row")
    found = found.withColumnsRenamed({HEDGING: "hedge_matches", SURE: "confident_matches"})
    return found.withColumn("label", F.when(F.size("hedge_matches") > 0, HEDGED).when(F.size("confident_matches") > 0, CONFIDENT).otherwise(UNMARKED))


def split_turns(turns: DataFrame) -> DataFrame:
    """One row per sentence: the turn's columns but its text, sent_no from 0, text."""
    rest = [c for c in turns.columns if c != "text"]
    return turns.select(*rest, F.posexplode(sentences("text")).alias("sent_no", "text"))


def analyze(turns: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    return classify(split_turns(turns), "text", lexicon)


def claim_labels(claims: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Claims with the label of their source quote."""
    quoted = classify(claims.withColumn("_quote", F.coalesce("source_quote", F.lit(""))), "_quote", lexicon)
    return quoted.select(*claims.columns, F.col("label").alias("quote_label"))
