"""Texts sent to the model: turns, claims and revision requests rendered as strings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREAMBLE = "Extract the claims of the following transcript turns."


def without_front_matter(text: str) -> str:
    """Text after a leading block between two --- marks, stripped, if there is one."""
    if text.startswith("---"):
        end = text.find("---", 3)
        return text[end + 3 :].strip() if end >= 0 else text
    return text


def system_prompt(instructions: str | Path, categories: str | Path) -> list[dict]:
    """Two blocks: instructions, and categories with the marker that lets a provider cache what precedes it."""
    read = lambda p: Path(p).read_text(encoding="utf-8")
    return [{"type": "text", "text": without_front_matter(read(instructions))}, {"type": "text", "text": read(categories), "cache_control": {"type": "ephemeral"}}]


def turn_block() -> Column:
    who = F.concat("speaker_name", F.coalesce(F.concat(F.lit(", "), "speaker_title"), F.lit("")))
    return F.concat(F.lit("[Turn "), F.col("turn_number").cast("string"), F.lit(" | "), "section", F.lit(" | "), who, F.lit("]\n"), "text")


def extraction_prompts(turns: DataFrame) -> DataFrame:
    """doc_id, prompt: the turns of a document in order, a blank line between them. No turns, no prompt."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn_number", turn_block().alias("block")))), lambda t: t["block"])
    return turns.groupBy("doc_id").agg(F.concat(F.lit(PREAMBLE + "\n\n"), F.array_join(blocks, "\n\n")).alias("prompt"))


def claim_prompt() -> Column:
    return F.format_string('Claim: %s\nQuote: "%s"', F.col("claim_text"), F.col("source_quote"))


def revision_prompt() -> Column:
    """For rows with the claim's fields, contexts (array of strings) and turn_text."""
    listed = F.array_join(F.transform("contexts", lambda c: F.concat(F.lit("- "), c)), "\n")
    return F.format_string("Claim: %s\nCategory: %s\nQuote: %s\nProblems:\n%s\nTurn %s:\n%s", F.col("claim_text"), F.col("category"), F.col("source_quote"), listed, F.col("source_turn_number").cast("string"), F.col("turn_text"))
