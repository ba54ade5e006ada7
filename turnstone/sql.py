"""The SQL surface: functions over texts, and views over a table of documents, for sessions that write no Python.

    from turnstone import sql
    sql.install(spark, "documents")
    spark.sql("select section, ts_label(text) as label, count(*) from ts_sentences group by all")

Functions are SQL functions of the session, so Catalyst inlines them: no Python worker, and whole-stage code as with column expressions.
Views are those of the batch operators, planned when they are read.

Functions: ts_strip(text), ts_normalized(text), ts_sentences_of(text), ts_quoted_in(quote, turn_text), ts_label(text).
Views over documents (doc_id, text): ts_turns, ts_reports, ts_sentences (a row per sentence, with its label).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from turnstone.functions.lexicon import DEFAULT, Lexicon, pattern
from turnstone.functions.text import CURLY, PLAIN, SPACE
from turnstone.operators import hedging, segment
from turnstone.plans.schemas import CONFIDENT, HEDGED, UNMARKED


def _raw(s: str) -> str:
    """A string literal as it is."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def functions(lexicon: Lexicon = DEFAULT) -> dict[str, str]:
    """Signature and body of each function."""
    strip = lambda x: f"regexp_replace({x}, {_raw(rf'(?U)\A{SPACE}+|{SPACE}+\z')}, '')"
    normal = lambda x: f"trim(regexp_replace(translate({x}, {_raw(CURLY)}, {_raw(PLAIN)}), {_raw(f'(?U){SPACE}+')}, ' '))"
    parts = f"split(x, {_raw(rf'(?U)(?<=[.!?]){SPACE}+(?=[A-Z])')})"
    return {
        "ts_strip(x STRING) RETURNS STRING": strip("x"),
        "ts_normalized(x STRING) RETURNS STRING": normal("x"),
        "ts_sentences_of(x STRING) RETURNS ARRAY<STRING>": f"filter(transform({parts}, s -> {strip('s')}), s -> s <> '')",
        "ts_quoted_in(quote STRING, turn STRING) RETURNS BOOLEAN": f"coalesce(contains({normal('turn')}, {normal('quote')}), false)",
        "ts_label(x STRING) RETURNS STRING": f"CASE WHEN x RLIKE {_raw(pattern(lexicon.hedging))} THEN '{HEDGED}' WHEN x RLIKE {_raw(pattern(lexicon.confident))} THEN '{CONFIDENT}' ELSE '{UNMARKED}' END",
    }


def install(spark: SparkSession, documents: str | None = None, lexicon: Lexicon = DEFAULT) -> None:
    """Creates the functions, and the views over table or view ``documents`` if it is given."""
    for signature, body in functions(lexicon).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    if documents:
        turns, reports = segment.segment(spark.table(documents).select("doc_id", "text"))
        for name, df in (("ts_turns", turns), ("ts_reports", reports), ("ts_sentences", hedging.analyze(turns, lexicon))):
            df.createOrReplaceTempView(name)
