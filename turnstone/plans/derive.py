"""Inputs for the registered queries, made from whole driver tables, and the same as SQL.

The tables hold no transcripts, so each conversation becomes one: its rows are spoken turns with cues in two
styles, and by conversation number a heading, an announcement, a second Operator turn or nothing marks the Q&A.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.lexicon import Lexicon
from turnstone.functions.text import SPACE
from turnstone.plans.schemas import CATEGORIES, PREPARED, QA

#: Phrases that occur in the tables.
LEXICON = Lexicon(
    hedging=(("to", "modal"), ("to the", "belief"), ("that", "modal"), ("por", "modal"), ("é", "modal"), ("of the that", "odds")),
    confident=(("the", "strong"), ("of the", "done"), ("of", "done"), ("der", "strong"), ("le", "strong"), ("is", "surely")),
)
#: White space and word characters in the oracle's regular expressions.
SP = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDLY = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Java pattern of this package as a quoted RE2 pattern."""
    out = pattern.replace(SPACE[1:-1], SP)
    for a, b in (("(?sU)", "(?s)"), ("(?iuU)", "(?i)"), ("(?isuU)", "(?is)"), ("(?U)", ""), (r"\A", "^"), (r"\z", "$")):
        out = out.replace(a, b)
    return quoted(out)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Both engines take this SQL; {nl} is a line feed.
_PIECE = """
concat_ws('{nl}{nl}',
  case when conv_id % 8 = 3 and turn = 0 then 'Acme Holdings - Quarterly Call{nl}Participants - many' end,
  case when conv_id % 4 = 2 and turn = 0 then 'Operator: Good day.' end,
  case when conv_id % 4 = 0 and turn = 2 then 'Questions & Answers Section:'
       when conv_id % 4 = 1 and turn = 2 then 'Operator: Thank you.{nl}We will now open the lines for questions.'
       when conv_id % 4 = 2 and turn = 2 then 'operator: Next, please.'
       when conv_id % 4 = 2 and turn = 3 then 'Operator: Next, please.' end,
  case when role = 'system' then 'Operator: ' || coalesce(text, '')
       when conv_id % 2 = 0 and role = 'user' then 'Jean-Pierre O{q}Neil,  Analyst, Acme & Co.{nl}{nl}' || coalesce(text, '')
       when conv_id % 2 = 0 then 'Susan Li, Chief Financial Officer{nl}{nl}' || coalesce(text, '')
       when role = 'user' then 'Jean-Pierre O{q}Neil: ' || coalesce(text, '')
       else 'Susan Li, Chief Financial Officer:' || coalesce(text, '') end)
"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.expr(_PIECE.replace("{nl}", "\\n").replace("{q}", "\\'")).alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "piece"))), lambda p: p["piece"])
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(pieces, "\n\n").alias("text"))


SQL_TRANSCRIPTS = "select conv_id as doc_id, string_agg(" + _PIECE.replace("'{nl}{nl}'", "chr(10) || chr(10)").replace("{nl}", "' || chr(10) || '").replace("{q}", "''") + ", chr(10) || chr(10) order by turn, role, text) as text from conversations group by conv_id"


_SPOKEN = "coalesce(text, '') || ' It''s a re-rated  outlook.'"
_SECTION = f"case when turn >= 2 then '{QA}' else '{PREPARED}' end"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("turn_number"),
        F.col("role").alias("speaker_name"), F.when(F.col("turn") % 2 == 1, "Analyst").alias("speaker_title"),
        F.expr(_SECTION).alias("section"), F.expr(_SPOKEN.replace("''s", "\\'s")).alias("text"),
    )


SQL_TURNS = f"select conv_id as doc_id, (turn + 1)::int as turn_number, role as speaker_name, case when turn % 2 = 1 then 'Analyst' end as speaker_title, {_SECTION} as section, {_SPOKEN} as text from conversations"

_START = "cast(1 + (doc_id * 7 + turn_number) % 20 as int)"
_QUOTE = f"""
case (doc_id + turn_number) % 9
  when 2 then replace(substr(text, {_START}, 40), ' ', '   ')
  when 3 then replace(right(text, 24), '''', '{{q}}')
  when 4 then replace(right(text, 24), '-', '{{d}}')
  when 5 then 'not said: ' || substr(text, {_START}, 20)
  when 6 then upper(right(text, 24))
  when 7 then ''
  else substr(text, {_START}, 40) end
"""
# claims of some documents cite no turn of the second section
_TURN = "cast(case when (doc_id + turn_number) % 11 = 0 or doc_id % 7 = 3 and turn_number > 2 then turn_number + 99 else turn_number end as int)"
_CATEGORY = "case (doc_id + 2 * turn_number) % 6 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(CATEGORIES)) + " end"
_CLAIM = f"doc_id, {{no}} as claim_no, 'Claim ' || cast(turn_number as {{text}}) || ' of ' || cast(doc_id as {{text}}) as claim_text, {_CATEGORY} as category, {_TURN} as source_turn_number, {_QUOTE} as source_quote, turn_number % 3 = 0 as confidence_flag"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim of every turn; every fifth turn's comes twice."""
    t = turns(spark, sf_dir)
    text = _CLAIM.replace("''''", "\"'\"").replace("{q}", "’").replace("{d}", "–").replace("{text}", "string")
    t = t.withColumn("again", F.explode(F.when(F.col("turn_number") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return spark.sql(f"select {text.replace('{no}', 'cast(turn_number - 1 + 1000 * again as int)')} from {{t}}", t=t)


SQL_CLAIMS = f"select {_CLAIM.replace('{q}', '’').replace('{d}', '–').replace('{text}', 'varchar').replace('{no}', '(turn_number - 1 + 1000 * again)::int')} from (select *, unnest(case when turn_number % 5 = 0 then [0, 1] else [0] end) as again from t)"

_SCORE = "cast(1 + (doc_id * 7 + claim_no * 5 + sample_no * (doc_id % 4)) % 5 as int)"


def samples(claims_: DataFrame) -> DataFrame:
    x = claims_.select("doc_id", "claim_no", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sample_no"))
    return x.withColumn("score", F.expr(_SCORE))


SQL_SAMPLES = f"select doc_id, claim_no, sample_no, {_SCORE} as score from (select doc_id, claim_no, unnest([1, 2, 3, 4, 5]) as sample_no from c)"
