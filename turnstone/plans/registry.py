"""Queries over the operators of this package, with the SQL that computes the same rows."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone import sql as sql_functions
from turnstone.functions.lexicon import DEFAULT, HEDGING, SURE, file_lines, parse_lines, to_table
from turnstone.functions.text import CURLY, PLAIN, chars_per_page, sentences
from turnstone.operators import consistency as cons
from turnstone.operators import coverage as cov
from turnstone.operators import hedging, model, pipeline, prompts, revise, scratch, segment, usage, verify
from turnstone.operators.replies import ReplyStore
from turnstone.plans import derive
from turnstone.plans.derive import SP, quoted, re2, sql_strip
from turnstone.plans.schemas import CONFIDENT, DIMENSIONS, HEDGED, HIGH_VARIANCE_SPREAD, MIN_CHARS_PER_PAGE, PREPARED, QA, UNMARKED
from turnstone.sources import layout
from turnstone.sources.documents import decoded
from turnstone.sources.report import markdown
from turnstone.sources.turns import from_arrays

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query; one that writes files has no SQL and is tested against the query that does not."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# Claims against turns.

_NORM = lambda x: f"trim(regexp_replace(translate({x}, {quoted(CURLY)}, {quoted(PLAIN)}), '[{SP}]+', ' ', 'g'), ' ')"
_CHECK = f"""with t as ({derive.SQL_TURNS}), c as ({derive.SQL_CLAIMS}),
f as (select c.*, case when t.doc_id is null then 'turn_missing' when contains({_NORM("t.text")}, {_NORM("c.source_quote")}) then 'kept' else 'quote_not_found' end as found,
  case when t.doc_id is null then 'turn_missing' when contains(t.text, c.source_quote) then 'kept' else 'quote_not_found' end as status, t.text as turn_text
  from c left join t on c.doc_id = t.doc_id and c.source_turn_number = t.turn_number)
"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derive.claims(spark, sf_dir), derive.turns(spark, sf_dir)


@query(_CHECK + """select doc_id, count(f.claim_no)::bigint as total, count(*) filter (found = 'kept')::bigint as passed,
  (count(f.claim_no) - count(*) filter (found = 'kept'))::bigint as failed,
  coalesce(count(*) filter (found = 'kept')::double / nullif(count(f.claim_no), 0), 1.0)::double as rate
from (select distinct doc_id from documents union select distinct doc_id from t) left join f using (doc_id) group by doc_id""")  # fmt: skip
def faithfulness_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without claims have a rate of 1."""
    c, t = _inputs(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").union(t.select("doc_id"))
    return verify.faithfulness_rate(docs, verify.faithfulness(c, t))


@query(_CHECK + "select doc_id, claim_no, found = 'kept' as passed, case when found <> 'kept' then found end as reason from f")
def faithfulness_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.faithfulness(*_inputs(spark, sf_dir)).select("doc_id", "claim_no", "passed", "reason")


@query(_CHECK + "select doc_id, claim_no, claim_text, category, source_turn_number, source_quote, confidence_flag from f where status = 'kept'")
def claims_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.kept_claims(verify.gate(*_inputs(spark, sf_dir)))


@query(_CHECK + """select doc_id, claim_no, status, case status when 'turn_missing' then 'dropped claim citing missing turn ' else 'dropped claim whose quote is not in turn ' end
  || source_turn_number || ': ' || substr(claim_text, 1, 60) as warning from f where status <> 'kept'""")  # fmt: skip
def claims_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.dropped_claims(verify.gate(*_inputs(spark, sf_dir))).select("doc_id", "claim_no", "status", "warning")


_COVER = f"""with t as ({derive.SQL_TURNS}), c as ({derive.SQL_CLAIMS}),
s as (select doc_id, section, min(turn_number) as first_turn, bool_or(turn_number in (select source_turn_number from c where c.doc_id = t.doc_id)) as covered from t group by all)
"""


@query(_COVER + """select doc_id, string_agg(section, ',' order by first_turn) as present, coalesce(string_agg(section, ',' order by first_turn) filter (covered), '') as covered,
  coalesce(string_agg(section, ',' order by first_turn) filter (not covered), '') as missing, bool_and(covered) as passed from s group by doc_id""")  # fmt: skip
def coverage_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = _inputs(spark, sf_dir)
    out = cov.coverage(t, cov.section_coverage(c, t))
    return out.select("doc_id", *[F.array_join(f"sections_{n}", ",").alias(n) for n in ("present", "covered", "missing")], "passed")


@query(_COVER + "select doc_id, section, first_turn from s where not covered")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.section_coverage(*_inputs(spark, sf_dir)).where("not covered").select("doc_id", "section", "first_turn")


# Segmentation.

_LINES = f"""with recursive tx as ({derive.SQL_TRANSCRIPTS}),
raw as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10)))))::int as pos from tx),
st as (select doc_id, pos, {sql_strip("raw")} as line from raw),
bl as (select *, count(*) filter (line = '') over (partition by doc_id order by pos)::bigint as block from st),
ln as (select * from bl where line <> '')
"""
_CUES = _LINES + f""", k1 as (select *, count(*) over (partition by doc_id, block) as block_size, regexp_matches(line, {re2(segment.HEADING)}) as is_heading from ln),
k2 as (select *, not is_heading and regexp_matches(line, {re2(segment.INLINE)}) as is_inline, not is_heading and block_size = 1 and regexp_matches(line, {re2(segment.HEADER)}) as is_header from k1),
cue as (select *, is_inline or is_header as is_cue, (count(*) filter (is_inline or is_header) over (partition by doc_id order by pos))::int as turn_no from k2)
"""
_DRAFTS = _CUES + f""", sd as (select *,
  {sql_strip(f"case when is_inline then regexp_extract(line, {re2(segment.INLINE)}, 1) when is_header then regexp_extract(line, {re2(segment.HEADER)}, 1) end")} as name,
  {sql_strip(f"case when is_inline then case when regexp_matches(line, {re2(segment.TITLED)}) then regexp_extract(line, {re2(segment.INLINE)}, 2) end when is_header then regexp_extract(line, {re2(segment.HEADER)}, 2) end")} as title,
  {sql_strip(f"case when is_heading or is_header then '' when is_inline then regexp_extract(line, {re2(segment.INLINE)}, 3) else line end")} as said from cue),
dr as (select doc_id, turn_no, max(name) filter (is_cue) as name, max(title) filter (is_cue) as title, {sql_strip("coalesce(string_agg(said, ' ' order by pos) filter (said <> ''), '')")} as text,
  count(*) filter (is_heading) as headings, count(*) filter (turn_no = 0 and not is_heading) as front_lines, min_by(line, pos) filter (turn_no = 0 and not is_heading) as front_first
  from sd group by doc_id, turn_no),
b1 as (select doc_id, coalesce(max(turn_no) filter (turn_no > 0), 0) as n_turns, max(front_lines) as front_lines, max(front_first) as front_first,
  min(turn_no) filter (turn_no > 0 and lower(name) = 'operator' and regexp_matches(text, {re2(segment.ANNOUNCES)})) as keyword,
  (list(turn_no order by turn_no) filter (turn_no > 0 and lower(name) = 'operator'))[2] as second from dr group by doc_id),
hd as (select doc_id, max(turn_no + 1) as heading from dr join b1 using (doc_id) where headings > 0 and turn_no + 1 <= n_turns group by doc_id),
bd as (select tx.doc_id, coalesce(n_turns, 0) as n_turns, coalesce(front_lines, 0) as front_lines, front_first, coalesce(heading, keyword, second) as boundary,
  case when heading is not null then 'heading' when keyword is not null then 'keyword' when second is not null then 'second_operator' end as boundary_by
  from (select distinct doc_id from tx) tx left join b1 using (doc_id) left join hd using (doc_id))
"""


@query(_LINES + "select doc_id, pos, line, block from ln")
def lines_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.lines(derive.transcripts(spark, sf_dir))


@query(_CUES + "select doc_id, pos, is_heading, is_inline, is_header, turn_no from cue where is_cue or is_heading")
def cue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = segment.cue_lines(derive.transcripts(spark, sf_dir)).where("is_cue or is_heading")
    return x.select("doc_id", "pos", "is_heading", "is_inline", "is_header", "turn_no")


@query(_DRAFTS + f"""select doc_id, turn_no as turn_number, name as speaker_name, title as speaker_title,
  case when turn_no >= boundary then '{QA}' else '{PREPARED}' end as section, text from dr join bd using (doc_id) where turn_no > 0""")  # fmt: skip
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(derive.transcripts(spark, sf_dir))[0]


@query(_DRAFTS + "select doc_id, n_turns, coalesce(boundary, 0) as qa_boundary_turn, coalesce(boundary_by, 'none') as boundary_by from bd")
def qa_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 where there is no boundary."""
    report = segment.segment(derive.transcripts(spark, sf_dir))[1]
    return report.select("doc_id", "n_turns", F.coalesce("qa_boundary_turn", F.lit(0)).alias("qa_boundary_turn"), F.coalesce("boundary_by", F.lit("none")).alias("boundary_by"))


@query(_DRAFTS + """select doc_id, boundary is null or n_turns < 2 as low_confidence, concat_ws(',', case when front_lines > 0 then 'front_matter_skipped' end,
  case when boundary_by = 'second_operator' then 'weak_boundary' end, case when boundary is null then 'no_boundary' end, case when n_turns < 2 then 'few_turns' end) as warnings from bd""")  # fmt: skip
def seg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(derive.transcripts(spark, sf_dir))[1].select("doc_id", "low_confidence", F.array_join("warnings", ",").alias("warnings"))


@query(_DRAFTS + "select doc_id, front_lines::bigint as front_lines, substr(front_first, 1, 60) as front_preview from bd where front_lines > 0")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(derive.transcripts(spark, sf_dir))[1].where("front_lines > 0").select("doc_id", "front_lines", "front_preview")


# Sentences and labels, over conversations and over whole documents.


def _split_sql(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?])[{SP}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


def _hits_sql(entries: tuple, x: str) -> str:
    """Whole phrases in their order: every other character than a word's is doubled, so that neighbours do not share one."""
    w = derive.WORDLY
    phrases = [re.sub(r"(\W)", r"\1\1", p) for p in sorted((p for p, _ in entries), key=len, reverse=True)]
    doubled = f"'  ' || regexp_replace({x}, '([^{w}])', '\\1\\1', 'g') || '  '"
    hits = f"regexp_extract_all({doubled}, {quoted(f'(?i)[^{w}](' + '|'.join(phrases) + f')[^{w}]')}, 1)"
    return f"list_transform({hits}, lambda s: lower(replace(replace(s, '  ', ' '), '--', '-')))"


def _found_sql(entries: tuple, x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({_hits_sql(entries, x)})), ',')"


_LABELLED = f"""with t as ({derive.SQL_TURNS}), s0 as (select doc_id, turn_number, section, {_split_sql("text")} as s from t),
s1 as (select doc_id, turn_number, section, unnest(s) as text, unnest(range(len(s)))::int as sent_no from s0),
s2 as (select *, {_found_sql(derive.LEXICON.hedging, "text")} as hedges, {_found_sql(derive.LEXICON.confident, "text")} as sures from s1),
lb as (select *, case when hedges <> '' then '{HEDGED}' when sures <> '' then '{CONFIDENT}' else '{UNMARKED}' end as label from s2)
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hedging.analyze(derive.turns(spark, sf_dir), derive.LEXICON)


@query(_LABELLED + "select doc_id, turn_number, sent_no, text from s1")
def turn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hedging.split_turns(derive.turns(spark, sf_dir)).select("doc_id", "turn_number", "sent_no", "text")


@query(f"with s as (select doc_id, {_split_sql('coalesce(text, chr(32))')} as s from documents) select doc_id, len(s)::int as n_sentences, md5(array_to_string(s, chr(10))) as digest from s")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query(_LABELLED + "select doc_id, turn_number, sent_no, label, hedges, sures from lb")
def sentence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda c: F.array_join(F.array_sort(F.transform(c, lambda m: m["phrase"])), ",")
    return _labelled(spark, sf_dir).select("doc_id", "turn_number", "sent_no", "label", names("hedge_matches").alias("hedges"), names("confident_matches").alias("sures"))


_CATEGORY_SQL = "case phrase " + " ".join(f"when {quoted(p)} then {quoted(c)}" for p, c in derive.LEXICON.hedging + derive.LEXICON.confident) + " end"


@query(_LABELLED + f""", pm as (select 'hedging' as bucket, unnest(string_split(hedges, ',')) as phrase from lb union all select 'confident', unnest(string_split(sures, ',')) from lb)
select bucket, {_CATEGORY_SQL} as category, phrase, count(*)::bigint as n_sentences from pm where phrase <> '' group by all""")  # fmt: skip
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _labelled(spark, sf_dir)
    each = [x.select(F.lit(b).alias("bucket"), F.explode(c).alias("m")) for b, c in (("hedging", "hedge_matches"), ("confident", "confident_matches"))]
    return each[0].union(each[1]).select("bucket", "m.category", "m.phrase").groupBy("bucket", "category", "phrase").agg(F.count("*").alias("n_sentences"))


@query(_LABELLED + "select section, label, count(*)::bigint as n_sentences from lb group by all")
def label_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("section", "label").agg(F.count("*").alias("n_sentences"))


@query(f"""with t as ({derive.SQL_TURNS}), c as ({derive.SQL_CLAIMS}), m as (select doc_id, claim_no, {_found_sql(derive.LEXICON.hedging, sql_strip("source_quote"))} as h, {_found_sql(derive.LEXICON.confident, sql_strip("source_quote"))} as s from c)
select doc_id, claim_no, case when h <> '' then '{HEDGED}' when s <> '' then '{CONFIDENT}' else '{UNMARKED}' end as quote_label from m""")  # fmt: skip
def claim_hedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hedging.claim_labels(derive.claims(spark, sf_dir), derive.LEXICON).select("doc_id", "claim_no", "quote_label")


# Scores and revision.

_DIMENSION = "case category " + " ".join(f"when '{c}' then '{d}'" for c, d in DIMENSIONS.items()) + " end"
_SCORES = _CHECK.rstrip() + f""", sm as ({derive.SQL_SAMPLES}), gp as (select doc_id, claim_no, max(score) filter (sample_no <= 2) - min(score) filter (sample_no <= 2) as gap from sm group by all),
cs as (select doc_id, claim_no, {_DIMENSION.replace("category", "any_value(category)")} as dimension, string_agg(score, ',' order by sample_no) as samples, median(score) as median, min(score) as low, max(score) as high, any_value(gap) <= 1 as stable
  from sm join gp using (doc_id, claim_no) join c using (doc_id, claim_no) where category in ('risk_factors', 'hedging_tone') and (sample_no <= 2 or gap > 1) group by doc_id, claim_no)
"""


def _consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derive.claims(spark, sf_dir)
    return cons.summarize(c, derive.samples(c))


@query(_SCORES + "select doc_id, claim_no, dimension, samples, median, low, high, stable, not stable as escalated from cs")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consistency(spark, sf_dir).select("doc_id", "claim_no", "dimension", F.array_join("samples", ",").alias("samples"), "median", "low", "high", "stable", "escalated")


@query(_SCORES + "select doc_id, claim_no, high - low as spread, high - low >= 2 as to_revise from cs where not stable")
def consistency_escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.col("high") - F.col("low")
    return _consistency(spark, sf_dir).where("escalated").select("doc_id", "claim_no", spread.alias("spread"), (spread >= HIGH_VARIANCE_SPREAD).alias("to_revise"))


_VALUE = "doc_id, claim_text, category, source_turn_number, source_quote, confidence_flag"
_FLAGGED = _SCORES + f""", wy as (select f.*, 0 as kind, 'unfaithful_quote' as why from f where found <> 'kept' union all
  select f.*, 1, 'high_variance_judgment' from f join cs using (doc_id, claim_no) where not stable and high - low >= 2),
fl as (select {_VALUE}, any_value(turn_text) as turn_text, min(claim_no) as first_no, string_agg(why, ',' order by kind, claim_no) as reasons from wy group by {_VALUE}),
oc as (select *, case when turn_text is null or first_no % 3 = 0 then 'discard' else 'corrected' end as action, case when turn_text is null then 'the cited turn does not exist' else 'by rule' end as reasoning,
  case when first_no % 3 = 1 then substr(turn_text, 1, 30) else 'still wrong' end as new_quote from fl),
rv as (select f.doc_id, f.claim_no, case when action = 'corrected' then 'revised: ' || f.claim_text else f.claim_text end as claim_text, f.category, f.source_turn_number,
  case when action = 'corrected' then new_quote else f.source_quote end as source_quote, f.confidence_flag, coalesce(action = 'corrected', false) as was_revised, f.turn_text
  from f left join oc on {" and ".join(f"f.{v} is not distinct from oc.{v}" for v in _VALUE.split(", "))} where coalesce(action, 'keep') <> 'discard')
"""


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, t = _inputs(spark, sf_dir)
    return c, t, revise.needing_revision(c, verify.faithfulness(c, t), cons.summarize(c, derive.samples(c)))


def _outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corrections by a rule in place of a model."""
    c, t, flagged = _flagged(spark, sf_dir)
    asked = revise.requests(flagged, t)
    fixed = asked.where("turn_found").select(
        "doc_id", "first_no", F.when(F.col("first_no") % 3 == 0, "discard").otherwise("corrected").alias("action"),
        F.concat(F.lit("revised: "), "claim_text").alias("claim_text"), "category",
        F.when(F.col("first_no") % 3 == 1, F.substring("turn_text", 1, 30)).otherwise("still wrong").alias("source_quote"),
        "confidence_flag", F.lit("by rule").alias("reasoning"),
    )
    return c, t, revise.outcomes(asked, fixed)


@query(_FLAGGED + "select doc_id, claim_text, first_no, reasons from fl")
def claims_to_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir)[2].select("doc_id", "claim_text", "first_no", F.array_join("reasons", ",").alias("reasons"))


@query(_FLAGGED + "select doc_id, claim_text, first_no, action, reasoning from oc")
def revision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)[2].select("doc_id", "claim_text", "first_no", "action", "reasoning")


@query(_FLAGGED + "select doc_id, claim_no, claim_text, category, source_turn_number, source_quote, confidence_flag, was_revised from rv")
def revised_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, found = _outcomes(spark, sf_dir)
    return revise.apply(c, found)


@query(_FLAGGED + f"select doc_id, claim_no, coalesce(contains({_NORM('turn_text')}, {_NORM('source_quote')}), false) as passed from rv")
def post_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, found = _outcomes(spark, sf_dir)
    return revise.recheck(revise.apply(c, found), t).select("doc_id", "claim_no", "passed")


# Usage, text gate, prompts, report.


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = F.element_at(F.array(*map(F.lit, ("extraction", "eval_consistency", "revision"))), (F.col("doc_id") % 3 + 1).cast("int"))
    n = F.length("text").cast("long")
    return d.select("doc_id", stage.alias("stage"), F.when(F.col("doc_id") % 2 == 0, "strong").otherwise("cheap").alias("model"), n.alias("input_tokens"), (n % 97).alias("output_tokens"), F.when(F.col("doc_id") % 5 == 0, n).alias("cache_creation_input_tokens"), F.lit(None).cast("long").alias("cache_read_input_tokens"))


@query("""with u as (select ['extraction', 'eval_consistency', 'revision'][doc_id % 3 + 1] as stage, case when doc_id % 2 = 0 then 'strong' else 'cheap' end as model,
  length(text) as i, length(text) % 97 as o, case when doc_id % 5 = 0 then length(text) end as w from documents)
select stage, model, count(*)::bigint as calls, sum(coalesce(i, 0))::bigint as input_tokens, sum(coalesce(o, 0))::bigint as output_tokens, sum(coalesce(w, 0))::bigint as cache_creation_input_tokens, 0::bigint as cache_read_input_tokens
from u group by rollup (stage, model)""")  # fmt: skip
def usage_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_stage(_usage(spark, sf_dir))


@query(f"""with p as (select doc_id, case when doc_id % 97 = 0 then 0 else 1 + doc_id % 40 end::int as page_count, length({sql_strip("coalesce(text, '')")}) as n from documents)
select doc_id, page_count, case when page_count = 0 then 'zero_pages' when n < {MIN_CHARS_PER_PAGE} * page_count then 'no_text_layer' else 'ok' end as status from p""")  # fmt: skip
def doc_text_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnstone.sources.documents import gate

    pages = F.when(F.col("doc_id") % 97 == 0, 0).otherwise(1 + F.col("doc_id") % 40).cast("int")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", pages.alias("page_count"), F.coalesce("text", F.lit("")).alias("text"))
    return gate(d).select("doc_id", "page_count", "status")


@query(f"with p as (select doc_id, count(*) filter (length({sql_strip('coalesce(text, chr(32))')}) >= 100) as dense, avg(length({sql_strip('coalesce(text, chr(32))')}))::double as chars_per_page from documents group by doc_id) select doc_id, chars_per_page, dense::bigint as dense from p")
def chars_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", chars_per_page(F.coalesce("text", F.lit("")), F.lit(1)).alias("n"))
    return d.groupBy("doc_id").agg(F.avg("n").alias("chars_per_page"), F.count_if(F.col("n") >= 100).alias("dense"))


_BLOCK = "'[Turn ' || turn_number || ' | ' || section || ' | ' || speaker_name || coalesce(', ' || speaker_title, '') || ']' || chr(10) || text"


@query(f"with t as ({derive.SQL_TURNS}), p as (select doc_id, {quoted(prompts.PREAMBLE)} || chr(10) || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) order by turn_number) as prompt from t group by doc_id) select doc_id, length(prompt)::int as n_chars, md5(prompt) as digest from p")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts.extraction_prompts(derive.turns(spark, sf_dir))
    return p.select("doc_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query(_CHECK + """, rp as (select doc_id, '# Document ' || doc_id || chr(10) || chr(10) || 'Faithfulness: ' || count(*) filter (found = 'kept') || ' of ' || count(*) || chr(10) || chr(10)
  || string_agg('- [' || case when found = 'kept' then 'x' else ' ' end || '] ' || claim_text || ' (turn ' || source_turn_number || ')', chr(10) order by claim_no) as body from f group by doc_id)
select doc_id, length(body)::int as n_chars, md5(body) as digest from rp""")  # fmt: skip
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = markdown(verify.faithfulness(*_inputs(spark, sf_dir)))
    return body.select("doc_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


# Replies of models: bodies of every kind, by document number.

_BODIES = {
    "extraction": (
        ('{"claims": []}', "ok"),
        ('{"claims": [{"claim_text": "a", "category": "guidance", "source_turn_number": 2, "source_quote": "q", "confidence_flag": true}]}', "ok"),
        ('{"claims": [{"claim_text": "a", "category": "weather", "source_turn_number": 2, "source_quote": "q", "confidence_flag": true}]}', "invalid_reply"),
        ('{"claims": [{"claim_text": "a", "category": "guidance", "source_quote": "q", "confidence_flag": true}]}', "invalid_reply"),
        ('{"claims": [{"claim_text": "a", "cat', "invalid_reply"),
        (None, "no_reply"),
        ('{"claims": [{"claim_text": "a", "category": "guidance", "source_turn_number": "two", "source_quote": "q", "confidence_flag": true}]}', "invalid_reply"),
        ("{}", "invalid_reply"),
    ),
    "eval_consistency": (
        ('{"score": 1, "rationale": "r"}', "ok"), ('{"score": 5, "rationale": ""}', "ok"), ('{"score": 0, "rationale": "r"}', "invalid_reply"), ('{"score": 6, "rationale": "r"}', "invalid_reply"),
        ('{"score": 3}', "invalid_reply"), (None, "no_reply"), ("three", "invalid_reply"), ('{"score": 3, "rationale": "r"', "invalid_reply"),
    ),
    "revision": (
        ('{"action": "discard", "reasoning": "r"}', "ok"), ('{"action": "discard"}', "invalid_reply"), ('{"action": "keep", "reasoning": "r"}', "invalid_reply"), (None, "no_reply"),
        ('{"action": "corrected", "claim_text": "a", "category": "guidance", "source_quote": "q", "confidence_flag": false, "reasoning": "r"}', "ok"),
        ('{"action": "corrected", "claim_text": "a", "category": "guidance", "confidence_flag": false, "reasoning": "r"}', "invalid_reply"),
        ('{"action": "corrected", "claim_text": "a", "category": "weather", "source_quote": "q", "confidence_flag": false, "reasoning": "r"}', "invalid_reply"),
        ("[]", "invalid_reply"),
    ),
}


def _replies(spark: SparkSession, sf_dir: str, stage: str) -> DataFrame:
    body = F.element_at(F.array(*[F.lit(b) for b, _ in _BODIES[stage]]), (F.col("doc_id") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(0).alias("claim_no"), F.lit(1).alias("sample_no"), F.lit(stage).alias("stage"), body.alias("body"), F.lit("end_turn").alias("stop_reason"))


def _statuses(stage: str) -> str:
    return f"[{', '.join(quoted(x) for _, x in _BODIES[stage])}][doc_id % 8 + 1]"


@query(f"select doc_id, {_statuses('extraction')} as status, case doc_id % 8 when 0 then 0 when 1 then 1 end::int as n_claims from documents")
def reply_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.parse_claims(_replies(spark, sf_dir, "extraction")).select("doc_id", "status", F.when(F.col("claims").isNotNull(), F.size("claims")).alias("n_claims"))


@query(f"select doc_id, {_statuses('eval_consistency')} as status, case doc_id % 8 when 0 then 1 when 1 then 5 end::int as score from documents")
def reply_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.parse_scores(_replies(spark, sf_dir, "eval_consistency")).select("doc_id", "status", "score")


@query(f"select doc_id, {_statuses('revision')} as status, case doc_id % 8 when 0 then 'discard' when 4 then 'corrected' end as action, case when doc_id % 8 = 4 then 'q' end as source_quote from documents")
def reply_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.parse_revisions(_replies(spark, sf_dir, "revision")).select("doc_id", "status", "action", "source_quote")


# The stages with a model by rule: calls, strict replies, and what becomes of the claims.


def _by_rule(asked: list[dict]) -> list[dict]:
    """Claims of the second and of a missing turn; scores and corrections as the queries above derive them."""
    out = []
    for q in asked:
        doc, no = q["doc_id"], q["claim_no"]
        if q["stage"] == "extraction":
            claim = {"claim_text": "c", "category": "guidance", "confidence_flag": True}
            found = [(2, "re-rated  outlook"), (2, "re-rated outlook"), (99, "re-rated"), (1, "")]
            body = {"claims": [claim | {"source_turn_number": t, "source_quote": x} for t, x in found]}
        elif q["stage"] == "eval_consistency":
            body = {"score": 1 + (doc * 7 + no * 5 + q["sample_no"] * (doc % 4)) % 5, "rationale": "by rule"}
        else:
            fields = dict(line.split(": ", 1) for line in q["prompt"].split("\n", 2)[:2])
            said = q["prompt"].split("\nTurn ", 1)[1].split(":\n", 1)[1]
            body = {"action": "discard", "reasoning": "by rule"}
            if no % 3:
                body |= {"action": "corrected", "claim_text": "revised: " + fields["Claim"], "category": fields["Category"], "source_quote": said[:30] if no % 3 == 1 else "still wrong", "confidence_flag": _turn_of(fields["Claim"]) % 3 == 0}
        out.append({"body": json.dumps(body), "stop_reason": "end_turn", "input_tokens": len(q["prompt"]), "output_tokens": no})
    return out


def _turn_of(claim: str) -> int:
    return int(claim.split(" ")[1])


@query(f"""with t as ({derive.SQL_TURNS}), c(claim_no, turn_number, quote) as (values (0, 2, 're-rated  outlook'), (1, 2, 're-rated outlook'), (2, 99, 're-rated'), (3, 1, '')),
k as (select t.doc_id, c.claim_no from t join c using (turn_number) where contains(t.text, c.quote)) select d.doc_id, c.claim_no, case when k.doc_id is not null then 'kept'
  when c.turn_number in (select turn_number from t where t.doc_id = d.doc_id) then 'quote_not_found' else 'turn_missing' end as status from (select distinct doc_id from t) d cross join c left join k on k.doc_id = d.doc_id and k.claim_no = c.claim_no""")  # fmt: skip
def extracted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.extract(derive.turns(spark, sf_dir), _by_rule, "rule", strict=True)
    return found.claims.select("doc_id", "claim_no", F.lit(verify.KEPT).alias("status")).union(found.dropped.select("doc_id", "claim_no", "status"))


@query(ORACLE["consistency"])
def consistency_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phases of model calls in place of given samples."""
    c = derive.claims(spark, sf_dir)
    scores, _ = pipeline.sample(c, _by_rule, "rule")
    return cons.summarize(c, scores).select("doc_id", "claim_no", "dimension", F.array_join("samples", ",").alias("samples"), "median", "low", "high", "stable", "escalated")


def _corrected(spark: SparkSession, sf_dir: str) -> pipeline.Revision:
    c, t = _inputs(spark, sf_dir)
    docs = t.select("doc_id").distinct()
    return pipeline.correct(docs, c, t, pipeline.evaluate(docs, c, t, _by_rule, "rule"), _by_rule, "rule")


@query(ORACLE["revised_claims"])
def corrected_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation and revision as one pipeline of model calls."""
    return _corrected(spark, sf_dir).claims


@query(_FLAGGED + f"""select doc_id, count(rv.claim_no)::bigint as total, count(*) filter (contains({_NORM('turn_text')}, {_NORM('source_quote')}))::bigint as passed from (select distinct doc_id from t) left join rv using (doc_id) group by doc_id""")
def corrected_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir).rates.select("doc_id", "total", "passed")


# Guards, prompts and the default phrases.


@query(_SCORES + f"select doc_id, claim_no, {_DIMENSION} as dimension from c where category in ('risk_factors', 'hedging_tone')")
def judgment_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any other category would be an error."""
    return cons.only_judgment_claims(cons.judgment_claims(derive.claims(spark, sf_dir))).select("doc_id", "claim_no", "dimension")


@query(_CHECK + "select doc_id, claim_no from c where source_turn_number % 4 = 0 union all select doc_id, claim_no + 5000 from c where source_turn_number % 4 = 1")
def unmatched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only the claims, or only the results, have."""
    c, t = _inputs(spark, sf_dir)
    r = verify.faithfulness(c, t)
    other = r.where("source_turn_number % 4 = 1").withColumn("claim_no", F.col("claim_no") + 5000)
    return revise.unmatched(c, r.where("source_turn_number % 4 <> 0").union(other))


@query(f"with c as ({derive.SQL_CLAIMS.replace('from t)', f'from ({derive.SQL_TURNS}))')}) select doc_id, claim_no, md5('Claim: ' || claim_text || chr(10) || 'Quote: \"' || source_quote || '\"') as digest from c")
def claim_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.claims(spark, sf_dir).select("doc_id", "claim_no", F.md5(prompts.claim_prompt()).alias("digest"))


@query(_CHECK + """select doc_id, claim_no, md5('Claim: ' || claim_text || chr(10) || 'Category: ' || category || chr(10) || 'Quote: ' || source_quote || chr(10) || 'Problems:' || chr(10) || '- ' || found || chr(10) || '- again' || chr(10)
  || 'Turn ' || source_turn_number || ':' || chr(10) || turn_text) as digest from f where found = 'quote_not_found'""")  # fmt: skip
def revision_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = _inputs(spark, sf_dir)
    bad = verify.faithfulness(c, t).where("reason = 'quote_not_found'").withColumn("contexts", F.array("reason", F.lit("again")))
    return verify.cited(bad, t).select("doc_id", "claim_no", F.md5(prompts.revision_prompt()).alias("digest"))


@query("select doc_id, 'extraction' as stage, 'none' as model, 0::bigint as input_tokens, 0::bigint as output_tokens, 0::bigint as cache_creation_input_tokens, 0::bigint as cache_read_input_tokens from documents where doc_id not in (select conv_id from conversations)")
def uncalled_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without turns make no call: their usage is a row of zeros."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return usage.zero_rows(d.join(derive.turns(spark, sf_dir), "doc_id", "left_anti"), "extraction", "none")


_PHRASES = [p for p, _ in DEFAULT.hedging + DEFAULT.confident]
_PLANTED = f"'Then ' || case when doc_id % 2 = 0 then upper(p) else p end || case when doc_id % 3 = 0 then 'x' when doc_id % 3 = 1 then ', it said' else '.' end"
_PLANTED_SQL = f"with d as (select doc_id, [{', '.join(map(quoted, _PHRASES))}][doc_id % {len(_PHRASES)} + 1] as p from documents), t as (select doc_id, {_PLANTED} as text from d)"


@query(_PLANTED_SQL + f""", m as (select doc_id, {_found_sql(DEFAULT.hedging, "text")} as hedges, {_found_sql(DEFAULT.confident, "text")} as sures from t)
select *, case when hedges <> '' then '{HEDGED}' when sures <> '' then '{CONFIDENT}' else '{UNMARKED}' end as label from m""")  # fmt: skip
def default_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each default phrase planted, in two cases, as a word of its own and as part of a longer one."""
    p = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % len(_PHRASES) + 1).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", p.alias("p")).select("doc_id", F.expr(_PLANTED).alias("text"))
    names = lambda c: F.array_join(F.array_sort(F.transform(c, lambda m: m["phrase"])), ",")
    return hedging.classify(d).select("doc_id", "label", names("hedge_matches").alias("hedges"), names("confident_matches").alias("sures"))


_DEFAULT_ROWS = "(values " + ", ".join(f"({quoted(b)}, {quoted(c)}, {quoted(p)}, {i})" for b, c, p, i in DEFAULT.rows()) + ") v(bucket, category, phrase, ord)"


@query(f"select bucket, category, phrase, ord, count(d.doc_id)::bigint as n_documents from {_DEFAULT_ROWS} left join documents d on contains(lower(d.text), phrase) group by all")
def default_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default phrases, and how many documents hold each as a string, word boundaries aside."""
    # lower-cased below the generator: inside the filter it would be done again for every phrase
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lower("text").alias("low"))
    found = F.filter(F.array(*map(F.lit, dict.fromkeys(_PHRASES))), lambda p: F.contains("low", p))
    n = texts.select(F.explode(found).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    return to_table(spark, DEFAULT).join(n, "phrase", "left").select("bucket", "category", "phrase", "ord", F.coalesce("n", F.lit(0)).alias("n_documents"))


_PAGES = "case when doc_id % 7 = 3 then '' else coalesce(text, '') || {ff} || coalesce(source, '') end"


@query(f"""with p as (select doc_id, case when doc_id % 5 <> 1 then {_PAGES.format(ff='chr(12)')} end as text from documents),
q as (select doc_id, text, text is null or text = '' as bad, length({sql_strip("replace(text, chr(12), chr(10))")}) as n, len(string_split(text, chr(12))) as pages from p)
select doc_id, case when bad then 0 else pages end::int as page_count, case when bad then 'unreadable' when n < {MIN_CHARS_PER_PAGE} * pages then 'no_text_layer' else 'ok' end as status,
  case when bad then md5('') else md5(replace(text, chr(12), chr(10))) end as digest from q""")  # fmt: skip
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of files, some empty and some broken: those that the decoder cannot read are rows with a status, not errors."""
    content = F.expr(_PAGES.format(ff="'\f'")).cast("binary")
    content = F.when(F.col("doc_id") % 5 == 1, F.concat(content, F.lit(b"\xff"))).otherwise(content)
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("p").alias("path"), content.alias("content"))
    return decoded(files).select("doc_id", "page_count", "status", F.md5("text").alias("digest"))


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_MARKDOWN = """concat('# ', coalesce(source, ''), '{nl}- stray{nl}## ', case doc_id % 4 when 0 then 'Hedging phrases' when 1 then 'Other' when 2 then 'hedging PHRASES ' else 'Confident / unqualified phrases' end,
  '{nl}- early{nl}### ', lang, '{nl}- ', substr(coalesce(text, ''), 1, 12), '{nl}-bare{nl}-  Twice {nl} - inner{nl}###{nl}### ', lang, ' 2{nl}- Ab', substr(coalesce(text, ''), 20, 9),
  '{nl}## Confident / Unqualified Phrases{nl}- none{nl}### Sure{nl}- ', coalesce(source, ''), '{nl}')"""


@query(f"""with d as (select doc_id, {_MARKDOWN.replace("'{nl}", "chr(10) || '").replace("{nl}", "' || chr(10) || '")} as text from documents where doc_id not in (select doc_id from documents group by doc_id having count(*) > 1)),
l as (select doc_id, unnest(string_split_regex(text, {quoted(_ENDS)})) as line, generate_subscripts(string_split_regex(text, {quoted(_ENDS)}), 1) as pos from d),
m as (select doc_id, pos, regexp_extract(line, '(?s)^(##|###|-)[{SP}]+(.*)$', 1) as mark, {sql_strip(f"regexp_extract(line, '(?s)^(##|###|-)[{SP}]+(.*)$', 2)")} as rest from l),
s as (select *, last_value(case when mark = '##' then case lower(rest) when 'hedging phrases' then 'hedging' when 'confident / unqualified phrases' then 'confident' else '' end end ignore nulls) over w as bucket,
  last_value(case mark when '##' then '' when '###' then rest end ignore nulls) over w as category from m where rest <> '' window w as (partition by doc_id order by pos))
select doc_id, bucket, category, lower(rest) as phrase, (row_number() over (partition by doc_id, bucket order by pos) - 1)::int as ord from s where mark = '-' and bucket <> '' and category <> ''""")  # fmt: skip
def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon files made of the documents, parsed as rows."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")
    texts = d.join(once, "doc_id").select("doc_id", F.expr(_MARKDOWN.replace("{nl}", "\\n")).alias("text"))
    return parse_lines(file_lines(texts)).select("doc_id", "bucket", "category", "phrase", "ord")


# Carried order, long transcripts, large lexicons, layouts and replies that are paid once.

_AGAIN = "concat('superseded ', cast(turn_number as {text}))"


@query(f"""with t0 as ({derive.SQL_TURNS}), t as (select * exclude (text), case when turn_number % 3 = 0 then {_AGAIN.format(text="varchar")} else text end as text from t0), c as ({derive.SQL_CLAIMS.replace("from t)", "from t0)")})
select c.doc_id, c.claim_no, coalesce(contains({_NORM("t.text")}, {_NORM("c.source_quote")}), false) as passed from c left join t on c.doc_id = t.doc_id and c.source_turn_number = t.turn_number""")  # fmt: skip
def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn comes twice, in an array per document; the place in the array says which is the last."""
    c, t = _inputs(spark, sf_dir)
    fields = [x for x in t.columns if x != "doc_id"]
    old = t.withColumn("text", F.expr(_AGAIN.format(text="string")))
    place = lambda d, early: d.withColumn("at", F.when((F.col("turn_number") % 3 == 0) == F.lit(early), 1).otherwise(0))
    both = place(t, False).union(place(old, True))
    calls = both.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("turns"))
    return verify.faithfulness(c, from_arrays(calls)).select("doc_id", "claim_no", "passed")


_LONG = _DRAFTS.replace("with recursive tx as", "with recursive tx0 as").replace("raw as (select doc_id,", "raw0 as (select doc_id,").replace("::int as pos from tx),", "::int as pos from tx0),\nraw as (select doc_id % 3 as doc_id, raw, doc_id * 100000 + pos as pos from raw0), tx as (select distinct doc_id from raw),")


def _long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three long transcripts, of all conversations after each other, as lines."""
    x = derive.transcripts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return x.select((F.col("doc_id") % 3).alias("doc_id"), (F.col("doc_id") * 100000 + F.col("pos")).alias("pos"), "raw")


@query(_LONG + f"select doc_id, turn_no as turn_number, name as speaker_name, title as speaker_title, case when turn_no >= boundary then '{QA}' else '{PREPARED}' end as section, text from dr join bd using (doc_id) where turn_no > 0")
def long_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_lines(_long_lines(spark, sf_dir))[0]


@query(_LONG + "select doc_id, n_turns, coalesce(boundary, 0) as qa_boundary_turn, coalesce(boundary_by, 'none') as boundary_by, front_lines::bigint as front_lines from bd")
def long_transcript_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = segment.segment_lines(_long_lines(spark, sf_dir))[1]
    return report.select("doc_id", "n_turns", F.coalesce("qa_boundary_turn", F.lit(0)).alias("qa_boundary_turn"), F.coalesce("boundary_by", F.lit("none")).alias("boundary_by"), "front_lines")


@query(ORACLE["sentence_labels"])
def indexed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the phrase index in place of the pattern."""
    names = lambda c: F.array_join(F.array_sort(F.transform(c, lambda m: m["phrase"])), ",")
    x = hedging.classify_indexed(hedging.split_turns(derive.turns(spark, sf_dir)), to_table(spark, derive.LEXICON))
    return x.select("doc_id", "turn_number", "sent_no", "label", names("hedge_matches").alias("hedges"), names("confident_matches").alias("sures"))


_WORDS_SQL = f"regexp_extract_all(lower(coalesce(text, '')), '[{derive.WORDLY}]+')"


@query(f"""with t as ({derive.SQL_TURNS}), s0 as (select doc_id, turn_number, {_split_sql("text")} as s from t), s1 as (select doc_id, turn_number, unnest(s) as text, unnest(range(len(s)))::int as sent_no from s0),
v as (select distinct unnest({_WORDS_SQL}) as w from documents where text is not null), x as (select doc_id, turn_number, sent_no, unnest(list_distinct({_WORDS_SQL})) as w from s1),
n as (select doc_id, turn_number, sent_no, count(*) filter (length(w) % 2 = 0) as hedges, count(*) filter (length(w) % 2 = 1) as sures from x join v using (w) where length(w) > 3 group by all)
select doc_id, turn_number, sent_no, coalesce(hedges, 0)::int as hedges, coalesce(sures, 0)::int as sures from s1 left join n using (doc_id, turn_number, sent_no)""")  # fmt: skip
def corpus_lexicon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon as large as the vocabulary of all documents."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("phrase")).distinct().where("length(phrase) > 3")
    lexicon = words.select(F.when(F.length("phrase") % 2 == 0, HEDGING).otherwise(SURE).alias("bucket"), F.lit("word").alias("category"), "phrase", F.lit(0).alias("ord"))
    x = hedging.classify_indexed(hedging.split_turns(derive.turns(spark, sf_dir)), lexicon)
    return x.select("doc_id", "turn_number", "sent_no", F.size("hedge_matches").alias("hedges"), F.size("confident_matches").alias("sures"))


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(None)
def bucketed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``faithfulness_results`` over claims and turns that are written as tables bucketed by document."""
    folder = _own_folder(spark, "bucketed")
    name = folder.rsplit("-", 1)[1]
    c, t = (layout.save(df, f"{kind}_{name}", 16, f"{folder}/{kind}") for kind, df in zip(("claims", "turns"), _inputs(spark, sf_dir), strict=True))
    return verify.faithfulness(c, t).select("doc_id", "claim_no", "passed", "reason")


@query(None)
def replies_paid_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extracted_claims`` by two runs over one store of replies: the second asks for what the first, over half of the documents, left."""
    store = ReplyStore(spark, _own_folder(spark, "replies"))
    t = derive.turns(spark, sf_dir)
    pipeline.extract(t.where("doc_id % 2 = 0"), _by_rule, "rule", store=store)

    def odd_only(asked: list[dict]) -> list[dict]:
        if any(q["doc_id"] % 2 == 0 for q in asked):
            raise AssertionError("asked again")
        return _by_rule(asked)

    found = pipeline.extract(t, odd_only, "rule", strict=True, store=store)
    return found.claims.select("doc_id", "claim_no", F.lit(verify.KEPT).alias("status")).union(found.dropped.select("doc_id", "claim_no", "status"))


@query(None)
def usage_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``usage_by_stage`` over a sink that took four batches, some of them twice."""
    folder, u = _own_folder(spark, "usage"), _usage(spark, sf_dir)
    for batch in (0, 1, 1, 2, 0, 3):
        usage.append_batch(u.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == batch), folder, batch)
    return usage.by_stage(usage.committed(spark, folder))


@query(_DRAFTS + f""", tt as (select doc_id, turn_no, case when turn_no >= boundary then '{QA}' else '{PREPARED}' end as section, text from dr join bd using (doc_id) where turn_no > 0),
s1 as (select section, unnest({_split_sql("text")}) as text from tt),
lb as (select section, case when {_found_sql(derive.LEXICON.hedging, "text")} <> '' then '{HEDGED}' when {_found_sql(derive.LEXICON.confident, "text")} <> '' then '{CONFIDENT}' else '{UNMARKED}' end as label, length(text) as n from s1)
select section, label, count(*)::bigint as n_sentences, sum(n)::bigint as n_chars from lb group by all""")  # fmt: skip
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by section, by the functions and views of the SQL surface alone."""
    derive.transcripts(spark, sf_dir).createOrReplaceTempView("ts_transcripts")
    sql_functions.install(spark, "ts_transcripts", derive.LEXICON)
    return spark.sql("""
        with p as (select section, ts_sentences_of(text) as parts from ts_turns), s as (select section, explode(parts) as text from p)
        select section, ts_label(text) as label, count(*) as n_sentences, sum(length(text)) as n_chars from s group by section, label""")


_ORDERED = lambda entries: f"""(select coalesce(string_agg(h, ',' order by i), '') from (select h, min(i) as i from (select unnest(hits) as h, generate_subscripts(hits, 1) as i from (select {_hits_sql(entries, "s1.text")} as hits)) group by h))"""


@query(_LABELLED + f"select doc_id, turn_number, sent_no, {_ORDERED(derive.LEXICON.hedging)} as hedges, {_ORDERED(derive.LEXICON.confident)} as sures from s1")
def phrases_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in the order of their first places."""
    names = lambda c: F.array_join(F.transform(c, lambda m: m["phrase"]), ",")
    return _labelled(spark, sf_dir).select("doc_id", "turn_number", "sent_no", names("hedge_matches").alias("hedges"), names("confident_matches").alias("sures"))


@query(_SCORES + f""", wy as (select {_VALUE}, 0 as kind, claim_no, found as told from f where found <> 'kept' union all
  select {", ".join(f"f.{v}" for v in _VALUE.split(", "))}, 1, f.claim_no, cs.dimension || ' scores ' || samples || ', median ' || median || ', range ' || low || ' to ' || high from f join cs using (doc_id, claim_no) where not stable and high - low >= 2)
select doc_id, claim_text, min(claim_no) as first_no, string_agg(told, '; ' order by kind, claim_no) as contexts from wy group by {_VALUE}""")  # fmt: skip
def revision_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model is told about each claim that it is asked to revise."""
    return _flagged(spark, sf_dir)[2].select("doc_id", "claim_text", "first_no", F.array_join("contexts", "; ").alias("contexts"))
