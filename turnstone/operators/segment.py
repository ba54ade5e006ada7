r"""Transcript segmentation: raw text to speaker turns with sections, in window functions.

Lines become rows. Running counts of blank lines and of speaker cues give the block and the turn of each line, so
one shuffle by doc_id serves all windows and the aggregation by turn. The boundary between prepared remarks and Q&A
is the turn after the last heading, else the first Operator turn that announces questions, else the second
Operator turn.

``segment`` takes documents as texts and keeps a document's lines together. ``segment_lines`` takes lines as rows, for transcripts that are
too long for one task: running counts are prefix sums in two levels, over ranges of lines and within each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.text import SPACE, preview, strip
from turnstone.plans.schemas import MIN_TURNS, PREPARED, QA

# The grammar of cues. A name is one to five capitalised words.
NAME = rf"[A-Z][A-Za-z.'\-]*(?:{SPACE}+[A-Z][A-Za-z.'\-]*){{0,4}}"
INLINE = rf"(?sU)\A({NAME})(?:,{SPACE}*([^:]+?))?:{SPACE}*(.*)\z"
TITLED = rf"(?U)\A{NAME}(,)"
HEADER = rf"(?U)\A({NAME}),{SPACE}*([A-Za-z0-9&,.'/\-\s\x1c-\x1f]+)\z"
HEADING = rf"(?iuU)\A(?:questions?{SPACE}*(?:and|&){SPACE}*answers?(?:{SPACE}+section)?|q{SPACE}*&{SPACE}*a(?:{SPACE}+section)?){SPACE}*:?{SPACE}*\z"
ANNOUNCES = rf"(?isuU)question.{{0,20}}(?:and|&).{{0,20}}answer|open(?:ing)?(?: the| up)?(?: the)? (?:lines?|call|floor) for questions|q{SPACE}*&{SPACE}*a\b"
# Codes of the warnings, in their order.
FRONT_MATTER, WEAK_BOUNDARY, NO_BOUNDARY, FEW_TURNS = "front_matter_skipped", "weak_boundary", "no_boundary", "few_turns"

RANGE = 1 << 16  # lines of a document that a task of segment_lines takes together


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, block: stripped lines that are not blank; blank lines end a block."""
    d = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw")).withColumn("line", strip("raw"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("block", F.count_if(F.col("line") == "").over(before)).where("line <> ''").select("doc_id", "pos", "line", "block")


def _flagged(x: DataFrame, alone: Column) -> DataFrame:
    """is_heading, is_inline, is_header, is_cue of lines; ``alone`` tells whether a line is all of its block."""
    x = x.withColumn("is_heading", F.col("line").rlike(HEADING))
    x = x.withColumn("is_inline", ~F.col("is_heading") & F.col("line").rlike(INLINE))
    x = x.withColumn("is_header", ~F.col("is_heading") & alone & F.col("line").rlike(HEADER))
    return x.withColumn("is_cue", F.col("is_inline") | F.col("is_header"))


def ranged_cue_lines(given: DataFrame, rows_a_range: int = RANGE) -> DataFrame:
    """``cue_lines`` of lines as rows (doc_id, pos, raw), where no task needs more than a range of a document's lines.

    A range is ``rows_a_range`` values of ``pos``, which numbers a document's lines (gaps are fine). Each range is counted; offsets are sums
    over the ranges before; places within follow from windows over single ranges. What a line at an edge needs of its neighbour, whether
    it is blank, comes with the offsets too. Lines are dealt once, by (doc_id, range).
    """
    x = given.select("doc_id", F.col("pos").cast("long").alias("pos"), strip(F.coalesce("raw", F.lit(""))).alias("line"))
    x = x.withColumns({"_range": F.floor(F.col("pos") / rows_a_range), "_blank": F.col("line") == ""}).repartition("doc_id", "_range")
    key, ranges = ["doc_id", "_range"], Window.partitionBy("doc_id").orderBy("_range")
    before, here = ranges.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key).orderBy("pos")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    edges = x.groupBy(*key).agg(F.count_if("_blank").alias("n"), F.min_by("_blank", "pos").alias("first"), F.max_by("_blank", "pos").alias("last"))
    edges = edges.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_blocks"), F.lag("last").over(ranges).alias("_prior"), F.lead("first").over(ranges).alias("_next"))
    x = x.join(edges, key)
    x = x.withColumns({
        "block": F.col("_blocks") + F.count_if("_blank").over(so_far),
        "_alone": F.coalesce(F.lag("_blank").over(here), "_prior", F.lit(True)) & F.coalesce(F.lead("_blank").over(here), "_next", F.lit(True)),
    })
    x = _flagged(x.where(~F.col("_blank")), F.col("_alone"))
    cues = x.groupBy(*key).agg(F.count_if("is_cue").alias("n"))
    cues = cues.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_turns"))
    x = x.join(cues, key).withColumn("turn_no", (F.col("_turns") + F.count_if("is_cue").over(so_far)).cast("int"))
    return x.select("doc_id", "pos", "line", "block", "is_heading", "is_inline", "is_header", "is_cue", "turn_no")


def cue_lines(docs: DataFrame) -> DataFrame:
    """Lines with is_heading, is_inline, is_header, is_cue and turn_no, the number of cues so far."""
    x = lines(docs).withColumn("block_size", F.count("*").over(Window.partitionBy("doc_id", "block")))
    x = _flagged(x, F.col("block_size") == 1)
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("turn_no", F.count_if("is_cue").over(so_far).cast("int"))


def _drafts(cues: DataFrame) -> DataFrame:
    """One row per document and turn; turn 0 holds front matter and headings before any cue."""
    name = F.when(F.col("is_inline"), F.regexp_extract("line", INLINE, 1)).when(F.col("is_header"), F.regexp_extract("line", HEADER, 1))
    inline_title = F.when(F.regexp_extract("line", TITLED, 1) == ",", strip(F.regexp_extract("line", INLINE, 2)))
    title = F.when(F.col("is_inline"), inline_title).when(F.col("is_header"), strip(F.regexp_extract("line", HEADER, 2)))
    said = F.when(F.col("is_heading") | F.col("is_header"), "").when(F.col("is_inline"), strip(F.regexp_extract("line", INLINE, 3))).otherwise(F.col("line"))
    x = cues.select("doc_id", "turn_no", "pos", "line", "is_heading", "is_cue", strip(name).alias("name"), title.alias("title"), said.alias("said"))
    parts = F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct("pos", "said"))))
    own = (F.col("turn_no") == 0) & ~F.col("is_heading")
    return x.groupBy("doc_id", "turn_no").agg(
        F.max(F.when(F.col("is_cue"), F.col("name"))).alias("name"),
        F.max(F.when(F.col("is_cue"), F.col("title"))).alias("title"),
        strip(F.array_join(F.transform(parts, lambda p: p["said"]), " ")).alias("text"),
        F.count_if("is_heading").alias("headings"),
        F.count_if(own).alias("front_lines"),
        F.min_by(F.when(own, F.col("line")), F.when(own, F.col("pos"))).alias("front_first"),
    )


def _bounded(drafts: DataFrame) -> DataFrame:
    """Drafts with n_turns, qa_boundary_turn and boundary_by of their document, in windows over the same partitions."""
    doc = Window.partitionBy("doc_id")
    turn = F.when(F.col("turn_no") > 0, F.col("turn_no"))
    operator = F.lower("name") == "operator"
    d = drafts.withColumn("n_turns", F.coalesce(F.max(turn).over(doc), F.lit(0)))
    # a heading in turn k announces turn k + 1, if there is one
    announced = F.when((F.col("headings") > 0) & (F.col("turn_no") < F.col("n_turns")), F.col("turn_no") + 1)
    d = d.withColumns({
        "_heading": F.max(announced).over(doc),
        "_keyword": F.min(F.when(operator & F.col("text").rlike(ANNOUNCES), turn)).over(doc),
        "_operators": F.array_sort(F.collect_list(F.when(operator, turn)).over(doc)),
    })
    second = F.when(F.size("_operators") >= 2, F.element_at("_operators", 2))
    by = F.when(F.col("_heading").isNotNull(), "heading").when(F.col("_keyword").isNotNull(), "keyword").when(second.isNotNull(), "second_operator")
    return d.withColumns({"qa_boundary_turn": F.coalesce("_heading", "_keyword", second), "boundary_by": by}).drop("_heading", "_keyword", "_operators")


def _bounded_apart(drafts: DataFrame) -> DataFrame:
    """``_bounded`` without a window over a document: what a document needs to know is aggregated, and joined with its turns."""
    turn = F.when(F.col("turn_no") > 0, F.col("turn_no"))
    operator = F.when(F.lower("name") == "operator", turn)
    slim = drafts.select("doc_id", "turn_no", (F.col("headings") > 0).alias("_headed"), turn.alias("_turn"), operator.alias("_operator"), F.when(F.col("text").rlike(ANNOUNCES), operator).alias("_announces"))
    by = slim.groupBy("doc_id").agg(F.coalesce(F.max("_turn"), F.lit(0)).alias("n_turns"), F.min("_announces").alias("_keyword"), F.min("_operator").alias("_first"))
    more = slim.join(by, "doc_id").groupBy("doc_id").agg(
        F.max(F.when(F.col("_headed") & (F.col("turn_no") < F.col("n_turns")), F.col("turn_no") + 1)).alias("_heading"),
        F.min(F.when(F.col("_operator") > F.col("_first"), F.col("_operator"))).alias("_second"),
    )
    kind = F.when(F.col("_heading").isNotNull(), "heading").when(F.col("_keyword").isNotNull(), "keyword").when(F.col("_second").isNotNull(), "second_operator")
    known = by.join(more, "doc_id").select("doc_id", "n_turns", F.coalesce("_heading", "_keyword", "_second").alias("qa_boundary_turn"), kind.alias("boundary_by"))
    return drafts.join(known, "doc_id")


def _turns(bounded: DataFrame) -> DataFrame:
    section = F.when(F.col("turn_no") >= F.col("qa_boundary_turn"), QA).otherwise(PREPARED)
    return bounded.where("turn_no > 0").select("doc_id", F.col("turn_no").alias("turn_number"), F.col("name").alias("speaker_name"), F.col("title").alias("speaker_title"), section.alias("section"), "text")


def _report(docs: DataFrame, bounded: DataFrame) -> DataFrame:
    by = bounded.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("n_turns", "qa_boundary_turn", "boundary_by", "front_lines", "front_first")])
    d = docs.select("doc_id").distinct().join(by, "doc_id", "left").withColumn("n_turns", F.coalesce("n_turns", F.lit(0)))
    front = F.coalesce("front_lines", F.lit(0))
    none, few = F.col("qa_boundary_turn").isNull(), F.col("n_turns") < MIN_TURNS
    warnings = F.array_compact(F.array(F.when(front > 0, FRONT_MATTER), F.when(F.col("boundary_by") == "second_operator", WEAK_BOUNDARY), F.when(none, NO_BOUNDARY), F.when(few, FEW_TURNS)))
    return d.select("doc_id", "n_turns", "qa_boundary_turn", "boundary_by", (none | few).alias("low_confidence"), front.alias("front_lines"), preview("front_first").alias("front_preview"), warnings.alias("warnings"))


def segment(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns, and one report row per document (kept for documents without any line)."""
    bounded = _bounded(_drafts(cue_lines(docs)))
    return _turns(bounded), _report(docs, bounded)


def segment_lines(given: DataFrame, rows_a_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """``segment`` for transcripts that come as lines (doc_id, pos, raw): no task holds a document, a turn's text excepted.

    Equal to ``segment`` over the lines joined in the order of ``pos``. Null lines are blank; a document needs a line to be reported.
    """
    bounded = _bounded_apart(_drafts(ranged_cue_lines(given, rows_a_range)))
    return _turns(bounded), _report(given, bounded)
