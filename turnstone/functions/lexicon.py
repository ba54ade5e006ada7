r"""The phrase lexicon: data, its Markdown form, and the patterns made from it on the driver.

A lexicon is a short ordered list, so patterns are literals in the plan and categories a literal map.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.text import strip
from turnstone.plans.schemas import LEXICON

HEDGING, SURE = "hedging", "confident"
# The titles of the two buckets in a lexicon file.
MARKED = r"(?sU)\A(##|###|-)[\s\x1c-\x1f]+(.*)\z"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TITLES = {"hedging phrases": HEDGING, "confident / unqualified phrases": SURE}


@dataclass(frozen=True)
class Lexicon:
    """(phrase, category) pairs of each bucket, in file order."""

    hedging: tuple[tuple[str, str], ...]
    confident: tuple[tuple[str, str], ...]

    def rows(self) -> list[tuple[str, str, str, int]]:
        return [(b, c, p, i) for b, entries in ((HEDGING, self.hedging), (SURE, self.confident)) for i, (p, c) in enumerate(entries)]


def parse_lexicon(markdown: str) -> Lexicon:
    """``##`` names a bucket (others close it), ``###`` a category of the open bucket, ``-`` a phrase of the category.

    A mark stands at the start of its line, with white space after it; other lines are passed over.
    """
    found: dict[str, list[tuple[str, str]]] = {HEDGING: [], SURE: []}
    bucket = category = None
    for line in markdown.splitlines():
        mark, *rest = ("" if line[:1].isspace() else line).split(maxsplit=1) or [""]
        rest = "".join(rest).strip()
        if not rest:
            continue
        if mark == "##":
            bucket, category = TITLES.get(rest.lower()), None
        elif mark == "###":
            category = rest if bucket else None
        elif mark == "-" and bucket and category:
            found[bucket].append((rest.lower(), category))
    for name, entries in found.items():
        if not entries:
            raise ValueError(f"the lexicon has no {name} phrases")
    return Lexicon(tuple(found[HEDGING]), tuple(found[SURE]))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``parse_lexicon`` for files of any number and length, as rows: doc_id and LEXICON columns from lines (doc_id, pos, line).

    The open bucket and category of a line are the last ones named before it. ``ord`` counts a bucket's phrases within its file.
    """
    head = F.regexp_extract("line", MARKED, 1)
    rest = strip(F.regexp_extract("line", MARKED, 2))
    x = lines.select("doc_id", "pos", F.when(rest != "", head).alias("mark"), rest.alias("rest"))
    titles = F.create_map(*[F.lit(v) for pair in TITLES.items() for v in pair])
    named = F.when(F.col("mark") == "##", F.coalesce(titles[F.lower("rest")], F.lit("")))
    under = F.when(F.col("mark") == "##", "").when(F.col("mark") == "###", F.col("rest"))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"bucket": F.last(named, ignorenulls=True).over(so_far), "category": F.last(under, ignorenulls=True).over(so_far)})
    x = x.where((F.col("mark") == "-") & (F.col("bucket") != "") & (F.col("category") != ""))
    no = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("pos")) - 1
    return x.select("doc_id", "bucket", "category", F.lower("rest").alias("phrase"), no.alias("ord"))


def file_lines(texts: DataFrame) -> DataFrame:
    """doc_id, pos, line of texts (doc_id, text), cut where Python's splitlines cuts."""
    return texts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_ENDS)).alias("pos", "line"))


@lru_cache(maxsize=8)
def load_lexicon(path: str) -> Lexicon:
    return parse_lexicon(Path(path).read_text(encoding="utf-8"))


def read_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """The same from any store that Spark reads."""
    return parse_lexicon("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def from_table(rows: DataFrame) -> Lexicon:
    """From a table of LEXICON rows, which is as small as the lexicon."""
    got = sorted(rows.collect(), key=lambda r: r["ord"])
    return Lexicon(*(tuple((r["phrase"], r["category"]) for r in got if r["bucket"] == b) for b in (HEDGING, SURE)))


def to_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    return spark.createDataFrame(lexicon.rows(), LEXICON)


def _quoted(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def pattern(entries: tuple[tuple[str, str], ...]) -> str:
    """Whole phrases in any case, the longest first where several begin; nothing if there are none."""
    if not entries:
        return "(?!)"
    phrases = sorted((_quoted(p) for p, _ in entries), key=len, reverse=True)
    return r"(?iuU)\b(?:" + "|".join(phrases) + r")\b"


def matches(text: Column | str, entries: tuple[tuple[str, str], ...]) -> Column:
    """Array of (phrase, category), distinct, by first place; of a phrase in two categories the last counts."""
    of = dict(entries)
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern(entries)), F.lit(0)), F.lower))
    if not of:
        return F.transform(found, lambda p: F.struct(p.alias("phrase"), F.lit("").alias("category")))
    table = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    return F.transform(found, lambda p: F.struct(p.alias("phrase"), F.coalesce(table[p], F.lit("")).alias("category")))


DEFAULT = parse_lexicon(Path(__file__).with_name("default_lexicon.md").read_text(encoding="utf-8"))
