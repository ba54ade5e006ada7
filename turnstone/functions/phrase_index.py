r"""Phrases of a lexicon of any size in texts, by joins in place of one pattern with all phrases.

A pattern of 76 phrases is tried at every place of a text; one of 100 000 is not usable. Here a text is cut into words and what stands
between them (maximal runs of \w and of \W, so every cut is a word boundary). A phrase of L words can only be a window of L words with the
separators between them, so:

1. The index tells, for each first word, how many words its phrases have. Places of a text whose word begins a phrase give one window for
   each of those lengths. A place carries what follows it up to the longest phrase, never the rest of its text.
2. Windows are joined with the phrases by equality of the whole window: a hit is a phrase, and no pair is tried in vain.
3. Of the hits of a text, as of a pattern's, the leftmost counts, the longest where several begin, and none may overlap one before.

Equal to ``lexicon.matches`` for phrases that begin and end with a word character, which is checked; others have no word boundary to stand
on. Both sides are lower-cased. Lengths by first word are at most as long as the lexicon; they and the phrases are broadcast up to
``BROADCAST_BYTES``, which is counted, and shuffled above, with very frequent first words split by adaptive execution. Either way the join is
named: Spark takes the places of a text for as small as the file that the texts are in, and would broadcast them. So is the join of the texts with
their hits, which would be broadcast up to the session's threshold; nothing that grows with the texts comes to the driver.

Cases: null and empty texts have no matches; a phrase that comes twice in a bucket has the category of its last row (``ord``); a phrase may be in
both buckets; repeated phrases in a text count once, by their first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = r"(?U)\w+|\W+"
WORDLY = r"(?sU)\A\w(?:.*\w)?\z"
WORD_FIRST = r"(?U)\A\w"
BROADCAST_BYTES = 2 << 20


def pieces(text: Column | str) -> Column:
    """Words and separators of a text, in turn; together they are the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(PIECES), F.lit(0))


def index(lexicon: DataFrame) -> DataFrame:
    """bucket, phrase, category, first, n_pieces from rows of LEXICON (bucket, category, phrase, ord)."""
    p = F.lower("phrase")
    error = F.raise_error(F.concat(F.lit("not a phrase between word characters: "), F.coalesce(p, F.lit("null"))))
    d = lexicon.select("bucket", F.when(F.coalesce(p.rlike(WORDLY), F.lit(False)), p).otherwise(error).alias("phrase"), "category", "ord")
    d = d.groupBy("bucket", "phrase").agg(F.max_by("category", "ord").alias("category"))
    cut = pieces("phrase")
    return d.select("bucket", "phrase", "category", F.element_at(cut, 1).alias("first"), F.size(cut).alias("n_pieces"))


def places(texts: DataFrame, key: str, column: str, longest: int) -> DataFrame:
    """_key, _at, first, _rest: each word of a text, and up to ``longest`` - 1 pieces after it."""
    d = texts.select(F.col(key).alias("_key"), pieces(column).alias("_pieces"))
    place = lambda p, i: F.when(p.rlike(WORD_FIRST), F.struct(i.alias("_at"), p.alias("first"), F.slice("_pieces", i + 2, longest - 1).alias("_rest")))
    return d.select("_key", F.inline(F.array_compact(F.transform("_pieces", place))))


def hits(texts: DataFrame, key: str, column: str, phrases: DataFrame) -> DataFrame:
    """``key``, bucket, at, n_pieces, phrase, category: every place where a phrase stands, overlapping ones included. Reads ``phrases`` at once."""
    size, longest = phrases.agg(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("category"), F.lit(0)) + 100), F.max("n_pieces")).first()
    joined = F.broadcast if (size or 0) <= BROADCAST_BYTES else lambda table: table.hint("merge")
    lengths = phrases.groupBy("first").agg(F.collect_set("n_pieces").alias("_lengths"))  # a handful for each word
    d = places(texts, key, column, longest or 1).join(joined(lengths), "first")
    d = d.select("_key", "_at", "first", "_rest", F.explode("_lengths").alias("n_pieces")).where(F.col("n_pieces") <= F.size("_rest") + 1)
    d = d.select("_key", "_at", F.concat("first", F.array_join(F.slice("_rest", F.lit(1), F.col("n_pieces") - 1), "")).alias("phrase"))
    return d.join(joined(phrases), "phrase").select(F.col("_key").alias(key), "bucket", F.col("_at").alias("at"), "n_pieces", "phrase", "category")


def _taken(found: Column) -> Column:
    """Of hits (at, -n_pieces, ...) in order, those that begin where the last taken one has ended."""
    start = F.struct(F.lit(0).alias("end"), F.filter(found, lambda x: F.lit(False)).alias("kept"))
    step = lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] - x["less"]).alias("end"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)
    return F.aggregate(found, start, step)["kept"]


def matches(texts: DataFrame, key: str, column: str, phrases: DataFrame, buckets: tuple[str, ...]) -> DataFrame:
    """``texts`` with an array of (phrase, category) for each of ``buckets``, distinct, by first place. ``key`` must be unique."""
    h = hits(texts, key, column, phrases)
    hit = F.struct("at", (-F.col("n_pieces")).alias("less"), "phrase", "category")
    by = h.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("bucket") == b, hit))).alias(b) for b in buckets])
    named = lambda b: F.array_distinct(F.transform(_taken(F.col(b)), lambda x: F.struct(x["phrase"].alias("phrase"), F.coalesce(x["category"], F.lit("")).alias("category"))))
    by = by.select(F.col(key).alias("_key"), *[named(b).alias(f"_{b}") for b in buckets])
    none = F.array().cast("array<struct<phrase:string,category:string>>")
    joined = texts.join(by.hint("merge"), texts[key] == by["_key"], "left")
    return joined.select(*[texts[c] for c in texts.columns], *[F.coalesce(f"_{b}", none).alias(b) for b in buckets])
