r"""License scans: an exact containment join of text blocks with license templates, in DataFrame operations.

A block is a line of the text, cut into pieces of BLOCK words every BLOCK / 2 words if it is longer (more words, if a
template has over BLOCK / 2); texts of several lines are cut into such pieces as a whole too, as sentences wrap. A block
meets a template when it holds at least THRESHOLD of the template's distinct words. Template words are ordered by
the number of documents that hold them, rarest first, counted over all documents. With need = ceil(t * n):

* prefix: a block that meets a template of n words holds one of its n - need + 1 rarest words;
* length: the block has at least need distinct words of templates;
* position: if the first word that they share is at place p (from 0) of the template's words and at place q of the block's m words
  of templates, both in the global order, then they share at most 1 + min(n - p - 1, m - q - 1).

Templates are a parameter of bounded size, so their index is broadcast; documents are never shuffled with texts.

Cases: null text is empty; a text without words has no places and score 0; repeated rows repeat their result;
rows are told apart by doc_id and text, so rows that share a doc_id or lack one keep their own results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER


#: Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening or grant sentences of public licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
)
#: Words of lower-cased text, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, in the form that Java matches fastest.
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
THRESHOLD, BLOCK = 0.9, 64
#: Templates together hold at most this many distinct words.
MAX_VOCABULARY = 100_000


#: A character of a word before A-Z is lower-cased.
CHARACTER = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _whole_word(words: list[str]) -> str:
    return f"(?i)(?<!{CHARACTER})(?:{'|'.join(words)})(?!{CHARACTER})"


def _order(docs: DataFrame, templates: tuple) -> dict[str, int]:
    """Place of every template word in the global order: rarest first, ties by the word."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError("templates hold too many words to broadcast")
    held = docs.select(F.explode(F.array_intersect(_words(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("w"))
    n = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def candidates(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a block and a template with a prefix word in common: doc_id, key, block, template, label, have (the block's words of
    templates, in the global order), words, need, bound (by place, on the words they share). Those under need are no match."""
    spark = docs.sparkSession
    order = _order(docs, templates)
    rows, full = [], []
    for no, (label, text) in enumerate(templates):
        words = sorted(set(text.split()), key=order.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        full.append((no, label, words))
        rows += [(w, no, p, len(words), need) for p, w in enumerate(words[: len(words) - need + 1])]
    index = F.broadcast(spark.createDataFrame(rows, "w string, template int, place int, size int, need int"))
    whole = F.broadcast(spark.createDataFrame(full, "template int, label string, words array<string>"))
    first = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    d = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").where("text is not null")
    # a text or line without a word of a prefix holds no matching block
    pattern = _whole_word(sorted({r[0] for r in rows}))
    d = d.where(F.col("text").rlike(pattern))
    lines = d.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").rlike(pattern))
    lines = lines.select("doc_id", "key", "line", _words(F.col("t")).alias("all"))
    # sentences that wrap: the words of the whole text as if it were one line, with the number -1
    whole_texts = d.where(F.contains("text", F.lit("\n"))).select("doc_id", "key", F.lit(-1).alias("line"), _words(F.col("text")).alias("all"))
    lines = lines.union(whole_texts)
    # a template's words lie in one block wherever they begin
    longest = max(len(t.split()) for _, t in templates)
    size = max(BLOCK, 2 * longest)
    stride = min(BLOCK // 2, size - longest + 1)
    starts = F.expr(f"sequence(0, greatest(size(all) - 1, 0), {stride})")
    blocks = lines.select("doc_id", "key", "line", "all", F.explode(starts).alias("at"))
    blocks = blocks.select("doc_id", "key", F.struct("line", "at").alias("block"), F.array_distinct(F.slice("all", F.col("at") + 1, size)).alias("have"))
    # the block's words of templates in the global order
    ordered = F.array(*[F.lit(w) for w in sorted(order, key=order.__getitem__)])
    blocks = blocks.where(F.arrays_overlap("have", first)).select("doc_id", "key", "block", F.array_intersect(ordered, "have").alias("have"))
    found = blocks.select("*", F.posexplode("have").alias("q", "w")).join(index, "w").where(F.size("have") >= F.col("need"))
    # each pair is met once for every shared prefix word; the first one in the order decides the bound by place
    at = F.min(F.struct("place", "q"))
    found = found.groupBy("doc_id", "key", "block", "template").agg(at.alias("at"), F.first("size").alias("size"), F.first("need").alias("need"), F.first("have").alias("have"))
    bound = F.least(F.col("size") - F.col("at.place"), F.size("have") - F.col("at.q"))
    return found.join(whole, "template").select("doc_id", "key", "block", "template", "label", "have", "words", "need", bound.alias("bound"))


def join_templates(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Matches of blocks and templates: doc_id, key, block, template, label, score (share of the template held)."""
    shared = F.size(F.array_intersect("have", "words"))
    found = candidates(docs, templates, threshold).where("bound >= need").where(shared >= F.col("need"))
    return found.select("doc_id", "key", "block", "template", "label", (shared / F.size("words")).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    matches = join_templates(docs).groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    d = docs.select("doc_id", F.xxhash64("text").alias("key"), _words(F.col("text")).alias("w"))
    places = []
    for phrase in PHRASES:
        ws = phrase.split()
        test = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ws))
        every = " and ".join(f"array_contains(w, '{x}')" for x in ws)
        places.append(F.expr(f"case when size(w) >= {len(ws)} and {every} then filter(sequence(0, size(w) - {len(ws)}), i -> {test}) else array() end"))
    d = d.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), *[p.alias(f"p{i}") for i, p in enumerate(places)])
    every = F.concat(*[f"p{i}" for i in range(len(places))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]))
    d = d.select("doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"))
    d, m = d.alias("d"), matches.alias("m")
    both = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.key").eqNullSafe(F.col("m.key")), "left")
    more = F.coalesce("m.more", F.array().cast("array<string>"))
    return both.select(
        "d.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("m.best", F.lit(0.0))).alias("score"),
    )
