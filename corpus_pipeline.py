"""The corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. doc_id identifies a
document (documents has one row for each); columns that a table has beyond its own are carried along.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import decontam, mixing, ngramjoin, quality, repeats, suffixes
from turnstone.llm.common import cut, table

#: Texts that suffix-array dedup leaves without a word are gone with it.
WORD = r"[^\x20\x09-\x0D]"
#: A document's number: rows that repeat doc_id and text are one document to the stages.
RID = "xxhash64(doc_id, text)"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose number, a hash of doc_id and text, is not in ``gone`` (rid)."""
    gone = cut(gone.select("rid").distinct())
    side = F.broadcast(gone) if gone.count() <= repeats.BROADCAST_ROWS else gone.hint("shuffle_hash")
    d = docs.alias("given_docs")
    return d.join(side.alias("gone_docs"), F.expr("xxhash64(given_docs.doc_id, given_docs.text)") == F.col("gone_docs.rid"), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (op 3): documents that the base rule or a learned rule rejects go.

    Null or empty text fails the base rule; rows that repeat go or stay together; null ids and all columns are kept.
    """
    feats = cut(quality.features(docs.select("doc_id", "text", F.expr(RID).alias("rid"))).drop("text"))
    rejected = quality.base_failed() | quality.verdict(quality.learn(feats, table(spark, sf_dir, "labels"))).isNotNull()
    return _without(docs, feats.where(rejected).select("rid"))


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (op 2): of each class of near duplicates the document of least doc_id stays.

    Null, empty or wordless text links with nothing and stays; so does a document with null doc_id, whose class it cannot lead.
    Of rows that repeat doc_id and text one stays: the one whose other columns come first as JSON.
    """
    found = cut(ngramjoin.classes(docs.select("doc_id", "text", F.expr(RID).alias("rid"))))
    if found.count() > found.select("rid").distinct().count():
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        if others:
            rest = F.struct(*[F.col(f"`{c}`") for c in others])
            one = docs.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("given_rest"))
            docs = one.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"given_rest.`{c}`").alias(c) for c in docs.columns])
        else:
            docs = docs.distinct()
    return _without(docs, found.where("doc_id <> component_id").select("rid"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup (op 5): bytes of 100-byte strings that occur earlier are cut from the texts.

    What is left of characters that a cut splits is dropped; texts without a word left go, null ones too; n_chars is set
    anew. Earlier is by doc_id, null last; rows that repeat doc_id and text are one document, each cut alike.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rest = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in others)

    def finish(given, rows):
        kept = pa.array([r[0].decode("utf-8", "ignore") for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([given, kept], ["rest", "kept"])

    out = suffixes.kept_bytes(docs, others, f"rest struct<{rest}>, kept string", finish).where(F.col("kept").rlike(WORD))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (op 9): documents that hold a benchmark item go.

    Null or empty text and items hold nothing; rows that repeat go or stay together; without a benchmark all stay.
    """
    leaks = decontam.leaks(docs.select(F.expr(RID).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, leaks.select(F.col("doc_id").alias("rid")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (op 8): each copy taken, with source_size, target and copy_no.

    Texts without a word have size 0; a null source is one of its own. Rows that repeat doc_id, text and source each
    count towards sizes, and their copies are numbered together.
    """
    key = F.xxhash64("doc_id", "text", "source")
    given = docs.select("doc_id", "text", "source")
    each = cut(mixing.mix(given.select(key.alias("doc_id"), "text", "source")).select(F.col("doc_id").alias("key"), "size", "source_size", "target", "copies"))
    taken = each.groupBy("key").agg(*[F.first(c).alias(c) for c in ("size", "source_size", "target")], F.sum("copies").alias("copies"), F.count("*").alias("n"))
    taken = cut(taken)
    if taken.where("n > 1").limit(1).count():
        given = given.distinct()
    taken = taken.where("copies > 0").drop("n")
    side = F.broadcast(taken) if taken.count() <= repeats.BROADCAST_ROWS else taken.hint("shuffle_hash")
    out = given.withColumn("key", key).join(side, "key")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "text", "source", "size", "source_size", "target", "copy_no")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_class),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Learned rules and latent retrieval cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for no, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if no < len(STAGES) - 1:
            docs = cut(docs)
    return docs
