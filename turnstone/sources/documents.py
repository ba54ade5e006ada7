"""Documents from files, by a pluggable decoder, and the gate for texts without a usable text layer.

A decoder turns the bytes of one file into (page texts). None is bundled for PDF: pass one, or read plain text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as filesystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.text import strip
from turnstone.plans.schemas import MIN_CHARS_PER_PAGE

Decoder = Callable[[bytes], list[str]]
OK, UNREADABLE, ZERO_PAGES, NO_TEXT, MISSING = "ok", "unreadable", "zero_pages", "no_text_layer", "missing"
LOADED = "doc_id BIGINT, source_path STRING, page_count INT, text STRING, decoded BOOLEAN, there BOOLEAN"


class MissingPath(FileNotFoundError):
    """The path to load from does not exist."""


def plain_text(data: bytes) -> list[str]:
    """Pages of a text file, set apart by form feeds."""
    if not data:
        raise ValueError("the file is empty")
    return data.decode("utf-8").split("\f")


def gate(docs: DataFrame) -> DataFrame:
    """``docs`` (page_count, text) with status; ``decoded``, where there is one, tells unreadable files."""
    readable = F.col("decoded") if "decoded" in docs.columns else F.lit(True)
    thin = F.length(strip("text")) / F.col("page_count") < MIN_CHARS_PER_PAGE
    return docs.withColumn("status", F.when(~readable, UNREADABLE).when(F.col("page_count") == 0, ZERO_PAGES).when(thin, NO_TEXT).otherwise(OK))


def decoded(files: DataFrame, decoder: Decoder = plain_text) -> DataFrame:
    """doc_id, source_path, page_count, text, status of files as rows (doc_id, path, content): null content cannot be read.

    ``there``, where there is such a column, tells files that are missing.
    """
    there = F.col("there") if "there" in files.columns else F.lit(True)
    files = files.select("doc_id", "path", "content", there.alias("there"))

    def decode(frames):
        for f in frames:
            rows = []
            for doc_id, where, data, there in zip(f["doc_id"], f["path"], f["content"], f["there"], strict=True):
                try:
                    pages = decoder(bytes(data) if data is not None else b"")
                    rows.append((doc_id, where, len(pages), "\n".join(pages), True, there))
                except Exception:  # a decoder may fail in any way: the row says so
                    rows.append((doc_id, where, 0, "", False, there))
            yield pd.DataFrame(rows, columns=["doc_id", "source_path", "page_count", "text", "decoded", "there"])

    out = gate(files.mapInPandas(decode, LOADED))
    return out.withColumn("status", F.when(F.col("there"), F.col("status")).otherwise(MISSING)).drop("decoded", "there")


def read_paths(paths: DataFrame, decoder: Decoder = plain_text) -> DataFrame:
    """doc_id (a hash of the path), source_path, page_count, text, status of files that a table names (column path), batch or stream.

    Nothing is listed and nothing goes through the driver: a task opens the files of its rows, by Arrow's file systems (local, hdfs, s3, gs
    by the path's scheme). A file that is not there is a row with status missing, an empty or broken one is unreadable. Paths that
    repeat are read as often; a null path is missing.
    """

    def run(frames):
        for f in frames:
            rows = []
            for path in f["path"]:
                try:
                    system, at = filesystem.FileSystem.from_uri(path if re.match("[a-z][a-z0-9]*:", path) else f"file://{quote(path)}")
                    with system.open_input_stream(at) as file:
                        rows.append((path, file.read(), True))
                except (FileNotFoundError, TypeError):
                    rows.append((path, None, False))
                except OSError:  # it is there, but cannot be read
                    rows.append((path, None, True))
            yield pd.DataFrame(rows, columns=["path", "content", "there"])

    found = paths.select("path").mapInPandas(run, "path STRING, content BINARY, there BOOLEAN")
    return decoded(found.select(F.xxhash64("path").alias("doc_id"), "path", "content", "there"), decoder)


def load(spark: SparkSession, path: str, decoder: Decoder = plain_text, pattern: str | None = None, strict: bool = False) -> DataFrame:
    """doc_id (a hash of the path), source_path, page_count, text, status of every file; ``strict`` fails on a bad one.

    A path that does not exist is a MissingPath error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise MissingPath(f"PATH_NOT_FOUND: {path}") from e
        raise
    # Spark's readers pass over files without a byte: the listing has them
    one_form = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string").select(one_form("path").alias("path"))
    files = found.select(one_form("path").alias("path"), "content")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    files = files.union(empty).select(F.xxhash64("path").alias("doc_id"), "path", "content")

    out = decoded(files, decoder)
    if strict:
        out = out.withColumn("status", F.when(F.col("status") == OK, F.col("status")).otherwise(F.raise_error(F.concat_ws(": ", "source_path", "status"))))
    return out
