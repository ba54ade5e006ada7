"""python -m turnstone.cli --input PATH --output PATH: transcripts to turns, labels and reports."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from turnstone.functions.lexicon import DEFAULT, read_lexicon
from turnstone.operators import hedging, segment
from turnstone.sources.documents import OK, Decoder, load, plain_text


def named(name: str) -> Decoder:
    """The decoder ``module:function``, which the executors must be able to import as well."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True, help="file or folder of transcripts")
    parser.add_argument("--output", required=True, help="folder for turns, sentences, reports and rejected files")
    parser.add_argument("--decoder", help="module:function from a file's bytes to the texts of its pages; plain text without one")
    parser.add_argument("--lexicon", help="Markdown file of phrases")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("turnstone").getOrCreate()
    docs = load(spark, a.input, named(a.decoder) if a.decoder else plain_text)
    good = docs.where(docs["status"] == OK)
    turns, report = segment.segment(good)
    lexicon = read_lexicon(spark, a.lexicon) if a.lexicon else DEFAULT
    for name, df in (("turns", turns), ("reports", report), ("sentences", hedging.analyze(turns, lexicon)), ("rejected", docs.where(docs["status"] != OK).drop("text"))):
        df.write.mode("overwrite").parquet(f"{a.output}/{name}")


if __name__ == "__main__":
    main()
