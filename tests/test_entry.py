"""Registered queries against their SQL in DuckDB, over whole tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from turnstone.plans import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    got = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, got.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want and want


@pytest.mark.parametrize(("name", "plain"), [("bucketed_checks", "faithfulness_results"), ("replies_paid_once", "extracted_claims"), ("usage_by_batch", "usage_by_stage")])
def test_query_that_writes_files_equals_the_one_that_does_not(spark, name, plain):
    a, b = (registry.queries()[n](spark, SF_DIR) for n in (name, plain))
    assert name not in registry.oracle_sql() and sorted(a.columns) == sorted(b.columns)
    got = rows(a.columns, [tuple(r) for r in a.collect()])
    assert got == rows(b.columns, [tuple(r) for r in b.collect()]) and got


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["doc_id", "total", "passed", "failed", "rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_derived_inputs_cover_all_outcomes(spark):
    got = lambda n, c: {r[c] for r in registry.queries()[n](spark, "/root/testdata/sf0.01").collect()}
    assert got("qa_boundary", "boundary_by") == {"heading", "keyword", "second_operator", "none"}
    assert got("claims_dropped", "status") == {"turn_missing", "quote_not_found"}
    assert got("sentence_labels", "label") == {"hedged", "confident", "unmarked"}
    assert got("consistency", "stable") == {True, False}
    assert got("revision_outcomes", "action") == {"corrected", "discard"}
    assert got("post_faithfulness", "passed") == {True, False}


def test_default_lexicon_lowers_each_text_once(spark, tmp_path):
    """Not inside the filter, where it was done for each of the phrases."""
    phrases = [p for _, _, p, _ in registry.DEFAULT.rows()]
    texts = [phrases[0].upper() + "x " + phrases[-1], None, "", "É " + phrases[-1].title() * 2]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["default_lexicon"](spark, str(tmp_path))
    steps = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert ["lower(" in s for s in steps if "Generate explode" in s] == [False] and sum("lower(" in s for s in steps) == 1
    want = {p: sum(p in (t or "").lower() for t in texts) for p in phrases}
    got = df.collect()
    assert len(got) == len(phrases) and {r["phrase"]: r["n_documents"] for r in got} == want and want[phrases[-1]] == 2
