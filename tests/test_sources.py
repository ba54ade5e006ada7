from __future__ import annotations

import pytest

from turnstone import cli
from turnstone.operators import usage, verify
from turnstone.plans import schemas
from turnstone.sources import documents, report
from turnstone.streaming import micro_batches


def test_load_and_gate(spark, tmp_path):
    (tmp_path / "good.txt").write_text("x" * 100 + "\f")
    (tmp_path / "thin.txt").write_text("x" * 99 + "\f ")
    (tmp_path / "blank.txt").write_text(" \f ")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfd")
    got = {r["source_path"].rpartition("/")[2]: (r["status"], r["page_count"]) for r in documents.load(spark, str(tmp_path)).collect()}
    assert got == {"good.txt": ("ok", 2), "thin.txt": ("no_text_layer", 2), "blank.txt": ("no_text_layer", 2), "empty.txt": ("unreadable", 0), "bad.txt": ("unreadable", 0)}
    zero = documents.load(spark, str(tmp_path), decoder=lambda b: [])
    assert {r["status"] for r in zero.collect()} == {"zero_pages"}
    with pytest.raises(Exception, match="no_text_layer|unreadable"):
        documents.load(spark, str(tmp_path), strict=True).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.load(spark, str(tmp_path / "missing")).collect()


def test_files_that_a_table_names(spark, tmp_path):
    """Read where their rows are, in batches and as a stream; what is empty, broken or not there is a row."""
    (tmp_path / "a good.txt").write_text("x" * 60)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "bad").write_bytes(b"\xff")
    (tmp_path / "folder").mkdir()
    names = ["a good.txt", "empty", "bad", "none", "a good.txt", "folder"]
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names] + [((tmp_path / "bad").as_uri(),), (None,)], "path string").repartition(3)
    want = sorted([("a good.txt", "ok"), ("a good.txt", "ok"), ("empty", "unreadable"), ("bad", "unreadable"), ("bad", "unreadable"), ("none", "missing"), ("folder", "unreadable"), (None, "missing")], key=str)
    status = lambda df: sorted(((r["source_path"] and r["source_path"].rpartition("/")[2], r["status"]) for r in df.collect()), key=str)
    got = documents.read_paths(paths)
    assert status(got) == want and got.columns == documents.load(spark, str(tmp_path)).columns
    paths.write.parquet(str(tmp_path / "paths"))
    stream = documents.read_paths(spark.readStream.schema("path string").parquet(str(tmp_path / "paths")))
    stream.writeStream.format("memory").queryName("named_files").trigger(availableNow=True).start().awaitTermination(120)
    assert status(spark.table("named_files")) == want


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/call.txt").write_text("Ana Ruiz: We may grow. We did.\nOperator: We now open the call for questions.\nBo Chen: Thanks.")
    cli.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/turns")).where("section = 'Q&A'").count() == 2
    assert spark.read.parquet(str(tmp_path / "out/sentences")).where("label = 'hedged'").count() == 1


def test_command_line_with_a_decoder(spark, tmp_path):
    (tmp_path / "call.bin").write_bytes("Ana Ruiz: We may grow. We did so, and more of it than anyone had thought.".encode("utf-16"))
    cli.main(["--input", str(tmp_path / "call.bin"), "--output", str(tmp_path / "out"), "--decoder", "decoders:utf16"])
    assert [r["text"][:12] for r in spark.read.parquet(str(tmp_path / "out/turns")).collect()] == ["We may grow."]
    with pytest.raises(AttributeError):
        cli.named("decoders:none")


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, "Ana Ruiz: We may grow.\nBo Chen: Good.")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "docs"))
    micro_batches.segment_stream(spark, str(tmp_path / "docs"), d.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    turns = spark.read.parquet(str(tmp_path / "out/turns"))
    assert turns.count() == 2
    c = spark.createDataFrame([(1, 0, "c", "guidance", 1, "may grow", False), (1, 1, "c", "guidance", 2, "no", False)], schemas.CLAIMS)
    c.write.parquet(str(tmp_path / "claims"))
    micro_batches.check_stream(spark, str(tmp_path / "claims"), schemas.CLAIMS, turns, str(tmp_path / "checked"), str(tmp_path / "cp2")).awaitTermination(120)
    assert {r["claim_no"]: r["passed"] for r in spark.read.parquet(str(tmp_path / "checked")).collect()} == {0: True, 1: False}


def test_report_and_usage_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, "A", None, "Q&A", "we grew")], schemas.TURNS)
    c = spark.createDataFrame([(1, 0, "grew", "guidance", 1, "grew", False)], schemas.CLAIMS)
    body = report.markdown(verify.faithfulness(c, t))
    assert body.first()["body"] == "# Document 1\n\nFaithfulness: 1 of 1\n\n- [x] grew (turn 1)"
    report.write(body, str(tmp_path / "reports"))
    assert [(r["doc_id"], r["body"]) for r in spark.read.json(str(tmp_path / "reports")).collect()] == [(1, body.first()["body"])]
    for _ in range(2):
        usage.append(usage.zero_rows(t, "extraction", "m"), str(tmp_path / "usage"))
    assert spark.read.parquet(str(tmp_path / "usage")).count() == 2


def test_a_missing_path_is_an_error_of_its_own(spark, tmp_path):
    with pytest.raises(documents.MissingPath):
        documents.load(spark, str(tmp_path / "none"))
