from __future__ import annotations

import pytest

from turnstone.operators import segment

CASES = {
    "no cues": "the quarter went well, as it were.\nnothing else to say",
    "empty": "",
    "headers": "Ana Ruiz, Chief Executive\n\nGood day to all.\n\nBo Chen, Analyst\n\nThanks.",
    "one operator": "Ana Ruiz, Chief Executive\n\nGood day.\n\nOperator: Next.",
    "heading": "Operator: Hello.\nAna Ruiz: We did well.\n\nQuestion and Answer Section\n\nBo Chen: A question.",
    "two headings": "Q & A\nOperator: Hello.\n\nQuestions & Answers:\n\nAna Ruiz: Well.\nQ&A\nBo Chen: Me.",
    "trailing heading": "Operator: Hello.\nAna Ruiz: Well.\n\nQ&A Section",
    "keyword below": "Ana Ruiz: Well.\nOperator:\nWe will now open the lines for questions.",
    "two operators": "Operator: Hello.\nAna Ruiz: Well.\nOperator: Next.",
    "front matter": "Acme Co - Call\nDate - May\n\nAna Ruiz, Chief Executive\n\nHello.",
    "dense": "Ana Ruiz: One.\nBo Chen, Analyst: Two.\nmore of two\nCy Dee: Three.",
    "header in a block": "Ana Ruiz: One.\nBo Chen, Analyst\nstill one",
    "false cue": "Ana Ruiz: One.\nWell, as I said: two.",
    "unicode blanks": " Ana Ruiz Li:  One. \u001c\n\t \nBo Chen: Two more",
}
# turns, boundary, by, warnings
EXPECTED = {
    "no cues": (0, None, None, ["front_matter_skipped", "no_boundary", "few_turns"]),
    "empty": (0, None, None, ["no_boundary", "few_turns"]),
    "headers": (2, None, None, ["no_boundary"]),
    "one operator": (2, None, None, ["no_boundary"]),
    "heading": (3, 3, "heading", []),
    "two headings": (3, 3, "heading", []),
    "trailing heading": (2, None, None, ["no_boundary"]),
    "keyword below": (2, 2, "keyword", []),
    "two operators": (3, 3, "second_operator", ["weak_boundary"]),
    "front matter": (1, None, None, ["front_matter_skipped", "no_boundary", "few_turns"]),
    "dense": (3, None, None, ["no_boundary"]),
    "header in a block": (1, None, None, ["no_boundary", "few_turns"]),
    "false cue": (2, None, None, ["no_boundary"]),
    "unicode blanks": (2, None, None, ["no_boundary"]),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES.values())] + [(99, None)], "doc_id long, text string")
    turns, report = segment.segment(docs)
    by: dict = {}
    for r in turns.orderBy("doc_id", "turn_number").collect():
        by.setdefault(r["doc_id"], []).append(r)
    return by, {r["doc_id"]: r for r in report.collect()}


@pytest.mark.parametrize("case", CASES)
def test_report(found, case):
    r = found[1][list(CASES).index(case)]
    assert (r["n_turns"], r["qa_boundary_turn"], r["boundary_by"], r["warnings"]) == EXPECTED[case]
    assert r["low_confidence"] == (r["qa_boundary_turn"] is None or r["n_turns"] < 2)


def turns(found, case):
    return found[0].get(list(CASES).index(case), [])


def test_turns(found):
    assert [(t["speaker_name"], t["speaker_title"], t["text"]) for t in turns(found, "dense")] == [("Ana Ruiz", None, "One."), ("Bo Chen", "Analyst", "Two. more of two"), ("Cy Dee", None, "Three.")]
    assert [t["section"] for t in turns(found, "heading")] == ["Prepared Remarks", "Prepared Remarks", "Q&A"]
    assert turns(found, "headers")[0]["speaker_title"] == "Chief Executive"
    assert turns(found, "header in a block")[0]["text"] == "One. Bo Chen, Analyst still one"
    assert turns(found, "false cue")[1]["speaker_title"] == "as I said"
    assert [(t["speaker_name"], t["text"]) for t in turns(found, "unicode blanks")] == [("Ana Ruiz Li", "One."), ("Bo Chen", "Two more")]
    assert found[1][list(CASES).index("front matter")]["front_preview"] == "Acme Co - Call"


def test_null_text_is_an_empty_document(found):
    assert found[1][99]["n_turns"] == 0 and found[1][99]["warnings"] == ["no_boundary", "few_turns"]


def test_one_shuffle_serves_windows_and_turns(spark):
    plan = segment.segment(spark.createDataFrame([(1, "a")], "doc_id long, text string"))[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
