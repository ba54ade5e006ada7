from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.functions.text import normalized
from turnstone.operators import consistency, coverage, model, pipeline, prompts, revise, usage, verify
from turnstone.plans import schemas

TURNS = [(1, 1, "Ana Ruiz", "Chief Executive", "Prepared Remarks", "Revenue  grew\nby “ten” per cent – again."), (1, 2, "Bo Chen", None, "Q&A", "What about the risk?"), (2, 1, "Ana Ruiz", None, "Prepared Remarks", "Hello.")]
CLAIMS = [
    (1, 0, "a", "guidance", 2, "about the risk", False),
    (1, 1, "b", "risk_factors", 2, "about this risk", True),
    (1, 2, "c", "risk_factors", 99, "about the risk", False),
    (1, 3, "d", "guidance", 1, "Revenue grew by", False),
    (1, 4, "e", "guidance", 1, 'by "ten" per cent - again', False),
    (1, 5, "f", "guidance", 2, "About the risk", False),
    (1, 6, "g", "guidance", 2, "", False),
    (1, 7, "h", "guidance", 2, None, False),
    (1, 8, "b", "risk_factors", 2, "about this risk", True),
]
EXACT = ["kept", "quote_not_found", "turn_missing", "quote_not_found", "quote_not_found", "quote_not_found", "kept", "quote_not_found", "quote_not_found"]
FAITHFUL = [True, False, False, True, True, False, True, False, False]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(CLAIMS, schemas.CLAIMS), spark.createDataFrame(TURNS, schemas.TURNS)


def test_gate(tables):
    got = verify.gate(*tables).orderBy("claim_no").collect()
    assert [r["status"] for r in got] == EXACT
    assert all((r["warning"] is None) == (r["status"] == "kept") for r in got)
    assert verify.kept_claims(verify.gate(*tables)).columns == tables[0].columns


def test_faithfulness(tables, spark):
    results = verify.faithfulness(*tables)
    assert [r["passed"] for r in results.orderBy("claim_no").collect()] == FAITHFUL
    rates = {r["doc_id"]: (r["total"], r["passed"], r["failed"], r["rate"]) for r in verify.faithfulness_rate(tables[1], results).collect()}
    assert rates == {1: (9, 4, 5, 4 / 9), 2: (0, 0, 0, 1.0)}


def test_last_of_repeated_turns_counts(spark):
    t = spark.createDataFrame([(1, 1, "s", "old", 0), (1, 1, "s", "new", 1)], "doc_id long, turn_number int, section string, text string, at int")
    assert [r["text"] for r in verify.last_turns(t, "at").collect()] == ["new"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("aB “'‘-– \n\x1c"), st.text("aB “'‘-– \n\x1c", max_size=4)), min_size=1, max_size=12))
def test_normalisation(spark, pairs):
    df = spark.createDataFrame(pairs, "t string, q string").select("t", "q", normalized("t").alias("n"), normalized("q").alias("m"))
    for r in df.select("*", normalized("n").alias("nn"), F.contains("t", "q").alias("exact"), F.contains("n", "m").alias("near")).collect():
        plain = r["t"].translate(str.maketrans("‘’“”‐‑‒–—", "''\"\"-----"))
        assert r["n"] == r["nn"] == " ".join(plain.split())
        assert r["near"] or not r["exact"] or r["q"] != r["q"].strip()


def test_coverage(tables):
    claims, turns = tables
    for given_claims, want in ((claims, {1: ([], True), 2: (["Prepared Remarks"], False)}), (claims.where("source_turn_number = 99"), {1: (["Prepared Remarks", "Q&A"], False), 2: (["Prepared Remarks"], False)})):
        got = {r["doc_id"]: (r["sections_missing"], r["passed"]) for r in coverage.coverage(turns, coverage.section_coverage(given_claims, turns)).collect()}
        assert got == want


SCORES = {1: ([2, 2, 5, 5, 5], (2.0, 2, 2, True), [2, 2]), 2: ([4, 5, 1, 1, 1], (4.5, 4, 5, True), [4, 5]), 3: ([5, 1, 2, 2, 4], (2.0, 1, 5, False), [5, 1, 2, 2, 4]), 4: ([2, 4, 3, 3, 2], (3.0, 2, 4, False), [2, 4, 3, 3, 2])}


def test_consistency(spark):
    claims = spark.createDataFrame([(1, n, "t", "risk_factors" if n < 3 else "hedging_tone", 1, "q", False) for n in SCORES] + [(1, 9, "t", "guidance", 1, "q", False)], schemas.CLAIMS)
    samples = spark.createDataFrame([(1, n, i + 1, s) for n, (scores, _, _) in SCORES.items() for i, s in enumerate(scores)], schemas.SAMPLES)
    got = {r["claim_no"]: r for r in consistency.summarize(claims, samples).collect()}
    assert set(got) == set(SCORES)
    for n, (_, want, taken) in SCORES.items():
        assert (got[n]["median"], got[n]["low"], got[n]["high"], got[n]["stable"]) == want and got[n]["samples"] == taken
    assert got[1]["dimension"] == "materiality" and got[3]["dimension"] == "framing"
    assert {r["claim_no"] for r in consistency.unstable(samples).collect()} == {3, 4}
    with pytest.raises(Exception, match="not a judgment category"):
        consistency.only_judgment_claims(claims).collect()


def reply(body, **more):
    return {"body": body if body is None or isinstance(body, str) else json.dumps(body), "stop_reason": "end_turn", "input_tokens": 5} | more


def test_replies_are_valid_as_a_whole(spark):
    good = {"claim_text": "t", "category": "guidance", "source_turn_number": 1, "source_quote": "q", "confidence_flag": False}
    bodies = [{"claims": [good]}, {"claims": []}, {"claims": [good, good | {"category": "gossip"}]}, '{"claims": [{"claim_te', None, {"claims": [{k: v for k, v in good.items() if k != "source_quote"}]}, {}]
    asked = spark.createDataFrame([(i, 0, 0, "", "p") for i in range(len(bodies))], "doc_id long, claim_no int, sample_no int, system string, prompt string")
    got = model.parse_claims(model.call(asked, lambda qs: [reply(bodies[q["doc_id"]]) for q in qs], "extraction", "m"))
    assert [r["status"] for r in got.orderBy("doc_id").collect()] == ["ok", "ok", "invalid_reply", "invalid_reply", "no_reply", "invalid_reply", "invalid_reply"]
    assert model.claim_rows(got).count() == 1
    with pytest.raises(Exception, match="no_reply|invalid_reply"):
        model.strict(got).collect()


def test_scores_and_revisions_are_checked(spark):
    bodies = [{"score": 5, "rationale": "r"}, {"score": 6, "rationale": "r"}, {"score": 3}, {"action": "discard", "reasoning": "r"}, {"action": "corrected", "reasoning": "r"}, {"action": "keep", "reasoning": "r"}]
    rows = spark.createDataFrame([(i, 0, 0, "s", "m", json.dumps(b), "end_turn", 0, 0, 0, 0) for i, b in enumerate(bodies)], schemas.REPLIES)
    assert [r["status"] == "ok" for r in model.parse_scores(rows.where("doc_id < 3")).orderBy("doc_id").collect()] == [True, False, False]
    assert [r["status"] == "ok" for r in model.parse_revisions(rows.where("doc_id > 2")).orderBy("doc_id").collect()] == [True, False, False]


def poison(requests):
    raise AssertionError("the model was called")


def test_no_call_without_need(spark, tables):
    claims, turns = tables
    assert pipeline.extract(turns.limit(0), poison).claims.count() == 0
    plain = claims.where("claim_no in (0, 6)")
    report = pipeline.evaluate(turns, plain, turns, poison)
    assert report.consistency.count() == 0
    done = pipeline.correct(turns, plain, turns, report, poison)
    assert done.claims.count() == 2 and done.outcomes.count() == 0


def test_extraction_keeps_only_verified_claims(spark, tables):
    good = {"claim_text": "t", "category": "guidance", "source_turn_number": 2, "source_quote": "the risk", "confidence_flag": False}

    def ask(requests):
        assert all("[Turn 1 | Prepared Remarks | Ana Ruiz" in q["prompt"] and q["max_tokens"] == 8192 for q in requests)
        return [reply({"claims": [good, good | {"source_quote": "no"}, good | {"source_turn_number": 7}]}, output_tokens=3) for _ in requests]

    got = pipeline.extract(tables[1].where("doc_id = 1"), ask, "m")
    assert got.claims.count() == 1 and {r["status"] for r in got.dropped.collect()} == {"quote_not_found", "turn_missing"}
    total = {(r["stage"], r["model"]): r["output_tokens"] for r in usage.by_stage(got.usage).collect()}
    assert total == {("extraction", "m"): 3, ("extraction", None): 3, (None, None): 3}


def test_evaluate_and_correct(spark, tables):
    claims, turns = tables

    def judge(requests):
        return [reply({"score": 1 if q["sample_no"] % 2 else 5, "rationale": "r"}) for q in requests]

    report = pipeline.evaluate(turns, claims, turns, judge, "m")
    taken = {r["claim_no"]: len(r["samples"]) for r in report.consistency.collect()}
    assert taken == {1: 5, 2: 5, 8: 5}

    def fix(requests):
        out = []
        for q in requests:
            quote = "about the risk" if "about this risk" in q["prompt"] else "still wrong"
            out.append(reply({"action": "corrected", "claim_text": "new", "category": "risk_factors", "source_quote": quote, "confidence_flag": False, "reasoning": "r"} if "About" not in q["prompt"] else {"action": "discard", "reasoning": "r"}))
        return out

    done = pipeline.correct(turns, claims, turns, report, fix, "m")
    found = {r["first_no"]: r for r in done.outcomes.collect()}
    assert set(found) == {1, 2, 5, 7}
    assert found[1]["reasons"] == ["unfaithful_quote", "unfaithful_quote", "high_variance_judgment", "high_variance_judgment"]
    assert found[2]["action"] == "discard" and found[2]["reasoning"] == "the cited turn does not exist"
    kept = {r["claim_no"]: r for r in done.claims.collect()}
    assert set(kept) == {0, 1, 3, 4, 6, 7, 8} and kept[1]["source_quote"] == kept[8]["source_quote"] == "about the risk" and kept[1]["source_turn_number"] == 2
    passed = {r["claim_no"]: r["passed"] for r in done.faithfulness.collect()}
    assert passed[1] and passed[8] and not passed[7]
    assert done.usage.count() == 3


def test_spread_threshold(spark, tables):
    claims, turns = tables
    wide = spark.createDataFrame([(1, 0, "t", "risk_factors", "materiality", [2, 4, 3, 3, 2], 3.0, 2, 4, False, True)], "doc_id long, claim_no int, claim_text string, category string, dimension string, samples array<int>, median double, low int, high int, stable boolean, escalated boolean")
    one = claims.where("claim_no = 0").withColumn("category", F.lit("risk_factors"))
    ok = verify.faithfulness(claims.where("claim_no = 0"), turns)
    assert revise.needing_revision(one, ok, wide, 2).count() == 1
    assert revise.needing_revision(one, ok, wide, 3).count() == 0
    for c, r, w in ((claims, ok, wide), (one, ok.limit(0), wide), (one, ok, wide.limit(0)), (claims.where("claim_no = 0"), ok, wide), (one, ok.withColumn("doc_id", F.lit(7)), wide)):
        with pytest.raises(Exception, match="do not match the claims"):
            revise.needing_revision(c, r, w).count()
    assert revise.unmatched(claims, ok).count() == 8


def test_the_last_of_turns_that_share_a_number_counts(spark, tables):
    claims, turns = tables
    more = spark.createDataFrame([(1, 2, "Bo Chen", None, "Prepared Remarks", "About the risk again")], turns.schema)
    again = turns.withColumn("ordinal", F.lit(0)).union(more.withColumn("ordinal", F.lit(1)))
    one = claims.where("claim_no in (0, 5)")
    assert {r["claim_no"]: r["passed"] for r in verify.faithfulness(one, again).collect()} == {0: False, 5: True}
    assert verify.faithfulness(one, again).count() == verify.gate(one, again).count() == 2
    covered = {r["section"]: r["covered"] for r in coverage.section_coverage(one, again).where("doc_id = 1").collect()}
    assert covered == {"Prepared Remarks": True, "Q&A": False}


@pytest.mark.parametrize("bad", [{"body": None}, {"body": '{"score": 9, "rationale": "r"}'}])
def test_a_sample_without_a_valid_score_is_an_error(tables, bad):
    """Else the other of the first two would stand alone, and pass for agreement."""
    claims, _ = tables
    ask = lambda asked: [bad if q["sample_no"] == 1 else {"body": '{"score": 3, "rationale": "r"}'} for q in asked]
    with pytest.raises(Exception, match="no_reply|invalid_reply"):
        pipeline.sample(claims, ask)[0].count()


def test_extraction_may_be_strict(tables):
    refuse = lambda asked: [{} for _ in asked]
    assert pipeline.extract(tables[1], refuse).failed.count() == 2
    with pytest.raises(Exception, match="no_reply"):
        pipeline.extract(tables[1], refuse, strict=True).claims.count()


def test_prompts(spark, tables, tmp_path):
    p = prompts.extraction_prompts(tables[1]).where("doc_id = 1").first()["prompt"]
    assert p.endswith("[Turn 2 | Q&A | Bo Chen]\nWhat about the risk?")
    (tmp_path / "a").write_text("---\nx: y\n---\n\nDo it. \n\n")
    (tmp_path / "b").write_text("kinds")
    assert [b["text"] for b in prompts.system_prompt(tmp_path / "a", tmp_path / "b")] == ["Do it.", "kinds"]
