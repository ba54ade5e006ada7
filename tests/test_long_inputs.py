"""Carried order, bucketed layouts, paid replies, long transcripts and large lexicons, each against its plainer form."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnstone.functions import phrase_index
from turnstone.functions.lexicon import DEFAULT, HEDGING, SURE, Lexicon, to_table
from turnstone.operators import consistency, coverage, hedging, model, pipeline, replies, revise, segment, verify
from turnstone.plans import derive, schemas
from turnstone.sources import layout, turns as turn_source

SF = "/root/testdata/sf0.001"
REPEATED = [(1, 1, "s", "first says", 0), (1, 1, "s", "last says", 1), (1, 2, "s", "only", 2), (2, 1, "s", "b", 9), (2, 1, "s", "a", 7), (2, 1, "s", "b", 9)]
KINDS = "doc_id long, turn_number int, section string, text string, ordinal int"


@pytest.mark.parametrize("deal", [(1,), (2, "text"), (3, "text"), (5, "doc_id"), (7, "text")])
def test_last_turn_by_ordinal_wherever_rows_lie(spark, deal):
    t = spark.createDataFrame(REPEATED, KINDS).repartition(*deal)
    got = sorted((r["doc_id"], r["turn_number"], r["text"]) for r in verify.last_turns(t).collect())
    assert got == [(1, 1, "last says"), (1, 2, "only"), (2, 1, "b")]
    c = spark.createDataFrame([(1, 0, "c", "guidance", 1, "last", False), (1, 1, "c", "guidance", 1, "first", False)], schemas.CLAIMS)
    assert {r["claim_no"]: r["passed"] for r in verify.faithfulness(c, t).collect()} == {0: True, 1: False}


def test_turns_that_differ_without_an_ordinal_are_an_error(spark):
    t = spark.createDataFrame(REPEATED, KINDS)
    with pytest.raises(PySparkException, match="turn 1 of document [12] repeats"):
        verify.last_turns(t.drop("ordinal")).collect()
    with pytest.raises(PySparkException, match="turn 1 of document 1 repeats"):
        verify.last_turns(t.withColumn("ordinal", F.lit(3)).where("doc_id = 1")).collect()
    alike = t.where("text in ('b', 'only')").drop("ordinal")
    assert alike.count() == 3 and verify.last_turns(alike).count() == 2


def test_ordinals_from_files_and_arrays(spark, tmp_path):
    """Rows of many files, read in one piece and in splits of a few bytes: the same last turns."""
    for no in range(3):
        rows = [{"doc_id": i % 5, "turn_number": 1 + i % 3, "speaker_name": "A", "section": "Q&A", "text": f"file {no} line {i}"} for i in range(200)]
        (tmp_path / f"{no}.json").write_text("\n".join(map(json.dumps, rows)))
    last = {(d, t): f"file 2 line {max(i for i in range(200) if i % 5 == d and 1 + i % 3 == t)}" for d in range(5) for t in range(1, 4)}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (was, "1000", "333"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            t = turn_source.from_files(spark, str(tmp_path)).repartition(4, "text")
            assert {(r["doc_id"], r["turn_number"]): r["text"] for r in verify.last_turns(t).collect()} == last
            assert t.select("ordinal").distinct().count() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    spark.read.schema(schemas.TURNS).json(str(tmp_path)).orderBy("text").coalesce(1).write.parquet(str(tmp_path / "parquet"))
    t = turn_source.from_files(spark, str(tmp_path / "parquet"), "parquet")
    assert [r["text"] for r in t.orderBy("ordinal").collect()] == sorted(r["text"] for r in t.collect())
    calls = spark.createDataFrame([(1, [(1, "old"), (2, "x"), (1, "new")]), (2, []), (3, None)], "doc_id long, turns array<struct<turn_number: int, text: string>>")
    t = turn_source.from_arrays(calls).withColumn("section", F.lit("s"))
    assert {(r["turn_number"], r["text"]) for r in verify.last_turns(t.repartition(3, "text")).collect()} == {(1, "new"), (2, "x")}


def test_checks_over_bucketed_tables_shuffle_nothing(spark, tmp_path):
    """Every join of checks, coverage and revision stands on the layout; results are those without it."""
    c, t = derive.claims(spark, SF), derive.turns(spark, SF)
    samples = derive.samples(c)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = {}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        layout.colocate(spark)
        for name, df in (("claims", c), ("turns", t), ("samples", samples)):
            names[name] = layout.save(df, f"bucketed_{name}", 4, str(tmp_path / name))

        def results(c, t, samples):
            docs = t.select("doc_id").distinct()
            faithful, scores = verify.faithfulness(c, t), consistency.summarize(c, samples)
            flagged = revise.needing_revision(c, faithful, scores)
            asked = revise.requests(flagged, t)
            fixed = asked.where("turn_found").select("doc_id", "first_no", F.lit("corrected").alias("action"), F.concat(F.lit("r"), "claim_text").alias("claim_text"), "category", "source_quote", "confidence_flag", F.lit("r").alias("reasoning"))
            revised = revise.apply(c, revise.outcomes(asked, fixed))
            return {
                "gate": verify.gate(c, t), "faithful": faithful, "rate": verify.faithfulness_rate(docs, faithful), "coverage": coverage.coverage(docs, coverage.section_coverage(c, t)),
                "flagged": flagged, "revised": revised, "again": revise.recheck(revised, t),
            }

        laid, plain = results(*names.values()), results(c, t, samples)
        for name, df in laid.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            shuffles = [x for x in plan.split("\n") if "Exchange" in x and "SinglePartition" not in x]  # guards add up one number a task
            assert not shuffles and ("SinglePartition" in plan) <= (name in ("flagged", "revised", "again")), (name, plan)
            assert sorted(map(str, df.collect())) == sorted(map(str, plain[name].collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        layout.colocate(spark, False)
        for name in names:
            spark.sql(f"drop table bucketed_{name}")


def _requests(spark, n):
    return spark.createDataFrame([(i, 0, 1, "s", f"prompt {i % (n - 3)}") for i in range(n)], "doc_id long, claim_no int, sample_no int, system string, prompt string")


def _counting(path, fail_at=None):
    def ask(asked):
        out = []
        for q in asked:
            with open(path, "a") as f:
                f.write(q["prompt"] + "\n")
            if q["prompt"] == fail_at:
                raise RuntimeError("killed")
            body = None if q["prompt"] == "prompt 5" else json.dumps({"score": 3, "rationale": q["prompt"]})
            out.append({"body": body, "stop_reason": "end_turn", "input_tokens": 10, "output_tokens": 1})
        return out

    return ask


def test_replies_are_paid_once(spark, tmp_path):
    """A run that dies, one that ends, and one more: only what the dying task had asked is asked again."""
    log, store = str(tmp_path / "log"), replies.ReplyStore(spark, str(tmp_path / "store"), rows_a_task=1)
    requests = _requests(spark, 30)
    with pytest.raises(Exception, match="killed"):
        store.call(requests, _counting(log, "prompt 7"), "eval_consistency", "m").collect()
    saved = store.files().count()
    assert saved < 27
    before = open(log).read().split("\n")[:-1]
    got = store.call(requests, _counting(log), "eval_consistency", "m")
    after = open(log).read().split("\n")[:-1][len(before) :]
    done = {r["body"] for r in store.files().collect()}
    assert len(after) == 27 - saved == len(set(after)) and len(done) == 27
    assert got.count() == 30 and got.columns == schemas.REPLIES.fieldNames()
    assert {(r["doc_id"], json.loads(r["body"])["rationale"] if r["body"] else None) for r in got.collect()} == {(i, f"prompt {i % 27}" if i % 27 != 5 else None) for i in range(30)}

    def poison(asked):
        raise AssertionError("called")

    assert store.call(requests.repartition(5), poison, "eval_consistency", "m").count() == 30
    assert store.usage().agg(F.sum("input_tokens")).first()[0] == 270
    for other in ({"stage": "revision"}, {"name": "n"}, {"max_tokens": 9}):  # another question each
        with pytest.raises(Exception, match="called"):
            store.call(requests, poison, **({"stage": "eval_consistency", "name": "m"} | other)).collect()
    again = replies.ReplyStore(spark, store.folder, retry=True)
    size = len(open(log).read().split("\n"))
    again.call(requests, _counting(log), "eval_consistency", "m")
    assert open(log).read().split("\n")[size - 1 : -1] == ["prompt 5"]
    assert store.call(requests.limit(0), poison, "eval_consistency", "m").count() == 0


def test_pipeline_over_a_store(spark, tmp_path):
    store = replies.ReplyStore(spark, str(tmp_path / "store"))
    t, c = derive.turns(spark, SF), derive.claims(spark, SF)
    docs = t.select("doc_id").distinct()

    def run(ask, **options):
        found = pipeline.extract(t, ask, **options)
        report = pipeline.evaluate(docs, c, t, ask, **options)
        done = pipeline.correct(docs, c, t, report, ask, **options)
        return [sorted(map(str, d.collect())) for d in (found.claims, report.rates, report.consistency, done.claims, done.rates)]

    def poison(asked):
        raise AssertionError("called")

    assert run(model.stub) == run(model.stub, store=store) == run(poison, name="stub", store=store)


WORDS = ["Ana Ruiz: hello", "Bo Chen, Analyst", "Operator: next", "Operator: We now open the call for questions", "Questions and Answers", "so it goes", "", " \t", "Q & A:", "plain. text"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 16])
def test_long_transcripts_equal_the_window_version(spark, size):
    own = random.Random(size)
    texts = {i: "\n".join(own.choices(WORDS, k=own.randint(0, 25))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    given = spark.createDataFrame([(i, 3 * p + 5, x or None) for i, t in texts.items() for p, x in enumerate(t.split("\n"))], "doc_id long, pos long, raw string").repartition(5)
    for a, b in zip(segment.segment(docs), segment.segment_lines(given, size), strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_one_very_long_transcript_is_many_tasks(spark):
    """300 000 lines of one document: the largest task takes a range of lines, and turns are right."""
    n, per = 300_000, 1000
    line = F.when(F.col("id") % 100 == 0, F.concat(F.lit("Ana Ruiz: turn "), F.col("id").cast("string"))).when(F.col("id") == 150_050, "Questions and Answers").otherwise(F.concat(F.lit("line "), F.col("id").cast("string")))
    given = spark.range(n).select(F.when(F.col("id") < 0, 2).otherwise(1).alias("doc_id"), F.col("id").alias("pos"), line.alias("raw"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cues = segment.ranged_cue_lines(given, per)
        windows = re.findall(r"windowspecdefinition\((.*?) ASC", cues._jdf.queryExecution().optimizedPlan().toString())
        assert {re.sub(r"#\w+", "", w) for w in windows} == {"doc_id, _range", "doc_id, _range, pos"}  # ranges of a document; lines of a range
        assert cues.groupBy(F.spark_partition_id()).count().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    turns, report = segment.segment_lines(given, per)
    assert turns.count() == n // 100 and report.first()["qa_boundary_turn"] == 1502
    assert turns.where("turn_number = 2").first()["text"].startswith("turn 100 line 101 line 102")


def _named(column):
    return [(m["phrase"], m["category"]) for m in column]


@pytest.mark.parametrize("lexicon", [DEFAULT, derive.LEXICON, Lexicon((("a b", "x"), ("a b c", "y"), ("b", "z"), ("a b", "last"), ("c-d", "w")), (("b c", "s"), ("é", "t")))])
def test_phrase_index_equals_the_pattern(spark, lexicon):
    own = random.Random(4)
    words = [w for p, _ in (lexicon.hedging + lexicon.confident)[:60] for w in p.split(" ")] + ["a", "b", "c", "d", "É", "é", "x_1", "日本"]
    texts = ["".join(w + own.choice([" ", " ", " ", "  ", "-", ", ", ". ", "\n", ""]) for w in own.choices([x.upper() if own.random() < 0.3 else x for x in words], k=own.randint(0, 25))) for _ in range(200)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "a b c a b-b c", "A B C"])], "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: (r["label"], _named(r["hedge_matches"] or []), _named(r["confident_matches"] or [])) for r in hedging.classify(d.where("text is not null"), lexicon=lexicon).collect()}
    got = {r["doc_id"]: (r["label"], _named(r["hedge_matches"]), _named(r["confident_matches"])) for r in hedging.classify_indexed(d, to_table(spark, lexicon)).collect()}
    assert got.pop(201) == ("unmarked", [], []) and got == want


def test_a_lexicon_of_100_000_phrases(spark):
    own = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    phrases = list({" ".join(own.choices(vocabulary, k=own.choice([1, 2, 3, 3, 4, 4]))) for _ in range(150_000)})[:100_000]
    assert len(phrases) == 100_000
    table = spark.createDataFrame([(HEDGING if i % 2 else SURE, f"c{i % 7}", p, i) for i, p in enumerate(phrases)], schemas.LEXICON)
    texts = [" ".join(own.choices(vocabulary, k=40)) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {b: {p: f"c{i % 7}" for i, p in enumerate(phrases) if (i % 2 == 1) == (b == HEDGING)} for b in (HEDGING, SURE)}

    def by_hand(text, known):
        ws, i, out = text.split(" "), 0, []
        while i < len(ws):
            n = next((n for n in (4, 3, 2, 1) if i + n <= len(ws) and " ".join(ws[i : i + n]) in known), 0)
            if n:
                out.append((p := " ".join(ws[i : i + n]), known[p]))
            i += n or 1
        return list(dict.fromkeys(out))

    got = {r["doc_id"]: (_named(r["hedge_matches"]), _named(r["confident_matches"])) for r in hedging.classify_indexed(d, table).collect()}
    assert got == {i: (by_hand(t, rows[HEDGING]), by_hand(t, rows[SURE])) for i, t in enumerate(texts)}
    with pytest.raises(PySparkException, match="not a phrase between word characters"):
        phrase_index.index(spark.createDataFrame([(HEDGING, "c", "-x", 0)], schemas.LEXICON)).collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_places_of_texts_are_never_broadcast(spark, tmp_path, monkeypatch, most):
    """By the size of their file Spark would take them for small; the lexicon is broadcast if it is small, else nothing is."""
    monkeypatch.setattr(phrase_index, "BROADCAST_BYTES", most, raising=False)
    spark.createDataFrame([(i, "of the that is to the end " * 20) for i in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    table = to_table(spark, derive.LEXICON)
    found = phrase_index.hits(d, "doc_id", "text", phrase_index.index(table))
    assert "BuildLeft" not in _plan(found) and _plan(found).count("BroadcastHashJoin") == (2 if most else 0)
    want = {r["doc_id"]: _named(r["hedge_matches"]) for r in hedging.classify(d, lexicon=derive.LEXICON).collect()}
    assert {r["doc_id"]: _named(r["hedge_matches"]) for r in hedging.classify_indexed(d, table).collect()} == want


def test_hits_of_texts_are_never_broadcast(spark):
    """They grow with the texts; a high threshold used to bring them to the driver once adaptive execution had seen their size."""
    d = spark.createDataFrame([(i, "of the that is to the end") for i in range(300)] + [(300, "none"), (301, None)], "doc_id long, text string").repartition(3)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "512m")
        found = hedging.classify_indexed(d, to_table(spark, derive.LEXICON))
        rows = found.collect()
        plan = _plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "isFinalPlan=true" in plan
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and "BroadcastHashJoin [_row" not in final and final.count("BroadcastHashJoin") == 2  # the lexicon's
    assert {len(r["hedge_matches"]) for r in rows if r["doc_id"] < 300} == {2} and [len(r["hedge_matches"]) for r in rows if r["doc_id"] >= 300] == [0, 0] and len(rows) == 302


def test_places_carry_no_more_than_the_longest_phrase(spark, monkeypatch):
    """A text of 20 000 words, which each of its places used to carry whole."""
    monkeypatch.setattr(phrase_index, "BROADCAST_BYTES", 0, raising=False)
    d = spark.createDataFrame([(1, "-a b c " * 3), (2, "ab"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r["_key"], r["_at"], r["first"], list(r["_rest"])) for r in phrase_index.places(d, "doc_id", "text", 3).sort("_key", "_at").collect()]
    assert got[:2] == [(1, 1, "a", [" ", "b"]), (1, 3, "b", [" ", "c"])] and got[-2:] == [(1, 17, "c", [" "]), (2, 0, "ab", [])] and len(got) == 10
    long = spark.createDataFrame([(1, "of the that is to the end, then " * 2500)], "doc_id long, text string")
    r = hedging.classify_indexed(long, to_table(spark, derive.LEXICON)).first()
    assert _named(r["hedge_matches"]) == [("of the that", "odds"), ("to the", "belief")] and _named(r["confident_matches"]) == [("of the", "done"), ("is", "surely"), ("the", "strong")]


def test_a_lexicon_parsed_as_rows(spark):
    """Files as rows equal the parser on the driver, with odd lines, ends of lines and closed buckets."""
    from pathlib import Path

    from turnstone.functions import lexicon

    default = Path(lexicon.__file__).with_name("default_lexicon.md").read_text(encoding="utf-8")
    odd = "- x\r\n## Hedging Phrases \x0b### A\u2028- One  Two \n-three\n - four\n###\n- five\x85## other\n### B\n- six\n## confident / unqualified phrases\n- seven\n###\tC\n-\x1ceight\n- Nine\n##\n- ten"
    files = {1: default, 2: odd, 3: odd.replace("C", "D"), 4: "", 5: None}
    d = spark.createDataFrame(list(files.items()), "doc_id long, text string").repartition(3)
    got = lexicon.parse_lines(lexicon.file_lines(d)).collect()
    for i, text in files.items():
        want = lexicon.parse_lexicon(text).rows() if text else []
        assert sorted((r["bucket"], r["category"], r["phrase"], r["ord"]) for r in got if r["doc_id"] == i) == sorted(want)


def test_a_batch_of_usage_counts_once(spark, tmp_path, monkeypatch):
    """Repeated, committed and repeated, or written and never committed."""
    from turnstone.operators import usage

    rows = lambda n: spark.createDataFrame([(i, "extraction", "m", 1, 2, 3, 4) for i in range(n)], schemas.USAGE)
    path = str(tmp_path / "usage")
    total = lambda: usage.committed(spark, path).agg(F.count("*"), F.sum("output_tokens")).first()[:]
    assert total() == (0, None)
    assert usage.append_batch(rows(3), path, 0) and not usage.append_batch(rows(3), path, 0)
    rows(50).write.parquet(f"{path}/batch=1")  # a run that died before its commit
    assert total() == (3, 6)
    assert usage.append_batch(rows(5), path, 1) and total() == (8, 16)
    assert {r["batch"]: r["count"] for r in usage.committed(spark, path).groupBy("batch").count().collect()} == {0: 3, 1: 5}
