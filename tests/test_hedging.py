from __future__ import annotations

import pytest

from turnstone.functions import lexicon as lx
from turnstone.operators import hedging

MARKDOWN = """# Words
- outside
## Hedging phrases
- before any category
### Modal
- may
- May Be
## Other
### Modal
- not here
## Confident / unqualified phrases
### Strong
- will
### Vow
- we will
- will
"""


def test_default_lexicon_has_all_phrases():
    assert (len(lx.DEFAULT.hedging), len(lx.DEFAULT.confident)) == (51, 25)


def test_parse():
    got = lx.parse_lexicon(MARKDOWN)
    assert got.hedging == (("may", "Modal"), ("may be", "Modal"))
    assert got.confident == (("will", "Strong"), ("we will", "Vow"), ("will", "Vow"))


def test_a_missing_bucket_is_an_error():
    with pytest.raises(ValueError):
        lx.parse_lexicon("## Hedging phrases\n### A\n- may")


def test_marks_of_a_lexicon_stand_at_the_start_of_a_line():
    got = lx.parse_lexicon("##\tHedging phrases\n###  A \n-\tMay \n  - might\n-could\n -x\n## Confident / unqualified phrases\n### B\n- will\n## Other\n### C\n- none")
    assert got == lx.Lexicon((("may", "A"),), (("will", "B"),))


def test_lexicon_file_and_table(spark, tmp_path):
    (tmp_path / "l.md").write_text(MARKDOWN)
    got = lx.load_lexicon(str(tmp_path / "l.md"))
    assert got == lx.read_lexicon(spark, str(tmp_path / "l.md")) == lx.from_table(lx.to_table(spark, got))


CASES = [
    ("Results may vary.", "hedged", ["may"], []),
    ("We WILL deliver.", "confident", [], ["we will"]),
    ("Revenue was flat.", "unmarked", [], []),
    ("We will probably grow, and we will.", "hedged", ["probably"], ["we will"]),
    ("The mayor of Willow.", "unmarked", [], []),
    ("Actual results may differ materially.", "hedged", ["actual results may differ materially"], []),
    ("These are forward-looking statements.", "hedged", ["forward-looking statements"], []),
    ("It must, it must, it shall.", "confident", [], ["must", "shall"]),
    ("émay mayé may_", "unmarked", [], []),
    ("", "unmarked", [], []),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    for r in hedging.classify(df).collect():
        want = CASES[r["id"]]
        assert (r["label"], [m["phrase"] for m in r["hedge_matches"]], [m["phrase"] for m in r["confident_matches"]]) == want[1:]


def test_last_category_of_a_repeated_phrase_counts(spark):
    r = hedging.classify(spark.createDataFrame([("it will",)], "text string"), lexicon=lx.parse_lexicon(MARKDOWN)).first()
    assert r["confident_matches"][0]["category"] == "Vow"


def test_sentences(spark):
    text = "  We grew.  It may last! Why? no split 3.5 here. Mr. Li left.\n"
    got = hedging.analyze(spark.createDataFrame([(1, 1, text), (1, 2, " "), (1, 3, None)], "doc_id long, turn_number int, text string")).orderBy("sent_no").collect()
    assert [r["text"] for r in got] == ["We grew.", "It may last!", "Why? no split 3.5 here.", "Mr.", "Li left."]
    assert [r["label"] for r in got[:2]] == ["confident", "hedged"]


def test_labels_of_claims(spark):
    c = spark.createDataFrame([(1, "it may be"), (2, None)], "claim_no int, source_quote string")
    assert {r["claim_no"]: r["quote_label"] for r in hedging.claim_labels(c).collect()} == {1: "hedged", 2: "unmarked"}
