"""The byte-level codec, importance resampling and the co-bucketed pair against plain restatements."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path
from urllib.parse import unquote, urlparse

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from turnstone.llm import bpe, cobucket, queries, resample

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "  ", "\n", " \n\t  x", "a", "a  b", "a \n b", "don't can't I'll we've they're I'd I'm 'sample ''s !'s 's", "x's's", "'", "'r", "'l", "l'", "a'", "'ll", "1'2", "1's",
    "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "  <|endoftext|>  ", "<|endof", "text|>", "é ñ ß 日本語 한국어 🙂👩‍👩‍👧 á", " x y　 z", "\x00\x1f\x85", "٣٤ Ⅷ ½ ²",
    "\U0001e5d0 ౝ Ᲊ \U00010d4a Ɤ", "!!! ??? --- ...", "x" * 5000, "ab " * 3000, "\t\t\tdef f(x):\n\n    return x  \n", "​ ﻿", "a\r\nb\r\n", "'S 'T", "“quoted” — dash",
]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_words_are_cut_where_the_tokenizer_cuts(spark):
    cutter = bpe.splitter(bpe.model(PATH))
    texts = [(t or "").encode() for t in ODD if "<|endoftext|>" not in (t or "")]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    cuts = set(cutter.cuts(buf, off).tolist())
    want = {int(o) + len(t.decode()[:a].encode()) for o, t in zip(off, texts) for _, (a, _) in TOKENIZER.pre_tokenizer.pre_tokenize_str(t.decode())}
    assert cuts == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stmdrevlaZ0! é日"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_cuts_of_any_text(texts):
    cutter = bpe.splitter(bpe.model(PATH))
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
    want = [int(o) + len(t[:a].encode()) for o, t in zip(off, texts) for _, (a, _) in TOKENIZER.pre_tokenizer.pre_tokenize_str(t)]
    assert cutter.cuts(buf, off).tolist() == want


@pytest.mark.parametrize("hold", [1, 300, 1 << 24])
def test_codec(spark, monkeypatch, hold):
    monkeypatch.setattr(bpe, "HOLD", hold)
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)] + [(0, ODD[-1])] * 2
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, chunk string").repartition(3)
    encoded = bpe.encode(docs, PATH)
    want = sorted(((i, ids_of(t)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in encoded.collect()), key=str) == want
    back = bpe.decode(encoded, PATH)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    got = sorted((tuple(r) for r in bpe.digests(encoded, PATH).collect()), key=str)
    assert got == sorted(((i, *brute.bpe(t, TOKENIZER)) for i, t in rows), key=str)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_decoding_of_any_ids(spark, monkeypatch):
    """Parts of characters, ids that the vocabulary lacks, null lists."""
    monkeypatch.setattr(bpe, "DECODED", 5)
    smile = ids_of("🙂")
    rows = [(0, smile), (1, smile[:1]), (2, smile[1:]), (3, [0, 99_999, 50256, -1, 5]), (4, []), (5, None), (6, list(range(0, 50257, 999)))]
    got = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, bpe.ENCODED), PATH).collect()}
    assert got == {i: TOKENIZER.decode([x for x in ids or [] if 0 <= x <= 50256], skip_special_tokens=False) for i, ids in rows}


def test_codec_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        bpe.model(public_tokenizers.path("word_bpe_49k.json"))


def test_codec_of_the_given_documents(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_bpe_codec(spark, SF).collect()}
    assert got == {i: brute.bpe(t, TOKENIZER) for i, t in text.items()}


# Resampling.


def test_shift_matrices_join_checksums():
    own = random.Random(3)
    for n in (0, 1, 2, 7, 63, 64, 1000, 123_457):
        a, b = own.randbytes(9), own.randbytes(n)
        x = np.array([zlib.crc32(a)], np.uint32)
        assert int(resample.shifted(x, np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 3), (2, 2), (3, 5)])
def test_checksums_of_ngrams(low, high):
    texts = ["The quick brown fox, the quick", "", "one", "É日本 x1 " + "y" * 200 + " z" * 70, "a b"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]
    low_, start, stop, first = resample.words(buf, off)
    found = list(resample.ngram_crcs(resample.word_crcs(low_, start, stop), stop - start, first, low, high))
    for d, t in enumerate(texts):
        got = [int(c) for crc, at in found for c in crc[at[d] : at[d + 1]]]
        assert got == [zlib.crc32(f) for f in brute.features(t, low, high)]


def _resampled(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"low": 1, "high": 3, "buckets": 97, "percent": 50}, {"least": 0, "percent": 100}])
def test_resampling(spark, options):
    own = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(own.choices(vocabulary, k=own.choice([5, 19, 20, 40])))) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, None), (900, None), (901, ""), (902, "É " * 30), (903, "x" * 3000 + " Y" * 25), *[(1000, "w1 " * 30)] * 60]
    target = [" ".join(own.choices(vocabulary[:20], k=30)) for _ in range(20)] + [None]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, score int, rank int").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert _resampled(resample.resample(docs, bench, rows_a_range=25, **options)) == sorted(brute.resample(rows, target, **options), key=str)
    assert _resampled(resample.resample(docs.limit(0), bench)) == []
    assert _resampled(resample.resample(docs, bench.limit(0))) == sorted(brute.resample(rows, []), key=str)


def test_resampling_of_the_given_documents(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    want = brute.resample([(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")])
    assert _resampled(queries.op12_target_resample(spark, SF)) == sorted(want, key=str)


# The co-bucketed pair.

NAMES = ("sales", "sale_lines")
LIST = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()


def local(path):
    return Path(unquote(urlparse(path).path))


def holds(rows, parent, child, buckets):
    """The report, and the files that it names, against the restatement."""
    want = brute.cobucket(parent, child, "sale_id", "item_id", buckets, "s")
    got = {(NAMES.index(r["table_name"]), r["bucket"]): r for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    for at, (found, of, stays, joined) in want.items():
        r = got[at]
        columns = list(found[0])
        assert r["columns"] == ",".join(columns) and r["n_rows"] == len(found) and r["n_joined"] == joined
        assert r["rewritten"] == (stays is None)
        assert r["ids_sha256"] == LIST("" if x["sale_id"] is None else str(x["sale_id"]) for x in found)
        assert r["lineage_sha256"] == LIST(f"{s}:{n}" for s, n in sorted(of.items()))
        table = pq.ParquetFile(local(r["path"])).read()
        assert table.column_names == columns and table.to_pylist() == found
    if rows:
        for side in {r["table_name"] for r in rows}:
            mine = {local(r["path"]) for r in rows if r["table_name"] == side}
            folder = next(iter(mine)).parent.parent
            assert set(folder.rglob("*.parquet")) == mine


def test_cobuckets_of_the_given_tables(spark):
    sales, lines = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in NAMES)
    holds(queries.op13_cobucketed_pair(spark, SF).collect(), sales, lines, 600)


def _sides(spark, parent, child):
    p = spark.createDataFrame(parent, "sale_id long, number string, bucket int")
    c = spark.createDataFrame(child, "item_id long, sale_id long, id string, `part.x` double, row int")
    return p, c, [r.asDict() for r in p.collect()], [r.asDict() for r in c.collect()]


@pytest.mark.parametrize(("buckets", "least"), [(4, 1), (16, 5), (600, 20_000)])
def test_cobuckets_of_odd_tables(spark, buckets, least):
    """Nulls, repeated keys and rows, orphans, a hot key, clashing names; files that stay on either side."""
    own = random.Random(buckets)
    parent = [(own.choice([None, *range(40)]), own.choice([None, "", "é", "z", "Z", "\U0001f642", "￿"]), own.randint(0, 3)) for _ in range(80)] + [(5, "hot", 1)] * 60
    child = [(own.choice([None, *range(9)]), own.choice([None, *range(55)]), own.choice([None, "a", "B", "ä"]), own.choice([None, -1.5, 0.0, 2.5]), 1) for _ in range(200)] + [(3, 5, "hot", 1.0, 7)] * 150
    p, c, parents, children = _sides(spark, parent, child)
    made = cobucket.rewrite(p.repartition(3), c.repartition(3), NAMES, buckets=buckets, least_part=least).collect()
    holds(made, parents, children, buckets)
    assert any(not r["rewritten"] for r in made if r["table_name"] == "sales")


def test_cobuckets_that_stay_and_empty_tables(spark):
    """A line file that has exactly the rows of one bucket stays, whatever its number; either table may be empty."""
    p, c, parents, children = _sides(spark, [(1, "x", 1)], [(9, 1, "a", 1.0, 1), (9, 1, "b", 2.0, 1)])
    made = cobucket.rewrite(p, c, NAMES).collect()
    holds(made, parents, children, 600)
    assert [r["rewritten"] for r in made if r["table_name"] == "sale_lines"] == [False]
    for a, b in ((p.limit(0), c), (p, c.limit(0)), (p.limit(0), c.limit(0))):
        holds(cobucket.rewrite(a, b, NAMES).collect(), [r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()], 600)


def test_keys_are_hashed_in_blocks(monkeypatch):
    monkeypatch.setattr(cobucket, "REPEATED", 3)
    keys = [(1, "a", None, 5), (1, "a", 7, 8), (1, "b", -3, 1), (2, "a", 4, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*keys)], ["number", "path", "id", "n"])
    got = [tuple(r.values()) for b in cobucket._hashed([batch]) for r in b.to_pylist()]
    assert got == [(1, "a", LIST([""] * 5 + ["7"] * 8), 13), (1, "b", LIST(["-3"]), 1), (2, "a", LIST(["4", "4"]), 2)]


def test_language_of_repeated_ids_rare_and_many_languages(spark):
    """Rows that share one doc_id, a language of one row, and some hundred languages: a bounded sample, and none left without."""
    from turnstone.llm import language

    own = random.Random(8)
    alphabets = {f"l{i:03}": own.sample("abcdefghijklmnopqrstuvwxyzàéîöüßñç", 9) for i in range(200)}
    text = lambda lang: " ".join("".join(own.choices(alphabets[lang], k=own.randint(2, 7))) for _ in range(60))
    learn = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2]
    for same in learn[:3]:
        rows = [(same, text("l000"), "l000")] * 3000 + [(i, text("l001"), "l001") for i in learn[10:60]] + [(learn[70], text("l002"), "l002")]
        got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).groupBy("doc_id", "lang_pred").count().collect()
        assert {r["lang_pred"] for r in got if r["doc_id"] == same} == {"l000"} and {r["lang_pred"] for r in got} == {"l000", "l001", "l002"}
    rows = [(learn[k], text(x), x) for k, x in enumerate(list(alphabets) * 3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model["langs"]) == set(alphabets)
