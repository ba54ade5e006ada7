"""Decontamination of paraphrases: items of the given benchmark, changed in several ways, in the given documents."""

from __future__ import annotations

import math
import random
import re
from functools import cache

import numpy as np
import pytest

from turnstone.llm import decontam

SF_DIR = "/root/testdata/sf0.01"
CHANGES = ("replaced", "inserted", "deleted", "both", "halved")


def changed(words: list[str], kind: str, filler: list[str], own: random.Random) -> list[str]:
    n = len(words)
    if kind == "halved":  # half of the question, the whole answer
        cut = max((i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".!?"), default=0)
        lost = set(own.sample(range(cut), cut // 2)) if cut else set()
        return [own.choice(filler) if i in lost else w for i, w in enumerate(words)]
    share = {"replaced": 0.38, "inserted": 0.0, "deleted": 0.38, "both": 0.3}[kind]
    lost = set(own.sample(range(n), int(share * n)))
    out = []
    for i, w in enumerate(words):
        if i in lost:
            if kind != "deleted":
                out.append(own.choice(filler))
            continue
        out.append(w)
        if kind in ("inserted", "both") and own.random() < (0.4 if kind == "inserted" else 0.15):
            out.append(own.choice(filler))
    return out


def longest(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Longest common subsequences with each row of ``windows``, by the table of all prefixes."""
    row = np.zeros((windows.shape[1] + 1, len(windows)), np.int16)
    for x in item:
        before, row = row, np.zeros_like(row)
        for j in range(windows.shape[1]):
            row[j + 1] = np.where(windows[:, j] == x, before[j] + 1, np.maximum(before[j + 1], row[j]))
    return row[-1]


@cache
def fixture():
    import duckdb

    own = random.Random(31)
    items = duckdb.sql(f"select item_id, text from read_parquet('{SF_DIR}/benchmark.parquet') where text is not null order by item_id").fetchall()
    texts = [r[0].split() for r in duckdb.sql(f"select text from read_parquet('{SF_DIR}/documents.parquet') where length(text) between 600 and 3000 order by doc_id limit 120").fetchall()]
    filler = [w for t in texts for w in t]
    docs = list(texts[:40])
    for no, (_, text) in enumerate(items):
        for kind in CHANGES:
            t = own.choice(texts)
            at = own.randint(0, len(t))
            docs.append([*t[:at], *changed(text.split(), kind, filler, own), *t[at:]])
    number: dict[str, int] = {}
    numbered = lambda ws: np.array([number.setdefault(w.lower(), len(number)) for w in ws], np.int32)
    coded, want = [numbered(ws) for ws in docs], set()
    for item_id, text in items:
        item, answer = numbered(text.split()), numbered(re.split(r"[.!?]\s+", text.rstrip())[-1].split())
        n, windows, of = math.ceil(1.5 * len(item)), [], []
        for d, ws in enumerate(coded):
            ws = np.r_[ws, np.full(max(n - len(ws), 0), -1, np.int32)]
            windows.append(np.lib.stride_tricks.sliding_window_view(ws, n))
            of += [d] * len(windows[-1])
        windows, of = np.concatenate(windows), np.array(of)
        some = np.isin(windows, np.unique(item)).sum(axis=1) >= decontam.COMMON_WITH_ANSWER * len(item)
        windows, of = windows[some], of[some]
        shared = longest(item, windows)
        told = longest(answer, windows) >= decontam.ANSWER * len(answer)
        leak = (shared >= decontam.COMMON * len(item) - 1e-9) | (shared >= decontam.COMMON_WITH_ANSWER * len(item) - 1e-9) & told
        want |= {(d, item_id) for d in of[leak].tolist()}
    return [(i, " ".join(ws)) for i, ws in enumerate(docs)], items, want


def found(spark) -> set[tuple[int, int]]:
    docs, items, _ = fixture()
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in got.collect()}


def test_latent_search_finds_paraphrases(spark):
    """Against the longest common subsequence in every window of every document with every item."""
    docs, items, want = fixture()
    got = found(spark)
    assert len(want) >= 4 * len(items)
    assert len(got & want) >= 0.95 * len(want) and got <= want


@pytest.mark.parametrize("bound", [2.0])
def test_without_the_latent_search_nothing_is_found(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "COSINE", bound)
    assert not found(spark)


def test_long_items_are_compared_in_bounded_time(spark):
    """Windows of an item of 6000 words begin at every 64th part of it."""
    import time

    own = random.Random(7)
    item = [f"w{own.randint(0, 3000)}" for _ in range(6000)]
    copy = [w if own.random() < 0.8 else "other" for w in item]
    docs = [(1, " ".join(copy)), (2, " ".join(own.choices(item, k=9000))), (3, " ".join([*own.choices(item, k=500), *copy[:3800], *own.choices(item, k=500)]))]
    before = time.monotonic()
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    rows = {r["doc_id"]: r["common"] for r in got.collect()}
    kept = sum(a == b for a, b in zip(item, copy, strict=True))
    assert set(rows) == {1} and rows[1] == kept / 6000
    assert time.monotonic() - before < 120
