"""Suffix-array dedup: every byte covered by a 100-byte string that starts earlier is removed.

Suffixes are sorted by the difference-cover algorithm, distributed by content (module repeats): a shard holds all
places of its strings, and its suffix array is built on its own. Symbols are the 8 bytes from a place on, as
one number; the string of a place goes on 8 bytes later. Sampled triples (two of three blocks) are sorted and named;
the names are a string again, three times as far apart, on which the algorithm recurses until names cover DEPTH
bytes or differ; the remaining suffixes are sorted by their symbol and the rank of the next sampled suffix and
merged. Then adjacent suffixes are compared over 100 bytes.

Earlier means a smaller doc_id (null: last), or the same document and an earlier start. Cases: null text is empty;
texts under 100 bytes lose nothing; rows that repeat doc_id and text are one document and each get its result;
rows that share a doc_id but not the text are different documents, in the order of a hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Kind, Part, covered, keyed, repeated, with_spans
from .textnum import pieces

SPAN = 100
KIND = Kind(words=False, window=SPAN, gram=32)
STEP, DEPTH, BITS = 8, 100, 21


def _named(key: np.ndarray) -> np.ndarray:
    """Numbers from 1 on in the order of ``key``, equal for equal keys."""
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.r_[1, s[1:] != s[:-1]])
    return out


def _below(of: np.ndarray, among: np.ndarray) -> np.ndarray:
    """How many of ``among`` are less than each of ``of``."""
    order = np.argsort(of)
    out = np.empty(len(of), np.int64)
    out[order] = np.searchsorted(np.sort(among), of[order], "left")
    return out


def _ranks(t: np.ndarray, places: np.ndarray, step: int, wanted: np.ndarray) -> np.ndarray:
    """For each of the places ``wanted``: how many of their suffixes are less, plus one, over DEPTH bytes at least.

    ``t`` holds names from 1 to 2 ** BITS - 1 at ``places`` and 0 beyond the end; the symbol after place i is at
    i + step. Names are given to all sampled suffixes; only wanted suffixes, and the sampled ones that
    tell them apart, are merged.
    """
    sampled = places[places // step % 3 != 0]
    pack = lambda i, last: (t[i] << (2 * BITS)) | (t[i + step] << BITS) | last[i + 2 * step]
    rank = np.zeros(len(t), np.int64)
    kind = wanted // step % 3
    if len(sampled):
        name = _named(pack(sampled, t))
        rank[sampled] = name
        if name.max() < len(sampled) and 3 * step < DEPTH:
            need = np.zeros(len(t), bool)
            for i in (wanted, wanted + step, wanted + 2 * step):
                need[i] = True
            need = sampled[need[sampled]]
            higher = _ranks(rank, sampled, 3 * step, need)
            rank = np.zeros(len(t), np.int64)
            rank[need] = higher
    pair = lambda i: (t[i] << BITS) | rank[i + step]
    triple = lambda i: pack(i, rank)
    rest, one, two = (wanted[kind == k] for k in range(3))
    rest2, rest3, one2, two3 = pair(rest), triple(rest), pair(one), triple(two)
    both = np.concatenate([rank[one], rank[two]])
    low = _below(both, both)
    out = np.zeros(len(t), np.int64)
    out[rest] = _below(rest2, rest2) + _below(rest2, one2) + _below(rest3, two3)
    out[one] = low[: len(one)] + _below(one2, rest2)
    out[two] = low[len(one) :] + _below(two3, rest3)
    return out[wanted] + 1


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the wanted suffixes (ties possible beyond DEPTH bytes), and the names of the 8 bytes at each place."""
    n = len(text)
    if n + 1 >= 1 << BITS:
        raise ValueError("a part of a shard is too large")
    code = np.zeros(n + STEP, np.uint64)
    code[:n] = text
    for shift in (1, 2, 4):
        code = (code << np.uint64(8 * shift)) | np.r_[code[shift:], np.zeros(shift, np.uint64)]
    t = np.zeros(n + 9 * DEPTH + 64, np.int64)
    t[:n] = _named(code[:n])
    return _ranks(t, np.arange(n), STEP, wanted), t


def earlier_windows(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(part.begin)
    wins = sizes - SPAN + 1
    snippet = np.repeat(np.arange(len(sizes)), wins)
    shift = np.arange(len(snippet)) - np.repeat(np.cumsum(wins) - wins, wins)
    start = part.begin[snippet] + shift
    rank, t = suffix_order(part.content, start)
    when = (part.rank[snippet] << 32) | (part.pos[snippet] + shift)
    order = np.argsort(rank, kind="stable")
    s = start[order]
    same = np.ones(len(s) - 1, bool)
    for d in (*range(0, SPAN - STEP, STEP), SPAN - STEP):
        same &= t[s[1:] + d] == t[s[:-1] + d]
    group = np.flatnonzero(np.r_[True, ~same])
    least = np.repeat(np.minimum.reduceat(when[order], group), np.diff(np.r_[group, len(s)]))
    again = np.zeros(len(s), bool)
    again[order] = when[order] != least
    lo = np.flatnonzero(again & ~(np.r_[False, again[:-1]] & (shift > 0)))
    hi = np.flatnonzero(again & ~(np.r_[again[1:], False] & (shift < wins[snippet] - 1)))
    return snippet[lo], shift[lo], shift[hi]


def kept_bytes(docs: DataFrame, columns: list[str], schema: str, finish) -> DataFrame:
    """``finish(rest, rows)`` over the struct of ``columns`` and (kept bytes, size, removed, runs) of every text."""
    keys = keyed(docs).select("rid", "doc_id", "text")
    spans = repeated(keys.where(F.octet_length("text") >= SPAN), KIND, earlier_windows, spare_first=True)

    def apply(batches):
        for b in batches:
            rows = []
            lists = b.column("spans")
            for i, j, buf, off in pieces(b):
                gone = covered(lists, i, j, off, SPAN)
                edge = gone & ~np.r_[False, gone[:-1]]
                edge[off[:-1][off[:-1] < off[-1]]] |= gone[off[:-1][off[:-1] < off[-1]]]
                total, runs = (np.r_[np.int32(0), np.cumsum(x, dtype=np.int32)] for x in (gone, edge))
                kept = buf[~gone].tobytes()
                at = off - total[off]
                rows += [(kept[at[k] : at[k + 1]], int(off[k + 1] - off[k]), int(total[off[k + 1]] - total[off[k]]), int(runs[off[k + 1]] - runs[off[k]])) for k in range(j - i)]
            yield finish(b.column("rest"), rows)

    packed = docs.select(F.struct(*columns).alias("rest"), "text", F.xxhash64("doc_id", "text").alias("rid"))
    return with_spans(packed, spans).select("rest", "text", "spans").mapInArrow(apply, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def finish(rest, rows):
        return pa.RecordBatch.from_arrays([rest.field("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return kept_bytes(docs, ["doc_id"], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", finish)
