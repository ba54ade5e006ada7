"""Importance resampling towards a target distribution by hashed n-grams.

Features of a text are all runs of ``low`` to ``high`` consecutive words, joined by one space, repeats counted; a feature's bucket is
the CRC-32 of its bytes modulo ``buckets``. N-gram strings are never made: with the CRC of two strings and the length of the second,
the CRC of both after each other is

    crc(a + b) = shift(crc(a), len(b)) ^ crc(b),

where shift is linear over GF(2): a 32 x 32 matrix for one zero byte, raised to the power of the length. Powers by two are kept as
four tables of 256 entries, so a shift is a few look-ups for a whole array of values. Each word's CRC is computed once, from its bytes;
runs of words follow from it.

A bucket's gain compares its frequency in the target with that in the corpus, both smoothed by one; counts of both sides are sums of
partial counts, one row a task and bucket, so what reaches the driver is as long as the number of buckets. A document's weight is the
floored mean of its gains. Documents are drawn without replacement by Gumbel keys: score = weight + noise, the highest are drawn. The
noise follows from the seed and doc_id, so reruns agree.

Ranks: long-enough documents are dealt by ranges of (score, doc_id) and sorted there; a row's rank is its place in its range plus the
sizes of the ranges before, one number a range. No task sees more than its range.

Cases: null or wordless text has no features, weight 0, and is never drawn if ``least`` words are asked for; a null doc_id is the empty
string to the noise and comes after all others among equal scores; repeated rows are judged and ranked one by one; an empty corpus gives
no rows, an empty target counts 0 everywhere; other columns, whatever their names, stay behind. Words that are longer than any text is
bounded by are fine: their CRC is taken by zlib.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches
from .textnum import pieces

BUCKETS, LOW, HIGH, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 1, 20, 10, "2024"
ROWS_A_RANGE = 200_000
SHORT = 64  # words of up to so many bytes are taken together, byte by byte
POLYNOMIAL = 0xEDB88320
C = np.uint32
#: Bytes of words, with A-Z as a-z; 0 for all other bytes.
_WORDLY = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORDLY[_b] = _b
_WORDLY[0x41:0x5B] = np.arange(0x61, 0x7B)


def _by_byte(columns: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, given as the images of the 32 bits, as four tables of 256 values."""
    out = np.zeros((4, 256), C)
    for k in range(4):
        for bit in range(8):
            out[k, 1 << bit : 2 << bit] = out[k, : 1 << bit] ^ columns[8 * k + bit]
    return out


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & C(255)] ^ tables[1][x >> C(8) & C(255)] ^ tables[2][x >> C(16) & C(255)] ^ tables[3][x >> C(24)]


@lru_cache(maxsize=64)
def shift_power(k: int) -> np.ndarray:
    """Tables of the matrix for 2**k zero bytes."""
    if k:
        half = shift_power(k - 1)
        return _by_byte(_applied(half, _applied(half, C(1) << np.arange(32, dtype=C))))
    columns = C(1) << np.arange(32, dtype=C)
    for _ in range(8):
        columns = columns >> C(1) ^ np.where(columns & C(1), C(POLYNOMIAL), C(0))
    return _by_byte(columns)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What each CRC contributes to that of a string which goes on for ``length`` bytes more."""
    out, length = crc.astype(C), np.asarray(length, np.int64)
    k = 0
    while k < 63 and (length >> k).any():
        where = np.flatnonzero(length >> k & 1)
        out[where] = _applied(shift_power(k), out[where])
        k += 1
    return out


@lru_cache(maxsize=1)
def _step() -> np.ndarray:
    """CRC register after one byte, by the register's low byte."""
    return shift_power(0)[0]


def word_crcs(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start:stop] of each word; words that share a length are taken together."""
    size = stop - start
    out = np.full(len(start), 0xFFFFFFFF, C)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")[int((size > SHORT).sum()) :]
    left = size[order]
    for k in range(int(left[0]) if len(left) else 0):
        now = order[: np.searchsorted(-left, -k, "left")]  # words longer than k
        x = out[now]
        out[now] = _step()[(x ^ raw[start[now] + k]) & C(255)] ^ x >> C(8)
    out ^= C(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(raw[start[i] : stop[i]])
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and for each document (and one past the last) the number of its first word."""
    raw = _WORDLY[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    edge[1:-1] |= (raw[:-1] > 0) != (raw[1:] > 0)
    at = np.flatnonzero(edge)
    inside = raw[at[:-1]] > 0 if len(at) > 1 else np.zeros(0, bool)
    start, stop = at[:-1][inside], at[1:][inside]
    return raw, start, stop, np.searchsorted(start, off)


def ngram_crcs(crc: np.ndarray, size: np.ndarray, first: np.ndarray, low: int, high: int):
    """For each n from ``low`` to ``high``: CRCs of all n-grams, and for each document (and one past the last) its first n-gram."""
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), C), size) ^ crc  # of a blank and the word
    run, last = crc, np.arange(len(crc))  # CRC of the words that begin at a place, and the last of them
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(crc))
    for n in range(1, high + 1):
        if n > 1:
            more = np.flatnonzero(last + 1 < first[1:][doc[at]]) if len(at) else at
            at, run, last = at[more], run[more], last[more] + 1
            run = shifted(run, size[last] + 1) ^ spaced[last]
        if n >= low:
            yield run, np.searchsorted(at, first)


def _featured(batches, low: int, high: int, buckets: int):
    """Some documents at a time: (rows of the batch from, to), words of each, buckets of their features, features of each."""
    for b in batches:
        for i, j, buf, off in pieces(b):
            raw, start, stop, first = words(buf, off)
            found = list(ngram_crcs(word_crcs(raw, start, stop), stop - start, first, low, high))
            yield b, i, j, np.diff(first), [(crc % C(buckets), at) for crc, at in found]


def counts(docs: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts by bucket; buckets without any have no row."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for _, _, _, _, found in _featured(batches, low, high, buckets):
            for bucket, _ in found:
                n += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of each bucket: as many numbers as there are buckets."""
    n = []
    for side in (docs, target):
        rows = counts(side, low, high, buckets).collect()
        n.append(np.zeros(buckets))
        n[-1][[r["bucket"] for r in rows]] = [float(r["n"]) for r in rows]
    s, t = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, low: int = LOW, high: int = HIGH) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    buckets = len(gain)

    def run(batches):
        for b, i, j, n_words, found in _featured(batches, low, high, buckets):
            n, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
            for bucket, at in found:
                n += np.diff(at)
                total += np.diff(np.r_[0, np.cumsum(gain[bucket])][at])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _ranked(scored: DataFrame, rows_a_range: int) -> DataFrame:
    """Adds rank, 1 for the highest score, by the smaller doc_id among equals."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranges = scored.count() // rows_a_range + 1
    # the place within a partition is in the lower 33 bits; cut off, as places must not change between the two uses
    placed = cut(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    n = placed.groupBy("range").agg(F.count("*").alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(n.select("range", before.alias("before")), "range").select("row", (F.col("before") + F.col("place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; rank is null where a row is not drawn."""
    small_batches(docs.sparkSession)
    found = weights(docs, gains(docs, target, low, high, buckets), low, high)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # rows are told apart by a number of their own, so that repeated ones keep theirs; narrow, and read three times
    scored = cut(found.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    ranks = _ranked(able.select("row", "doc_id", "score"), rows_a_range).where(F.col("rank") <= drawn)
    return scored.join(ranks, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
