"""Benchmark decontamination by latent semantic retrieval.

1. Passages are BLOCKS blocks of STRIDE words, one from each block of a document on (a short document is one
   passage). Words are hashed to SIZE columns, weighted by inverse frequency over all words of all documents.
   A block is projected once; passages add up their blocks.
2. A distributed randomised SVD: with a Gaussian G (SIZE x RANK), every task adds up its part of A'(A G) over the
   passages A of all documents; the sums, RANK columns wide, are merged in two levels, and give the leading right
   singular vectors and values of A.
3. Benchmark items of SHORT words or more are cut into passages too, projected, and compared with every projected
   passage by cosine. Pairs above COSINE are candidates when their words overlap, as counted without order, by OVERLAP.
   This is the only way to a leak of such an item.
4. A candidate is confirmed by the longest common subsequence of the item's words with a window of STRETCH times as many
   words around the passage: COMMON of the item, or COMMON_WITH_ANSWER of it if the item's answer (its last sentence)
   is there as well. Bit-parallel, for all windows at once.
5. An item of fewer than SHORT words has no direction of its own in a passage of SPAN words. It is looked for by its rare words:
   a leak of n words within such a window shares at least need = COMMON_WITH_ANSWER * n of them in order, so at least l of its
   n - need + l rarest words, and windows with l such words are compared. No leak of such items is lost.
6. Words of items are sent to every task, so a benchmark is searched in slices of about MAX_ITEMS items and MAX_BYTES bytes.

Result: one row per document row and item that leaks into it. Cases: null or empty texts and items hold nothing
and match nothing; null ids are kept; repeated documents and items are reported for each; an empty benchmark or
an empty documents table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .textnum import U, pieces, word_hashes, word_spans

SIZE, RANK, STRIDE, BLOCKS, SEED, BLOCK = 4096, 96, 8, 3, 11, 128
SPAN = STRIDE * BLOCKS
COSINE, OVERLAP, COMMON, COMMON_WITH_ANSWER, ANSWER = 0.35, 0.3, 0.6, 0.45, 0.8
MAX_ITEMS, MAX_BYTES, LIMIT, STRETCH, SHORT = 20_000, 16 << 20, 1 << 18, 1.5, 12
#: Cells up to which a table of items by words is an array; beyond it, only the cells that are set are kept. Cosines, pairs
#: whose words are counted, and windows at once.
CELLS, COSINES, OVERLAPS, WINDOWS = 1 << 23, 4_000_000, 4096, 200_000


def _frequencies(batches):
    n = np.zeros(SIZE, np.int64)
    for b in batches:
        for _, _, buf, off in pieces(b):
            s, e, _ = word_spans(buf, off)
            n += np.bincount((word_hashes(buf, s, e, lower=True) & U(SIZE - 1)).astype(np.int64), minlength=SIZE)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["c", "n"])


def _padded(c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns with each document filled up to whole blocks by the empty column SIZE; its first block in each."""
    n = np.diff(first)
    begin = np.r_[0, np.cumsum(-(-n // STRIDE))]
    out = np.full(int(begin[-1]) * STRIDE, SIZE, np.int32)
    out[np.arange(len(c)) + np.repeat(begin[:-1] * STRIDE - first[:-1], n)] = c
    return out, begin


def _blocks(padded: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Projections of blocks; ``basis`` has a row of zeros for the empty column."""
    out = np.empty((len(padded) // STRIDE, basis.shape[1]), np.float32)
    word = np.ascontiguousarray(padded.reshape(-1, STRIDE).T, dtype=np.intp)
    part = np.empty((1024, basis.shape[1]), np.float32)  # one array for all words: fresh ones cost more than the sums
    for i in range(0, len(out), len(part)):
        total = out[i : i + len(part)]
        more = part[: len(total)]
        np.take(basis, word[0, i : i + len(part)], axis=0, out=total, mode="clip")
        for k in range(1, STRIDE):
            np.take(basis, word[k, i : i + len(part)], axis=0, out=more, mode="clip")
            total += more
    return out


def _passages(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first block of each passage."""
    n = np.diff(begin)
    k = np.where(n > 0, np.maximum(n - BLOCKS + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), k)
    return doc, begin[:-1][doc] + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)


def _projected(c: np.ndarray, first: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit projection, document, first word and end of every passage."""
    padded, begin = _padded(c, first)
    y = _blocks(padded, basis)
    doc, at = _passages(begin)
    x, last = y[at], begin[1:][doc]
    for k in range(1, BLOCKS):
        inside = at + k < last
        x[inside] += y[(at + k)[inside]]
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
    start = first[:-1][doc] + (at - begin[:-1][doc]) * STRIDE
    return x, doc, start, np.minimum(start + SPAN, first[1:][doc])


def _range_finder(weight: np.ndarray):
    test = np.random.default_rng(SEED).standard_normal((SIZE, RANK)).astype(np.float32)
    basis = np.vstack([test * weight[:, None], np.zeros((1, RANK))]).astype(np.float32)

    def run(batches):
        total, task = np.zeros((RANK, SIZE)), 0
        for b in batches:
            task = b.column("task")[0].as_py() if b.num_rows else task
            for _, _, buf, off in pieces(b, limit=LIMIT):
                s, e, first = word_spans(buf, off)
                if not len(s):
                    continue
                c = word_hashes(buf, s, e, lower=True) & U(SIZE - 1)
                padded, begin = _padded(c.astype(np.int32), first)
                # the fit takes passages side by side: every BLOCKS-th block of a document begins one
                no = np.arange(int(begin[-1])) - np.repeat(begin[:-1], np.diff(begin))
                new = no % BLOCKS == 0
                y = np.add.reduceat(_blocks(padded, basis), np.flatnonzero(new), axis=0)
                of = np.repeat(np.cumsum(new) - 1, STRIDE)
                columns, padded = np.ascontiguousarray(y.T, dtype=np.float64), padded.astype(np.int64)
                each = np.empty(len(of))
                for k in range(RANK):
                    np.take(columns[k], of, out=each, mode="clip")
                    total[k] += np.bincount(padded, each, SIZE + 1)[:SIZE]
        total = total.T * weight[:, None]
        data = [total[i : i + BLOCK].astype(np.float32).tobytes() for i in range(0, SIZE, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(data), dtype=np.int32)), pa.array([task] * len(data), pa.int32()), pa.array(data, pa.binary())], ["block", "task", "data"])

    return run


def _added(key, frames):
    # in one order, so that reruns agree to the last bit
    total = sum((np.frombuffer(x, np.float32).astype(float) for x in sorted(frames["data"])), np.zeros(BLOCK * RANK))
    out = frames.iloc[:1].copy()
    out["data"] = [total.astype(np.float32).tobytes()]
    return out[["block", "task", "data"]]


def latent_basis(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Right singular vectors of A over their singular values, from z = A'A G (Nystroem), times the weights.

    Over the singular values, so that what all passages have in common does not drown what sets them apart.
    """
    test = np.random.default_rng(SEED).standard_normal((SIZE, RANK)).astype(np.float32)
    core = test.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-9 * value.max()
    half = z @ (vector[:, keep] / np.sqrt(value[keep]))
    u, sigma, _ = np.linalg.svd(half, full_matrices=False)
    keep = sigma > 1e-6 * sigma.max()
    basis = u[:, keep] / sigma[keep] * sigma.max() * weight[:, None]
    # by rows in memory, as rows are gathered
    return np.ascontiguousarray(np.vstack([basis, np.zeros((1, basis.shape[1]))]), dtype=np.float32)


def semantic_space(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Basis of the latent space, weighted by inverse frequency, with a row of zeros for the empty column; the weights."""
    n = np.zeros(SIZE)
    for r in docs.mapInArrow(_frequencies, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        n[r["c"]] = r["n"]
    if not n.sum():
        return None
    weight = np.log1p(n.sum() / np.maximum(n, 1)).astype(np.float32) / np.log1p(n.sum())
    parts = docs.select("text", F.spark_partition_id().alias("task")).mapInArrow(_range_finder(weight), "block int, task int, data binary")
    tasks = max(1, docs.rdd.getNumPartitions())
    if tasks > 64:  # two levels, so that no task adds up more than about the root of their number
        parts = parts.withColumn("task", (F.col("task") % int(tasks**0.5)).cast("int")).groupBy("block", "task").applyInPandas(_added, "block int, task int, data binary")
    z = np.zeros((SIZE, RANK))
    for r in parts.groupBy("block").applyInPandas(lambda k, f: _added(k, f), "block int, task int, data binary").collect():
        z[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["data"], np.float32).reshape(BLOCK, RANK)
    return latent_basis(z, weight), weight


class Cells:
    """Values by (row, column), 0 where there is none; values of one cell are joined by or."""

    def __init__(self, rows: int, columns: int, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.columns = columns
        self.keys, at = np.unique(row.astype(np.int64) * columns + column, return_inverse=True)
        self.values = np.zeros(len(self.keys), value.dtype)
        np.bitwise_or.at(self.values, at, value)
        self.flat = None
        if rows * columns <= CELLS:
            self.flat = np.zeros(rows * columns, value.dtype)
            self.flat[self.keys] = self.values

    def get(self, base: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Values of the cells in rows that begin at ``base`` (row * columns)."""
        key = base + column
        if self.flat is not None:
            return np.take(self.flat, key)
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.values.dtype.type(0))


def _items(rows: list) -> list[tuple]:
    out = []
    for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or "")):
        raw = (r["text"] or "").encode()
        buf = np.frombuffer(raw, np.uint8)
        s, e, _ = word_spans(buf, np.array([0, len(buf)]))
        h = word_hashes(buf, s, e, lower=True) if len(s) else np.zeros(0, U)
        ends = [m.end() for m in re.finditer(rb"[.!?][\x09-\x0d\x20]+", raw.rstrip())]
        answer = int(np.searchsorted(s, ends[-1])) if ends else 0
        if len(h):
            out.append((r["item_id"], h, answer))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _reach(words: int) -> int:
    """Length of the windows in which an item's words are looked for."""
    return math.ceil(STRETCH * words)


class Places:
    """The places of words in sequences, as bits, 64 to a row: what longest common subsequences are counted with."""

    def __init__(self, sequences: list[np.ndarray], vocabulary: np.ndarray):
        self.size = np.array([len(h) for h in sequences], np.int64)
        self.limbs = np.r_[0, np.cumsum(-(-self.size // 64))]
        place = np.arange(int(self.size.sum())) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        word = np.searchsorted(vocabulary, np.concatenate([*sequences, np.zeros(0, U)]))
        self.masks = Cells(int(self.limbs[-1]), len(vocabulary) + 1, np.repeat(self.limbs[:-1], self.size) + place // 64, word, U(1) << (place % 64).astype(U))

    def common(self, no: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of sequences ``no`` with the words from ``lo`` to ``hi``, as in common()."""
        out, count = np.zeros(len(no), np.int64), -(-self.size[no] // 64)
        for n in np.unique(count[count > 0]).tolist():
            some, at_once = np.flatnonzero(count == n), max(1, WINDOWS // n)
            for x in np.split(some, np.arange(at_once, len(some), at_once)):
                out[x] = self._common(lo[x], hi[x], place, self.limbs[no[x]], self.size[no[x]], n)
        return out

    def _common(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, row: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
        full = [~U(0) >> (64 - np.clip(size - 64 * k, 1, 64)).astype(U) for k in range(count)]
        v = [x.copy() for x in full]
        if count == 1:  # nothing to carry
            v, row = v[0], row * self.masks.columns
            for t in range(int((hi - lo).max(initial=0))):
                word = np.take(place, lo + t, mode="clip")
                word[lo + t >= hi] = self.masks.columns - 1  # no word of an item
                u = v & self.masks.get(row, word)
                v = (v + u) | (v ^ u)
            return size - np.bitwise_count(v & full[0]).astype(np.int64)
        for t in range(int((hi - lo).max(initial=0))):
            inside, word, carry = lo + t < hi, np.take(place, lo + t, mode="clip"), U(0)
            for k in range(count):
                m = np.where(inside, self.masks.get((row + k) * self.masks.columns, word), U(0))
                total = v[k] + (v[k] & m)
                over = total < v[k]
                total = total + carry
                carry = (over | (total < carry)).astype(U)
                v[k] = (total | (v[k] & ~m)) & full[k]
        return size - sum(np.bitwise_count(x).astype(np.int64) for x in v)


def _needed(size: np.ndarray) -> np.ndarray:
    """Words in order below which no item of that size is a leak."""
    return np.ceil(min(COMMON, COMMON_WITH_ANSWER) * size - 1e-9).astype(np.int64)


def _enough(n, a):
    return (n >= COMMON) | (n >= COMMON_WITH_ANSWER) & (a >= ANSWER)


def regions(doc: np.ndarray, item: np.ndarray, start: np.ndarray, first: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, item, first word and end of what the windows around passages that begin at ``start`` can hold; passages that
    begin in the same stretch of a window's length share it."""
    cell = (start - first[doc]) // reach[item]
    most = int(cell.max(initial=0)) + 1
    key = np.unique((doc * len(reach) + item) * most + cell)
    (doc, item), cell = np.divmod(key // most, len(reach)), key % most
    lo = first[doc] + np.maximum((cell - 1) * reach[item] + 1, 0)
    return doc, item, lo, np.minimum(first[doc] + (cell + 2) * reach[item] + SPAN, first[doc + 1])


def best_windows(found: tuple, items: Places, answers: Places, place: np.ndarray) -> dict[tuple[int, int], tuple[float, float]]:
    """Shares of the item and of its answer in the best window of each (document, item) that holds a leak.

    Windows begin at every word, at every 64th part of the item where that is more (and are longer by it, so that none
    is lost). The regions of a pair are taken by what they can hold in order, most first, until one holds a leak.
    """
    doc, item, lo, hi = found
    most = items.common(item, lo, hi, place)
    order = np.lexsort((lo, -most, item, doc))
    order = order[most[order] >= _needed(items.size)[item[order]]]
    doc, item, lo, hi = (x[order] for x in (doc, item, lo, hi))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])][: len(doc)]
    pair = np.cumsum(new) - 1
    turn = np.log2(np.arange(len(doc)) - np.flatnonzero(new)[pair] + 1).astype(int) if len(doc) else pair
    out: dict[tuple[int, int], tuple[float, float]] = {}
    closed = np.zeros(len(doc), bool)
    for t in range(int(turn.max(initial=-1)) + 1):
        now = np.flatnonzero((turn == t) & ~closed[pair])
        step = np.maximum(1, items.size[item[now]] // 64)
        reach = np.ceil(STRETCH * items.size[item[now]]).astype(np.int64)
        many = np.maximum(-(-(hi[now] - lo[now] - reach) // step), 0) + 1
        of = np.repeat(np.arange(len(now)), many)
        at = lo[now][of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * step[of]
        end, of = np.minimum(at + (reach + step - 1)[of], hi[now][of]), now[of]
        n = items.common(item[of], at, end, place)
        some = n >= _needed(items.size)[item[of]]
        at, end, of, n = at[some], end[some], of[some], n[some] / items.size[item[of]][some]
        a = answers.common(item[of], at, end, place) / np.maximum(answers.size[item[of]], 1)
        ok = _enough(n, a)
        closed[pair[of[ok]]] = True
        for k, x in zip(of[ok].tolist(), zip(n[ok].tolist(), a[ok].tolist(), strict=True), strict=True):
            key = (int(doc[k]), int(item[k]))
            out[key] = max(out.get(key, x), x)
    return out


def rare_words(items: list[tuple], vocabulary: np.ndarray, weight: np.ndarray) -> tuple:
    """For each word of the vocabulary (and none, one past it) the items it is a rare word of; what each item needs.

    A window whose longest common subsequence with an item has ``need`` words or more has ``least`` of the item's
    n - need + least rarest words, whatever order of rarity is taken.
    """
    places = Places([h for _, h, _ in items], vocabulary)
    word, item, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for no, ((_, h, _), need) in enumerate(zip(items, _needed(places.size).tolist(), strict=True)):
        least.append(max(1, need // 2))
        rarest = np.argsort(-weight[(h & U(SIZE - 1)).astype(np.int64)], kind="stable")[: len(h) - need + least[-1]]
        # a word that stands there k times counts k times, as often as a common subsequence can hold it
        word.append(np.searchsorted(vocabulary, h[rarest]))
        item.append(np.full(len(rarest), no))
    pairs, often = np.unique(np.concatenate(word) * max(len(items), 1) + np.concatenate(item), return_counts=True)
    begin = np.searchsorted(pairs // max(len(items), 1), np.arange(len(vocabulary) + 2))
    return begin, pairs % max(len(items), 1), often, np.array(least, np.int64), places


def rare_windows(index: tuple, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item and first word of every window that may hold a leak, by item and place."""
    begin, of, often, least, places = index
    word = np.flatnonzero(begin[place + 1] > begin[place])
    if not len(word):
        return word, word
    size = places.size
    reach = np.array([_reach(n) for n in size.tolist()])
    k = (begin[place + 1] - begin[place])[word]
    at = np.arange(int(k.sum())) + np.repeat(begin[place[word]] - (np.cumsum(k) - k), k)
    item, word = of[at], np.repeat(word, k)
    # documents lie farther apart than any window reaches
    apart = word + (np.searchsorted(first, word, "right") - 1) * int(reach.max())
    key = item * (len(place) + len(first) * int(reach.max()) + 1) + apart
    order = np.argsort(key)
    key, item, word, sums = key[order], item[order], word[order], np.r_[0, np.cumsum(often[at[order]])]
    ok = sums[np.searchsorted(key, key + reach[item])] - sums[:-1] >= least[item]
    item, word = item[ok], word[ok]
    # the common subsequence with all words that such a window can hold
    doc = np.searchsorted(first, word, "right") - 1
    lo, hi = np.maximum(first[doc], word - reach[item] + 1), np.minimum(first[doc + 1], word + reach[item])
    ok = places.common(item, lo, hi, place) >= _needed(size)[item]
    return item[ok], word[ok]


def confirmed(words: np.ndarray, answer: int, text: np.ndarray, start: int, length: int) -> tuple[float, float] | None:
    """Shares of the item and of its answer in the best window of ``text`` that holds the word ``start`` and confirms a leak."""

    def shares(x):
        return common(words, x) / len(words), common(words[answer:], x) / max(len(words) - answer, 1)

    lo, hi = max(0, start - length + 1), start + length
    if not _enough(*shares(text[lo:hi])):
        return None
    found = [shares(text[i : i + length]) for i in range(lo, start + 1) if text[i] in words or i == lo]
    return max((x for x in found if _enough(*x)), default=None)


SCHEMA = "doc_id long, item_id long, cosine double, common double, answer double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common (share of the item found in order), answer (share of its answer)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = given.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    slices, space, found = max(-(-size["n"] // MAX_ITEMS), -(-size["bytes"] // MAX_BYTES)), None, None
    for no in range(slices):
        items = _items(given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == no).collect())
        space = space or (semantic_space(docs.select("text")) if items else None)
        if items and space:
            more = _search(docs, items, *space)
            found = more if found is None else found.union(more)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def _queries(items: list[tuple], basis: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Unit projections of the items' passages; item, first word and end of each."""
    queries, owner = [np.zeros((0, basis.shape[1]), np.float32)], []
    for no, (_, h, _) in enumerate(items):
        for at in range(0, len(h), STRIDE * 2):
            if at and len(h) - at < SPAN:
                at = max(len(h) - SPAN, 0)
            part = h[at : at + SPAN]
            queries.append(_projected((part & U(SIZE - 1)).astype(np.int32), np.array([0, len(part)]), basis)[0][:1])
            owner.append((no, at, at + len(part)))
            if at + SPAN >= len(h):
                break
    return np.concatenate(queries), owner


def _search(docs: DataFrame, items: list[tuple], basis: np.ndarray, weight: np.ndarray) -> DataFrame:
    short, items = [x for x in items if len(x[1]) < SHORT], [x for x in items if len(x[1]) >= SHORT]
    queries, owner = _queries(items, basis)
    vocabulary = np.unique(np.concatenate([h for _, h, _ in items + short]))
    sizes = np.array([j - i for _, i, j in owner], np.int64)
    words = np.concatenate([np.zeros(0, U), *(items[no][1][i:j] for no, i, j in owner)])
    held = Cells(len(owner), len(vocabulary) + 1, np.repeat(np.arange(len(owner)), sizes), np.searchsorted(vocabulary, words), np.ones(len(words), bool))
    exact = Places([h for _, h, _ in items], vocabulary), Places([h[answer:] for _, h, answer in items], vocabulary)
    given = docs.sparkSession.sparkContext.broadcast(([x[0] for x in items], short, basis, queries, owner, vocabulary, held, sizes, exact, rare_words(short, vocabulary, weight), _queries(short, basis)))

    def candidates(x, p, q, place):
        """Passages and queries that are alike by cosine and share enough words; their cosines."""
        _, _, _, queries, _, vocabulary, held, sizes, *_ = given.value
        near, far, cosines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        step = max(1, min(1024, COSINES // max(len(queries), 1)))
        products = np.empty((step, len(queries)), np.float32)
        # each passage's words, and no word past its end
        at = p[:, None] + np.arange(SPAN)
        words = np.where(at < q[:, None], np.take(place, at, mode="clip"), len(vocabulary)) if len(p) else at
        for k in range(0, len(x) if len(queries) else 0, step):
            cos = np.matmul(x[k : k + step], queries.T, out=products[: len(x) - k]).ravel()
            hit = np.flatnonzero(cos >= COSINE)
            for j in range(0, len(hit), OVERLAPS):
                cell = hit[j : j + OVERLAPS]
                passage, query = cell // len(queries) + k, cell % len(queries)
                # words in common, without order
                shared = held.get((query * held.columns)[:, None], words[passage]).sum(axis=1)
                ok = shared >= np.ceil(OVERLAP * np.minimum(sizes[query], (q - p)[passage]))
                near.append(passage[ok])
                far.append(query[ok])
                cosines.append(cos[cell[ok]])
        near, far, cosines = np.concatenate(near), np.concatenate(far), np.concatenate(cosines)
        return near, far, cosines

    def search(batches):
        item_ids, short, basis, _, owner, vocabulary, _, _, exact, index, (short_queries, short_owner) = given.value
        item_of, short_of = (np.array([no for no, _, _ in x], np.int64) for x in (owner, short_owner))
        reach = np.array([_reach(n) for n in exact[0].size.tolist()], np.int64)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for i, _, buf, off in pieces(b, limit=LIMIT):
                s, e, first = word_spans(buf, off)
                if not len(s):
                    continue
                h = word_hashes(buf, s, e, lower=True)
                x, doc, p, q = _projected((h & U(SIZE - 1)).astype(np.int32), first, basis)
                place = np.searchsorted(vocabulary, h).clip(0, len(vocabulary) - 1)
                place = np.where(vocabulary[place] == h, place, len(vocabulary))
                near, far, cosines = candidates(x, p, q, place)
                if len(near):
                    cosine: dict[tuple[int, int], float] = {}
                    for k in np.argsort(cosines, kind="stable").tolist():
                        cosine[int(doc[near[k]]), int(item_of[far[k]])] = float(cosines[k])
                    best = best_windows(regions(doc[near], item_of[far], p[near], first, reach), *exact, place)
                    rows += [(ids[i + d], item_ids[no], cosine[d, no], *v) for (d, no), v in sorted(best.items())]
                best = {}
                item, word = rare_windows(index, place, first)
                owners = np.searchsorted(first, word, "right") - 1
                for no, w, d in zip(item.tolist(), word.tolist(), owners.tolist(), strict=True):
                    if (d, no) not in best:
                        _, words, answer = short[no]
                        if new := confirmed(words, answer, h[first[d] : first[d + 1]], w - int(first[d]), _reach(len(words))):
                            k = np.flatnonzero((doc == d) & (p < w + _reach(len(words))) & (q > w - _reach(len(words))))
                            best[d, no] = (float((x[k] @ short_queries[short_of == no].T).max(initial=-1.0)), *new)
                rows += [(ids[i + d], short[no][0], *v) for (d, no), v in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cosine", "common", "answer"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, SCHEMA)
