"""LM scoring by cross-entropy difference: bigram models of target and background text over one vocabulary.

The target is the text of documents labelled as good (quality 1, not toxic), the background all documents. Every
word of all documents is in the shared vocabulary; a START stands before each text. Models are interpolated:
(n(a, b) + SMOOTH * p(b)) / (n(a) + SMOOTH), where p is the side's own unigram model, smoothed over the number of
distinct words, WIDTH at least.

Counts are tables that grow with the corpus and stay distributed, and labels are joined to document numbers, not to texts:

1. A first pass finds two numbers, the distinct words and the tokens of all documents; a second one, from document
   numbers and sizes, the target's tokens.
2. Tasks cut their documents into chunks of up to HOLD words, as word numbers over the chunk's vocabulary. This is the one
   form of the texts that is shuffled, once, by chunk: the steps below share that shuffle.
3. The chunk's document numbers are joined with the labels, and the places of labelled documents come back to it.
4. A chunk counts its words, predecessors and pairs. The counts go by hash to buckets, one row per chunk and bucket that
   it has a key of; a bucket adds up its keys over all chunks and answers each chunk with the sums of the keys it asked for.
5. Chunks meet their answers and score their documents.

A frequent word or pair is one entry per chunk, however many documents hold it, and a chunk has no more rows than keys, so
both entries and rows grow with the text and not with chunks times buckets. Nothing is collected or broadcast but the three
numbers, at any size.

Cases: null or wordless text has 0 tokens and null losses; without target text the models agree and the score is
0; rows that repeat count and are scored again; words are lower-cased in A-Z and split at ASCII blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textnum import U, mix, packed, pieces, unpacked, word_hashes, word_spans

WIDTH, SMOOTH = 1024, 50.0
HOLD, LEAST_BUCKETS, BYTES_A_BUCKET = 2_000_000, 256, 1 << 22  # words of a chunk; text whose counts a bucket holds
_SINGLE, _BEFORE, _START = U(0x8F1BBCDCBFA53E0B), U(0xCA62C1D66ED9EBA1), U(0x5BE0CD19137E2179)
_WORDS = "dest long, keys binary, n long"
_OWN = "chunk long, vocabulary binary, ids binary, doc_id binary, known binary, size binary"
_COUNTS = "dest long, chunk long, keys binary, n binary, t binary"
_ANSWER = "chunk long, bucket long, n binary, t binary"


def _keys(vocabulary: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple:
    """Keys of a chunk's words, its predecessors (START first) and its pairs; and what becomes of each token.

    ``ids`` are the places of the tokens' words in ``vocabulary``, from 1; 0 is START.
    """
    first = np.cumsum(size) - size
    before = np.r_[0, ids[:-1]] if len(ids) else ids
    before[first[size > 0]] = 0
    pairs, at = np.unique(before.astype(np.int64) * (len(vocabulary) + 1) + ids, return_inverse=True)
    a, b = pairs // (len(vocabulary) + 1), pairs % (len(vocabulary) + 1)
    left = np.r_[_START, vocabulary]
    pair = mix(mix(left[a] ^ _START) * U(0x9E3779B97F4A7C15) + left[b])
    keys = np.concatenate([mix(vocabulary ^ _SINGLE) | U(1), np.r_[mix(left ^ _BEFORE), pair] & ~U(1)])  # words are odd
    return keys, before, a, b, at


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in their order, and where each bucket (a power of two, by the highest bits) begins."""
    order = np.argsort(keys)
    return order, np.searchsorted(keys[order] >> U(65 - buckets.bit_length()), np.arange(buckets + 1).astype(U))


def _read(batches, hold: int):
    """Documents of over ``hold`` words (or so many documents) at a time: word hashes, number of words, doc_id, whether it is known."""
    held, size = [], 0
    for b in batches:
        ids = b.column("doc_id")
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        for i, j, buf, off in pieces(b):
            s, e, first = word_spans(buf, off)
            held.append((word_hashes(buf, s, e, lower=True) if len(s) else np.zeros(0, U), np.diff(first).astype(np.int64), ids[i:j], known[i:j]))
            size += len(s) + j - i
            if size > hold:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _totals(docs: DataFrame, good: DataFrame, buckets: int) -> tuple[int, int, int]:
    """Distinct words and tokens of all documents, and the tokens of the target."""
    hold = HOLD

    def words(batches):
        for hashes, _, _, _ in _read(batches, hold):
            keys, n = np.unique(hashes, return_counts=True)
            _, cuts = _dealt(keys, buckets)
            rows = [(int(i), packed(np.diff(keys[x], prepend=U(0))), int(n[x].sum())) for i in np.flatnonzero(np.diff(cuts)) for x in [slice(cuts[i], cuts[i + 1])]]
            if rows:
                yield _batch(rows, _WORDS)

    def add(table):
        held = np.concatenate([np.cumsum(unpacked(x, U), dtype=U) for x in table.column("keys").to_pylist()])
        return pa.table([[len(np.unique(held))], [sum(table.column("n").to_pylist())]], ["words", "n"])

    def sizes(batches):
        for b in batches:
            n = [np.diff(word_spans(buf, off)[2]) for _, _, buf, off in pieces(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], ["doc_id", "size"])

    found = docs.mapInArrow(words, _WORDS).groupBy("dest").applyInArrow(add, "words long, n long").agg(F.sum("words"), F.sum("n")).first()
    target = docs.mapInArrow(sizes, "doc_id long, size long").join(good, "doc_id", "left_semi").agg(F.sum("size")).first()
    return tuple(x or 0 for x in (*found, *target))


def _chunks():
    """Per chunk one row with its vocabulary, its documents as places in it (from 1), and their numbers and sizes."""
    hold = HOLD

    def run(batches):
        task = TaskContext.get().partitionId()
        for no, (hashes, k, doc, known) in enumerate(_read(batches, hold)):
            vocabulary, ids, often = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get low numbers
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(1, len(order) + 1)
            yield _batch([((task << 32) + no, packed(vocabulary[order]), packed(place[ids]), packed(doc), packed(known), packed(k))], _OWN)

    return run


def _numbers(table: pa.Table) -> pa.Table:
    """The known document numbers of a chunk and their places in it."""
    own = table.to_pylist()[0]
    doc, known = unpacked(own["doc_id"], np.int64), unpacked(own["known"], bool)
    place = np.flatnonzero(known)
    return pa.table([np.full(len(place), own["chunk"], np.int64), place, doc[place]], ["chunk", "place", "doc_id"])


def _count(buckets: int):
    """A chunk's counts, as one row for each bucket that it has keys of; ``marked`` has the places of target documents."""

    def run(own: pa.Table, marked: pa.Table) -> pa.Table:
        own = own.to_pylist()[0]
        vocabulary, ids, size = unpacked(own["vocabulary"], U), unpacked(own["ids"], np.int32), unpacked(own["size"], np.int64)
        good = np.zeros(len(size), bool)
        good[marked.column("place").to_numpy()] = True
        keys, before, _, _, at = _keys(vocabulary, ids, size)
        side, v = np.repeat(good, size), len(vocabulary)
        parts = ((ids - 1, v), (before, v + 1), (at, len(keys) - 2 * v - 1))
        n, t = (np.concatenate([np.bincount(x[where], minlength=m) for x, m in parts]).astype(np.int32) for where in (slice(None), side))
        order, cuts = _dealt(keys, buckets)
        keys, n, t = keys[order], n[order], t[order]
        slices = [(int(i), slice(cuts[i], cuts[i + 1])) for i in np.flatnonzero(np.diff(cuts))]
        rows = [(i, own["chunk"], packed(np.diff(keys[x], prepend=U(0))), packed(n[x]), packed(t[x])) for i, x in slices]
        return pa.Table.from_batches([_batch(rows, _COUNTS)])

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrays = [pa.array(x, pa.int64() if k == "long" else pa.binary()) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _add(table: pa.Table) -> pa.Table:
    """The sums of a bucket's keys, as an answer to each of its chunks."""
    rows = table.to_pylist()
    asked = [np.cumsum(unpacked(r["keys"], U), dtype=U) for r in rows]
    cuts = np.r_[0, np.cumsum([len(x) for x in asked])]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    n, t = (np.bincount(at, np.concatenate([unpacked(r[side], np.int32) for r in rows]), len(keys)).astype(np.int64) for side in ("n", "t"))
    out = []
    for i, r in enumerate(rows):
        x = at[cuts[i] : cuts[i + 1]]
        out.append((r["chunk"], r["dest"], packed(n[x]), packed(t[x])))
    return pa.Table.from_batches([_batch(out, _ANSWER)])


def _score(buckets: int, words: int, all_tokens: int, target_tokens: int):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        own, given = own.to_pylist()[0], sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        vocabulary, ids, size = unpacked(own["vocabulary"], U), unpacked(own["ids"], np.int32), unpacked(own["size"], np.int64)
        keys, _, a, b, at = _keys(vocabulary, ids, size)
        order, _ = _dealt(keys, buckets)
        width, v, loss = max(WIDTH, words), len(vocabulary), {}
        end = np.cumsum(size)
        for side, column, tokens in (("background", "n", all_tokens), ("target", "t", target_tokens)):
            if side == "target" and not tokens:
                loss[side] = loss["background"]
                continue
            n = np.empty(len(keys))
            counts = np.concatenate([unpacked(r[column], np.int64) for r in given])
            if len(counts) != len(keys):
                raise RuntimeError("a chunk lacks the counts of a bucket")
            n[order] = counts
            p = (n[:v] + 1) / (tokens + width)
            pair = -np.log((n[2 * v + 1 :] + SMOOTH * p[b - 1]) / (n[v + a] + SMOOTH))
            sums = np.r_[0, np.cumsum(pair[at])]
            loss[side] = np.where(size > 0, (sums[end] - sums[end - size]) / np.maximum(size, 1), np.nan)
        t, g = loss["target"], loss["background"]
        doc = pa.array(unpacked(own["doc_id"], np.int64), mask=~unpacked(own["known"], bool))
        return pa.table([doc, pa.array(size), *(pa.array(x, pa.float64(), from_pandas=True) for x in (t, g, t - g))], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score (target minus background, per token; low is near the target)."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (size // BYTES_A_BUCKET).bit_length())
    # other columns of the tables, whatever their names, stay behind
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    totals = _totals(given, good, buckets)
    own = given.mapInArrow(_chunks(), _OWN)
    marked = own.groupBy("chunk").applyInArrow(_numbers, "chunk long, place long, doc_id long").join(good, "doc_id").select("chunk", "place")
    counts = own.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(_count(buckets), _COUNTS)
    answers = counts.groupBy("dest").applyInArrow(_add, _ANSWER)
    scored = own.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return scored.applyInArrow(_score(buckets, *totals), "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
