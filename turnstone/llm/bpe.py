"""Byte-level BPE over whole corpora: each distinct word is encoded once, ids go back to the texts by position.

A word is a piece that the tokenizer's own splitting makes of a text. Encoding a word alone gives the ids that it gets inside any
text, so a corpus needs the tokenizer's merges only for its distinct words:

1. Tasks split texts into words, in chunks of about HOLD bytes of whole texts. A chunk keeps the place of every word in its own
   list of distinct words (one row, packed), and sends that list by hash to buckets, one row per chunk and bucket.
2. A bucket holds its part of the distinct-word table: it takes each word once over all chunks, encodes it, and answers each chunk
   with the ids of the words that the chunk asked for. A word that all documents hold is one entry a chunk.
3. Chunks meet their answers and replace places by ids.

Splitting is by the classes of characters (letter, number, space, other). What class a character has is asked of the tokenizer
itself, as libraries follow different versions of Unicode; the cuts are then found for a megabyte of text at a time.

Decoding joins ids with the table of pieces (id, bytes), which has as many rows as the vocabulary and is broadcast. Pieces of one
character may be spread over several ids; bytes are joined before they are read as text.

The tokenizer's file is read on the driver and sent to the tasks. It must be a byte-level BPE without a normalizer and without a
prefix space, which is checked.

Cases: null or empty text has no ids and decodes to empty text; special tokens' strings in a text become their ids, as in the
library; ids that the vocabulary lacks are passed over by decoding; repeated rows come out as often; a null doc_id stays null; other
columns, whatever their names, stay behind; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches
from .textnum import U, mix, packed, pieces, unpacked

HOLD, LEAST_BUCKETS, BYTES_A_BUCKET = 16 << 20, 64, 16 << 20  # text of a chunk; buckets at least; text whose words a bucket holds
DECODED = 1_000_000  # ids that are decoded at a time
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_OWN = "chunk long, doc_id binary, known binary, size binary, at binary, dest binary, length binary, words binary, n_bytes long"
_WORDS = "dest long, chunk long, size binary, words binary"
_ANSWER = "chunk long, dest long, size binary, ids binary"
ENCODED = "doc_id long, ids array<int>"


def model(path: str) -> str:
    """The tokenizer's definition as JSON text, checked to be of the kind that words can be encoded apart."""
    text = Path(path).read_text(encoding="utf-8")
    d = json.loads(text)
    split, kind = d.get("pre_tokenizer") or {}, d.get("model") or {}
    if kind.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or d.get("normalizer"):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d.get("added_tokens", [])):
        raise ValueError(f"special tokens that take their surroundings are not supported: {path}")
    return text


@lru_cache(maxsize=2)
def _tokenizer(definition: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """Cuts texts where the tokenizer cuts them. Classes of characters are asked of it when they first occur."""

    def __init__(self, tokenizer: Tokenizer, special: list[str]):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)

    def learn(self, codes: np.ndarray) -> None:
        for c in codes.tolist():
            x = chr(c)
            # a letter stays with a letter before it, a number with a number, another sign with another sign; else it is a space
            self.kind[c] = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.split(before + x)) == 1), SPACE)

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places of ``buf`` (UTF-8) where words begin; ``off`` are the places where texts begin, and the end."""
        if not len(buf):
            return np.zeros(0, np.int64)
        found = [m.span() for m in self.special.finditer(buf.tobytes())] if self.special else []
        found = [(a, b) for a, b in found if np.searchsorted(off, a, "right") == np.searchsorted(off, b, "left")]  # not over two texts
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        code = buf[at].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            raw = np.zeros(len(buf) + 3, np.int32)
            raw[: len(buf)] = buf & 0x3F
            a, lead = at[wide], code[wide]
            two, three, four = (raw[a + k] for k in (1, 2, 3))
            code[wide] = np.select(
                [lead < 0xE0, lead < 0xF0], [(lead & 0x1F) << 6 | two, (lead & 0x0F) << 12 | two << 6 | three], (lead & 0x07) << 18 | two << 12 | three << 6 | four
            )
        kind = self.kind[code]
        if (kind == UNKNOWN).any():
            self.learn(np.unique(code[kind == UNKNOWN]))
            kind = self.kind[code]
        n = len(at)
        edges = np.unique(np.concatenate([off, *([a, b] for a, b in found)])).astype(np.int64)
        first = np.zeros(n + 1, bool)  # a text, or what stands between special tokens, begins here
        first[np.searchsorted(at, edges)] = True
        first[n] = True
        begin = first.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        # white space before a word: its last character stands alone, or goes with the word if it is a blank
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        begin[last] = True
        begin[last + 1] = code[last] != 32
        self._contractions(code, kind, first, begin)
        for a, b in found:
            i, j = np.searchsorted(at, (a, b))
            begin[i + 1 : j] = False
        return at[begin[:n]]

    @staticmethod
    def _contractions(code: np.ndarray, kind: np.ndarray, first: np.ndarray, begin: np.ndarray) -> None:
        """An apostrophe that begins a word takes s, t, m, d, re, ve or ll after it, and no more letters."""
        n = len(code)
        x = np.r_[code, 0, 0]
        inside = lambda i, k: (i + k < n) & ~first[np.minimum(i + k, n)]
        i = np.flatnonzero((code == 39) & begin[:n])
        i = i[inside(i, 1)]
        a, b = x[i + 1], x[i + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(i), bool)
        for c, d in ("re", "ve", "ll"):
            two |= (a == ord(c)) & (b == ord(d))
        two &= inside(i, 2) & ~one
        for hit, k in ((one, 2), (two, 3)):
            j = i[hit]
            begin[j + 1] = False
            begin[np.minimum(j + k, n)] = True


@lru_cache(maxsize=2)
def splitter(definition: str) -> Splitter:
    return Splitter(_tokenizer(definition), [t["content"] for t in json.loads(definition).get("added_tokens", [])])


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == "long" else pa.binary()) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _glued(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths of binary values, and all of them after each other."""
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return np.diff(off), data.slice(int(off[0]), int(off[-1] - off[0])).to_pybytes() if data is not None and len(words) else b""


def _cut(size: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(data)])


def _bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """By the words' bytes: sums of mixed bytes and their places, which need not tell words apart."""
    size, data = _glued(words)
    start = np.r_[0, np.cumsum(size)[:-1]] if len(size) else np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8).astype(U)
    place = (np.arange(len(raw)) - np.repeat(start, size)).astype(U)
    return (mix(np.add.reduceat(mix(raw + place * U(257) + U(1)), start)) % U(buckets)).astype(np.int64) if len(raw) else np.zeros(len(size), np.int64)


def _chunks(definition: str, buckets: int, hold: int):
    """Documents as places in the distinct words of their chunk, one row a chunk with all that it knows, and its words by bucket."""

    def run(batches):
        cutter, task, no = splitter(definition), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            words = pa.chunked_array([h[0] for h in held], pa.binary()).dictionary_encode().combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            distinct, at = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            dest = _bucket(distinct, buckets)
            order = np.argsort(dest, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            lengths, data = _glued(distinct.take(pa.array(order)))
            columns = [np.concatenate([h[k] for h in held]) for k in (1, 2, 3)]
            # the words ride along with the chunk's row, sorted by bucket: _sent() hands them out after the one shuffle by chunk
            return (task << 32) + no, *map(packed, columns), packed(place[at]), packed(dest[order].astype(np.int32)), packed(lengths.astype(np.int32)), pa.compress(data, codec="zstd", asbytes=True) if data else b"", len(data)

        for b in batches:
            ids = b.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for i, j, buf, off in pieces(b):
                start = cutter.cuts(buf, off)
                held.append((_cut(np.diff(np.r_[start, len(buf)]), buf.tobytes()), ids[i:j], known[i:j], np.diff(np.searchsorted(start, off)).astype(np.int64)))
                size += len(buf) + 64 * (j - i)
                if size > hold:
                    yield _record([flush()], _OWN)
                    held, size, no = [], 0, no + 1
        if held:
            yield _record([flush()], _OWN)

    return run


def _sent(table: pa.Table) -> pa.Table:
    """The distinct words of a chunk, one row for each bucket that has any."""
    own = table.to_pylist()[0]
    dest, length = unpacked(own["dest"], np.int32), unpacked(own["length"], np.int32)
    data = pa.decompress(own["words"], own["n_bytes"], codec="zstd", asbytes=True) if own["n_bytes"] else b""
    at = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]]) if len(dest) else np.zeros(0, np.int64)
    byte = np.r_[0, np.cumsum(length, dtype=np.int64)]
    rows = [(int(dest[i]), own["chunk"], packed(length[i:j]), data[byte[i] : byte[j]]) for i, j in zip(at, np.r_[at[1:], len(dest)], strict=True)]
    if not rows:
        return pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in _WORDS.split(", ")]).empty_table()
    return pa.Table.from_batches([_record(rows, _WORDS)])


def _encode_words(definition: str):
    """A bucket of the distinct-word table: each word is encoded once, and each chunk gets the ids of its words."""

    def run(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        words = pa.chunked_array([_cut(unpacked(r["size"], np.int32), r["words"]) for r in asked], pa.binary()).dictionary_encode()
        distinct = words.chunk(0).dictionary
        found = _tokenizer(definition).encode_batch_fast([w.decode("utf-8", "replace") for w in distinct.to_pylist()], add_special_tokens=False)
        n = np.array([len(e.ids) for e in found], np.int32)
        flat = np.fromiter((i for e in found for i in e.ids), np.int32, int(n.sum()))
        first = np.r_[0, np.cumsum(n)]
        rows = []
        for r, part in zip(asked, words.chunks, strict=True):
            at = part.indices.to_numpy()
            rows.append((r["chunk"], r["dest"], packed(n[at]), packed(_spread(flat, first[at], n[at]))))
        return pa.Table.from_batches([_record(rows, _ANSWER)])

    return run


def _spread(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[first : first + n] of each, after each other."""
    ends = np.cumsum(n, dtype=np.int64)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)]


def _place(own: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's documents with their ids."""
    own, given = own.to_pylist()[0], sorted(answers.to_pylist(), key=lambda r: r["dest"])
    size, at = unpacked(own["size"], np.int64), unpacked(own["at"], np.int32)
    n = np.concatenate([np.zeros(0, np.int32), *(unpacked(r["size"], np.int32) for r in given)])
    flat = np.concatenate([np.zeros(0, np.int32), *(unpacked(r["ids"], np.int32) for r in given)])
    if len(n) != len(unpacked(own["dest"], np.int32)):
        raise RuntimeError("a chunk lacks the words of a bucket")
    first, off = np.r_[0, np.cumsum(n, dtype=np.int64)], np.r_[0, np.cumsum(size)]
    of = np.r_[0, np.cumsum(n[at], dtype=np.int64)][off].astype(np.int32)
    ids = np.concatenate([np.zeros(0, np.int32), *(_spread(flat, first[a], n[a]) for a in np.array_split(at, max(1, len(at) // DECODED)))])
    doc = pa.array(unpacked(own["doc_id"], np.int64), mask=~unpacked(own["known"], bool))
    return pa.table([doc, pa.ListArray.from_arrays(pa.array(of), pa.array(ids))], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row of ``docs``, as the library's encode with add_special_tokens=False."""
    small_batches(docs.sparkSession)
    definition = model(path)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BYTES_A_BUCKET)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks(definition, buckets, HOLD), _OWN).groupBy("chunk")
    answers = own.applyInArrow(_sent, _WORDS).groupBy("dest").applyInArrow(_encode_words(definition), _ANSWER)
    return own.cogroup(answers.groupBy("chunk")).applyInArrow(_place, ENCODED)


def piece_table(definition: str) -> pa.Array:
    """Bytes of each id, null where the vocabulary has none. One row an id: as long as the vocabulary."""
    t = _tokenizer(definition)
    special = {x["content"] for x in json.loads(definition).get("added_tokens", [])}
    # the byte-level alphabet: visible Latin-1 characters are themselves, the other bytes follow from 256 on
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(seen))}
    names = [t.id_to_token(i) for i in range(max(t.get_vocab().values(), default=-1) + 1)]
    return pa.array([None if x is None else x.encode() if x in special or not set(x) <= byte.keys() else bytes(byte[c] for c in x) for x in names], pa.binary())


def _joined(ids: pa.ListArray, table: pa.Array):
    """Bytes of each row of ids: the id-to-piece join of some rows at a time, put together by position."""
    off, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy(zero_copy_only=False)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(off, off[i] + DECODED, "right")) - 1)
        x = flat[off[i] : off[j]]
        got = table.take(pa.array(np.where((x >= 0) & (x < len(table)), x, 0)))
        if got.null_count or ((x < 0) | (x >= len(table))).any():
            known = got.is_valid().to_numpy(zero_copy_only=False) & (x >= 0) & (x < len(table))
            got = pa.array([p if k else b"" for p, k in zip(got.to_pylist(), known, strict=True)], pa.binary())
        n, data = _glued(got)
        at = np.r_[0, np.cumsum(n, dtype=np.int64)][off[i : j + 1] - off[i]]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield data[a:b]
        i = j


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of rows of ids, as the library's decode with skip_special_tokens=False; null ids have empty text."""
    table = encoded.sparkSession.sparkContext.broadcast(piece_table(model(path)))

    def run(batches):
        for b in batches:
            text = [x.decode("utf-8", "replace") for x in _joined(b.column("ids"), table.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, ENCODED + ", text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of the decoded text."""
    table = encoded.sparkSession.sparkContext.broadcast(piece_table(model(path)))

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids = b.column("ids")  # a null list has no values
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            own = [sha(flat[i:j].tobytes()) for i, j in zip(off[:-1], off[1:], strict=True)]
            text = [sha(x.decode("utf-8", "replace").encode()) for x in _joined(ids, table.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(own, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
