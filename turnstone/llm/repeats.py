"""Repeated windows of symbols (words or bytes) across all documents, by content-defined shards.

0. ``copies``: documents with equal texts are found by their hashes; one of each class goes on.

A window is W consecutive symbols of one document. Its anchor is its G-gram of least hash (ties: the leftmost), so
equal windows have equal anchors at equal places.

1. ``shared_anchors``: every anchor of every document is counted; an anchor that occurs once cannot lie in a
   repeated window, and its windows are done with.
2. ``shards``: the windows of one other anchor form a snippet of text; snippets go to the shard of their anchor.
   Snippets of an anchor that occurs more than HOT times go window by window, to the shards of the windows'
   own hashes, so that no anchor fills a shard.
3. The caller's ``find`` tells for a part of a shard (whole keys, up to PART bytes) which windows are repeated.

Tasks take documents in chunks. A chunk sends each of its different anchors, and each of its different snippets, once,
with how often it has it (and the first place); a bucket or shard adds up what the chunks sent and answers each of
them. So an anchor or a passage of any number of documents is one entry a chunk, places stay in their chunk, and
bytes are cut out once for all equal snippets of a piece of text.

Everything is lossless: what is left out cannot be repeated, and hashes only bring texts together or, at 64 bits
with equal key and length, stand for equal snippets. Documents are rows of distinct (doc_id, text): rows that
repeat both are one document, whose result each of them gets. Texts longer than a piece are taken in sections that overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .chunks import blobs, counted, record
from .common import cut, free, shard_count, small_batches
from .textnum import U, grams, mix, packed, pieces, powers, sliding, unpacked, within, word_hashes, word_spans

HOT, PART, HOLD, SECTION = 10_000, 1_500_000, 16 << 20, 1 << 23
CHUNK_ANCHORS, AT_ONCE = 2_000_000, 250_000
PACK = "zstd"
#: Document numbers up to which their list is broadcast, to leave other texts out of a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Kind:
    words: bool
    window: int
    gram: int


@dataclass
class Runs:
    """Windows with one anchor: hash, document (of the piece), first and last start, from the piece's first symbol."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray


class Symbols:
    """Symbols of a piece of text: where they start and end in bytes, and the first symbol of each document."""

    def __init__(self, kind: Kind, buf: np.ndarray, off: np.ndarray):
        self.kind, self.buf, self._sums, self._words = kind, buf, None, None
        if kind.words:
            self.start, self.stop, self.first = word_spans(buf, off)
        else:
            self.first = off

    def bytes_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range of the symbols a to b - 1."""
        return (self.start[a], self.stop[b - 1]) if self.kind.words else (a, b)

    def hashes(self, k: int) -> np.ndarray:
        """Hash of the k symbols from each one on."""
        if self.kind.words:
            return grams(word_hashes(self.buf, self.start, self.stop), k)
        n = len(self.buf) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        sums = self.sums()
        return mix((sums[k:] - sums[:-k]) * powers(n)[1])

    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.buf) + 1)
            self._sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum(textnum._BYTE[self.buf] * up[:-1], out=self._sums[1:])
        return self._sums

    def content_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes from a to b - 1."""
        s = self.sums()
        return mix((s[b] - s[a]) * powers(len(self.buf) + 1)[1][a] ^ (b - a).astype(U))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the symbols a to b - 1: for words one form whatever the blanks between them."""
        if not self.kind.words:
            return self.content_hashes(a, b)
        up, back = powers(len(self.start) + 1)
        if self._words is None:
            self._words = np.zeros(len(self.start) + 1, U)
            np.cumsum(grams(word_hashes(self.buf, self.start, self.stop), 1) * up[:-1], out=self._words[1:])
        return mix((self._words[b] - self._words[a]) * back[a] ^ (b - a).astype(U))

    def runs(self) -> Runs:
        w = self.kind.window - self.kind.gram + 1
        starts = within(self.first, self.kind.window)
        empty = np.zeros(0, np.int64)
        if not len(starts):
            return Runs(np.zeros(0, U), empty, empty, empty)
        docs = np.repeat(np.arange(len(self.first) - 1), np.maximum(np.diff(self.first) - self.kind.window + 1, 0))
        g = self.hashes(self.kind.gram)
        anchor = np.empty(len(starts), np.int64)
        # hash above, place below: the least is the leftmost of the least hashes; in sections, as places have 24 bits
        for a in range(0, len(g), SECTION):
            b = min(len(g), a + SECTION + w - 1)
            lo, hi = np.searchsorted(starts, (a, a + SECTION))
            if lo == hi:
                continue
            least = sliding((g[a:b] & ~U(0xFFFFFF)) | np.arange(b - a, dtype=U), w)
            anchor[lo:hi] = a + (least[starts[lo:hi] - a] & U(0xFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])])
        return Runs(g[anchor[at]], docs[at], starts[at], starts[np.r_[at[1:], len(starts)] - 1])


def sections(kind: Kind, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Pieces of a batch as in ``pieces``, and the place of their first symbol. A long text comes as several pieces that
    share W - 1 bytes; word windows take it whole, as their arrays are by words."""
    for i, j, buf, off in pieces(batch):
        if kind.words or len(buf) <= 2 * textnum.PIECE:
            yield i, j, buf, off, 0
            continue
        for a in range(0, len(buf) - kind.window + 1, textnum.PIECE):
            part = buf[a : a + textnum.PIECE + kind.window - 1]
            yield i, j, part, np.array([0, len(part)]), a


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))


def copies(docs: DataFrame) -> DataFrame:
    """rid, first (the rid of the first document with the same text, by doc_id) of texts that several documents have."""
    rows = docs.select("rid", "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"]
    many = rows.groupBy("h", "g", "n").agg(first.alias("first"), F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high")
    # cut off, so that the join stands directly on its shuffles, where Spark splits a large class
    return rows.join(cut(many.select("h", "g", "n", "first")), ["h", "g", "n"]).select("rid", "first").distinct()


def shared_anchors(docs: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """rid, anchors: the hashes of a document's anchors that occur more than once; hot ones are odd. Others have no row."""

    def items(batch):
        rid = batch.column("rid").to_numpy()
        held: list = []
        for i, j, buf, off, at in sections(kind, batch):
            runs = Symbols(kind, buf, off).runs()
            n = np.bincount(runs.doc, minlength=j - i)
            if at:  # one more section of the same text
                held[-1] = (np.r_[held[-1][0], runs.hash], held[-1][1] + n, held[-1][2])
            else:
                held.append((runs.hash, n, (rid[i:j],)))
        return held

    def finish(hashes, at, often, n, payload):
        h = ((hashes & ~U(1)) | (often > HOT).astype(U))[at]
        of = np.repeat(np.arange(len(n)), n)
        keep = often[at] > 1
        h, of = h[keep], of[keep]
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, np.int64)
        h, of = h[new], of[new]
        ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(n)))].astype(np.int32)
        out = pa.table({"rid": payload[0], "anchors": pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))})
        return out.filter(pa.array(np.diff(ends) > 0))

    return counted(docs.select("rid", "text"), items, (np.int64,), finish, "rid long, anchors array<long>", buckets, CHUNK_ANCHORS)


def _slices(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    n = b - a
    return buf[np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)]


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by ``keys`` (the first counts most), and where in it each run of equal rows begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


_SENT = "key size copies content rid doc null pos".split()
_OWN = "rids which place counts length".split()


def shards(docs: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """From rows (rid, doc_id, text, anchors): the different snippets of each chunk, for their shards (dest), with the number of
    their places and the first of them; and each chunk's places, for itself (dest -1 - chunk)."""
    columns = ["dest", "chunk", "base", *_SENT, *_OWN]

    def windows(s, runs, cold, hot):
        """Key, document, first symbol and end of snippets: of whole runs, and of each window of hot anchors."""
        for k in range(0, len(cold), AT_ONCE):
            k = cold[k : k + AT_ONCE]
            yield runs.hash[k], runs.doc[k], runs.start[k], runs.stop[k] + kind.window
        if not len(hot):
            return
        wide = s.hashes(kind.window) if kind.words else None
        many = np.cumsum(runs.stop[hot] - runs.start[hot] + 1)
        for k in np.split(hot, np.flatnonzero(np.diff(many // AT_ONCE)) + 1):
            n = runs.stop[k] - runs.start[k] + 1
            each = np.arange(int(n.sum())) + np.repeat(runs.start[k] - (np.cumsum(n) - n), n)
            yield s.content_hashes(each, each + kind.window) if wide is None else wide[each], np.repeat(runs.doc[k], n), each, each + kind.window

    def emit(batches):
        task, no = TaskContext.get().partitionId(), 0
        held, content, size, slots = [], [], 0, 0

        def flush():
            chunk = (task << 32) + no
            key, ident, rid, doc, null, pos, slot, length = (np.concatenate([x[k] for x in held]) for k in range(8))
            n = np.concatenate([x[0] for x in content])
            body = np.concatenate([x[1] for x in content])
            end = np.cumsum(n)
            # snippets by shard; their places from the first on
            by = mix(key) % U(buckets)
            order = np.lexsort((pos, rid, doc, null, ident, key, by))
            k, d, b = key[order], ident[order], by[order]
            at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
            one, copies = order[at], np.diff(np.r_[at, len(order)])
            rids, which = np.unique(rid[order], return_inverse=True)
            rows = [[-1 - chunk, chunk, None, *[None] * 8, packed(rids), packed(which.astype(np.int32)), packed(pos[order].astype(np.int32)), packed(copies), packed(length[one].astype(np.int32))]]
            edges = np.flatnonzero(np.r_[True, b[at][1:] != b[at][:-1]])
            for i, j in zip(edges, np.r_[edges[1:], len(at)], strict=True):
                o, z = one[i:j], slot[one[i:j]]
                text = pa.compress(_slices(body, end[z] - n[z], end[z]).tobytes(), codec=PACK, asbytes=True)
                sent = (key[o], n[z].astype(np.int32), copies[i:j].astype(np.int64), None, rid[o], doc[o], null[o].astype(np.uint8), pos[o].astype(np.int32))
                rows.append([int(by[o[0]]), chunk, int(i), *[text if x is None else x.tobytes() for x in sent], *[None] * 5])
            return record(rows, columns, 3)

        for batch in batches:
            rids = batch.column("rid").to_numpy()
            ids = batch.column("doc_id")
            nulls = np.array(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            lists = batch.column("anchors")
            flat, at = lists.values.to_numpy().view(U), lists.offsets.to_numpy()
            for i, j, buf, off, base in sections(kind, batch):
                s = Symbols(kind, buf, off)
                runs = s.runs()
                if not len(runs.hash):
                    continue
                mine = flat[at[i] : at[j]]
                owner = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                tag = lambda h, d: mix((h & ~U(1)) + d.astype(U) * U(0x9E3779B97F4A7C15))
                have = tag(mine, owner)
                order = np.argsort(have)
                want = tag(runs.hash, runs.doc)
                place = np.searchsorted(have[order], want).clip(0, max(len(have) - 1, 0))
                hit = have[order][place] == want if len(have) else np.zeros(len(want), bool)
                hot = hit & ((mine[order][place] & U(1)) == 1) if len(have) else hit
                for key, doc, a, b in windows(s, runs, np.flatnonzero(hit & ~hot), np.flatnonzero(hot)):
                    x, y = s.bytes_of(a, b)
                    ident = s.same(a, b)
                    order, first = _firsts(key, ident)
                    slot = np.empty(len(key), np.int64)
                    slot[order] = slots + np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
                    one = order[first]
                    held.append((key, ident, rids[i + doc], ids[i + doc], nulls[i + doc], base + a - s.first[doc], slot, b - a))
                    content.append(((y - x)[one], _slices(buf, x[one], y[one])))
                    slots += len(one)
                    size += len(content[-1][1]) + 32 * len(key)
                    if size > HOLD:
                        yield flush()
                        held, content, size, slots, no = [], [], 0, 0, no + 1
        if held:
            yield flush()

    return docs.mapInArrow(emit, "dest long, chunk long, base long, " + ", ".join(f"{c} binary" for c in _SENT + _OWN))


@dataclass
class Part:
    """Distinct snippets of one shard: bytes, number of places, and the first place (document's rank, and start in it)."""

    content: np.ndarray
    begin: np.ndarray  # of each snippet's bytes, and their end
    copies: np.ndarray
    rank: np.ndarray  # of the first place's document: by doc_id, nulls last, then rid
    pos: np.ndarray


def _parts(table: pa.Table) -> Iterator[tuple[Part, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a shard; and which rows were sent for it, the snippet of each, and whether it has the snippet's first place."""
    get = lambda n, t: np.frombuffer(b"".join(table.column(n).to_pylist()), t)
    sizes = [np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("size").to_pylist()]
    body = b"".join(pa.decompress(x, int(z.sum()), codec=PACK, asbytes=True) for x, z in zip(table.column("content").to_pylist(), sizes, strict=True))
    key, size, copies, content = get("key", U), np.concatenate(sizes), get("copies", np.int64), np.frombuffer(body, np.uint8)
    rid, doc, null, pos = get("rid", np.int64), get("doc", np.int64), get("null", np.uint8), get("pos", np.int32).astype(np.int64)
    end = np.cumsum(size)
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    total = np.r_[0, np.cumsum(np.add.reduceat(size[order], edges))]
    i = 0
    while i < len(edges):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PART, "right")) - 1)
        own = order[edges[i] : edges[j] if j < len(edges) else len(order)]
        i = j
        texts = _slices(content, end[own] - size[own], end[own])
        stop = np.cumsum(size[own])
        same = Symbols(Kind(False, 0, 0), texts, stop).content_hashes(stop - size[own], stop)
        by = np.lexsort((pos[own], rid[own], doc[own], null[own], same, key[own]))
        k, h = key[own][by], same[by]
        at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
        first = by[at]
        ident = np.empty(len(own), np.int64)
        ident[by] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(by)]))
        rank = np.empty(len(first), np.int64)
        r, d, z = (x[own][first] for x in (rid, doc, null))
        docs = np.lexsort((r, d, z))
        rank[docs] = np.cumsum(np.r_[0, (r[docs][1:] != r[docs][:-1]).astype(np.int64)])
        begin = np.r_[0, np.cumsum(size[own][first])]
        many = np.bincount(ident, copies[own]).astype(np.int64)
        lead = np.zeros(len(own), bool)
        lead[first] = True
        yield Part(_slices(texts, (stop - size[own])[first], stop[first]), begin, many, rank, pos[own][first]), own, ident, lead


def repeated(docs: DataFrame, kind: Kind, find: Callable[[Part], tuple[np.ndarray, np.ndarray, np.ndarray]], spare_first: bool) -> DataFrame:
    """rid, spans (array of struct a, b; b of -1: the end): where windows of a document are repeated, as ``find`` decides.

    Texts that several documents have are repeated as a whole, but for the first if ``spare_first``.

    ``find`` gets a Part and returns snippets with the first and last start of each run of windows that are repeated
    at the snippet's first place, counted in symbols from its start. At its other places all windows are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    same = cut(copies(docs))
    later = same.where("rid <> first").select("rid")
    whole = (later if spare_first else same.select("rid")).select("rid", F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    few = later.count() <= BROADCAST_ROWS
    buckets = shard_count(docs)  # of all texts, as a count of those left would shuffle them once more where ``later`` is long
    if few:
        docs = docs.join(F.broadcast(later), "rid", "left_anti")
    anchors = shared_anchors(docs, kind, buckets)
    if not few:
        # numbers meet numbers and texts stay: anchors of copies are counted too, so that what copies alone repeat goes to a
        # shard, which tells that its one text there repeats nothing
        anchors = anchors.join(later.hint("shuffle_hash"), "rid", "left_anti")
    anchors = cut(anchors)
    free(spark)
    with_anchors, _ = split(docs, anchors)
    # sorted by document, so that a chunk holds the same whatever task is run again; rows that repeat are one document
    texts = with_anchors.join(anchors.hint("merge"), "rid").dropDuplicates(["rid"])
    sent = shards(texts.select("rid", "doc_id", "text", "anchors"), kind, buckets)
    answer = ["chunk", "base", "lead", "slot", "lo", "hi", *_OWN]
    schema = "chunk long, base long, " + ", ".join(f"{c} binary" for c in answer[2:])

    def search(table):
        if table.column("dest")[0].as_py() < 0:
            none = pa.nulls(len(table), pa.binary())
            return pa.table([table.column("chunk"), table.column("base"), *[none] * 4, *(table.column(c) for c in _OWN)], answer)
        counts = np.array([len(x) // 8 for x in table.column("key").to_pylist()])
        begin, row = np.r_[0, np.cumsum(counts)], np.repeat(np.arange(len(counts)), counts)
        leads, where, los, his = np.zeros(len(row), bool), [], [], []
        for part, own, ident, lead in _parts(table):
            leads[own[lead]] = True
            sender = np.empty(len(part.copies), np.int64)
            sender[ident[lead]] = own[lead]
            snippet, lo, hi = find(part)
            where.append(sender[snippet])
            los.append(lo)
            his.append(hi)
        where, los, his = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, los, his))
        order = np.argsort(where, kind="stable")
        where, los, his = where[order], los[order], his[order]
        cuts = np.searchsorted(where, begin)
        out = []
        for k, (chunk, base) in enumerate(zip(table.column("chunk").to_pylist(), table.column("base").to_pylist(), strict=True)):
            x = slice(cuts[k], cuts[k + 1])
            runs = [packed(v.astype(np.int32)) for v in (where[x] - begin[k], los[x], his[x])]
            out.append([chunk, base, packed(leads[begin[k] : begin[k + 1]].view(np.uint8)), *runs, *[None] * 5])
        return pa.Table.from_batches([record(out, answer, 2)])

    def spread(table):
        rows = sorted(table.to_pylist(), key=lambda r: -1 if r["base"] is None else r["base"])
        own, rows = rows[0], rows[1:]
        rids, which, place, counts, length = (unpacked(own[c], t) for c, t in zip(_OWN, (np.int64, np.int32, np.int32, np.int64, np.int32), strict=True))
        lead = np.concatenate([unpacked(r["lead"], np.uint8) for r in rows]).astype(bool)
        if own["base"] is not None or len(lead) != len(counts):
            raise RuntimeError("a chunk lacks the answer of a shard")
        slot = np.concatenate([unpacked(r["slot"], np.int32).astype(np.int64) + r["base"] for r in rows])
        lo, hi = (np.concatenate([unpacked(r[c], np.int32) for r in rows]).astype(np.int64) for c in ("lo", "hi"))
        place, at = place.astype(np.int64), np.cumsum(counts) - counts
        # all windows at every place but the first one of all chunks, and there the runs
        rest = np.ones(len(place), bool)
        rest[at[lead]] = False
        ends = place + np.repeat(length, counts)
        a, b = np.r_[place[rest], place[at[slot]] + lo], np.r_[ends[rest], place[at[slot]] + hi + kind.window]
        doc = np.r_[which[rest], which[at[slot]]].astype(np.int64)
        # spans that meet become one
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order]
        reach = np.maximum.accumulate((doc << 40) + b)
        new = np.flatnonzero(np.r_[True, (doc[1:] << 40) + a[1:] > reach[:-1]]) if len(doc) else order
        last = np.r_[new[1:], len(doc)][: len(new)] - 1
        return pa.table({"rid": rids[doc[new]], "a": a[new], "b": reach[last] - (doc[new] << 40)})

    found = sent.groupBy("dest").applyInArrow(search, schema).groupBy("chunk").applyInArrow(spread, "rid long, a long, b long")
    out = cut(found.union(whole).repartition("rid").groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    free(spark)
    return out


def split(docs: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents that ``side`` has a row for, and the others, if the list of their numbers may be broadcast; else all."""
    if side.count() > BROADCAST_ROWS:
        return docs, None
    ids = F.broadcast(side.select("rid"))
    return docs.join(ids, "rid", "left_semi"), docs.join(ids, "rid", "left_anti")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the column spans; only texts that have any are shuffled, as long as their numbers are few."""
    free(docs.sparkSession)
    some, others = split(docs, spans)
    out = some.join(spans.hint("shuffle_hash"), "rid", "left")
    return out if others is None else out.unionByName(others.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def covered(lists: pa.Array, i: int, j: int, first: np.ndarray, window: int) -> np.ndarray:
    """For rows i to j - 1 of a batch: whether each of their symbols lies in a span."""
    delta = np.zeros(int(first[-1]) + 1, np.int32)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    at = np.r_[0, np.cumsum(lengths)]
    a, b = (flat.field(k).to_numpy()[at[i] : at[j]] for k in (0, 1))
    n = np.repeat(np.diff(first), lengths[i:j])
    base = np.repeat(first[:-1], lengths[i:j])
    end = np.where(b >= 0, b, np.where(n >= window, n, a))  # a whole text without a window has nothing repeated
    np.add.at(delta, base + a, 1)
    np.add.at(delta, base + end, -1)
    return np.cumsum(delta[:-1], dtype=np.int32) > 0
