"""N-gram Jaccard join by vertical partitioning: classes of linked documents and the number of links of each.

A document is the set of its distinct 5-word shingles (all its words as one, if fewer). Equal sets are one node.
Two nodes link when 100 * shared >= 75 * union.

1. ``screen``: a node that links has at least three quarters of its shingles in common with another. Every
   shingle of short documents and SAMPLE of the others' meet their equals; nodes whose unshared shingles in the
   sample already exceed what a link allows are done with, which are nearly all without a near copy.
2. ``ordered``: for the rest, shingles are counted and put in one global order, rarest first, which FRAGMENTS cut
   into ranges. In that order a link needs a common shingle within the first n - ceil(0.75 n) + 1 ones (prefix
   filter); nodes that share such a one are in one block, found as components of stars.
3. ``overlaps``: a block is a square of pairs, which is cut into tiles of at most about TILE_NODES nodes or TILE_TOKENS
   shingles a side, each in a task of its own; small blocks share a tile. In a tile the overlaps of each
   fragment are counted on their own, the rarest first, and summed per pair; rows without a pair that the
   other fragments could still make a link leave after each fragment. What leaves a tile is one row per node: its
   links, and a node that it is connected with. So every link is counted, but no list of pairs is ever sent.

A frequent shingle is one entry for each chunk of documents, in 1 and 2: chunks send their distinct shingles with
their counts to buckets, and get the sums back. The work on a block's pairs, though not its rows, grows with their number.

Shingles are 54-bit hashes, sets 64-bit ones. Cases: null, empty or wordless text has an empty set, linked
with nothing, and is its own class; rows that repeat are linked by their equal sets; null doc_id counts as a
row but never as the smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import blobs, counted
from .common import components, cut, free, shard_count, small_batches
from .textnum import U, grams, mix, pieces, within, word_hashes, word_spans

SHINGLE, SHIFT = 5, 10
SAMPLE, SENDS_ALL, JUDGED_BY_ALL = 0.4, 128, 96  # partners of nodes up to 96 shingles have up to 128
CHUNK_ROWS, CHUNK_TOKENS = 60_000, 1_000_000
#: Cuts of the global order: shingles of up to 8 nodes, of up to 64, and the rest.
FRAGMENTS = (8, 64)
TILE_NODES, TILE_TOKENS = 2048, 1_000_000
#: Postings that are counted at once; a shingle that more than one of DENSE pairs of a tile share is counted by a product.
STEP, DENSE = 4_000_000, 128
BROADCAST_ROWS = 1_000_000
_MANY = 0xFFFF


def sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document, and where each document's begin (one past the last included)."""
    s, e, first = word_spans(buf, off)
    h = word_hashes(buf, s, e, lower=True)
    n = np.diff(first)
    at = within(first, SHINGLE)
    token, doc = [grams(h, SHINGLE)[at]], [np.repeat(np.arange(len(n)), np.maximum(n - SHINGLE + 1, 0))]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(n == k)
        if len(few):
            token.append(grams(h, k)[first[few]])
            doc.append(few)
    low = U(64 - SHIFT)
    key = np.sort((np.concatenate(doc).astype(U) << low) | (np.concatenate(token) >> U(SHIFT)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    begin = np.searchsorted(key >> low, np.arange(len(n) + 1).astype(U))
    return (key & ((U(1) << low) - U(1))).view(np.int64), begin


def prints(token: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One hash for each set."""
    sums = np.r_[U(0), np.cumsum(mix(token.view(U)))]
    return mix((sums[begin[1:]] - sums[begin[:-1]]) ^ np.diff(begin).astype(U)).view(np.int64)


def _sampled(token: np.ndarray) -> np.ndarray:
    return (token >> 46 & 0xFF) < SAMPLE * 256


def screen(docs: DataFrame, buckets: int) -> DataFrame:
    """rid, doc_id, node, n, near for every row; near: the node may link with another."""

    def emit(batches):
        part, chunk = None, 0
        held, rows, size = [], 0, 0

        def flush():
            rid, doc, null, node, n, m = (np.concatenate([x[k] for x in held]) for k in range(6))
            token, local = np.concatenate([x[6] for x in held]), np.concatenate([x[7] for x in held])
            # copies of a set within the chunk send it once
            first = np.zeros(len(node), bool)
            first[np.unique(node, return_index=True)[1]] = True
            keep = first[local]
            token, local = token[keep], local[keep]
            # a shingle of several nodes of the chunk is known to be shared: one entry tells the other chunks
            order = np.argsort(token, kind="stable")
            token, local = token[order], local[order]
            at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            often = np.diff(np.r_[at, len(token)])
            known = np.bincount(local[np.repeat(often > 1, often)], minlength=rows).astype(np.int32)
            token, local = token[at], np.where(often > 1, _MANY, local[at]).astype(np.uint16)
            number = (part << 24) + chunk
            out = [(b, number, *x, None) for b, x in blobs(token % buckets, (token >> 22).astype(np.uint32), local)]
            table = [x.tobytes() for x in (rid, doc, null, node, n.astype(np.int32), m.astype(np.int32), known)]
            out.append((-1 - number, number, None, None, b"".join(table)))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "chunk", "token", "local", "table"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            rids, ids = batch.column("rid").to_numpy(), batch.column("doc_id")
            nulls, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
            for i, j, buf, off in pieces(batch):
                token, begin = sets(buf, off)
                n = np.diff(begin)
                doc = np.repeat(np.arange(j - i), n)
                inside = _sampled(token)
                m = np.bincount(doc[inside], minlength=j - i)
                send = inside | (n <= SENDS_ALL)[doc]
                held.append((rids[i:j], ids[i:j], nulls[i:j], prints(token, begin), n, np.where(n <= JUDGED_BY_ALL, n, m), token[send], (rows + doc[send]).astype(np.uint16)))
                rows, size = rows + j - i, size + int(send.sum())
                if size > CHUNK_TOKENS or rows > CHUNK_ROWS:
                    yield flush()
                    held, rows, size, chunk = [], 0, 0, chunk + 1
        if rows:
            yield flush()

    def meet(table):
        names = {"chunk": pa.int64(), "shared": pa.binary(), "table": pa.binary()}
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"chunk": table.column("chunk"), "shared": pa.nulls(len(table), pa.binary()), "table": table.column("table")}).cast(pa.schema(names))
        token = [np.frombuffer(x, np.uint32) for x in table.column("token").to_pylist()]
        local = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("local").to_pylist()])
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in token])
        token = np.concatenate(token)
        order = np.argsort(token)
        t = token[order]
        at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        n = np.diff(np.r_[at, len(t)])
        hit = order[np.repeat(n > 1, n)]
        hit = hit[local[hit] != _MANY]
        out = list(blobs(chunk[hit], local[hit]))
        return pa.table({"chunk": [x[0] for x in out], "shared": [x[1][0] for x in out], "table": [None] * len(out)}, schema=pa.schema(names))

    def judge(table):
        raw = next(x for x in table.column("table").to_pylist() if x is not None)
        rows = len(raw) // 37
        at, parts = 0, []
        for t in (np.int64, np.int64, bool, np.int64, np.int32, np.int32, np.int32):
            size = rows * np.dtype(t).itemsize
            parts.append(np.frombuffer(raw[at : at + size], t))
            at += size
        rid, doc, null, node, n, m, count = parts
        for x in table.column("shared").to_pylist():
            if x is not None:
                count = count + np.bincount(np.frombuffer(x, np.uint16), minlength=rows)
        spare = n - -(-3 * n // 4)
        near = (n > 0) & (count >= m - spare)
        by, back = np.unique(node, return_inverse=True)  # rows that did not send take the answer of the one that did
        answer = np.zeros(len(by), bool)
        sent = np.unique(node, return_index=True)[1]
        answer[:] = near[sent]
        return pa.table({"rid": rid, "doc_id": pa.array(doc, mask=null), "node": node, "n": n.astype(np.int64), "near": answer[back]})

    d = docs.select("rid", "doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    sent = d.mapInArrow(emit, "bucket long, chunk long, token binary, local binary, table binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "chunk long, shared binary, table binary")
    return met.groupBy("chunk").applyInArrow(judge, "rid long, doc_id long, node long, n long, near boolean")


def ordered(docs: DataFrame, buckets: int) -> DataFrame:
    """From rows (node, copies, text), one per node: node, n, copies, shared, prefix, cuts.

    ``shared`` holds the shingles of two nodes or more, the rarest first; ``cuts`` how many of them lie before each of the
    cuts of FRAGMENTS, and ``prefix`` how many in the prefix of the node's set. Nodes whose prefix has none are left out.
    """

    def items(batch):
        nodes, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
        for i, j, buf, off in pieces(batch):
            token, begin = sets(buf, off)
            yield token, np.diff(begin), (nodes[i:j], copies[i:j])

    def finish(token, at, df, n, columns):
        df, token, of = df[at], token.view(np.int64)[at], np.repeat(np.arange(len(n)), n)
        keep = df > 1
        df, token, of = df[keep], token[keep], of[keep]
        order = np.lexsort((token, df, of))
        df, token, of = df[order], token[order], of[order]
        held = np.bincount(of, minlength=len(n))
        begin = np.r_[0, np.cumsum(held)]
        prefix = (n - -(-3 * n // 4) + 1) - (n - held)  # places of the prefix left after the shingles of one node only
        low = [np.bincount(of[df <= f], minlength=len(n)) for f in FRAGMENTS]
        lists = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
        out = {"node": columns[0], "n": n, "copies": columns[1], "shared": lists(token, begin), "prefix": prefix.astype(np.int32)}
        out["cuts"] = lists(np.stack(low, axis=1).ravel().astype(np.int32), np.arange(len(n) + 1) * len(FRAGMENTS))
        return pa.table(out).filter(pa.array(prefix > 0))

    return counted(docs, items, (np.int64, np.int64), finish, "node long, n long, copies long, shared array<long>, prefix int, cuts array<int>", buckets, CHUNK_TOKENS)


def blocks(nodes: DataFrame) -> DataFrame:
    """node, block: components of nodes that share a shingle in their prefixes."""
    entries = nodes.select("node", F.explode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("token"))
    low = entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "low")
    return components(entries.join(low, "token").where("node <> low").select("node", "low").distinct(), "node", "low").select(F.col("node"), F.col("component").alias("block"))


class Tile:
    """Nodes of a tile: sizes, and their shared shingles as numbers, in fragments."""

    def __init__(self, n: np.ndarray, lists: list[np.ndarray], cuts: np.ndarray):
        self.n, size = n, np.array([len(x) for x in lists])
        self.of = np.repeat(np.arange(len(n)), size)
        self.token = np.unique(np.concatenate(lists), return_inverse=True)[1]
        place = np.arange(len(self.of)) - np.repeat(np.cumsum(size) - size, size)
        self.fragment = sum((place >= cuts[:, f][self.of] for f in range(cuts.shape[1])), np.zeros(len(place), np.int64))
        ends = np.c_[cuts, size]
        self.left = size[:, None] - ends  # shingles after each fragment

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of the rows ``a`` with the rows ``b`` that link, as an array of bool."""
        count, need = np.zeros((len(a), len(b)), np.float32), (3 * (self.n[a][:, None] + self.n[b])).astype(np.float32)
        row, column = np.full(len(self.n), -1), np.full(len(self.n), -1)
        row[a], column[b] = np.arange(len(a)), np.arange(len(b))
        for f in range(self.left.shape[1]):
            self._add(count, row, column, self.fragment == f)
            # what the fragments to come can add at most
            possible = 7 * (count + np.minimum(self.left[a, f][:, None], self.left[b, f]).astype(np.float32)) >= need
            if a is b:
                np.fill_diagonal(possible, False)
            row[a[~possible.any(1)]] = -1
            column[b[~possible.any(0)]] = -1
        return 7 * count >= need

    def _add(self, count: np.ndarray, row: np.ndarray, column: np.ndarray, here: np.ndarray) -> None:
        """Overlaps in the shingles that ``here`` tells, added to ``count``."""
        x, y = here & (row[self.of] >= 0), here & (column[self.of] >= 0)
        tx, rx, ty, ry = self.token[x], row[self.of[x]], self.token[y], column[self.of[y]]
        if not len(tx) or not len(ty):
            return
        top = int(max(tx.max(), ty.max())) + 1
        nx, ny = np.bincount(tx, minlength=top), np.bincount(ty, minlength=top)
        dense = np.flatnonzero(nx * ny * DENSE > count.size)
        if count.size <= 4096:
            dense = dense[:0]
        number = np.full(top, -1)
        number[dense] = np.arange(len(dense))
        for i in range(0, len(dense), 1024):
            sides = []
            for t, r, size in ((tx, rx, count.shape[0]), (ty, ry, count.shape[1])):
                k = (number[t] >= i) & (number[t] < i + 1024)
                m = np.zeros((size, min(1024, len(dense) - i)), np.float32)
                m[r[k], number[t[k]] - i] = 1
                sides.append(m)
            count += sides[0] @ sides[1].T
        k = (number[tx] < 0) & (ny[tx] > 0)
        tx, rx = tx[k], rx[k]
        if not len(tx):
            return
        order = np.argsort(ty, kind="stable")
        posting, at = ry[order], np.cumsum(ny) - ny
        many, flat = ny[tx], count.ravel()
        step = np.flatnonzero(np.diff(np.cumsum(many) // STEP, prepend=-1))
        for i, j in zip(step, np.r_[step[1:], len(tx)], strict=True):
            m = many[i:j]
            met = posting[np.arange(int(m.sum())) + np.repeat(at[tx[i:j]] - (np.cumsum(m) - m), m)]
            place = np.repeat(rx[i:j], m) * count.shape[1] + met
            if count.size <= 4 * len(place):
                flat += np.bincount(place, minlength=count.size).astype(np.float32)
            else:
                np.add.at(flat, place, np.float32(1))


def _connected(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The least row that each of ``size`` rows is connected with by the pairs (x, y)."""
    label = np.arange(size)
    while True:
        old, least = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == old).all():
            return label


def overlaps(members: DataFrame, bins: int) -> DataFrame:
    """node, other, links: for nodes of a tile that have links in it a node that they are connected with, and the
    documents that they link with. ``members``: block, sides (tiles of a side of the block), node, n, copies, shared, cuts."""

    def run(table):
        out: tuple = ([], [], [])
        block = table.column("block").to_numpy()
        node, n, copies, tile = (table.column(c).to_numpy() for c in ("node", "n", "copies", "tile"))
        lists = table.column("shared").combine_chunks()
        values, off = lists.values.to_numpy(), lists.offsets.to_numpy()
        cuts = table.column("cuts").combine_chunks().flatten().to_numpy().reshape(-1, len(FRAGMENTS))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.lexsort((node, tile, block))
        edges = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
        ends = np.r_[edges[1:], len(order)] if i is None else np.array([len(order)])  # tiles end where blocks do
        total = np.r_[0, np.cumsum(np.diff(off)[order])]
        start = 0
        while start < len(order):
            fit = ends[(ends > start) & (ends - start <= TILE_NODES) & (total[ends] - total[start] <= TILE_TOKENS)]
            stop = fit[-1] if len(fit) else ends[ends > start][0]
            own = order[start:stop]
            start = stop
            t = Tile(n[own], [values[off[k] : off[k + 1]] for k in own], cuts[own])
            every = np.arange(len(own))
            a, b = (every, every) if i == j else (np.flatnonzero(tile[own] == i), np.flatnonzero(tile[own] == j))
            link = t.overlaps(a, b)
            if i == j:
                np.fill_diagonal(link, False)
            x, y = np.nonzero(link)
            x, y = a[x], b[y]
            links = np.bincount(x, copies[own][y], len(own))
            if i != j:
                links += np.bincount(y, copies[own][x], len(own))
            some = np.flatnonzero(links)
            for o, v in zip(out, (node[own][some], node[own][_connected(x, y, len(own))[some]], links[some].astype(np.int64)), strict=True):
                o.append(v)
        return pa.table({k: np.concatenate(v) for k, v in zip(("node", "other", "links"), out, strict=True)})

    large = F.col("sides") > 1
    m = members.withColumn("tile", F.pmod(F.xxhash64("node"), "sides")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    # small blocks share tasks; a tile of a larger block has its own
    own = F.when(large, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(bins)))
    m = m.select("block", "node", "n", "copies", "shared", "cuts", "tile", own.alias("own"), *[F.when(large, f("tile", "with")).alias(c) for c, f in (("i", F.least), ("j", F.greatest))])
    return m.groupBy("own", "i", "j").applyInArrow(run, "node long, other long, links long")


def classes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, n_links of every row of ``docs`` (rid, doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = shard_count(docs)
    rows = cut(screen(docs.select("rid", "doc_id", "text"), buckets))
    near = rows.where("near").groupBy("node").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.count("*").alias("copies"))
    some = cut(near.select("rid", "node", "copies"))
    texts = docs.select("rid", "text")
    if some.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(some), "rid")
    else:  # in one order, whatever task is run again
        texts = texts.join(some.hint("shuffle_hash"), "rid").sortWithinPartitions("node")
    nodes = ordered(texts.select("node", "copies", "text"), buckets)
    if rows.count() > rows.select("rid").distinct().count():  # rows that repeat a rid have one text: the node is taken once
        nodes = nodes.dropDuplicates(["node"])
    nodes = cut(nodes)
    free(spark)
    members = nodes.join(blocks(nodes), "node")
    sides = F.ceil(F.greatest(F.sum(F.size("shared")) / TILE_TOKENS, F.count("*") / TILE_NODES)).cast("int")
    sizes = cut(members.groupBy("block").agg(sides.alias("sides")).where("sides > 1"))
    members = members.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "block", "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    found = cut(overlaps(members.select("block", "sides", "node", "n", "copies", "shared", "cuts"), buckets))
    free(spark)
    links = found.groupBy("node").agg(F.sum("links").alias("links")).alias("l")
    of = components(found, "node", "other").alias("o")
    i = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("n").alias("n"), F.count("*").alias("copies")).alias("i")
    joined = i.join(of, F.col("i.node") == F.col("o.node"), "left").join(links, F.col("i.node") == F.col("l.node"), "left")
    n_links = F.when(F.col("i.n") > 0, F.col("i.copies") - 1).otherwise(0) + F.coalesce("l.links", F.lit(0))
    rooted = cut(joined.select("i.node", "i.low", F.coalesce("o.component", "i.node").alias("root"), n_links.alias("n_links")))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    per_node = rooted.join(lows, "root").select("node", "component_id", "n_links")
    r, p = rows.alias("r"), per_node.alias("p")
    own = F.when(F.col("r.n") == 0, F.col("r.doc_id")).otherwise(F.col("p.component_id"))
    return r.join(p, F.col("r.node") == F.col("p.node")).select("r.rid", "r.doc_id", F.col("r.n").alias("n_shingles"), own.alias("component_id"), "p.n_links")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents that it links with) of every row."""
    return classes(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))).drop("rid")
