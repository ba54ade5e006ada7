"""Counts of tokens over the whole corpus, asked for and answered in chunks of documents.

Tasks take their documents in chunks. A chunk sends its distinct tokens with their counts to buckets by hash, as one row per
chunk and bucket, and what it knows of its documents to itself. Buckets add up and answer each chunk. A token that a third of all
documents hold is one entry a chunk; nothing but chunks and buckets, both bounded, ever meets in a task.

Rows must come in an order that a task that is run again finds again (a scan, or sorted within partitions).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textnum import U, packed, unpacked


def blobs(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' rows of each bucket, in their order, as bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    columns = [c[order] for c in columns]
    for i, j in zip(at, np.r_[at[1:], len(b)], strict=True):
        yield int(b[i]), [c[i:j].tobytes() for c in columns]


def record(rows: list, names: list[str], numbers: int) -> pa.RecordBatch:
    """Rows of so many numbers and then bytes."""
    kinds = [pa.int64()] * numbers + [pa.binary()] * (len(names) - numbers)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def counted(docs: DataFrame, items: Callable, kinds: tuple, finish: Callable, schema: str, buckets: int, hold: int) -> DataFrame:
    """``finish`` over each chunk of ``docs`` and the counts of its tokens over all documents.

    ``items`` gets a batch and gives, for some documents at a time, their tokens (64 bits), how many each document has, and
    a tuple of columns with a value (``kinds``) for each document. Chunks have up to about ``hold`` tokens.
    ``finish`` gets the chunk's distinct tokens, the place of each document's tokens among them, their counts, the numbers
    of tokens of the documents, and their columns; it gives a table of ``schema``.
    """
    own = ["token", "at", "size", *(f"column_{k}" for k in range(len(kinds)))]
    sent, answer = ["dest", "chunk", "sums", *own], ["chunk", "bucket", "sums", *own]
    bucket_of = lambda token: ((token >> U(10)) % U(buckets)).astype(np.int64)

    def emit(batches):
        task, no, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            chunk = (task << 32) + no
            token, at, often = np.unique(np.concatenate([x[0] for x in held]).view(U), return_inverse=True, return_counts=True)
            columns = [np.concatenate([x[2][k] for x in held]) for k in range(len(kinds))]
            rows = [[-1 - chunk, chunk, None, packed(token), packed(at.astype(np.int32)), packed(np.concatenate([x[1] for x in held]).astype(np.int64)), *map(packed, columns)]]
            for b, (t, n) in blobs(bucket_of(token), token, often.astype(np.int32)):
                rows.append([b, chunk, packed(np.frombuffer(n, np.int32)), packed(np.diff(np.frombuffer(t, U), prepend=U(0))), *[None] * (len(own) - 1)])
            return record(rows, sent, 2)

        for batch in batches:
            for x in items(batch):
                held.append(x)
                size += len(x[0])
                if size > hold:
                    yield flush()
                    held, size, no = [], 0, no + 1
        if held:
            yield flush()

    def add(table):
        if table.column("dest")[0].as_py() < 0:
            return pa.table([table.column(c) for c in ("chunk", "dest", "sums", *own)], answer)
        asked = [np.cumsum(unpacked(x, U), dtype=U) for x in table.column("token").to_pylist()]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(at, np.concatenate([unpacked(x, np.int32) for x in table.column("sums").to_pylist()]))[at].astype(np.int64)
        ends = np.cumsum([len(x) for x in asked])
        answers = pa.array([packed(x) for x in np.split(sums, ends[:-1])], pa.binary())
        return pa.table([table.column("chunk"), table.column("dest"), answers, *[pa.nulls(len(table), pa.binary())] * len(own)], answer)

    def conclude(table):
        by = np.argsort(table.column("bucket").to_numpy())
        mine = {c: table.column(c)[int(by[0])].as_py() for c in ("bucket", *own)}
        token, at, size = (unpacked(mine[c], t) for c, t in (("token", U), ("at", np.int32), ("size", np.int64)))
        sums = table.column("sums").to_pylist()
        total = np.concatenate([np.zeros(0, np.int64), *(unpacked(sums[k], np.int64) for k in by[1:])])
        if mine["bucket"] >= 0 or len(total) != len(token):
            raise RuntimeError("a chunk lacks the counts of a bucket")
        often = np.empty(len(token), np.int64)
        often[np.argsort(bucket_of(token), kind="stable")] = total
        return finish(token, at, often, size, [unpacked(mine[f"column_{k}"], t) for k, t in enumerate(kinds)])

    binary = ", ".join(f"{c} binary" for c in own)
    counts = docs.mapInArrow(emit, f"dest long, chunk long, sums binary, {binary}").groupBy("dest").applyInArrow(add, f"chunk long, bucket long, sums binary, {binary}")
    return counts.groupBy("chunk").applyInArrow(conclude, schema)
