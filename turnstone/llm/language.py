r"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

Vectors hold hashed byte trigrams (ASCII letters lower-cased, other ASCII as one blank), log-scaled, weighted by
inverse document frequency and normalised. Document frequencies come from all documents that may be learned from;
centroids from about FIT_ROWS of them per language, chosen by a hash of doc_id, clustered by spherical k-means. The
sample is bounded to about FIT_TOTAL rows: with more languages each has fewer rows, down to LEAST_ROWS, and none is left
out. Every text is compared with every centroid; of equal cosines the first language by code point wins. A prediction whose cosine is below the least cosine that its centroid's own documents have
(their LEAST quantile) is marked as rejected.

Cases: text that is null or has no letter is "und" with score 0; with nothing to learn from all are "und"; null
doc_id is never learned from and not held out. Rows that repeat a doc_id are in the sample together, and at most twice the rows that were
meant for their language stay; a language of which no doc_id fell into the sample is learned from its LEAST_ROWS least rows by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches
from .textnum import packed, pieces, unpacked

SIZE, CENTROIDS, FIT_ROWS, LEAST, K_ROUNDS = 2048, 3, 400, 0.01, 12
FIT_TOTAL, LEAST_ROWS = 65_536, 32
_MAP = np.full(256, 32, np.uint32)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts of each document, hashed to SIZE columns."""
    n = len(off) - 1
    x = _MAP[buf]
    if len(x) < 3:
        return np.zeros((n, SIZE), np.float32)
    code = ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)) & np.uint32(SIZE - 1)
    doc = np.repeat(np.arange(n), np.diff(off))
    same = (doc[:-2] == doc[2:]) & ~((x[:-2] == 32) & (x[1:-1] == 32))
    return np.bincount(doc[:-2][same] * SIZE + code[same], minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _gather(batches):
    """Per task one row of document frequencies, and the counts of the sampled documents."""
    df, n, some = np.zeros(SIZE, np.int64), 0, []
    for b in batches:
        lang, fit = b.column("lang").to_pylist(), b.column("fit").to_numpy(zero_copy_only=False)
        for i, j, buf, off in pieces(b, limit=1 << 19):
            c = counts(buf, off)
            df += (c > 0).sum(0)
            n += j - i
            some += [(lang[i + k], packed(c[k].astype(np.int32))) for k in np.flatnonzero(fit[i:j])]
        if len(some) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.binary()), pa.array([0] * len(some), pa.int64())], ["lang", "data", "n"])
            some = []
    some.append((None, df.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.binary()), pa.array([0] * (len(some) - 1) + [n], pa.int64())], ["lang", "data", "n"])


def _kmeans(v: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(v))
    c = [v.mean(0)]
    for _ in range(k - 1):  # next centre: the vector farthest from those chosen
        c.append(v[np.argmin((v @ np.array(c).T).max(1))])
    c = np.array(c)
    for _ in range(K_ROUNDS):
        own = (v @ c.T).argmax(1)
        c = np.array([v[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame) -> dict | None:
    """The model from documents that may be learned from: idf, centroids, their languages and least cosines."""
    n = {r["lang"]: r["n"] for r in docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    spark = docs.sparkSession
    most = max(LEAST_ROWS, min(FIT_ROWS, FIT_TOTAL // len(n)))
    share = F.broadcast(spark.createDataFrame([(x, min(1.0, most / c)) for x, c in n.items()], "fit_lang string, share double"))
    d = docs.select("doc_id", "lang", "text").join(share, F.col("lang") == F.col("fit_lang")).select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).alias("fit"))
    found = cut(d.mapInArrow(_gather, "lang string, data binary, n long"))
    # frequencies are summed by the JVM per column before they reach the driver
    spread = found.where("lang is null").select(F.col("n"), "data").mapInArrow(_columns, "c int, n long")
    by = {r["c"]: r["n"] for r in spread.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    df, total = np.array([by.get(c, 0) for c in range(SIZE)], float), by.get(-1, 0)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1e-3
    by_lang: dict = {lang: [] for lang in n}
    # the share of a language is by doc_id, so rows that repeat one come together: at most twice the rows that were meant are kept
    few = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("data"), "data")) <= 2 * most
    for r in found.where("lang is not null").select("lang", "data", few.alias("few")).where("few").collect():
        by_lang[r["lang"]].append(r["data"])
    none = [(x,) for x in n if not by_lang[x]]
    if none:  # no doc_id of theirs fell into the share: their least rows
        own = docs.join(F.broadcast(spark.createDataFrame(none, "fit_lang string")), F.col("lang") == F.col("fit_lang"))
        no = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "doc_id"))
        own = own.select("lang", "text", no.alias("no")).where(F.col("no") <= LEAST_ROWS).select("lang", "text", F.lit(True).alias("fit"))
        for r in own.mapInArrow(_gather, "lang string, data binary, n long").where("lang is not null").select("lang", "data").collect():
            by_lang[r["lang"]].append(r["data"])
    centres, langs, least = [], [], []
    for lang in sorted(n):
        x = sorted(by_lang[lang])
        v = vectors(np.array([unpacked(b, np.int32) for b in x], np.float32), idf)
        c = _kmeans(v, CENTROIDS)
        cos = v @ c.T
        own = cos.argmax(1)
        for i in range(len(c)):
            centres.append(c[i])
            langs.append(lang)
            least.append(float(np.quantile(cos[own == i, i], LEAST)) if (own == i).any() else 1.0)
    return {"idf": idf, "centres": np.array(centres, np.float32), "langs": np.array(langs, object), "least": np.array(least)} if centres else None


def _columns(batches):
    for b in batches:
        for data, n in zip(b.column("data").to_pylist(), b.column("n").to_pylist(), strict=True):
            df = np.frombuffer(data, np.int64)
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]].astype(np.int64))], ["c", "n"])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    d = docs.select("doc_id", held.alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    given = spark.sparkContext.broadcast(model)  # SIZE floats for each of CENTROIDS of a language, and one more

    def predict(batches):
        m = given.value
        for b in batches:
            lang, score, out = [], [], []
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            for i, j, buf, off in pieces(b, limit=1 << 19):
                if m is None:
                    best, cos = np.zeros(j - i, int), np.zeros(j - i)
                else:
                    all_cos = vectors(counts(buf, off), m["idf"]) @ m["centres"].T
                    best = all_cos.argmax(1)
                    cos = all_cos[np.arange(j - i), best].astype(float).clip(0, 1)
                ok = letters[i:j] & (m is not None)
                lang += [m["langs"][k] if y else "und" for k, y in zip(best, ok, strict=True)]
                score += list(np.where(ok, cos, 0.0))
                out += [not y or cos_ < m["least"][k] for k, y, cos_ in zip(best, ok, cos, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(x) for x in out], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return d.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
