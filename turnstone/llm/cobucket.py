"""A parent and a child table rewritten as co-bucketed files: one Parquet file per table and bucket of the key they share.

Both tables first stand in numbered files, as some writer left them; they are then rewritten so that all rows of a key are in the file
of its bucket, on both sides. Child rows whose key the parent lacks, and rows without a key, get buckets of their own.

1. Parent keys are counted, dealt by bucket and stored as files: per bucket the sorted unique keys and their numbers of parent rows.
   That index is all that the child table meets; no payload is joined.
2. Child keys, counted per starting file, probe it: rows are dealt by bucket, each bucket's keys come before its rows in one sorted stream,
   and rows find their key by a binary search in an array of that bucket alone. From the counts follow the orphans, the rows of the
   bucket's join and how many rows of each starting file go to each bucket.
3. A starting file that has exactly a bucket's rows stays as it is. All other rows are dealt by bucket and written; child rows probe the
   index again on the way, with the rows of a bucket that is larger than others dealt over several tasks, each with the bucket's keys.
4. Starting files that were rewritten are deleted.

The counts of (starting file, bucket) are at most the product of the two numbers, whatever the input's size. What goes to the driver
are numbers of starting files, at most as many as buckets. One task writes a file whole, from Spark's sort, which spills.

Order in every file: key descending, then the other columns from left to right ascending, nulls first. The layout below a table's
folder is ``<number column>=<number>/part-*.parquet``: starting files have their own number, the others FIRST + bucket.

Cases: a null key has bucket ``buckets`` + 1 in both tables; keys may repeat in either (the join's rows are products of counts); repeated
rows stay as often; an empty table has no files; columns may have any names, also those used here; no text is looked at, so its length does
not matter; rows that tie in all columns are equal, so their order does not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpoint_dir, cut

BUCKETS, SALT, KEY, OTHER = 600, "s", "sale_id", "item_id"
LEAST_PART = 20_000  # rows of a bucket that always stay together when it is probed
REPEATED = 1 << 16
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
REPORT = "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket long, n_rows long, n_joined long, rewritten boolean"


@dataclass(frozen=True)
class Layout:
    """Where a table's files are, and the name of the column that numbers them, which is none of the table's own."""

    name: str
    folder: str
    number: str
    columns: tuple[str, ...]
    schema: T.StructType

    def read(self, spark: SparkSession) -> DataFrame:
        """The files as they are now. Folders are listed by a few tasks, not by one task each."""
        was = spark.conf.get(LISTING)
        spark.conf.set(LISTING, str(2 * spark.sparkContext.defaultParallelism))
        try:
            return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.number, T.IntegerType())])).parquet(self.folder)
        finally:
            spark.conf.set(LISTING, was)

    def write(self, df: DataFrame, key: str) -> None:
        """One file a number, sorted."""
        order = [F.col(self.number), _c(key).desc_nulls_first(), *[_c(c).asc_nulls_first() for c in self.columns if c != key]]
        sorted_ = df.repartition(F.col(self.number)).sortWithinPartitions(*order)
        sorted_.write.mode("append").partitionBy(self.number).option("maxRecordsPerFile", 0).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.folder)


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bucket(key: Column, buckets: int = BUCKETS, salt: str = SALT) -> Column:
    """Null for a null key."""
    return (F.crc32(F.concat(F.lit(salt), key.cast("string"))) % buckets).cast("int")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _layout(spark: SparkSession, df: DataFrame, name: str, root: str) -> Layout:
    number = "number"
    while number in {c.lower() for c in df.columns}:
        number += "_"
    out = Layout(name, f"{root}/{name}", number, tuple(df.columns), T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))
    fs, path = _files(spark, out.folder)
    fs.mkdirs(path)
    return out


def start(spark: SparkSession, df: DataFrame, name: str, root: str, number: Column, key: str) -> Layout:
    """Writes a table's starting files, numbered by ``number``."""
    out = _layout(spark, df, name, root)
    out.write(df.withColumn(out.number, number.cast("int")), key)
    return out


def write_index(keys: DataFrame, folder: str, buckets: int, salt: str) -> None:
    """``keys``: id, n. Files of sorted unique ids with their counts, each bucket whole in one file and in one run."""
    rows = keys.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).select(bucket(F.col("id"), buckets, salt).alias("bucket"), "id", "n")
    rows.repartition("bucket").sortWithinPartitions("bucket", "id").write.parquet(folder)


def _searched(batches):
    """Rows after the keys of their bucket and part: each gets the number of parent rows of its key."""
    at, ids, n = None, [], []
    for b in batches:
        cells = np.stack([b.column(c).to_numpy() for c in ("bucket", "part")])
        kind, own, often = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "n"))
        cut_at = np.r_[0, np.flatnonzero((np.diff(cells, axis=1) != 0).any(axis=0)) + 1, len(own)] if len(own) else [0]
        found = np.zeros(len(own), np.int64)
        for i, j in zip(cut_at[:-1], cut_at[1:], strict=True):
            if at != (cell := tuple(cells[:, i])):
                at, ids, n = cell, [], []
            k = i + int(np.searchsorted(kind[i:j], 1))  # keys up to here
            if k > i:
                ids.append(own[i:k])
                n.append(often[i:k].astype(np.int64))
            if k < j:
                if len(ids) != 1:
                    ids, n = [np.concatenate([np.zeros(0, np.int64), *ids])], [np.concatenate([np.zeros(0, np.int64), *n])]
                place = np.searchsorted(ids[0], own[k:j])
                hit = place < len(ids[0])
                hit[hit] = ids[0][place[hit]] == own[k:j][hit]
                found[k:j][hit] = n[0][place[hit]]
        rows = pa.array(kind == 1)
        yield pa.RecordBatch.from_arrays([b.column("row").filter(rows), pa.array(found).filter(rows)], ["row", "found"])


def probe(rows: DataFrame, key: str, index: DataFrame, buckets: int, salt: str, parts: DataFrame | None = None) -> DataFrame:
    """Struct ``row`` with all columns of ``rows`` that have a key, and ``found``: the parent's rows of that key, 0 for an orphan.

    ``parts``: bucket, parts; rows of a bucket are dealt over so many tasks, each with the bucket's keys. At most one row a bucket.
    """
    row = F.struct(*[_c(c) for c in rows.columns]).alias("row")
    # the place of a row in its file only deals it to a task; a file's rows come in the same order when a task runs again
    given = rows.where(_c(key).isNotNull()).select(bucket(_c(key), buckets, salt).alias("bucket"), F.monotonically_increasing_id().alias("place"), _c(key).cast("long").alias("id"), row)
    keys = index.select(F.col("bucket").cast("int").alias("bucket"), F.col("id").cast("long").alias("id"), "n")
    if parts is None:
        given, keys = given.withColumn("part", F.lit(0)), keys.withColumn("part", F.lit(0))
    else:
        few = F.broadcast(parts.select("bucket", "parts"))
        given = given.join(few, "bucket", "left").withColumn("part", (F.col("place") % F.coalesce("parts", F.lit(1))).cast("int"))
        keys = keys.join(few, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), (F.coalesce("parts", F.lit(1)) - 1).cast("int"))))
    kind = given.select("row").schema["row"].dataType
    both = given.select("bucket", "part", F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("n"), "row").union(keys.select("bucket", "part", F.lit(0).alias("kind"), "id", "n", F.lit(None).cast(kind).alias("row")))
    dealt = both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind", "id")
    return dealt.mapInArrow(_searched, T.StructType([T.StructField("row", kind), T.StructField("found", T.LongType())]))


def _hashed(batches):
    """Digest of the keys of each file, in its order: keys come by file, counted."""
    now = None
    done = []

    def end():
        done.append((now[0], now[1], digest.hexdigest(), rows))

    for b in batches:
        for number, path, key, n in zip(*(b.column(c).to_pylist() for c in ("number", "path", "id", "n")), strict=True):
            if now != (number, path):
                if now:
                    end()
                now, digest, rows, lead = (number, path), hashlib.sha256(), 0, b""
            text = b"" if key is None else str(key).encode()
            digest.update(lead + text)
            lead, left = b",", n - 1
            while left:
                take = min(left, REPEATED)
                digest.update((b"," + text) * take)
                left -= take
            rows += n
    if now:
        end()
    columns = list(zip(*done, strict=True)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], ["number", "path", "ids_sha256", "n_rows"])


def key_digests(spark: SparkSession, layout: Layout, key: str) -> DataFrame:
    """number, path, ids_sha256, n_rows of each file of a table, read from the files."""
    keys = layout.read(spark).select(F.col(layout.number).alias("number"), F.col("_metadata.file_path").alias("path"), _c(key).alias("id"))
    keys = keys.groupBy("number", "path", "id").agg(F.count("*").alias("n"))
    order = ["number", "path", F.col("id").desc_nulls_first()]
    return keys.repartition("number", "path").sortWithinPartitions(*order).mapInArrow(_hashed, "number int, path string, ids_sha256 string, n_rows long")


def rewrite(parent: DataFrame, child: DataFrame, names: tuple[str, str], key: str = KEY, other: str = OTHER, buckets: int = BUCKETS, salt: str = SALT, least_part: int = LEAST_PART) -> DataFrame:
    """Writes both tables into a new folder, rewrites them by bucket, and returns one row per final file (REPORT)."""
    spark = parent.sparkSession
    run = uuid.uuid4().hex
    root, index_at = f"{checkpoint_dir(spark)}/cobucket-{run}", f"{checkpoint_dir(spark)}/cobucket-index-{run}"  # the index is no table's file
    orphan, keyless, first = buckets, buckets + 1, buckets + 2
    own = F.coalesce(bucket(_c(key), buckets, salt), F.lit(keyless))
    up = start(spark, parent, names[0], root, F.when(own % 4 == 1, own - 1).otherwise(own), key)
    down = start(spark, child, names[1], root, F.coalesce(F.crc32(_c(other).cast("string")) % buckets, F.lit(0)), key)

    # what of each starting file goes where
    begun = [t.read(spark) for t in (up, down)]
    counted = lambda t, df: df.groupBy(F.col(t.number).alias("number"), _c(key).alias("id")).agg(F.count("*").alias("n"))
    parents = cut(counted(up, begun[0]))
    write_index(parents, index_at, buckets, salt)
    index = spark.read.schema("bucket int, id long, n long").parquet(index_at)
    children = counted(down, begun[1])
    met = probe(children, "id", index, buckets, salt).select("row.*", "found")
    met = met.select("number", "n", bucket(F.col("id"), buckets, salt).alias("home"), "found").union(children.where("id is null").select("number", "n", F.lit(keyless), F.lit(None).cast("long")))
    to = F.when(F.col("found") == 0, orphan).otherwise(F.col("home"))
    cells = parents.select(F.lit(0).alias("side"), "number", F.coalesce(bucket(F.col("id"), buckets, salt), F.lit(keyless)).alias("home"), "n", F.lit(0).cast("long").alias("joined"))
    cells = cells.withColumn("to", F.col("home")).union(met.select(F.lit(1), "number", "home", "n", F.coalesce(F.col("n") * F.col("found"), F.lit(0)), to))
    cells = cut(cells.groupBy("side", "number", "home", "to").agg(F.sum("n").alias("n"), F.sum("joined").alias("joined")))
    moves = cells.groupBy("side", "number", "to").agg(F.sum("n").alias("n"), F.sum("joined").alias("joined"))
    alone = lambda c: F.count("*").over(Window.partitionBy("side", c)) == 1
    moves = cut(moves.withColumn("stays", alone("number") & alone("to")))

    # what must move
    kept = {0: set(), 1: set()}
    for r in moves.where("stays").select("side", "number").collect():  # at most one a bucket
        kept[r["side"]].add(r["number"])
    moving = lambda t, side: begun[side].where(~F.col(t.number).isin(sorted(kept[side])) if kept[side] else F.lit(True)).select(*[_c(c) for c in t.columns])
    up.write(moving(up, 0).withColumn(up.number, first + own), key)
    size = F.sum("n")
    parts = cells.where("side = 1").groupBy(F.col("home").alias("bucket")).agg(size.alias("n"))
    usual = F.greatest(F.lit(least_part), 2 * F.sum("n").over(Window.partitionBy(F.lit(0))) / buckets)  # one row a bucket
    parts = parts.select("bucket", F.ceil(F.col("n") / usual).cast("int").alias("parts"))
    rows = moving(down, 1)
    found = probe(rows, key, index, buckets, salt, parts)
    home = bucket(F.col("row").getField(key), buckets, salt)
    found = found.select("row.*", F.when(F.col("found") == 0, first + orphan).otherwise(first + home).alias(down.number))
    down.write(found.union(rows.where(_c(key).isNull()).withColumn(down.number, F.lit(first + keyless))), key)
    for side, t in enumerate((up, down)):
        gone = {r["number"] for r in moves.where(F.col("side") == side).select("number").distinct().collect()} - kept[side]  # numbers of files
        for number in gone:
            fs, path = _files(spark, f"{t.folder}/{t.number}={number}")
            fs.delete(path, True)

    # one row a final file
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("number", "n"))), lambda x: F.concat(x["number"].cast("string"), F.lit(":"), x["n"].cast("string"))))
    finals = moves.groupBy("side", "to").agg(F.sha2(text, 256).alias("lineage_sha256"), F.first(F.when(F.col("stays"), F.col("number")), ignorenulls=True).alias("stayed"))
    joined = moves.where("side = 1").groupBy("to").agg(F.sum("joined").alias("n_joined"))
    finals = finals.join(joined, "to", "left").withColumn("number", F.coalesce("stayed", F.col("to") + first))
    out = []
    for side, t in enumerate((up, down)):
        about = finals.where(F.col("side") == side).drop("side")
        out.append(key_digests(spark, t, key).join(about, "number").select(
            F.lit(t.name).alias("table_name"), "path", F.lit(",".join(t.columns)).alias("columns"), "ids_sha256", "lineage_sha256", F.col("to").cast("long").alias("bucket"),
            "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), F.col("stayed").isNull().alias("rewritten"),
        ))
    return out[0].union(out[1])
