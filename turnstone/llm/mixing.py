"""Mix sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Documents are put
in a fixed order within their source; the prefix sum of the expected copies plus one random offset of the
source crosses an integer boundary once for each copy that is taken.

Order within a source: size, bucket of doc_id, doc_id. The rank comes from counts of (source, size) and
(source, size, bucket) plus a row number inside one bucket, so that no task ever sees a whole source.
Sorting by size keeps the words taken near the target.

Cases: null text has size 0; null source is a source of its own, ordered last; null doc_id and repeated rows
are rows like any other; a source without words has target 0 and takes nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut

WEIGHTS, CAP, ROWS_A_BUCKET, LEAST_BUCKETS, SEED = (1, 2, 3), 3, 200_000, 16, "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its size, target and expected copies. Only source totals enter the windows here.

    Reshared excess ends at target = min(cap * size, share * weight) with one share for all; sources are
    capped in order of cap * size / weight, so the share follows from running sums in that order.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    by = by.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("share", share)
    by = by.withColumn("share", F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share"))).over(every))
    by = by.withColumn("target", F.least("most", F.col("share") * F.col("weight")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return by.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Columns doc_id, source, size, source_size, target, copies of every row of ``docs``."""
    sized = cut(sizes(docs).select("doc_id", "source", "size"))
    buckets = F.greatest(F.lit(LEAST_BUCKETS), F.lit(sized.count() // ROWS_A_BUCKET + 1))
    sized = sized.withColumn("bucket", F.coalesce(F.abs((F.col("doc_id") % 1000003) * 7919) % buckets, F.lit(0)).cast("int"))
    t = targets(sized, weights, cap)
    cells = sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("in_size", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    by_size = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("smaller", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    c, z = cells.alias("c"), by_size.alias("z")
    cells = c.join(z, F.col("c.source").eqNullSafe(F.col("z.source")) & (F.col("c.size") == F.col("z.size"))).select("c.source", "c.size", "c.bucket", (F.col("in_size") + F.col("smaller")).alias("before"))
    row = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id")) - 1
    d, c, t = sized.withColumn("row", row).alias("d"), cells.alias("c"), t.alias("t")
    ranked = d.join(c, F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d.bucket") == F.col("c.bucket")))
    rank = (F.col("c.before") + F.col("d.row")).cast("double")
    # one row per source: a table of distinct source names, far below any broadcast bound; Spark decides by its size
    ranked = ranked.join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
    copies = F.floor(F.col("t.rate") * (rank + 1) + F.col("t.offset")) - F.floor(F.col("t.rate") * rank + F.col("t.offset"))
    return ranked.select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", copies.cast("long").alias("copies"))


ORACLE_SQL = f"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents),
b as (select *, coalesce(abs((doc_id % 1000003) * 7919) % greatest({LEAST_BUCKETS}, (select count(*) from sized) // {ROWS_A_BUCKET} + 1), 0) as bucket from sized),
s as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, 1.0::double + (row_number() over (order by source nulls last) - 1) % 3 as weight from s),
r as (select *, {CAP} * source_size::double as most, {CAP} * source_size::double / weight as ratio from w),
q as (select *, (sum(source_size::double) over () - coalesce(sum(most) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) as share from r),
t as (select source, source_size, least(most, (select max(share) from q where share <= ratio) * weight) as target,
  ('0x' || substr(md5('{SEED}' || coalesce('=' || source, '-')), 1, 8))::bigint / 4294967296.0::double as off from q),
k as (select *, (row_number() over (partition by source order by size, bucket, doc_id) - 1)::double as rank from b)
select k.doc_id, k.size::bigint as size, t.source_size, t.target,
  (k.size * (floor(rate * (rank + 1) + off) - floor(rate * rank + off)))::bigint as taken
from k join (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from t) t on k.source is not distinct from t.source
"""
