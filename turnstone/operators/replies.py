"""Model replies that are paid once: a store of Parquet files keyed by what was asked.

A request's key is a hash of stage, model, reply cap, sample number, system text and prompt; whose document it came from does not
matter, so equal requests share a reply. A call first looks up which keys the store lacks (an anti-join on keys), asks the model for
one request of each, in tasks of few requests, and appends the replies; then all requests are joined with the store.

Each task's replies are in the store when the task ends, not when the job ends (version 2 of Hadoop's output committer, whose known
flaw, that a failed job leaves its finished tasks' files behind, is the point here). A run that is killed loses at most what its
running tasks had not finished, and the next run asks for that only.

Two runs at a time may pay for the same key; then one of the replies, the same for every reader, counts. A refusal is a reply as well:
it is kept, unless ``retry`` asks for refused requests again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.plans.schemas import REPLIES, REPLY_CAPS, USAGE_COUNTERS

from . import model
from .scratch import checkpointed

KEY = "request"
_OWN = ("doc_id", "claim_no", "sample_no")  # what a request adds to a reply
STORED = T.StructType([T.StructField(KEY, T.StringType()), *(f for f in REPLIES.fields if f.name not in _OWN), T.StructField("first_doc", T.LongType())])


def request_key(stage: str, name: str, cap: int) -> Column:
    asked = F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("model"), F.lit(cap).alias("cap"), "sample_no", "system", "prompt")
    return F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class ReplyStore:
    """Replies in ``folder``, in any store that Spark writes to; ``rows_a_task`` bounds what a killed task loses."""

    spark: SparkSession
    folder: str
    rows_a_task: int = 16
    retry: bool = False

    def files(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        return self.spark.read.schema(STORED).parquet(self.folder)

    def read(self) -> DataFrame:
        """One row per key; a reply goes before a refusal, and of several replies the least counts."""
        rest = [c for c in STORED.fieldNames() if c != KEY]
        one = F.min(F.struct(F.col("body").isNull().alias("_refused"), *rest)).alias("one")
        return self.files().groupBy(KEY).agg(one).select(KEY, *[F.col(f"one.{c}").alias(c) for c in rest])

    def usage(self) -> DataFrame:
        """USAGE rows of all replies that were paid for, each once; doc_id is that of the request that was sent."""
        return self.files().select(F.col("first_doc").alias("doc_id"), "stage", "model", *USAGE_COUNTERS)

    def call(self, requests: DataFrame, ask: model.Model, stage: str, name: str, max_tokens: int | None = None) -> DataFrame:
        """Reply rows (REPLIES), one for each of ``requests``; the model is asked for what the store lacks only."""
        cap = max_tokens or REPLY_CAPS[stage]
        keyed = requests.select(F.col("doc_id").cast("long"), F.col("claim_no").cast("int"), F.col("sample_no").cast("int"), "system", "prompt").withColumn(KEY, request_key(stage, name, cap))
        known = self.files().where("body is not null" if self.retry else "true").select(KEY)
        one = F.min(F.struct("doc_id", "claim_no", "sample_no", "system", "prompt")).alias("one")
        lacking = keyed.join(known, KEY, "left_anti").groupBy(KEY).agg(one).select(KEY, "one.*")
        n = lacking.count()
        if n:
            new = model.call(lacking.repartition(-(-n // self.rows_a_task), KEY), ask, stage, name, max_tokens, carry=(KEY,))
            new = new.withColumn("first_doc", F.col("doc_id")).select(*STORED.fieldNames())
            new.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.folder)
        # cut off: a check of replies that fails the query must not be moved to where it sees other requests' replies
        return checkpointed(keyed.select(*_OWN, KEY).join(self.read(), KEY).select(*REPLIES.fieldNames()))
