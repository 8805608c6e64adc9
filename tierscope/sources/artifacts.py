"""Content-addressed artifacts as a table partitioned by the first two characters of their key.

A writer claims the ranges of its keys before it looks whether they are taken: a claim is a file that only one can
create. Writers of other ranges go on beside it, those of the same wait. So of two writers of one key the second
one sees the first one's row: the same payload adds nothing, another one is a conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.work import written
from .claims import Claims


class CorruptArtifact(ValueError):
    """A stored payload whose hash isn't the recorded one."""


class ConflictingArtifact(ValueError):
    """A key that would get a second, different payload."""


class ArtifactStore:
    """Rows of cache_key, case_id, payload (canonical JSON). A key is written once."""

    def __init__(self, spark: SparkSession, path: str, wait_s: float = 600.0):
        self.spark, self.path = spark, path
        self.claims = Claims(spark, path.rstrip("/") + "/_claims", wait_s)

    def _table(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], "cache_key string, case_id string, payload string, payload_hash string, bucket string")
        return self.spark.read.schema("cache_key string, case_id string, payload string, payload_hash string, bucket string").parquet(self.path)

    def get(self, keys: DataFrame) -> DataFrame:
        """(cache_key, case_id, payload, hit) for wanted (cache_key, case_id): the payload under the wanted case's
        id, null on a miss. The bucket is part of the join, so only wanted partitions are read."""
        wanted = keys.select("cache_key", "case_id", F.substring("cache_key", 1, 2).alias("bucket"))
        held = self._table().select("cache_key", "bucket", "payload", "payload_hash")
        out = wanted.join(held, ["cache_key", "bucket"], "left")
        bad = F.col("payload").isNotNull() & (F.sha2("payload", 256) != F.col("payload_hash"))
        payload = F.when(bad, F.raise_error(F.concat(F.lit("corrupt artifact "), "cache_key")).cast("string")).otherwise(F.col("payload"))
        return out.select("cache_key", "case_id", payload.alias("payload"), F.col("payload_hash").isNotNull().alias("hit"))

    def put(self, artifacts: DataFrame) -> int:
        """Append the keys that aren't there; the same payload again is fine, another one raises. Returns the
        number written. What is put is evaluated once, and a bucket's rows are gathered before they are written: a
        task that has some of every bucket would write a file for each."""
        rows = artifacts.select("cache_key", "case_id", "payload", F.sha2("payload", 256).alias("payload_hash"))
        one = rows.groupBy("cache_key").agg(F.max(F.struct("payload_hash", "case_id", "payload")).alias("row"), F.min("payload_hash").alias("least"))
        rows = written(one.select("cache_key", "row.case_id", "row.payload", "row.payload_hash", F.substring("cache_key", 1, 2).alias("bucket"), "least"), "artifact-rows")
        if not rows.where("least <> payload_hash").isEmpty():
            raise ConflictingArtifact("a key comes with two payloads")
        # At most as many as two characters tell apart.
        buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        with self.claims.held(buckets):
            held = self._table().where(F.col("bucket").isin(buckets)).select("cache_key", "bucket", F.col("payload_hash").alias("there"))
            # Settled before the append changes the table that the new rows are compared with.
            taken = written(rows.select("cache_key", "bucket", "payload_hash").join(held, ["cache_key", "bucket"]), "artifact-taken")
            if not taken.where("there <> payload_hash").isEmpty():
                raise ConflictingArtifact("a key holds another payload already")
            n = rows.count() - taken.select("cache_key").distinct().count()
            if n:
                new = rows.drop("least").join(taken, "cache_key", "left_anti")
                new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
            return n

    def verify(self) -> DataFrame:
        """Keys whose payload doesn't have its hash."""
        return self._table().where(F.sha2("payload", 256) != F.col("payload_hash")).select("cache_key")
