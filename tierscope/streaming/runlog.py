"""The run log as a stream: new cell rows, each (case, tier, page) once, counted by status."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.timing import status_counts
from ..operators.work import shared_folder

KEYS = ("case_id", "tier", "page")


def once(cells: DataFrame, keys: tuple[str, ...] = KEYS, time: str = "started_at", delay: str = "1 day") -> DataFrame:
    """A stream of cells without those that come again within the delay, so that state stays bounded."""
    return cells.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def cell_stream(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = KEYS, time: str = "started_at", delay: str = "1 day") -> DataFrame:
    """Cells of a growing folder of JSON lines, each once."""
    return once(spark.readStream.schema(schema).json(path), keys, time, delay)


def status_stream(cells: DataFrame, by: tuple[str, ...] = ("tier",)) -> DataFrame:
    return status_counts(cells, list(by))


def settled(counts: DataFrame, timeout_s: int = 3600) -> DataFrame:
    """The rows of a stream of aggregates once it has read all that is there now. Each batch writes a table of its own, named by
    its number, so a batch that runs again after a failure writes the same one; the last is the answer."""
    spark = counts.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{n}")
        last.append(n)

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError("the stream hasn't read all that was there")
    rows = spark.read.schema(counts.schema)
    return rows.parquet(f"{folder}/batch-{max(last)}") if last else spark.createDataFrame([], counts.schema)
