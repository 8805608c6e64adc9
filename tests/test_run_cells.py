"""The run_cells data source: pruned reads, writes that are all or nothing, and a stream of the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from tierscope.sources import files, run_cells


def cells(spark, n=40, first=0):
    i = F.col("id")
    return spark.range(first, first + n).select(
        F.when(i % 3 == 0, "calibration").otherwise("evaluation").alias("partition"), F.format_string("F%03d-x", i).alias("case_id"), F.when(i % 2 == 0, i.cast("int")).alias("page"), F.concat(F.lit("T"), (i % 4).cast("string")).alias("tier"), F.lit("succeeded").alias("status"),
        F.lit("2026-08-05 03:00:00").cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), (i * 1.5).alias("wall_ms"), F.lit(None).cast("double").alias("observed_minimum_wall_ms"), F.lit("é").alias("artifact_key"), (i % 5 == 0).alias("cache_hit"), F.lit("p").alias("provider_id"), F.lit(None).cast("string").alias("error_code"))


@pytest.fixture
def folder(spark, tmp_path):
    run_cells.register(spark)
    cells(spark).repartition(4).write.format("run_cells").mode("append").save(str(tmp_path))
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


def test_written_cells_are_read_again(spark, folder):
    assert len([n for n in os.listdir(folder) if n.endswith(".json")]) == 40 and not [n for n in os.listdir(folder) if n.startswith("_staged")]
    got = spark.read.format("run_cells").option("filesPerPartition", 7).load(folder)
    assert got.rdd.getNumPartitions() == 6 and rows(got) == rows(cells(spark))
    # The reader of any store sees the same cells.
    other = files.read_cells(spark, folder + "/*.json").select(*got.columns)
    assert rows(other) == rows(got)


def test_other_tiers_are_not_opened(spark, folder):
    got = spark.read.format("run_cells").load(folder)
    for name in os.listdir(folder):
        if name.endswith(".json") and not (name.startswith("evaluation") and "-T3" in name):
            with open(os.path.join(folder, name), "w") as f:
                f.write("{broken")
    want = cells(spark).where("tier = 'T3' AND partition = 'evaluation'")
    assert rows(got.where("tier = 'T3' AND partition = 'evaluation' AND wall_ms > 10")) == rows(want.where("wall_ms > 10"))
    assert rows(got.where(F.col("tier").isin("T3", "T9") & F.col("partition").isin("evaluation"))) == rows(want)
    with pytest.raises(Exception):
        got.where("tier = 'T2'").collect()


def test_no_name_is_written_twice(spark, folder):
    before = rows(spark.read.format("run_cells").load(folder))
    again = cells(spark, 10, 35).repartition(3)
    with pytest.raises(Exception):
        again.write.format("run_cells").mode("append").save(folder)
    assert rows(spark.read.format("run_cells").load(folder)) == before, "nothing of a write that fails stays"
    with pytest.raises(Exception):
        cells(spark, 2, 50).union(cells(spark, 1, 50)).repartition(3).write.format("run_cells").mode("append").save(folder)
    with pytest.raises(Exception):
        cells(spark, 1, 60).withColumn("tier", F.lit("T7")).write.format("run_cells").mode("append").save(folder)
    with pytest.raises(Exception):
        cells(spark, 1, 60).write.format("run_cells").mode("overwrite").save(folder)
    assert rows(spark.read.format("run_cells").load(folder)) == before
    with open(os.path.join(folder, "stray.json"), "w") as f:
        f.write("{}")
    with pytest.raises(Exception, match="not a run cell"):
        spark.read.format("run_cells").load(folder).collect()


def test_stream_has_the_rows_of_batches(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")

    def run():
        query = spark.readStream.format("run_cells").load(folder).writeStream.format("parquet").option("checkpointLocation", str(at / "checkpoint")).option("path", str(at / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    cells(spark, 9, 100).write.format("run_cells").mode("append").save(folder)
    cells(spark, 5, 200).write.format("run_cells").mode("append").save(folder)
    run()
    assert rows(spark.read.parquet(str(at / "out"))) == rows(spark.read.format("run_cells").load(folder))
    assert spark.read.parquet(str(at / "out")).count() == 54
