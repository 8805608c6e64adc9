"""Passes over the texts: what several steps of a query use is made once."""

import pytest
from pyspark.sql import functions as F

from tierscope import fixtures, queries
from tierscope.operators import calibration, gate, trees
from tierscope.plans import annotations, report
from tierscope.sources import artifacts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sampled_signals", "declared_pages", "annotation_pack"])
def test_signals_are_made_once(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(fixtures, "signals", lambda *a, f=fixtures.signals: made.append(1) or f(*a))
    assert queries.QUERIES[name](spark, SF).count() > 0 and len(made) == 1


def test_candidates_of_routing_are_written_once(spark):
    files = queries.QUERIES["routing_choice"](spark, SF).inputFiles()
    assert files and all("/routing-candidates-" in f for f in files)


def test_candidates_of_the_gate_are_written_once(spark):
    examples = spark.createDataFrame([(0.99, 0.8, None, 1.0, 0.9, True, False)], ", ".join(f"{c} double" for c in gate.COMPONENTS) + ", reading_accepted boolean, structurally_accepted boolean")
    chosen, candidates = calibration.select_gate(examples)
    files = candidates.inputFiles()
    assert files and all("/gate-candidates-" in f for f in files)
    assert candidates.count() == 81 and chosen == {c: candidates.first()[f"t_{c}"] for c in gate.COMPONENTS}


def test_only_images_of_the_pack_go_on(spark):
    declared = spark.createDataFrame([(1, "evaluation", "s", [1, 2])], "case_id long, partition string, stratum string, pages array<int>")
    images = spark.range(1, 2001).select((F.col("id") % 1000).alias("case_id"), F.ceil(F.col("id") / 1000).cast("int").alias("page"), F.col("id").cast("string").cast("binary").alias("content"))
    pack = annotations.prepare_pack(declared, images)
    assert [(r["page"], r["image_file"]) for r in pack.orderBy("page").collect()] == [(1, "t3-page-images/1-P0001.png"), (2, "t3-page-images/1-P0002.png")]
    assert all("/pack-" in f for f in pack.inputFiles())


def test_inputs_of_the_report_are_written_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(report, "written", lambda df, name, f=report.written: names.append(name) or f(df, name))
    assert queries.QUERIES["value_report"](spark, "/root/testdata/sf0.01").count() > 0
    assert len(names) == len(set(names)) and {"report-gate", "report-policies", "report-corpus", "report-page-timing"} <= set(names)


def test_trees_are_read_once(spark, tmp_path, monkeypatch):
    """Later steps read nodes, not trees; the last round of the walk, in which nodes lead nowhere, writes no second table."""
    tree = '{"body":{"children":[{"$ref":"g"}]},"groups":[{"self_ref":"g","children":[{"$ref":"t"},{"$ref":"g"}]}],"texts":[{"self_ref":"t","text":"x"}]}'
    spark.createDataFrame([(1, tree), (2, "[]"), (None, "{broken")], "case_id long, tree string").write.parquet(f"{tmp_path}/trees")
    names = []
    monkeypatch.setattr(trees, "written", lambda df, name, f=trees.written: names.append(name) or f(df, name))
    views = trees.structural_views(spark.read.parquet(f"{tmp_path}/trees"))
    assert {f.split("/")[-2].rsplit("-", 1)[0] for f in views.inputFiles()} <= {"tree-nodes", "walk"} and names.count("walk") == 2
    assert sorted((r["case_id"] or 0, r["view"], r["has_structure"]) for r in views.collect()) == [(0, None, False), (1, "[text] x", True), (2, None, False)]


def test_a_bucket_is_written_by_one_task(spark, tmp_path):
    """What is put is evaluated once, and a put writes a file a bucket, however many tasks its rows come from."""
    seen = spark.sparkContext.accumulator(0)
    payload = F.udf(lambda i: seen.add(1) or f'{{"x":{i}}}', "string")
    store, key = artifacts.ArtifactStore(spark, str(tmp_path / "cas")), F.concat(F.element_at(F.array(*map(F.lit, ("ab", "cd", "ef"))), (F.col("id") % 3 + 1).cast("int")), F.col("id").cast("string"))
    rows = spark.range(0, 600, 1, 6).select(key.alias("cache_key"), F.lit("c").alias("case_id"), payload("id").alias("payload"))
    files = lambda: len(list((tmp_path / "cas").glob("bucket=*/*.parquet")))
    assert (store.put(rows.where("id < 450").union(rows.where("id < 30"))), files(), seen.value) == (450, 3, 480)
    assert (store.put(rows), files(), seen.value) == (150, 6, 1080)
    found = store.get(rows.select("cache_key", "case_id"))
    assert found.where("hit").count() == found.join(rows, ["cache_key", "payload"]).count() == 600
