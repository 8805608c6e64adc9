"""The value report and the annotation pack: what they refuse, and figures by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tierscope.operators import export
from tierscope.operators.gate import COMPONENTS
from tierscope.plans import annotations, report


def parts(spark):
    one = lambda **v: spark.createDataFrame([tuple(v.values())], list(v))
    policies = spark.createDataFrame([("gated", 4, 3, 1, 1, 0, 1, 2, 10, 9, 3, 2, 1, 0), ("allT0", 4, 4, 4, 0, 0, 0, 4, 10, 10, 5, 0, 6, 0)], "policy string, documents long, selected_documents long, selected_t0 long, selected_t1 long, selected_t2 long, selected_t3 long, observed_documents long, pages long, covered_pages long, reading_false_accepts long, reading_false_escalations long, structural_false_accepts long, structural_false_escalations long")
    return {
        "corpus": one(attachments=9, included=5, excluded=3, unreadable=1, pages=100), "coverage": one(documents=5, high=2, low=1, middle=2), "sample": spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "stratum string, calibration long, evaluation long"),
        "gate": one(**dict.fromkeys(COMPONENTS, 0.5), denominator=8, reading_false_accepts=1, reading_false_rejects=2, structural_false_accepts=0, structural_false_rejects=3), "policies": policies,
        "baseline": one(reading_false_accepts=1, reading_false_escalations=2, structural_false_accepts=3, structural_false_escalations=4, pages=10), "timing": spark.createDataFrame([(t, "overall", 100.0, 4, 5, 0.25) for t in ("T0", "T1", "T2", "T3")], "tier string, group string, wall_ms double, succeeded long, documents long, cost_proxy_usd double"),
        "page_timing": spark.createDataFrame([("evaluation", 7200.0, 2, 1), ("calibration", 1.0, 1, 0)], "partition string, total_ms double, numerator long, excluded_count long"), "degradation": spark.createDataFrame([("calibration", 4, 1), ("evaluation", 8, 2)], "partition string, pages long, degraded_pages long"),
        "density": spark.createDataFrame([(3, 4), (1, 4)], "numerator long, denominator long"), "probes": spark.createDataFrame([(f"T{i}", f"p{i}", "1.0", "available") for i in range(4)], "tier string, provider_id string, version string, status string"),
        "unavailable": spark.createDataFrame([("cost.energy", "not measured")], "key string, reason string"),
    }


def test_figures_of_a_report(spark):
    values = report.value_report(**parts(spark))
    got = {r["key"]: r for r in values.collect()}
    figure = lambda key: tuple(got[key][c] for c in ("value_num", "numerator", "denominator", "excluded_count"))
    assert figure("policy.gated.reading.false_accepts") == (3 / 9, 3.0, 9.0, 1.0) and figure("policy.gated.tier.T3.documents") == (1 / 3, 1.0, 3.0, 1.0)
    assert figure("policy.gated.observed_timing_coverage") == (0.5, 2.0, 4.0, 0.0) and figure("timing.T1.mean_wall_ms_per_document") == (25.0, 100.0, 4.0, 1.0)
    assert figure("timing.T3.projected_corpus_hours") == (3600.0 * 100 / 3_600_000, 0.1, 100.0, 1.0) and got["timing.T3.projected_corpus_hours"]["label"] == "projected"
    assert figure("oracle.all.higher_tier_degradation") == (0.25, 3.0, 12.0, 0.0) and figure("T2.thai_short_run_density") == (0.5, 4.0, 8.0, 0.0)
    assert figure("gate.threshold.text_retention") == (0.5, 0.5, 8.0, 0.0) and figure("sample.evaluation_documents") == (4.0, 4.0, 6.0, 0.0)
    assert got["provider.T2.identity"]["value_str"] == "p2 1.0" and got["cost.energy"]["value_num"] is None
    assert "timing.T3.mean_wall_ms_per_document" not in got and "| projected |" in export.markdown(values, "R")


def test_refused_reports(spark):
    p = parts(spark)
    for name, bad in (("coverage", p["coverage"].withColumn("middle", F.lit(3))), ("probes", p["probes"].where("tier <> 'T2'")), ("probes", p["probes"].withColumn("status", F.when(F.col("tier") == "T1", "unavailable").otherwise("available"))), ("policies", p["policies"].withColumn("pages", F.when(F.col("policy") == "gated", 11).otherwise(10))), ("unavailable", p["unavailable"].withColumn("key", F.lit("corpus.pages")))):
        with pytest.raises(report.ReportRefused):
            report.value_report(**(p | {name: bad}))


def test_annotation_pack(spark):
    declared = spark.createDataFrame([("evaluation", "F2", "s", [2, 3]), ("calibration", "F1", "s", [1])], "partition string, case_id string, stratum string, pages array<int>")
    images = spark.createDataFrame([("F2", p, bytearray(b"image%d" % p)) for p in (1, 2, 3)], "case_id string, page int, content binary")
    there = spark.createDataFrame([("F2", 3, "complete")], "case_id string, page int, annotation_status string")
    rows = {r["page"]: r for r in annotations.prepare_pack(declared, images, there, expected_pages=2).collect()}
    assert set(rows) == {2, 3} and rows[2]["image_sha256"] == hashlib.sha256(b"image2").hexdigest() and rows[2]["annotation_file"] == "F2/P0002.private.json" and rows[2]["image_file"] == "t3-page-images/F2-P0002.png"
    assert [(rows[p]["annotation_status"], rows[p]["created"]) for p in (2, 3)] == [("pending", True), ("complete", False)]
    assert annotations.prepare_pack(declared, images).where("created").count() == 2
    for bad in ((declared, images, there, 3), (declared, images.where("page <> 2")), (declared, images.union(images.limit(1))), (declared, images, there.withColumn("page", F.lit(9)))):
        with pytest.raises(annotations.PackRefused):
            annotations.prepare_pack(*bad)
