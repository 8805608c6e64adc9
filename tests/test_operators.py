"""Operators against hand-checked examples."""

import pytest
from pyspark.sql import functions as F

from tierscope.operators import calibration, corpus, export, gate, metrics, oracle, policies, sampling, signals, timing


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def evidence(spark, *pages):
    return spark.createDataFrame([("c", i + 1, t, a) for i, (t, a) in enumerate(pages)], "case_id string, page int, text string, image_area_ratio double")


def test_signals_are_inclusive_and_null_safe(spark):
    s = signals.document_signals(signals.inspect_pages(evidence(spark, ("a" * 31, 0.79), ("b" * 32, 0.8)))).first()
    assert (s["text_layer_coverage"], s["full_page_image_ratio"]) == (0.5, 0.5) and s["mean_image_area_ratio"] == pytest.approx(0.795)
    s = signals.document_signals(signals.inspect_pages(evidence(spark, ("", None), ("", 0.8)))).first()
    assert s["mean_image_area_ratio"] is None and s["chars_per_page_cv"] == 0 and s["thai_char_ratio"] == 0


def signal_row(spark, **changes):
    base = dict(text_layer_coverage=1.0, chars_per_page_cv=0.1, mean_image_area_ratio=0.0, full_page_image_ratio=0.0, encoding_anomaly_ratio=0.0, thai_char_ratio=0.0, latin_char_ratio=1.0, mixed_script=False) | changes
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'boolean' if k == 'mixed_script' else 'double'}" for k in base))


@pytest.mark.parametrize("changes,stratum,tier,confidence", [
    ({}, "born-digital-en", "T0", 1.0),
    ({"chars_per_page_cv": 0.75}, "layout-heavy-born-digital", "T1", 1.0),
    ({"text_layer_coverage": 0.49, "mixed_script": True}, "scanned-degraded-thai-mixed", "T2", 1.0),
    ({"encoding_anomaly_ratio": 0.02}, "scanned-degraded-en", "T2", 1.0),
    ({"full_page_image_ratio": None, "mean_image_area_ratio": None}, "born-digital-en", "T0", 0.5),
])
def test_strata_and_routes(spark, changes, stratum, tier, confidence):
    r = signals.initial_route(signal_row(spark, **changes)).select(signals.stratum().alias("s"), "route.*").first()
    assert (r["s"], r["tier"], r["confidence"]) == (stratum, tier, confidence)
    assert ("MISSING_REQUIRED_SIGNAL" in r["rationale"]) == (confidence < 1)


def test_sampled_signals_use_scripts_as_denominator(spark):
    pages = signals.inspect_pages(evidence(spark, ("กab1Ж", 0.0), ("zzz", 0.0)))
    r = signals.sampled_signals(pages, spark.createDataFrame([("c", 1)], "case_id string, page int")).first()
    assert r["thai_char_ratio"] == pytest.approx(1 / 3) and r["page_count"] == 1


def test_gate(spark):
    schema = "artifact_key string, text string, pages array<string>, has_structure boolean, total_text_chars long, page_count long, thai_char_ratio double, latin_char_ratio double, expects_structure boolean"
    df = spark.createDataFrame([("a", "x" * 3 + "y" * 227, ["p" * 32, "q"], False, 2623, 2, 0.0, 1.0, True), ("b", "text", None, True, 0, 0, 0.0, 0.0, False)], schema)
    a, b = gate.decide(gate.with_components(df)).orderBy("artifact_key").collect()
    assert a["text_retention"] == pytest.approx(230 / 2623) and a["usable_page_ratio"] == 0.5 and a["structural_yield"] == 0
    assert a["reasons"] == ["CHARACTER_SANITY_FAILED", "TEXT_RETENTION_FAILED", "USABLE_PAGE_RATIO_FAILED", "STRUCTURAL_YIELD_FAILED"]
    assert [b[c] for c in gate.COMPONENTS] == [1.0, None, None, None, None] and b["passed"]
    assert rows(gate.audit_sanity(df), "artifact_key", "below") == [("a", True), ("b", False)]


TEXT, SHAPE = ["TEXT_RETENTION_FAILED"], ["STRUCTURAL_YIELD_FAILED"]


@pytest.mark.parametrize("start,results,cap,status,path,last", [
    ("T0", {"T0": TEXT, "T2": TEXT, "T3": []}, 2, "accepted", ["T0", "T2", "T3"], []),
    ("T0", {"T0": SHAPE, "T1": TEXT, "T2": TEXT}, 2, "low-confidence", ["T0", "T1", "T2"], ["TEXT_RETENTION_FAILED", "MAX_ESCALATIONS_REACHED"]),
    ("T0", {"T0": SHAPE, "T1": SHAPE, "T3": []}, 2, "accepted", ["T0", "T1", "T3"], []),
    ("T1", {"T1": TEXT, "T2": SHAPE, "T3": SHAPE}, 2, "low-confidence", ["T1", "T2", "T3"], ["STRUCTURAL_YIELD_FAILED", "TERMINAL_TIER_FAILED"]),
    ("T1", {"T1": SHAPE, "T3": []}, 2, "accepted", ["T1", "T3"], []),
    ("T2", {"T2": TEXT}, 2, "unavailable", ["T2"], TEXT),
    ("T0", {}, 2, "unavailable", [], None),
    ("T0", {"T0": SHAPE, "T1": TEXT, "T2": TEXT, "T3": []}, 3, "accepted", ["T0", "T1", "T2", "T3"], []),
    ("T0", {"T0": TEXT}, 0, "low-confidence", ["T0"], ["TEXT_RETENTION_FAILED", "MAX_ESCALATIONS_REACHED"]),
])
def test_replay(spark, start, results, cap, status, path, last):
    initial = spark.createDataFrame([("c", start)], "case_id string, initial_tier string")
    found = spark.createDataFrame([("c", t, f"k{t}", not r, r) for t, r in results.items()], "case_id string, tier string, artifact_key string, passed boolean, reasons array<string>")
    r = gate.replay(initial, found, cap).first()
    assert r["status"] == status and [s["tier"] for s in r["steps"]] == path
    assert (r["steps"][-1]["reasons"] if r["steps"] else None) == last
    assert r["selected_key"] == (None if status == "unavailable" else f"k{path[-1]}") and r["final_tier"] == (None if status == "unavailable" else path[-1])


def test_calibration(spark):
    assert calibration.grid(spark, calibration.GATE_GRID).count() == 81 and calibration.grid(spark, calibration.ROUTING_GRID).count() == 27
    schema = ", ".join(f"{c} double" for c in gate.COMPONENTS) + ", reading_accepted boolean, structurally_accepted boolean"
    examples = spark.createDataFrame([(0.92, None, None, None, None, False, False), (0.99, None, None, None, None, True, True), (0.99, None, None, None, None, True, True)], schema)
    axes = {"character_sanity": (0.9, 0.95), "text_retention": (0.5,), "usable_page_ratio": (0.5,), "structural_yield": (1.0,), "script_consistency": (0.8,)}
    best, candidates = calibration.select_gate(examples, axes)
    assert best["character_sanity"] == 0.95 and candidates.count() == 2
    sample = spark.createDataFrame([("a", "born-digital-en", "calibration"), ("b", "scanned-degraded-en", "calibration"), ("e", "born-digital-en", "evaluation")], "case_id string, stratum string, partition string")
    good = signal_row(spark).withColumn("case_id", F.lit("a")).unionByName(signal_row(spark, text_layer_coverage=0.6).withColumn("case_id", F.lit("b")))
    best, candidates = calibration.tune_routing(sample, good)
    assert best == {"coverage": 0.75, "full_page_image": 0.25, "anomaly": 0.01} and candidates.first()["correct"] == 2
    with pytest.raises(ValueError):
        calibration.tune_routing(sample.unionByName(sample.where("case_id = 'a'").withColumn("partition", F.lit("evaluation"))), good)
    with pytest.raises(ValueError):
        calibration.tune_routing(sample, good.where("case_id = 'a'"))
    with pytest.raises(ValueError):
        calibration.tune_routing(sample, good, evaluation_cells=sample)
    j = spark.createDataFrame([("a", ["T0", "T1"]), ("a", ["T1"])], "case_id string, usable_tiers array<string>")
    assert rows(calibration.accepted_by_all_pages(j, "usable_tiers"), "tier", "accepted") == [("T0", False), ("T1", True), ("T2", False), ("T3", False)]


JUDGEMENT = "script string, annotator string, usable_tiers array<string>, structurally_adequate_tiers array<string>, structural_assessment_confirmed boolean, notes string"


def test_judgements(spark):
    r = oracle.normalise(spark.createDataFrame([("english", " me ", ["T3", "T1"], ["T1"], True, " ")], JUDGEMENT)).first()
    assert (r["usable_tiers"], r["lowest_usable_tier"], r["degraded_tiers"], r["higher_tier_degraded"], r["annotator"], r["notes"]) == (["T1", "T3"], "T1", ["T2"], True, "me", None)
    r = oracle.derive(spark.createDataFrame([("x", "a", [], ["T0", "T3"], True, None)], JUDGEMENT)).first()
    assert (r["lowest_usable_tier"], r["degraded_tiers"]) == ("unusable", ["T1", "T2"])
    bad = spark.createDataFrame([("latin", "", ["T1", "T1"], ["T9"], False, None), ("thai", "me", None, [], True, None)], JUDGEMENT).select(oracle.judgement_violations().alias("v")).collect()
    assert bad[0]["v"] == ["SCRIPT_REQUIRED", "ANNOTATOR_REQUIRED", "USABLE_TIERS_REPEATED", "STRUCTURAL_TIER_UNKNOWN", "STRUCTURE_NOT_CONFIRMED"] and bad[1]["v"] == ["USABLE_TIERS_REQUIRED"]
    with pytest.raises(Exception, match="SCRIPT_REQUIRED"):
        oracle.normalise(spark.createDataFrame([(None, "me", ["T0"], ["T0"], True, None)], JUDGEMENT)).collect()


ANNOTATION = "case_id string, page int, expected_case_id string, expected_page int, annotation_status string, structural_scope_status string, usable_tiers array<string>, structurally_adequate_tiers array<string>, lowest_usable_tier string, lowest_structurally_adequate_tier string, degraded_tiers array<string>, higher_tier_degraded boolean, elements array<struct<id:string,type:string,text:string,reading_order:int>>, boundaries array<struct<id:string,type:string,expected_action:string,before_element_id:string,after_element_id:string>>"


def test_annotations(spark):
    good = ("a", 1, "a", 1, "complete", "complete", ["T1", "T3"], ["T1"], "T1", "T1", ["T2"], True, [("x", "body", "t", 0), ("y", "body", "t", 1)], [("b", "k", "join", "x", "y")])
    bad = ("a", 2, "a", 1, "complete", "complete", ["T3", "T1"], ["T1"], "T3", "T1", [], False, [("x", "body", "t", 0), ("x", "body", "t", 2)], [("b", "k", "join", "x", "q"), ("b", "k", "join", "x", "x")])
    pending = ("z", 1, "a", 1, "pending", None, None, None, None, None, None, None, None, None)
    got = [r["v"] for r in spark.createDataFrame([good, bad, pending], ANNOTATION).select(oracle.annotation_violations().alias("v")).collect()]
    assert got[0] == [] and got[2] == ["IDENTITY"]
    assert got[1] == ["IDENTITY", "USABLE_TIERS_ORDER", "LOWEST_USABLE_TIER", "DEGRADED_TIERS", "HIGHER_TIER_DEGRADED", "ELEMENT_IDS_REPEATED", "READING_ORDER_GAPS", "BOUNDARY_IDS_REPEATED", "AFTER_ELEMENT_UNKNOWN", "BOUNDARY_JOINS_ITSELF"]


def test_fold(spark):
    notes = spark.createDataFrame([("a", 1, "s1", "pending", "unavailable", None), ("b", 1, "s2", "complete", "complete", "available")], "case_id string, page int, stratum string, annotation_status string, structural_scope_status string, text_reference_status string")
    base = spark.createDataFrame([(c, 1, "english", "me", ["T0"], ["T0"], True, None, "2026-01-01") for c in "ab"], "case_id string, page int, " + JUDGEMENT + ", judged_at string")
    folded = oracle.fold(notes, oracle.derive(base))
    assert rows(folded, "case_id", "annotation_status", "structural_scope_status", "text_reference_status") == [("a", "oracle-complete", "unavailable", "unavailable"), ("b", "complete", "complete", "available")]
    with pytest.raises(ValueError, match="missing"):
        oracle.fold(notes, oracle.derive(base.where("case_id = 'a'")))
    assert rows(oracle.pack_summary(folded), "stratum", "pages", "structure_annotated") == [("all", 2, 1), ("s1", 1, 0), ("s2", 1, 1)]


def test_gate_errors(spark):
    obs = spark.createDataFrame([([], "T0"), (["T1"], "T0"), (["T0", "T1"], "T1"), (["T0"], "T0"), (["T0"], None)], "acceptable_tiers array<string>, selected_tier string")
    r = policies.gate_errors(obs, []).first()
    assert (r["false_accepts"], r["false_escalations"], r["denominator"], r["excluded_count"]) == (2, 1, 4, 1)
    assert r["false_accept_rate"] == 0.5 and r["false_escalation_rate"] == 0.25


def test_policies(spark):
    cases = spark.createDataFrame([("a", "T0", "T1"), ("b", "T2", None)], "case_id string, static_tier string, gated_tier string")
    cells = spark.createDataFrame([("a", "T0", "succeeded", 10.0), ("b", "T0", "failed", None), ("a", "T1", "succeeded", 100.0), ("b", "T2", "succeeded", 200.0)], "case_id string, tier string, status string, wall_ms double")
    pages = spark.createDataFrame([("a", 1, ["T0"], ["T1"]), ("b", 1, ["T2"], [])], "case_id string, page int, usable_tiers array<string>, structurally_adequate_tiers array<string>")
    got = {r["policy"]: r for r in policies.simulate(cases, cells, pages).collect()}
    assert (got["staticInspection"]["observed_wall_ms"], got["staticInspection"]["observed_documents"]) == (210.0, 2)
    assert (got["gated"]["selected_documents"], got["gated"]["covered_pages"], got["gated"]["selected_t3"]) == (1, 1, 0)
    assert got["allT0"]["mean_wall_ms"] == 10.0 and got["allT0"]["reading_false_accepts"] == 1
    with pytest.raises(ValueError, match="T0"):
        policies.simulate(cases, cells.where("tier <> 'T0'"), pages)
    with pytest.raises(ValueError, match="unique"):
        policies.simulate(cases, cells, pages.union(pages))
    base = policies.page_baseline(spark.createDataFrame([("a", 1, "succeeded", 5.0), ("b", 1, "failed", None)], "case_id string, page int, status string, wall_ms double"), pages).first()
    assert (base["observed_pages"], base["page_cells"], base["reading_false_accepts"]) == (1, 2, 2)


CELLS = "case_id string, tier string, partition string, stratum string, page_count int, status string, has_artifact boolean, wall_ms double, provider_id string, provider_ms double, provider_timing_status string, cache_hit boolean, observed_minimum_wall_ms double"


def test_timing_cube(spark):
    cells = spark.createDataFrame([
        ("a", "T1", "calibration", "born-digital-en", 2, "succeeded", True, 100.0, "d", 80.0, "observed", True, None),
        ("b", "T1", "evaluation", "born-digital-en", 3, "failed", False, None, "d", None, "unavailable", False, None),
        ("c", "T3", "evaluation", "scanned-degraded-en", 1, "succeeded", True, 100.0, "p", None, "unavailable", False, None),
        ("d", "T3", "evaluation", "scanned-degraded-en", 9, "censored", False, None, "p", None, "unavailable", False, 1461000.0)], CELLS)
    over = spark.createDataFrame([("p", 10.0)], "provider_id string, fixed_overhead_ms double")
    got = {(r["tier"], r["group"]): r for r in timing.timing_cube(cells, over).collect()}
    assert len(got) == 4 * 7
    t1, t3, none = got["T1", "overall"], got["T3", "overall"], got["T0", "overall"]
    assert (t1["succeeded"], t1["documents"], t1["excluded"], t1["marginal_ms"], t1["pages"], t1["excluded_pages"]) == (1, 2, 1, 80.0, 2, 3)
    assert (t3["marginal_ms"], t3["censored_minimum_wall_ms"], t3["cost_proxy_usd"]) == (90.0, 1461000.0, pytest.approx(90 / 3.6e6, abs=1e-6))
    assert (none["documents"], none["succeeded"], none["mean_wall_ms"]) == (0, 0, None)


def test_matrix(spark):
    sample = spark.createDataFrame([("evaluation", "a"), ("calibration", "b")], "partition string, case_id string")
    expected = timing.expected_cells(sample)
    actual = expected.where("NOT (case_id = 'a' AND tier = 'T1')").union(spark.createDataFrame([("evaluation", "x", "T0"), ("calibration", "b", "T0")], expected.schema))
    assert rows(timing.matrix_gaps(expected, actual, ["partition", "case_id", "tier"]), "case_id", "tier", "gap") == [("a", "T1", "missing"), ("b", "T0", "repeated"), ("x", "T0", "unexpected")]
    todo = timing.todo_cells(expected, actual.limit(0), ["partition", "case_id", "tier"], 2).collect()
    assert [(r["partition"], r["tier"]) for r in todo] == [("calibration", "T0"), ("calibration", "T1")]


def test_page_timing_and_budgets(spark):
    cells = spark.createDataFrame([("p", "succeeded", float(x)) for x in (10, 20, 30, 40)] + [("p", "failed", None)], "provider_id string, status string, wall_ms double")
    r = timing.page_timing(cells, [[]]).first()
    assert (r["numerator"], r["denominator"], r["excluded_count"], r["median_ms"], r["mean_ms"]) == (4, 5, 1, 20.0, 25.0)
    with pytest.raises(ValueError):
        timing.page_timing(cells.union(cells.withColumn("provider_id", F.lit("q"))), [[]])
    n = lambda k: timing.project_pages(spark.createDataFrame([(k,)], "page_count int")).first()
    assert n(0)["scanned_cold_hours"] == 0 and n(1)["scanned_cold_hours"] == pytest.approx(38_500 / 3.6e6)
    sample = spark.createDataFrame([("calibration", None)] * 8 + [("evaluation", [1, 2])] * 16, "partition string, pages array<int>")
    b = timing.page_budget(sample, 40_000.0, 1_461_000.0).first()
    assert (b["total_pages"], b["warm_ms"], b["warm_fits"], b["doubled_fits"]) == (48, 1_920_000.0, True, True)
    with pytest.raises(ValueError):
        timing.page_budget(sample.withColumn("pages", F.array(F.lit(1))), 1.0, 1.0)
    empty = timing.page_count_profile(spark.createDataFrame([], "page_count int")).first()
    assert (empty["documents"], empty["p50"], empty["mean"]) == (0, 0, 0)


def test_cost(spark):
    schema = "wall_ms double, t0_wall_ms double, fixed_overhead_ms double, provider_ms double, provider_timing_status string, billed_cost double, machine_hourly_rate double"
    a, b = timing.timing_and_cost(spark.createDataFrame([(2000.0, 100.0, 500.0, 1400.0, "observed", None, 0.1), (2000.0, 100.0, 500.0, None, "unavailable", 1.0, 0.1)], schema)).collect()
    assert (a["marginal_ms"], a["t0_ratio"], a["billed_excluded"]) == (1400.0, 20.0, 1) and (b["marginal_ms"], b["billed_excluded"]) == (1500.0, 0)
    with pytest.raises(Exception, match="baseline"):
        timing.timing_and_cost(spark.createDataFrame([(1.0, 0.0, 0.0, None, "unavailable", None, 0.1)], schema)).collect()
    cal = spark.createDataFrame([("a", 10.0, 8.0, None), ("a", 14.0, 8.0, None), ("b", 5.0, None, 1.0), ("b", 5.0, None, 3.0)], "provider_id string, wall_ms double, provider_ms double, baseline_ms double")
    assert rows(timing.calibrate_overheads(cal), "provider_id", "fixed_overhead_ms") == [("a", 4.0), ("b", 2.0)]


def test_structure(spark):
    schema = "doc_id string, type string, idx int, text string"
    ref = spark.createDataFrame([("d", "body", 0, "same"), ("d", "heading", 1, "Methods")], schema)
    out = spark.createDataFrame([("d", "body", 0, "same"), ("d", "body", 1, "same"), ("d", "caption", 2, "Methods")], schema)
    r = metrics.structure_metrics(ref, out).first()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"]) == (1, 2, 1) and r["f1"]["value"] == pytest.approx(0.4)
    p = metrics.structure_metrics(ref, out, complete=False).first()
    assert p["false_positives"] is None and p["precision"]["value"] is None and p["recall"]["value"] == 0.5


def test_chunks(spark):
    e = spark.createDataFrame([("d", x, i, 0, t, False) for i, (x, t) in enumerate((("a", 2), ("b", 2), ("c", 2)))], "doc_id string, id string, reading_order int, pos int, tokens long, breaks boolean")
    assert rows(metrics.fixed_chunks(e, 3), "id", "first_chunk", "last_chunk") == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1)]
    b = spark.createDataFrame([("d", "break", "b", "c")], "doc_id string, expected_action string, before_element_id string, after_element_id string")
    marked = metrics.breaks_before(e.drop("breaks"), b)
    assert rows(metrics.structural_chunks(marked, 10), "id", "chunk") == [("a", 0), ("b", 0), ("c", 1)]
    assert rows(metrics.structural_chunks(e, 1), "id", "chunk") == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        metrics.fixed_chunks(e, 0)
    chunks = spark.createDataFrame([("d", "a", 0, 0), ("d", "b", 1, 1), ("d", "c", 1, 1)], "doc_id string, id string, first_chunk long, last_chunk long")
    ops = spark.createDataFrame([("d", "join", "a", "b"), ("d", "break", "b", "c"), ("d", "join", "a", "q")], b.schema)
    r = metrics.boundary_metrics(ops, chunks).first()
    assert (r["splits"], r["joins"], r["merges"], r["breaks"], r["excluded_joins"]) == (1, 1, 1, 1, 1) and r["violations_per_100"] == 100


def test_sampling(spark):
    strata = sampling.STRATA
    cases = spark.createDataFrame([(f"{s}-{i}", s, 2 + i % 2) for s in strata for i in range(6)] + [("tiny", strata[0], 1)], "case_id string, stratum string, page_count int")
    drawn = sampling.draw(cases, "seed")
    assert rows(drawn.groupBy("partition").count(), "partition", "count") == [("calibration", 8), ("evaluation", 16)]
    assert rows(drawn, "case_id", "partition") == rows(sampling.draw(cases.orderBy(F.rand(1)), "seed"), "case_id", "partition")
    assert "tiny" not in {r["case_id"] for r in drawn.collect()}
    sampling.assert_disjoint(drawn)
    with pytest.raises(ValueError):
        sampling.assert_disjoint(drawn.union(drawn.limit(1).withColumn("partition", F.lit("evaluation"))).union(drawn.limit(1).withColumn("partition", F.lit("calibration"))))
    with pytest.raises(ValueError, match="too few"):
        sampling.draw(cases.where("case_id <> 'born-digital-en-0'"), "seed")
    got = sampling.case_ids(spark.createDataFrame([(f"k{i:04}",) for i in range(1005)], "source_key string"))
    named = {r["source_key"]: r["case_id"] for r in got.collect()}
    assert named["k0000"] == "F001" and named["k0999"] == "F1000" and len(set(named.values())) == 1005
    pages = spark.createDataFrame([("c", i, t, a, 0) for i, (t, a) in enumerate(((100, 0.0), (5, 0.9), (100, 0.1), (400, 0.0)), 1)], "case_id string, page int, text_chars long, image_area_ratio double, warnings int")
    pick = lambda s: sampling.select_pages(spark.createDataFrame([("c", s, 100.0)], "case_id string, stratum string, chars_per_page double"), pages, "seed").first()["pages"]
    assert pick("scanned-degraded-en") == [2, 3] and pick("born-digital-en") == [2, 4]
    assert spark.range(1).select(sampling.cell_name(F.lit("calibration"), F.lit("F001"), F.lit("T3"), F.lit(1)).alias("n")).first()["n"] == "calibration-F001-P0001-T3.json"


def test_adjustments(spark):
    base = signal_row(spark).withColumn("case_id", F.lit("a"))
    change = lambda *r: spark.createDataFrame([r], "case_id string, from_stratum string, to_stratum string, reason string")
    good = change("a", "born-digital-en", "scanned-degraded-en", "r")
    assert sampling.adjusted_strata(base, good, reviewed=True).first()["stratum"] == "scanned-degraded-en"
    for bad, reviewed in ((good, False), (change("z", "born-digital-en", "scanned-degraded-en", "r"), True), (change("a", "scanned-degraded-en", "born-digital-en", "r"), True), (change("a", "born-digital-en", "born-digital-en", "r"), True), (good.union(good), True)):
        with pytest.raises(ValueError):
            sampling.adjusted_strata(base, bad, reviewed=reviewed)


def test_declaration(spark):
    sample = spark.createDataFrame([("evaluation", "a", "s", [1, 2]), ("calibration", "b", "s", None)], "partition string, case_id string, stratum string, pages array<int>")
    chosen = spark.createDataFrame([("a", [1, 2]), ("b", [3])], "case_id string, pages array<int>")
    out, digest = sampling.declare_pages(sample, chosen)
    assert len(digest) == 64 and ("all", "all", 2, 3) in rows(sampling.declared_counts(out), "partition", "stratum", "documents", "pages")
    with pytest.raises(ValueError):
        sampling.declare_pages(sample, chosen.withColumn("pages", F.array(F.lit(9))))


def test_corpus(spark):
    a = spark.createDataFrame([("application/pdf", None, 3), ("image/png", None, 1), ("application/pdf", "PDF_ENCRYPTED", 0)], "media_type string, error_code string, page_count int")
    r = corpus.corpus_summary(corpus.attachment_status(a), 5).first()
    assert (r["included"], r["excluded"], r["unreadable"], r["pages"], r["difference"]) == (1, 1, 1, 3, -4)
    h = spark.createDataFrame([("A" * 64,), ("xyz",), (None,)], "h string").select(corpus.clean_hash(F.col("h")).alias("h")).collect()
    assert [x["h"] for x in h] == ["a" * 64, None, None]
    v = spark.createDataFrame([(1, 10, 1, False), (1, 11, 1, True), (1, 9, 1, None), (2, 5, 2, False)], "document_id int, version_id int, collection_id int, deleted boolean")
    c = spark.createDataFrame([(1, "p"), (2, "q")], "collection_id int, path string")
    assert rows(corpus.current_versions(v, c, "p"), "document_id", "version_id") == [(1, 10)]


def test_export(spark):
    m = export.metric_values(spark.createDataFrame([("gate.reading_rate", 1.0, 4.0, 0.0, 0.25)], "key string, numerator double, denominator double, excluded_count double, value double"))
    u = export.unavailable_values(spark.createDataFrame([("cost.billed", "not measured")], "key string, reason string"))
    values = m.unionByName(u)
    assert m.first()["name"] == "Gate reading rate" and export.unaccounted(values).count() == 0
    assert "| Gate reading rate | observed | 25.0% (1/4) |" in export.markdown(values, "R") and "not measured" in export.markdown(values, "R")
    naked = m.withColumn("denominator", F.lit(None).cast("double"))
    assert rows(export.unaccounted(naked.union(naked)), "problem") == [("number without accounting",), ("number without accounting",), ("repeated key",)]
    assert spark.range(1).select(export.value_name(F.lit("a.b"), {"a.b": "Fixed"}).alias("n")).first()["n"] == "Fixed"


def test_published_policy_hash():
    """The frozen routing candidates hash to the published value: 8 of 8 correct below an anomaly limit of 0.05, else 7."""
    names = ("minimumTextLayerCoverage", "maximumFullPageImageRatio", "maximumEncodingAnomalyRatio")
    ordered = [(c, i, a, n) for n, limits in ((8, (0.01, 0.02)), (7, (0.05,))) for c in (0.75, 0.5, 0.25) for i in (0.25, 0.5, 0.75) for a in limits]
    candidates = [{"thresholds": dict(zip(names, r[:3], strict=True)), "correct": r[3], "denominator": 8} for r in ordered]
    cases = ["F129", "F047", "F155", "F120", "F085", "F015", "F318", "F279"]
    assert len(candidates) == 27
    assert calibration.routing_policy_hash(candidates[0]["thresholds"], cases, candidates) == "c1f14b50218c6ccb242af166ad660ea1bcb9af64e8b9f86d0c9c30985e9976fb"
