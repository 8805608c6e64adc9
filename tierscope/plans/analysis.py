"""Whole analyses as one plan each: policy analysis, gate calibration, and drawing a sample from page evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, gate, policies, sampling, signals


def draw_sample(evidence: DataFrame, seed: str, adjustments: DataFrame | None = None, reviewed: bool = False, calibration_n: int = 2, evaluation_n: int = 4, pages_n: int = 2) -> DataFrame:
    """Page evidence to a frozen sample: case_id, stratum, page_count, partition, pages (evaluation only)."""
    pages = signals.inspect_pages(evidence)
    found = sampling.adjusted_strata(signals.document_signals(pages), adjustments, reviewed=reviewed)
    drawn = sampling.draw(found, seed, calibration_n, evaluation_n, pages_n)
    cases = drawn.where("partition = 'evaluation'").join(found.select("case_id", "chars_per_page"), "case_id")
    warnings = F.size("warnings") if "warnings" in evidence.columns else F.lit(0)
    listed = pages.join(evidence.select("case_id", "page", warnings.alias("warnings")), ["case_id", "page"])
    return drawn.join(sampling.select_pages(cases, listed, seed, pages_n), "case_id", "left")


def gate_examples(artifacts: DataFrame, inspections: DataFrame, judgements: DataFrame) -> DataFrame:
    """Document and tier examples: components once, and acceptance by all judged pages on both axes."""
    rows = gate.with_components(gate.counted(artifacts).join(inspections, "case_id"))
    for axis, column in (("reading_accepted", "usable_tiers"), ("structurally_accepted", "structurally_adequate_tiers")):
        rows = rows.join(calibration.accepted_by_all_pages(judgements, column).withColumnRenamed("accepted", axis), ["case_id", "tier"])
    return rows.select("case_id", "tier", *gate.COMPONENTS, "reading_accepted", "structurally_accepted")


def analyse_policies(found: DataFrame, artifacts: DataFrame, cells: DataFrame, judgements: DataFrame, routing: signals.Routing = signals.TUNED, thresholds: gate.Thresholds = gate.Thresholds(), max_escalations: int = 2) -> DataFrame:
    """Signals, artifacts (case_id, tier, artifact_key, text, pages, has_structure), cells and judged pages to one
    row by policy. Structure is expected where the initial tier isn't T0; the gated tier is the one whose
    artifact the replay selected, none if a needed artifact is missing."""
    routed = signals.initial_route(found, routing).withColumn("initial_tier", F.col("route.tier"))
    inspections = routed.select("case_id", "total_text_chars", "page_count", "thai_char_ratio", "latin_char_ratio", (F.col("initial_tier") != "T0").alias("expects_structure"))
    decided = gate.decide(gate.with_components(gate.counted(artifacts).join(inspections, "case_id")), thresholds).select("case_id", "tier", "artifact_key", "passed", "reasons")
    replayed = gate.replay(routed.select("case_id", "initial_tier"), decided, max_escalations)
    chosen = replayed.join(artifacts.select("case_id", F.col("tier").alias("gated_tier"), F.col("artifact_key").alias("selected_key")), ["case_id", "selected_key"], "left")
    return policies.simulate(chosen.select("case_id", F.col("initial_tier").alias("static_tier"), "gated_tier"), cells, judgements)
