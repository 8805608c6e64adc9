"""The five-component quality gate and the bounded escalation that it drives."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import TIERS, reasons
from ..functions.text import character_sanity, gate_counts, script_consistency

COMPONENTS = ("character_sanity", "text_retention", "usable_page_ratio", "structural_yield", "script_consistency")
REASONS = tuple(f"{c.upper()}_FAILED" for c in COMPONENTS)
TEXT_REASONS = tuple(r for r in REASONS if r != "STRUCTURAL_YIELD_FAILED")


@dataclass(frozen=True)
class Thresholds:
    character_sanity: float = 0.99
    text_retention: float = 0.75
    usable_page_ratio: float = 0.75
    structural_yield: float = 1.0
    script_consistency: float = 0.95


def _counts() -> dict[str, Column]:
    long_pages = F.size(F.filter("pages", lambda p: F.length(F.coalesce(p, F.lit(""))) >= 32))
    return {**gate_counts(F.col("text")), "chars_": F.length("text"), "long_pages_": F.when(F.col("pages").isNotNull(), long_pages)}


def counted(artifacts: DataFrame) -> DataFrame:
    """The rows with what with_components counts in text and pages, and without these: a join with the inspections then moves
    a few numbers a row and no text."""
    return artifacts.withColumns(_counts()).drop("text", "pages")


def with_components(artifacts: DataFrame) -> DataFrame:
    """Add the components to rows of text, pages (array of text, or null), or of what counted() has made of them, has_structure,
    and of the inspection total_text_chars, page_count, thai_char_ratio, latin_char_ratio, expects_structure. Only sanity is
    never null."""
    total, pages = F.col("total_text_chars"), F.col("page_count")
    counted = artifacts if "long_pages_" in artifacts.columns else artifacts.withColumns(_counts())
    return counted.withColumns({
        "character_sanity": character_sanity(F.col("solid_"), F.col("bad_")),
        "text_retention": F.when(total > 0, F.least(F.lit(1.0), F.col("chars_") / F.when(total > 0, total))),
        "usable_page_ratio": F.when(pages != 0, F.col("long_pages_") / F.when(pages != 0, pages)),
        "structural_yield": F.when(F.col("expects_structure"), F.when(F.col("has_structure"), 1.0).otherwise(0.0)),
        "script_consistency": script_consistency(F.col("thai_"), F.col("latin_"), F.col("thai_char_ratio"), F.col("latin_char_ratio")),
    }).drop("solid_", "bad_", "thai_", "latin_", "chars_", "long_pages_")


def failures(thresholds: Thresholds | list[Column]) -> Column:
    """Names of the components below their threshold, in order; a null component never fails."""
    limits = [F.lit(x) for x in astuple(thresholds)] if isinstance(thresholds, Thresholds) else thresholds
    return reasons(*((F.col(c) < limit, r) for c, limit, r in zip(COMPONENTS, limits, REASONS, strict=True)))


def decide(artifacts: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Add reasons and passed to rows with components."""
    return artifacts.withColumn("reasons", failures(thresholds)).withColumn("passed", F.size("reasons") == 0)


def next_tier(tier: Column, failed: Column) -> Column:
    """Where a failure leads: text failures to T2, structural ones up by one; T2 to T3; null from T3."""
    text = F.arrays_overlap(failed, F.array(*map(F.lit, TEXT_REASONS)))
    return F.when(tier == "T0", F.when(text, "T2").otherwise("T1")).when(tier == "T1", F.when(text, "T2").otherwise("T3")).when(tier == "T2", "T3")


def replay(initial: DataFrame, artifacts: DataFrame, max_escalations: int = 2, key: str = "case_id") -> DataFrame:
    """Follow each case from its initial_tier through its artifacts (key, tier, artifact_key, passed, reasons).

    Adds status, final_tier, selected_key and steps. Accepted: a tier passed. Low confidence: the last tier
    failed or the escalations are used up, and its artifact stays selected. Unavailable: a tier has no artifact.
    Tiers only rise, so there are at most four attempts; each is one step of a column expression over the
    case's artifacts, which a single aggregation gathers (four rows a case at most).
    """
    held = artifacts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tier", F.struct("artifact_key", "passed", "reasons")))).alias("held"))
    rows = initial.join(held, key, "left").withColumns({"tier_": F.col("initial_tier"), "status": F.lit(None).cast("string"), "final_tier": F.lit(None).cast("string"), "selected_key": F.lit(None).cast("string"), "steps": F.expr("cast(array() as array<struct<tier:string,artifact_key:string,next_tier:string,reasons:array<string>>>)")})
    for attempt in range(len(TIERS)):
        artifact = F.try_element_at("held", F.col("tier_"))
        active = F.col("status").isNull()
        proposed = next_tier(F.col("tier_"), artifact["reasons"])
        stops = proposed.isNull() | F.lit(attempt >= max_escalations)
        rows = rows.withColumns({"artifact_": F.when(active, artifact), "proposed_": F.when(active & artifact.isNotNull() & ~artifact["passed"] & ~stops, proposed)})
        found = F.col("artifact_")
        ended = F.when(proposed.isNull(), F.array(F.lit("TERMINAL_TIER_FAILED"))).otherwise(F.array(F.lit("MAX_ESCALATIONS_REACHED")))
        why = F.when(found["passed"] | F.col("proposed_").isNotNull(), found["reasons"]).otherwise(F.concat(found["reasons"], ended))
        step = F.struct(F.col("tier_").alias("tier"), found["artifact_key"].alias("artifact_key"), F.col("proposed_").alias("next_tier"), why.alias("reasons"))
        done = F.when(found.isNull(), "unavailable").when(found["passed"], "accepted").when(F.col("proposed_").isNull(), "low-confidence")
        rows = rows.withColumns({
            "steps": F.when(active & found.isNotNull(), F.concat("steps", F.array(step))).otherwise(F.col("steps")),
            "final_tier": F.when(active & (done != "unavailable"), F.col("tier_")).otherwise(F.col("final_tier")),
            "selected_key": F.when(active & (done != "unavailable"), found["artifact_key"]).otherwise(F.col("selected_key")),
            "status": F.when(active, done).otherwise(F.col("status")),
            "tier_": F.coalesce("proposed_", "tier_"),
        })
    return rows.drop("held", "tier_", "artifact_", "proposed_")


def audit_sanity(artifacts: DataFrame, least: float = 0.95) -> DataFrame:
    """(artifact_key, character_sanity, below) of a single diagnostic threshold."""
    counts = gate_counts(F.col("text"))
    return artifacts.select("artifact_key", counts["solid_"].alias("solid_"), counts["bad_"].alias("bad_")).select("artifact_key", character_sanity(F.col("solid_"), F.col("bad_")).alias("character_sanity")).withColumn("below", F.col("character_sanity") < least)
