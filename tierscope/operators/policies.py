"""Escalation policies: gate errors, timing and coverage by policy, and the page baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import TIERS, ratio_value, tier_rank

POLICIES = ("allT0", "staticInspection", "gated")


def gate_error_columns(acceptable: Column, selected: Column) -> list[Column]:
    """Aggregates over observations: false accepts and escalations, their common denominator, and exclusions.

    Null selections are excluded. A false accept selects a tier that isn't acceptable, none being so included;
    a false escalation selects an acceptable one though a cheaper one is.
    """
    chosen = selected.isNotNull()
    fits = F.coalesce(F.array_contains(acceptable, selected), F.lit(False))
    cheaper = F.exists(acceptable, lambda t: tier_rank(t) < tier_rank(selected))
    return [F.count_if(chosen & ~fits).alias("false_accepts"), F.count_if(chosen & fits & cheaper).alias("false_escalations"), F.count_if(chosen).alias("denominator"), F.count_if(~chosen).alias("excluded_count")]


def gate_errors(observations: DataFrame, by: list[str], acceptable: str = "acceptable_tiers", selected: str = "selected_tier") -> DataFrame:
    out = observations.groupBy(*by).agg(*gate_error_columns(F.col(acceptable), F.col(selected)))
    d, e = F.col("denominator"), F.col("excluded_count")
    return out.withColumns({"false_accept_rate": ratio_value(F.col("false_accepts"), d, e), "false_escalation_rate": ratio_value(F.col("false_escalations"), d, e)})


def selections(cases: DataFrame) -> DataFrame:
    """(policy, case_id, tier) of cases (case_id, static_tier, gated_tier), one row for each policy."""
    return cases.select("case_id", F.expr("stack(3, 'allT0', 'T0', 'staticInspection', static_tier, 'gated', gated_tier) AS (policy, tier)"))


def _check(cases: DataFrame, cells: DataFrame, pages: DataFrame) -> None:
    if cases.groupBy("case_id").count().where("count > 1").limit(1).count():
        raise ValueError("policy cases must be unique")
    if cases.join(cells.where("tier = 'T0'"), "case_id", "left_anti").limit(1).count():
        raise ValueError("a case has no T0 cell")
    if pages.groupBy("case_id", "page").count().where("count > 1").limit(1).count():
        raise ValueError("policy pages must be unique")
    if pages.join(cases, "case_id", "left_anti").limit(1).count():
        raise ValueError("a policy page belongs to no case")


def simulate(cases: DataFrame, cells: DataFrame, pages: DataFrame, check: bool = True, expected_pages: int | None = None) -> DataFrame:
    """One row by policy: selections by tier, timing over succeeded and timed cells (case_id, tier, status,
    wall_ms), pages covered, and gate errors on both axes of pages (case_id, page, usable_tiers,
    structurally_adequate_tiers). expected_pages: how many pages there must be, else it raises."""
    if check:
        _check(cases, cells, pages)
    if expected_pages is not None and (found := pages.count()) != expected_pages:
        raise ValueError(f"expected {expected_pages} judged pages, found {found}")
    chosen = selections(cases)
    timed = cells.where("status = 'succeeded' AND wall_ms IS NOT NULL").select("case_id", "tier", "wall_ms")
    documents = chosen.join(timed, ["case_id", "tier"], "left").groupBy("policy").agg(
        F.count("*").alias("documents"),
        F.count("tier").alias("selected_documents"),
        *(F.count_if(F.col("tier") == t).alias(f"selected_{t.lower()}") for t in TIERS),
        F.count("wall_ms").alias("observed_documents"),
        F.coalesce(F.sum("wall_ms"), F.lit(0.0)).alias("observed_wall_ms"),
    )
    documents = documents.withColumn("mean_wall_ms", ratio_value(F.col("observed_wall_ms"), F.col("observed_documents"), F.col("documents") - F.col("observed_documents")))
    judged = pages.join(chosen, "case_id")
    errors = []
    for axis, column in (("reading", "usable_tiers"), ("structural", "structurally_adequate_tiers")):
        errors += [c.alias(f"{axis}_{n}") for c, n in zip(gate_error_columns(F.col(column), F.col("tier"))[:2], ("false_accepts", "false_escalations"), strict=True)]
    quality = judged.groupBy("policy").agg(F.count("*").alias("pages"), F.count("tier").alias("covered_pages"), *errors)
    return documents.join(quality, "policy", "left")


def page_baseline(page_cells: DataFrame, pages: DataFrame, tier: str = "T3") -> DataFrame:
    """One row: observed page cells and their time, and gate errors if every page used that tier."""
    if page_cells.groupBy("case_id", "page").count().where("count > 1").limit(1).count():
        raise ValueError("page cells must be unique")
    timed = (F.col("status") == "succeeded") & F.col("wall_ms").isNotNull()
    cells = page_cells.agg(F.count_if(timed).alias("observed_pages"), F.count("*").alias("page_cells"), F.coalesce(F.sum(F.when(timed, F.col("wall_ms"))), F.lit(0.0)).alias("observed_wall_ms"))
    errors = []
    for axis, column in (("reading", "usable_tiers"), ("structural", "structurally_adequate_tiers")):
        errors += [c.alias(f"{axis}_{n}") for c, n in zip(gate_error_columns(F.col(column), F.lit(tier))[:2], ("false_accepts", "false_escalations"), strict=True)]
    return cells.join(pages.agg(F.count("*").alias("pages"), *errors))
