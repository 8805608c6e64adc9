"""Human judgements: ordered tier sets, derived fields, validation and folding into annotations."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import TIERS, ordered_tiers, reasons, tier_rank
from ..functions.structure import stringify

SCRIPTS = ("english", "thai", "mixed")


def lowest_tier(tiers: Column) -> Column:
    """The first accepted tier, or `unusable`."""
    return F.coalesce(F.get(ordered_tiers(tiers), 0), F.lit("unusable"))


def _gaps(tiers: Column) -> Column:
    ordered = ordered_tiers(tiers)
    first, last = tier_rank(F.get(ordered, 0)), tier_rank(F.get(ordered, F.size(ordered) - 1))
    return F.filter(F.array(*map(F.lit, TIERS)), lambda t: ~F.array_contains(tiers, t) & (tier_rank(t) > first) & (tier_rank(t) < last))


def degraded_tiers(usable: Column, structural: Column) -> Column:
    """Tiers rejected between accepted ones, on either axis, T0 first."""
    either = F.array_union(F.coalesce(_gaps(usable), F.array().cast("array<string>")), F.coalesce(_gaps(structural), F.array().cast("array<string>")))
    return ordered_tiers(either)


def derive(judgements: DataFrame) -> DataFrame:
    """Add the derived fields to rows of usable_tiers and structurally_adequate_tiers; sent ones are replaced."""
    usable, structural = F.col("usable_tiers"), F.col("structurally_adequate_tiers")
    return judgements.withColumns({
        "usable_tiers": ordered_tiers(usable),
        "structurally_adequate_tiers": ordered_tiers(structural),
        "lowest_usable_tier": lowest_tier(usable),
        "lowest_structurally_adequate_tier": lowest_tier(structural),
        "degraded_tiers": degraded_tiers(usable, structural),
        "higher_tier_degraded": F.size(degraded_tiers(usable, structural)) > 0,
    })


def judgement_violations() -> Column:
    """What makes a submitted judgement unacceptable."""
    def bad_set(c: str) -> Column:
        return F.coalesce(F.size(ordered_tiers(F.col(c))) != F.size(c), F.lit(False))

    def unknown(c: str) -> Column:
        return F.coalesce(F.exists(c, lambda t: ~t.isin(*TIERS)), F.lit(False))

    out = [(~F.coalesce(F.col("script").isin(*SCRIPTS), F.lit(False)), "SCRIPT_REQUIRED"), (F.trim(F.coalesce("annotator", F.lit(""))) == "", "ANNOTATOR_REQUIRED")]
    for c, name in (("usable_tiers", "USABLE"), ("structurally_adequate_tiers", "STRUCTURAL")):
        out += [(F.col(c).isNull(), f"{name}_TIERS_REQUIRED"), (unknown(c), f"{name}_TIER_UNKNOWN"), (~unknown(c) & bad_set(c), f"{name}_TIERS_REPEATED")]
    return reasons(*out, (~F.coalesce("structural_assessment_confirmed", F.lit(False)), "STRUCTURE_NOT_CONFIRMED"))


def normalise(judgements: DataFrame) -> DataFrame:
    """Derived, trimmed judgements; raises on the first unacceptable one."""
    bad = judgement_violations()
    checked = judgements.withColumn("usable_tiers", F.when(F.size(bad) == 0, F.col("usable_tiers")).otherwise(F.raise_error(F.array_join(bad, ","))))
    return derive(checked).withColumns({"annotator": F.trim("annotator"), "notes": F.nullif(F.trim("notes"), F.lit(""))})


def annotation_violations() -> Column:
    """Violations of a row of annotation (identity and expectation, tier fields, elements, boundaries).

    Elements are structs (id, type, text, reading_order), boundaries (id, type, expected_action,
    before_element_id, after_element_id). Pending rows are checked for identity only, rows without a structural
    scope for identity and tiers only.
    """
    usable, structural = F.col("usable_tiers"), F.col("structurally_adequate_tiers")
    ids = F.transform("elements", lambda e: e["id"])
    orders = F.array_sort(F.transform("elements", lambda e: e["reading_order"].cast("long")))
    names = F.transform("boundaries", lambda b: b["id"])
    judged = F.col("annotation_status") != "pending"
    drawn = judged & (F.coalesce("structural_scope_status", F.lit("complete")) != "unavailable")
    expected = F.when(F.size("elements") > 0, F.sequence(F.lit(0).cast("long"), F.size("elements").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    return reasons(
        ((F.col("case_id") != F.col("expected_case_id")) | (F.col("page") != F.col("expected_page")), "IDENTITY"),
        (judged & differs(F.coalesce(usable, F.array().cast("array<string>")), ordered_tiers(F.coalesce(usable, F.array().cast("array<string>")))), "USABLE_TIERS_ORDER"),
        (judged & differs(F.col("lowest_usable_tier"), lowest_tier(F.coalesce(usable, F.array().cast("array<string>")))), "LOWEST_USABLE_TIER"),
        (judged & differs(F.coalesce(structural, F.array().cast("array<string>")), ordered_tiers(F.coalesce(structural, F.array().cast("array<string>")))), "STRUCTURAL_TIERS_ORDER"),
        (judged & differs(F.col("lowest_structurally_adequate_tier"), lowest_tier(F.coalesce(structural, F.array().cast("array<string>")))), "LOWEST_STRUCTURAL_TIER"),
        (judged & differs(F.coalesce("degraded_tiers", F.array().cast("array<string>")), degraded_tiers(usable, structural)), "DEGRADED_TIERS"),
        (judged & differs(F.col("higher_tier_degraded"), F.size(degraded_tiers(usable, structural)) > 0), "HIGHER_TIER_DEGRADED"),
        (drawn & (F.size(F.array_distinct(ids)) != F.size(ids)), "ELEMENT_IDS_REPEATED"),
        (drawn & (F.size(F.array_distinct(orders)) != F.size(orders)), "READING_ORDER_REPEATED"),
        (drawn & differs(orders, expected), "READING_ORDER_GAPS"),
        (drawn & (F.size(F.array_distinct(names)) != F.size(names)), "BOUNDARY_IDS_REPEATED"),
        (drawn & F.exists("boundaries", lambda b: ~F.array_contains(ids, b["before_element_id"])), "BEFORE_ELEMENT_UNKNOWN"),
        (drawn & F.exists("boundaries", lambda b: ~F.array_contains(ids, b["after_element_id"])), "AFTER_ELEMENT_UNKNOWN"),
        (drawn & F.exists("boundaries", lambda b: b["before_element_id"] == b["after_element_id"]), "BOUNDARY_JOINS_ITSELF"),
    )


def fold(annotations: DataFrame, judgements: DataFrame) -> DataFrame:
    """Judgements (case_id, page, derived fields) written over annotations; a structural annotation that exists
    keeps its status and scope. Both sides must cover the same pages."""
    keys = ["case_id", "page"]
    for a, b, what in ((judgements, annotations, "unexpected"), (annotations, judgements, "missing")):
        if a.join(b, keys, "left_anti").limit(1).count():
            raise ValueError(f"{what} judgement")
    fields = ["script", "usable_tiers", "structurally_adequate_tiers", "lowest_usable_tier", "lowest_structurally_adequate_tier", "degraded_tiers", "higher_tier_degraded", "annotator", "judged_at"]
    kept = annotations.select(*keys, "stratum", "annotation_status", "structural_scope_status", "text_reference_status")
    structured = F.col("annotation_status").isin("structure-partial", "complete")
    return kept.join(judgements.select(*keys, *fields), keys).withColumns({
        "structural_scope_status": F.when(structured, F.col("structural_scope_status")).otherwise("unavailable"),
        "annotation_status": F.when(structured, F.col("annotation_status")).otherwise("oracle-complete"),
        "text_reference_status": F.coalesce("text_reference_status", F.lit("unavailable")),
    })


def pack_summary(annotations: DataFrame) -> DataFrame:
    """Counts of complete oracle, structure and text references by stratum, and in total (stratum `all`)."""
    rows = annotations.groupingSets([["stratum"], []], "stratum").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("annotation_status") != "pending").alias("oracle_complete"),
        F.count_if(F.col("annotation_status").isin("structure-partial", "complete")).alias("structure_annotated"),
        F.count_if(F.col("text_reference_status") == "available").alias("text_references"),
    )
    return rows.withColumn("stratum", F.coalesce("stratum", F.lit("all")))


def script_histogram(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("script").agg(F.count("*").alias("pages"))


def degradation_counts(derived: DataFrame, by: str = "partition") -> DataFrame:
    """(by, pages, degraded_pages): pages, and those where a higher tier is worse than a lower one."""
    return derived.groupBy(by).agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.size("degraded_tiers"), F.lit(0)) > 0).alias("degraded_pages"))


def holds_frozen(value: object, frozen: object) -> bool:
    """Whether a value is a frozen criterion to the letter: the same JSON, keys in the same order."""
    return stringify(value) == stringify(frozen)


def declares_derivation(value: object, derivation: dict) -> bool:
    """Whether a declaration has the derivation's fields, rule and basis, and the date (year-month-day) of its use."""
    if not isinstance(value, dict):
        return False
    applied = value.get("appliedAt")
    same = stringify(value.get("fields")) == stringify(derivation["fields"]) and all(value.get(k) == derivation[k] for k in ("rule", "basis"))
    return same and isinstance(applied, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", applied) is not None


def frozen_criterion(frozen: object):
    """A function of a column of JSON texts: whether each is the frozen criterion; null isn't."""
    want = stringify(frozen)

    @F.pandas_udf("boolean")
    def same(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and stringify(json.loads(t)) == want)

    return same
