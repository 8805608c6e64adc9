"""Inspection: page counts, document signals, strata, initial routes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import reasons
from ..functions.text import character_counts


@dataclass(frozen=True)
class Inspection:
    minimum_text_chars: int = 32
    full_page_image: float = 0.8
    mixed_script: float = 0.1


@dataclass(frozen=True)
class Routing:
    """Thresholds of coverage (least), full-page images and encoding anomalies (most)."""

    coverage: float = 0.5
    full_page_image: float = 0.5
    anomaly: float = 0.02


#: The thresholds that calibration chose; strata keep the defaults.
TUNED = Routing(0.75, 0.25, 0.01)


def inspect_pages(evidence: DataFrame, key: str = "case_id", normalised: bool = False) -> DataFrame:
    """Page evidence (key, page, text, image_area_ratio) with its character counts.

    normalised: the texts are NFC already.
    """
    text = F.coalesce("text", F.lit(""))
    counted = evidence.withColumn("counts", character_counts(text, normalise=not normalised))
    return counted.select(key, "page", "counts.*", "image_area_ratio")


def document_signals(pages: DataFrame, thresholds: Inspection = Inspection(), key: str = "case_id") -> DataFrame:
    """Signals by document. Image signals are null unless every page has its ratio."""
    images = F.bool_and(F.col("image_area_ratio").isNotNull())
    totals = pages.groupBy(key).agg(
        F.count("*").alias("page_count"),
        F.sum("text_chars").alias("total_text_chars"),
        F.avg("text_chars").alias("chars_per_page"),
        (F.count_if(F.col("text_chars") >= thresholds.minimum_text_chars) / F.count("*")).alias("text_layer_coverage"),
        F.stddev_pop("text_chars").alias("sd"),
        F.when(images, F.sum("image_area_ratio") / F.count("*")).alias("mean_image_area_ratio"),
        F.when(images, F.count_if(F.col("image_area_ratio") >= thresholds.full_page_image) / F.count("*")).alias("full_page_image_ratio"),
        F.sum("anomalous_chars").alias("anomalous"),
        F.sum("letter_chars").alias("letters"),
        F.sum("thai_chars").alias("thai"),
        F.sum("latin_chars").alias("latin"),
    )
    return _with_ratios(totals, F.col("letters"), thresholds).select(key, "page_count", "total_text_chars", "chars_per_page", "text_layer_coverage", "chars_per_page_cv", "mean_image_area_ratio", "full_page_image_ratio", "encoding_anomaly_ratio", "thai_char_ratio", "latin_char_ratio", "mixed_script")


def _with_ratios(totals: DataFrame, letters: Column, thresholds: Inspection) -> DataFrame:
    share = lambda n: F.when(letters > 0, n / F.when(letters > 0, letters)).otherwise(F.lit(0.0))
    out = totals.withColumns({"thai_char_ratio": share(F.col("thai")), "latin_char_ratio": share(F.col("latin"))})
    mean = F.col("chars_per_page")
    return out.withColumns({
        "chars_per_page_cv": F.when(mean == 0, F.lit(0.0)).otherwise(F.col("sd") / F.when(mean != 0, mean)),
        "encoding_anomaly_ratio": F.col("anomalous") / F.greatest(F.lit(1), F.col("total_text_chars")),
        "mixed_script": (F.col("thai_char_ratio") >= thresholds.mixed_script) & (F.col("latin_char_ratio") >= thresholds.mixed_script),
    })


def sampled_signals(pages: DataFrame, chosen: DataFrame, key: str = "case_id") -> DataFrame:
    """Page count, characters and script ratios of chosen (key, page) only; here Thai and Latin letters together
    are the denominator."""
    totals = pages.join(chosen.select(key, "page").distinct(), [key, "page"]).groupBy(key).agg(F.count("*").alias("page_count"), F.sum("text_chars").alias("total_text_chars"), F.sum("thai_chars").alias("thai"), F.sum("latin_chars").alias("latin"))
    both = F.col("thai") + F.col("latin")
    share = lambda c: F.when(both > 0, F.col(c) / F.when(both > 0, both)).otherwise(F.lit(0.0))
    return totals.select(key, "page_count", "total_text_chars", share("thai").alias("thai_char_ratio"), share("latin").alias("latin_char_ratio"))


def stratum(routing: Routing = Routing(), inspection: Inspection = Inspection()) -> Column:
    """The stratum of a row of signals; a missing full-page signal counts as 0."""
    degraded = (F.col("text_layer_coverage") < routing.coverage) | (F.coalesce("full_page_image_ratio", F.lit(0.0)) >= routing.full_page_image) | (F.col("encoding_anomaly_ratio") >= routing.anomaly)
    thai = (F.col("thai_char_ratio") >= inspection.mixed_script) | F.col("mixed_script")
    layout = (F.coalesce("mean_image_area_ratio", F.lit(0.0)) >= 0.2) | (F.col("chars_per_page_cv") >= 0.75)
    return F.when(degraded & thai, "scanned-degraded-thai-mixed").when(degraded, "scanned-degraded-en").when(layout, "layout-heavy-born-digital").otherwise("born-digital-en")


def route(coverage: Column, images: Column, anomaly: Column) -> Column:
    """(tier, rationale, confidence) of a row of signals under thresholds given as columns.

    A missing signal is noted and halves the confidence; it triggers nothing by itself.
    """
    missing = F.col("text_layer_coverage").isNull() | F.col("full_page_image_ratio").isNull() | F.col("encoding_anomaly_ratio").isNull()
    low = F.coalesce(F.col("text_layer_coverage") < coverage, F.lit(False))
    full = F.coalesce(F.col("full_page_image_ratio") >= images, F.lit(False))
    odd = F.coalesce(F.col("encoding_anomaly_ratio") >= anomaly, F.lit(False))
    scanned = low | full | odd
    complex_ = (F.coalesce("mean_image_area_ratio", F.lit(0.0)) >= 0.2) | (F.coalesce("chars_per_page_cv", F.lit(0.0)) >= 0.75)
    return F.struct(
        F.when(scanned, "T2").when(complex_, "T1").otherwise("T0").alias("tier"),
        reasons((missing, "MISSING_REQUIRED_SIGNAL"), (low, "LOW_TEXT_LAYER_COVERAGE"), (full, "HIGH_FULL_PAGE_IMAGE_RATIO"), (odd, "ENCODING_ANOMALY"), (scanned & F.col("mixed_script"), "MIXED_SCRIPT"), (~scanned & complex_, "STRUCTURE_COMPLEXITY"), (~scanned & ~complex_, "TEXT_LAYER_INTACT")).alias("rationale"),
        F.when(missing, 0.5).otherwise(1.0).alias("confidence"),
    )


def initial_route(signals: DataFrame, routing: Routing = TUNED) -> DataFrame:
    return signals.withColumn("route", route(F.lit(routing.coverage), F.lit(routing.full_page_image), F.lit(routing.anomaly)))


def expected_tier(stratum_: Column) -> Column:
    return F.when(stratum_ == "born-digital-en", "T0").when(stratum_ == "layout-heavy-born-digital", "T1").otherwise("T2")
