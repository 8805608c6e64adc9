"""Seeded stratified sampling, page selection and page declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import STRATA
from ..functions.structure import canonical_json, sha256_text
from .signals import Inspection, Routing, stratum


def seeded_rank(seed: str, context: Column, value: Column) -> Column:
    """A hash whose order is the seed's order of values in a context."""
    return F.sha2(F.concat_ws("\x00", F.lit(seed), context, value), 256)


def case_ids(sources: DataFrame, key: str = "source_key", prefix: int = 3) -> DataFrame:
    """Stable ids F001, F002, ... by source key, a string; beyond 999 they widen. Null keys get none.

    Keys are numbered within their prefix and prefixes by the counts before them, so only the counts, at most
    one row a prefix, meet in one task; source keys are hashes, whose prefixes are even.
    """
    rows = sources.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct().withColumn("prefix", F.substring(key, 1, prefix))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("prefix").agg(F.count("*").alias("n")).select("prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("prefix").orderBy(key))).join(ahead, "prefix")
    return numbered.select(key, F.format_string("F%03d", F.col("r") + F.col("ahead")).alias("case_id"))


def adjusted_strata(signals: DataFrame, adjustments: DataFrame | None = None, routing: Routing = Routing(), inspection: Inspection = Inspection(), reviewed: bool = False) -> DataFrame:
    """Signals with their stratum, overridden by reviewed adjustments (case_id, from_stratum, to_stratum, reason).

    Refuses adjustments without a review, repeated or unknown cases, a wrong origin, or no change.
    """
    rows = signals.withColumn("stratum", stratum(routing, inspection))
    if adjustments is None:
        return rows
    if not reviewed and adjustments.limit(1).count():
        raise ValueError("adjustments need a completed review")
    joined = adjustments.join(rows.select("case_id", F.col("stratum").alias("was")), "case_id", "left")
    bad = joined.where("was IS NULL OR was <> from_stratum OR from_stratum = to_stratum").limit(1).count()
    if bad or adjustments.groupBy("case_id").count().where("count > 1").limit(1).count():
        raise ValueError("an adjustment is repeated, unknown, misdeclared or changes nothing")
    return rows.join(adjustments.select("case_id", "to_stratum"), "case_id", "left").withColumn("stratum", F.coalesce("to_stratum", "stratum")).drop("to_stratum")


def draw(cases: DataFrame, seed: str, calibration: int = 2, evaluation: int = 4, least_pages: int = 2, strict: bool = True) -> DataFrame:
    """(case_id, stratum, page_count, partition): by stratum the first cases in the seed's order, calibration
    before evaluation; cases with too few pages don't count. strict: raises where a stratum has too few.

    Only the first of each stratum are wanted, so the window keeps that many in each task before the shuffle.
    """
    order = Window.partitionBy("stratum").orderBy(seeded_rank(seed, F.col("stratum"), F.col("case_id").cast("string")))
    ranked = cases.where(F.col("page_count") >= least_pages).withColumn("r", F.row_number().over(order)).where(F.col("r") <= calibration + evaluation)
    if strict:
        found = {r[0]: r[1] for r in ranked.groupBy("stratum").count().collect()}
        short = [s for s in STRATA if found.get(s, 0) < calibration + evaluation]
        if short:
            raise ValueError(f"too few eligible cases: {', '.join(short)}")
    return ranked.select("case_id", "stratum", "page_count", F.when(F.col("r") <= calibration, "calibration").otherwise("evaluation").alias("partition"))


def page_score(stratum_: Column, text_chars: Column, image: Column, warnings: Column, mean_chars: Column) -> Column:
    """How telling a page is: images and missing text in scans, deviation from the usual length elsewhere."""
    deviation = F.abs(text_chars - mean_chars) / F.greatest(F.lit(1.0), mean_chars)
    image = F.coalesce(image, F.lit(0.0))
    return F.when(stratum_.startswith("scanned"), F.when(text_chars < 32, 2.0).otherwise(0.0) + image + warnings * 0.1).when(stratum_ == "layout-heavy-born-digital", image + deviation).otherwise(deviation)


def select_pages(cases: DataFrame, pages: DataFrame, seed: str, count: int = 2) -> DataFrame:
    """(case_id, pages): the count best pages of each case, ties in the seed's order, in page order.

    cases: case_id, stratum, chars_per_page. pages: case_id, page, text_chars, image_area_ratio, warnings (a count).
    """
    rows = pages.join(cases.select("case_id", "stratum", "chars_per_page"), "case_id")
    score = page_score(F.col("stratum"), F.col("text_chars"), F.col("image_area_ratio"), F.col("warnings"), F.col("chars_per_page"))
    tie = seeded_rank(seed, F.concat(F.col("case_id").cast("string"), F.lit(":page")), F.col("page").cast("string"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(score), tie))).where(F.col("r") <= count)
    return best.groupBy("case_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def assert_disjoint(sample: DataFrame) -> None:
    both = sample.where("partition = 'calibration'").join(sample.where("partition = 'evaluation'"), "case_id", "left_semi")
    if both.limit(1).count():
        raise ValueError("calibration and evaluation share cases")


def sample_summary(sample: DataFrame) -> DataFrame:
    """Cases by stratum, one column a partition, and pages."""
    n = lambda p: F.count_if(F.col("partition") == p)
    return sample.groupBy("stratum").agg(n("calibration").alias("calibration"), n("evaluation").alias("evaluation"), F.sum("page_count").alias("pages"))


def declare_pages(sample: DataFrame, selected: DataFrame) -> tuple[DataFrame, str]:
    """The declaration (partition, case_id, stratum, pages) and its SHA-256. Evaluation pages that the sample
    has frozen must be the selected ones."""
    rows = sample.join(selected.withColumnRenamed("pages", "chosen"), "case_id")
    frozen = F.col("pages") if "pages" in sample.columns else F.lit(None).cast("array<int>")
    if rows.where((F.col("partition") == "evaluation") & frozen.isNotNull() & (frozen.cast("array<long>") != F.col("chosen").cast("array<long>"))).limit(1).count():
        raise ValueError("selected pages differ from the frozen ones")
    out = rows.select("partition", "case_id", "stratum", F.col("chosen").alias("pages"))
    # A sample has a handful of cases by stratum.
    listed = [r.asDict() for r in out.orderBy("partition", "case_id").collect()]
    return out, sha256_text(canonical_json(listed))


def declared_counts(declaration: DataFrame) -> DataFrame:
    """Documents and pages by partition and stratum, by partition, and in total (`all`)."""
    out = declaration.groupingSets([["partition", "stratum"], ["partition"], []], "partition", "stratum").agg(F.count("*").alias("documents"), F.sum(F.size("pages")).alias("pages"))
    return out.withColumns({"partition": F.coalesce("partition", F.lit("all")), "stratum": F.coalesce("stratum", F.lit("all"))})


def cell_name(partition: Column, case_id: Column, tier: Column, page: Column | None = None) -> Column:
    """File name of a run cell, and of a page's."""
    middle = [] if page is None else [F.format_string("P%04d", page)]
    return F.concat(F.concat_ws("-", partition, case_id, *middle, tier), F.lit(".json"))
