"""Run cells: completeness, timing cubes, page timing, calibration, budgets and cost proxies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import STATUSES, STRATA, TIERS, ratio_value
from .quantiles import percentiles, with_percentiles


@dataclass(frozen=True)
class Tariff:
    """Declared comparison rates for a machine hour; not billed spend."""

    cpu_hour: float = 0.1
    gpu_hour: float = 1.0


def matrix_gaps(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap): cells missing, unexpected or repeated; empty if the matrix is complete."""
    missing = expected.join(actual, keys, "left_anti").select(*keys, F.lit("missing").alias("gap"))
    unexpected = actual.join(expected, keys, "left_anti").select(*keys, F.lit("unexpected").alias("gap")).distinct()
    repeated = actual.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated").alias("gap"))
    return missing.unionByName(unexpected).unionByName(repeated)


def expected_cells(sample: DataFrame, tiers: tuple[str, ...] = TIERS[:3]) -> DataFrame:
    """(partition, tier, case_id) of a full matrix."""
    return sample.select("partition", "case_id", F.explode(F.array(*map(F.lit, tiers))).alias("tier"))


def todo_cells(expected: DataFrame, actual: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Cells yet to run, calibration first, by tier and case; at most limit of them, the rest another time."""
    left = expected.join(actual, keys, "left_anti").orderBy("partition", "tier", *[k for k in keys if k not in ("partition", "tier")])
    return left if limit is None else left.limit(limit)


def declared_page_cells(cells: DataFrame, declaration: DataFrame) -> DataFrame:
    """Page cells (case_id, page, ...) with the partition and stratum of their declared page (partition, case_id,
    stratum, pages). Raises on a cell outside the declaration."""
    pages = declaration.select("partition", "case_id", "stratum", F.explode("pages").alias("page"))
    rows = cells.drop("partition", "stratum").join(pages, ["case_id", "page"], "left")
    outside = F.raise_error(F.concat(F.lit("page cell outside the declaration: "), F.col("case_id").cast("string"), F.lit(":"), F.col("page").cast("string")))
    return rows.withColumn("partition", F.when(F.col("partition").isNull(), outside.cast("string")).otherwise(F.col("partition")))


def undeclared_page_cells(cells: DataFrame, declaration: DataFrame) -> DataFrame:
    """The page cells (case_id, page, ...) that a declaration (case_id, pages) doesn't have; declared_page_cells raises on one."""
    return cells.join(declaration.select("case_id", F.explode("pages").alias("page")), ["case_id", "page"], "left_anti")


def with_page_counts(sample: DataFrame, inspections: DataFrame) -> DataFrame:
    """The sample with page_count of the inspections (case_id, page_count), 0 for cases without one."""
    return sample.drop("page_count").join(inspections.select("case_id", "page_count"), "case_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def status_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def _group_columns(tariff: Tariff) -> list[Column]:
    done = (F.col("status") == "succeeded") & F.coalesce("has_artifact", F.lit(False))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    reported = F.col("provider_timing_status") == "observed"
    marginal = F.when(reported, F.coalesce("provider_ms", F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), F.col("wall_ms") - F.coalesce("fixed_overhead_ms", F.lit(0.0))))
    return [
        F.count_if(done).alias("succeeded"),
        F.count("status").alias("documents"),
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES[1:]),
        total(F.col("page_count"), done).alias("pages"),
        total(F.col("page_count"), F.lit(True)).alias("all_pages"),
        total(F.col("page_count"), F.col("status") != "succeeded").alias("excluded_pages"),
        F.count_if(done & F.coalesce("cache_hit", F.lit(False))).alias("cache_hits"),
        F.coalesce(F.sum(F.when(done, F.col("wall_ms"))), F.lit(0.0)).alias("wall_raw"),
        F.coalesce(F.sum(F.when(done, marginal)), F.lit(0.0)).alias("marginal_raw"),
        F.count_if(done & reported).alias("provider_reported"),
        F.count_if(done & ~F.coalesce(reported, F.lit(False))).alias("client_observed"),
        F.coalesce(F.sum(F.when(F.col("status") == "censored", F.coalesce("observed_minimum_wall_ms", F.lit(0.0)))), F.lit(0.0)).alias("censored_raw"),
    ]


def timing_cube(cells: DataFrame, overheads: DataFrame | None = None, tariff: Tariff = Tariff(), partitions: tuple[str, ...] = ("calibration", "evaluation"), strata: tuple[str, ...] = STRATA, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """Tier by overall, partition and stratum, every combination present, groups without cells as zeros.

    cells: case_id, tier, partition, stratum, page_count, status, has_artifact, wall_ms, provider_id,
    provider_ms, provider_timing_status, cache_hit, observed_minimum_wall_ms. overheads: provider_id,
    fixed_overhead_ms; a provider without one has 0. Excluded documents are those failed, unavailable or
    censored; a success without an artifact is neither counted nor excluded.
    """
    rows = cells.join(overheads, "provider_id", "left") if overheads is not None else cells.withColumn("fixed_overhead_ms", F.lit(0.0))
    cube = rows.groupingSets([["tier"], ["tier", "partition"], ["tier", "stratum"]], "tier", "partition", "stratum").agg(F.grouping_id().alias("level"), *_group_columns(tariff))
    group = F.when(F.col("level") == 3, "overall").when(F.col("level") == 1, F.concat(F.lit("partition:"), "partition")).otherwise(F.concat(F.lit("stratum:"), "stratum"))
    cube = cube.withColumn("group", group)
    groups = ["overall", *(f"partition:{p}" for p in partitions), *(f"stratum:{s}" for s in strata)]
    scaffold = cells.sparkSession.createDataFrame([(t, g) for t in tiers for g in groups], "tier string, group string")
    out = F.broadcast(scaffold).join(cube, ["tier", "group"], "left").drop("partition", "stratum", "level").na.fill(0)
    wall, marginal, n, pages = F.col("wall_raw"), F.col("marginal_raw"), F.col("succeeded"), F.col("pages")
    rate = F.when(F.col("tier") == "T3", tariff.gpu_hour).otherwise(tariff.cpu_hour)
    return out.withColumns({
        "excluded": F.col("failed") + F.col("unavailable") + F.col("censored"),
        "wall_ms": F.round(wall, 6),
        "marginal_ms": F.round(marginal, 6),
        "mean_wall_ms": F.when(n > 0, F.round(wall / F.when(n > 0, n), 6)),
        "marginal_ms_per_page": F.when(pages > 0, F.round(marginal / F.when(pages > 0, pages), 6)),
        "censored_minimum_wall_ms": F.round("censored_raw", 6),
        "cost_proxy_usd": F.round(marginal / 3_600_000 * rate, 6),
    }).drop("wall_raw", "marginal_raw", "censored_raw")


def page_timing(cells: DataFrame, by: list[list[str]]) -> DataFrame:
    """Page cells by grouping sets: counts by status, total, mean, lower median, least and most wall time of
    those that succeeded and were timed."""
    if cells.select("provider_id").distinct().limit(2).count() > 1:
        raise ValueError("page timing needs a single provider")
    return page_groups(cells, by)


def page_groups(cells: DataFrame, by: list[list[str]]) -> DataFrame:
    columns = list(dict.fromkeys(c for s in by for c in s))
    wall = F.when((F.col("status") == "succeeded") & F.col("wall_ms").isNotNull(), F.col("wall_ms"))
    out = cells.groupingSets([[F.col(c) for c in s] for s in by], *columns).agg(
        F.grouping_id().alias("set_"),
        F.count(wall).alias("numerator"), F.count("*").alias("denominator"), (F.count("*") - F.count(wall)).alias("excluded_count"),
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
        F.coalesce(F.sum(wall), F.lit(0.0)).alias("total_ms"), F.min(wall).alias("min_ms"), F.max(wall).alias("max_ms"))
    # The rows of each grouping set, named as grouping_id does.
    timed, kinds = cells.where(wall.isNotNull()), {f.name: f.dataType for f in cells.schema.fields}
    parts = [timed.select(F.lit(sum(1 << i for i, c in enumerate(reversed(columns)) if c not in s)).cast("long").alias("set_"), *(F.col(c) if c in s else F.lit(None).cast(kinds[c]).alias(c) for c in columns), "wall_ms") for s in by]
    found = percentiles(reduce(DataFrame.unionByName, parts), ["set_", *columns], "wall_ms", nearest={"median_ms": 0.5})
    out = with_percentiles(out, found, ["set_", *columns], ["median_ms"]).drop("set_")
    n = F.col("numerator")
    return out.withColumns({"total_ms": F.round("total_ms", 3), "total_minutes": F.round(F.col("total_ms") / 60_000, 3), "mean_ms": F.when(n > 0, F.round(F.col("total_ms") / F.when(n > 0, n), 3))})


def page_count_profile(documents: DataFrame, column: str = "page_count") -> DataFrame:
    """Nearest-rank percentiles, least, most and mean of page counts; all 0 without documents."""
    ranks = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    out = documents.agg(F.count("*").alias("documents"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))
    out = with_percentiles(out, percentiles(documents, [], column, nearest=ranks), [], list(ranks))
    out = out.select("documents", *(F.col(r).cast("long").alias(r) for r in ranks), "min", "max", "mean")
    return out.na.fill(0)


def calibrate_overheads(samples: DataFrame) -> DataFrame:
    """(provider_id, fixed_overhead_ms, basis) of probe samples (provider_id, wall_ms, provider_ms,
    baseline_ms): the median of wall less reported time, or the median of baseline calls where nothing is
    reported. Raises where a provider has neither."""
    known = F.col("provider_ms").isNotNull()
    groups = samples.groupBy("provider_id").agg((F.count("provider_ms") > 0).alias("reported"), F.count("baseline_ms").alias("n_baseline"))
    values = samples.select("provider_id", F.when(known, F.col("wall_ms") - F.col("provider_ms")).alias("rest"), "baseline_ms")
    out = groups
    for column, name in (("rest", "rest_median"), ("baseline_ms", "baseline_median")):
        out = with_percentiles(out, percentiles(values, ["provider_id"], column, between={name: 0.5}), ["provider_id"], [name])
    reported = F.col("reported")
    overhead = F.when(reported, F.greatest(F.lit(0.0), "rest_median")).when(F.col("n_baseline") > 0, F.col("baseline_median")).otherwise(F.raise_error(F.lit("a provider has no sample to take a median of")).cast("double"))
    return out.select("provider_id", F.round(overhead, 3).alias("fixed_overhead_ms"), F.when(reported, "provider-reported").otherwise("client-observed-wall-minus-baseline-proxy").alias("basis"))


def timing_and_cost(observations: DataFrame, mark: bool = False) -> DataFrame:
    """Marginal time with its basis, ratio to T0, billed cost (excluded where null) and machine-time proxy.

    Raises on negative durations or rates and on a T0 time that isn't positive; mark: such rows have refused true and
    no figures instead.
    """
    bad = (F.col("wall_ms") < 0) | (F.col("fixed_overhead_ms") < 0) | (F.col("machine_hourly_rate") < 0) | (F.col("t0_wall_ms") <= 0)
    reported = (F.col("provider_timing_status") == "observed") & F.col("provider_ms").isNotNull()
    bad = F.coalesce(bad, F.lit(False))
    refused = F.lit(None) if mark else F.raise_error(F.lit("negative duration or rate, or no T0 baseline"))
    wall = F.when(bad, refused.cast("double")).otherwise(F.col("wall_ms"))
    return observations.withColumns({
        **({"refused": bad} if mark else {}),
        "marginal_ms": F.when(reported & ~(bad if mark else F.lit(False)), F.col("provider_ms")).when(~bad if mark else F.lit(True), F.greatest(F.lit(0.0), wall - F.col("fixed_overhead_ms"))),
        "marginal_basis": F.when(reported, "provider-reported").otherwise("client-observed-wall-minus-baseline-proxy"),
        "t0_ratio": ratio_value(wall, F.col("t0_wall_ms")),
        "billed_excluded": F.when(F.col("billed_cost").isNull(), 1).otherwise(0),
        "machine_time_proxy": wall / 3_600_000 * F.col("machine_hourly_rate"),
    })


# Measured page times in milliseconds.
BORN_DIGITAL_MS, SCANNED_WARM_MS, COLD_START_WALL_MS = 2856.500583, (7499.753416 + 7564.891833) / 2, 38_500.0
COLD_START_SURCHARGE_MS, ALLOWANCE_MS = 30967.6773755, 2 * 60 * 60 * 1000


def project_pages(counts: DataFrame, column: str = "page_count") -> DataFrame:
    """Hours for a number of pages: born digital, scanned and warm, the same with one cold start if there is a page."""
    n = F.col(column)
    cold = F.when(n > 0, COLD_START_WALL_MS - SCANNED_WARM_MS).otherwise(0.0)
    return counts.withColumns({"born_digital_hours": n * BORN_DIGITAL_MS / 3_600_000, "scanned_warm_hours": n * SCANNED_WARM_MS / 3_600_000, "scanned_cold_hours": (n * SCANNED_WARM_MS + cold) / 3_600_000})


def page_budget(sample: DataFrame, dense_wall_ms: float, censored_minimum_ms: float, calibration_pages: int = 2, censored_pages: int = 10) -> DataFrame:
    """One row: pages to run, projected warm, cold and doubled durations, and whether they fit the allowance.

    sample: partition, pages (array). Raises if the observations aren't positive or an evaluation document
    hasn't two pages.
    """
    if dense_wall_ms <= 0 or censored_minimum_ms <= 0:
        raise ValueError("observations must be positive")
    if sample.where("partition = 'evaluation' AND size(pages) <> 2").limit(1).count():
        raise ValueError("evaluation documents must have two pages")
    calibration = F.col("partition") == "calibration"
    out = sample.agg(F.count_if(calibration).alias("calibration_documents"), F.count_if(~calibration).alias("evaluation_documents"), F.coalesce(F.sum(F.when(~calibration, F.size("pages"))), F.lit(0)).alias("evaluation_pages"))
    out = out.withColumn("calibration_pages", F.col("calibration_documents") * calibration_pages).withColumn("total_pages", F.col("calibration_pages") + F.col("evaluation_pages"))
    n = F.col("total_pages")
    out = out.withColumns({"warm_ms": n * dense_wall_ms, "warm_cold_ms": n * dense_wall_ms + COLD_START_SURCHARGE_MS, "doubled_ms": n * dense_wall_ms * 2, "permitted_ms_per_page": F.when(n > 0, F.lit(float(ALLOWANCE_MS)) / F.when(n > 0, n)), "censored_multiple": F.lit(censored_minimum_ms / (censored_pages * dense_wall_ms))})
    return out.withColumns({"warm_fits": F.col("warm_ms") <= ALLOWANCE_MS, "doubled_fits": F.col("doubled_ms") <= ALLOWANCE_MS})
