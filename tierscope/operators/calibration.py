"""Threshold grids and the choice of a candidate. The grids are literals, so their cross joins are bounded."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import TIERS
from ..functions.structure import canonical_json, sha256_text
from .gate import COMPONENTS
from .signals import expected_tier, route
from .work import written

# The declared grids.
ROUTING_GRID = {"coverage": (0.25, 0.5, 0.75), "full_page_image": (0.25, 0.5, 0.75), "anomaly": (0.01, 0.02, 0.05)}
GATE_GRID = {"character_sanity": (0.9, 0.95, 0.99), "text_retention": (0.25, 0.5, 0.75), "usable_page_ratio": (0.25, 0.5, 0.75), "structural_yield": (1.0,), "script_consistency": (0.5, 0.8, 0.95)}


def grid(spark: SparkSession, axes: dict[str, Sequence[float]]) -> DataFrame:
    """All combinations, one row each, columns t_<axis>."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(f"t_{name}", F.explode(F.array(*map(F.lit, values))))
    return out


def accepted_by_all_pages(judgements: DataFrame, tiers: str, key: str = "case_id") -> DataFrame:
    """(key, tier, accepted): a tier is accepted for a document only if every page's tier set has it."""
    rows = judgements.select(key, tiers, F.explode(F.array(*map(F.lit, TIERS))).alias("tier"))
    return rows.groupBy(key, "tier").agg(F.bool_and(F.array_contains(tiers, F.col("tier"))).alias("accepted"))


def routing_candidates(records: DataFrame, axes: dict[str, Sequence[float]] = ROUTING_GRID) -> DataFrame:
    """Every candidate with correct and denominator over calibration records (signals and stratum), best first.

    A record counts by how many thresholds of each axis it crosses, none for a missing signal, so only as many kinds as the
    grid tells apart meet the grid.
    """
    crossed = {"coverage": lambda t: F.col("text_layer_coverage") < t, "full_page_image": lambda t: F.col("full_page_image_ratio") >= t, "anomaly": lambda t: F.col("encoding_anomaly_ratio") >= t}
    numbers = [sum(F.coalesce(f(t), F.lit(False)).cast("int") for t in axes[a]).alias(f"n_{a}") for a, f in crossed.items()]
    # No threshold of these is crossed: what the route is without them.
    unscanned = route(F.lit(-1.0), F.lit(float("inf")), F.lit(float("inf")))["tier"]
    kinds = records.select(*numbers, unscanned.alias("unscanned"), expected_tier(F.col("stratum")).alias("expected")).groupBy(*(f"n_{a}" for a in crossed), "unscanned", "expected").agg(F.count("*").alias("n"))
    # Coverage is crossed from above, the others from below.
    least = {a: sum(((F.lit(t) >= F.col(f"t_{a}")) if a == "coverage" else (F.lit(t) <= F.col(f"t_{a}"))).cast("int") for t in axes[a]) for a in crossed}
    scanned = reduce(or_, (F.col(f"n_{a}") >= n for a, n in least.items()))
    hit = F.when(scanned, F.lit("T2")).otherwise(F.col("unscanned")) == F.col("expected")
    keys = [f"t_{a}" for a in axes]
    all_ = kinds.crossJoin(F.broadcast(grid(records.sparkSession, axes)))
    out = all_.groupBy(*keys).agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("correct"), F.sum("n").alias("denominator"))
    return _routing_order(out)


def _routing_order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("correct"), F.desc("t_coverage"), "t_full_page_image", "t_anomaly")


def routing_policy_hash(selected: dict, case_ids: list[str], candidates: list[dict]) -> str:
    return sha256_text(canonical_json({"selected": selected, "calibrationCaseIds": case_ids, "candidates": candidates}))


def tune_routing(sample: DataFrame, signals: DataFrame, evaluation_cells: DataFrame | None = None, axes: dict[str, Sequence[float]] = ROUTING_GRID) -> tuple[dict, DataFrame]:
    """Choose routing thresholds on the calibration cases of sample (case_id, stratum, partition).

    Refuses if the partitions overlap, if a calibration case has no signals, or if an evaluation cell exists. Sample and
    signals are read several times, so they should be written tables; the candidates are.
    """
    calibration, evaluation = (sample.where(F.col("partition") == p) for p in ("calibration", "evaluation"))
    if calibration.join(evaluation, "case_id", "left_semi").limit(1).count():
        raise ValueError("calibration and evaluation share cases")
    if calibration.join(signals, "case_id", "left_anti").limit(1).count():
        raise ValueError("a calibration case has no inspection")
    if evaluation_cells is not None and evaluation_cells.limit(1).count():
        raise ValueError("thresholds can't be tuned after evaluation cells exist")
    candidates = _routing_order(written(routing_candidates(calibration.join(signals, "case_id"), axes), "routing-candidates"))
    best = candidates.first()
    return {a: best[f"t_{a}"] for a in axes}, candidates


def gate_candidates(examples: DataFrame, axes: dict[str, Sequence[float]] = GATE_GRID) -> DataFrame:
    """Every threshold vector with its errors over examples (components, reading_accepted,
    structurally_accepted), best first: fewest false accepts in total, then on the worse axis, then false
    rejects likewise, then higher thresholds in component order.

    An example counts by how many thresholds of each component it reaches; a null one reaches all. So examples meet
    as few kinds as the grid tells apart, and only the kinds meet the grid.
    """
    reached = [F.when(F.col(c).isNull(), len(axes[c])).otherwise(sum((F.col(c) >= t).cast("int") for t in axes[c])).alias(f"n_{c}") for c in COMPONENTS]
    count = {"all_": F.count("*")}
    for axis, expected in (("reading", "reading_accepted"), ("structural", "structurally_accepted")):
        count[f"{axis}_wanted"], count[f"{axis}_unwanted"] = F.count_if(F.col(expected)), F.count_if(~F.col(expected))
    kinds = examples.select(*reached, "reading_accepted", "structurally_accepted").groupBy(*(f"n_{c}" for c in COMPONENTS)).agg(*(c.alias(n) for n, c in count.items()))
    # A threshold passes examples that reach at least as many thresholds of its component as lie at or below it.
    least = [sum((F.lit(t) <= F.col(f"t_{c}")).cast("int") for t in axes[c]) for c in COMPONENTS]
    passed = reduce(and_, (F.col(f"n_{c}") >= n for c, n in zip(COMPONENTS, least, strict=True)))
    all_ = kinds.crossJoin(F.broadcast(grid(examples.sparkSession, axes))).withColumn("passed", passed)
    keys = [f"t_{c}" for c in COMPONENTS]
    total = lambda when, n: F.sum(F.when(when, F.col(n)).otherwise(F.lit(0)))
    errors = [f(axis) for axis in ("reading", "structural") for f in (lambda a: total(F.col("passed"), f"{a}_unwanted").alias(f"{a}_false_accepts"), lambda a: total(~F.col("passed"), f"{a}_wanted").alias(f"{a}_false_rejects"))]
    out = all_.groupBy(*keys).agg(F.sum("all_").alias("denominator"), *errors)
    for kind in ("false_accepts", "false_rejects"):
        a, b = F.col(f"reading_{kind}"), F.col(f"structural_{kind}")
        out = out.withColumn(f"total_{kind}", a + b).withColumn(f"worst_{kind}", F.greatest(a, b))
    return _gate_order(out)


def _gate_order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("total_false_accepts", "worst_false_accepts", "total_false_rejects", "worst_false_rejects", *(F.desc(f"t_{c}") for c in COMPONENTS))


def select_gate(examples: DataFrame, axes: dict[str, Sequence[float]] = GATE_GRID) -> tuple[dict, DataFrame]:
    """The best threshold vector, and all candidates. These are written once, so that the examples aren't scored again for each use."""
    candidates = _gate_order(written(gate_candidates(examples, axes), "gate-candidates"))
    best = candidates.first()
    return {c: best[f"t_{c}"] for c in COMPONENTS}, candidates
