"""Metric values, tiers and small column helpers. Unavailable stays null; no division is unguarded."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TIERS = ("T0", "T1", "T2", "T3")
STATUSES = ("succeeded", "failed", "unavailable", "censored")
STRATA = ("born-digital-en", "layout-heavy-born-digital", "scanned-degraded-en", "scanned-degraded-thai-mixed")
#: Bytes of an Arrow batch on the way to Python, unless the session has a bound of its own.
BATCH_BYTES = 2 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """Rows go to Python in batches of bounded bytes: by count alone a worker would hold ten thousand texts, and what it makes of
    them, at once. A setting of the session; one of its own stays."""
    conf = (spark or SparkSession.active()).conf
    if int(str(conf.get(_BATCH, str(_BATCH_DEFAULT))).rstrip("bB") or 0) == _BATCH_DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))


def tier_rank(tier: Column) -> Column:
    """0 to 3; null for anything else."""
    return F.when(tier.isin(*TIERS), F.array_position(F.array(*map(F.lit, TIERS)), tier) - 1)


def ordered_tiers(tiers: Column) -> Column:
    """The known tiers of a set, each once, T0 first."""
    return F.filter(F.array(*map(F.lit, TIERS)), lambda t: F.array_contains(tiers, t))


def ratio_value(numerator: Column, denominator: Column, excluded: Column | int = 0) -> Column:
    """numerator / denominator; by zero 0 if nothing was counted or excluded, else null."""
    excluded = F.lit(excluded) if isinstance(excluded, int) else excluded
    return F.when(denominator != 0, numerator.cast("double") / denominator).when((numerator == 0) & (excluded == 0), F.lit(0.0))


def metric(numerator: Column, denominator: Column, excluded: Column | int = 0) -> Column:
    """A metric value: numerator, denominator, excluded count, value."""
    excluded = F.lit(excluded) if isinstance(excluded, int) else excluded
    return F.struct(numerator.alias("numerator"), denominator.alias("denominator"), excluded.alias("excluded_count"), ratio_value(numerator, denominator, excluded).alias("value"))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names, in order, whose condition holds."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs)))


def percentage(numerator: Column, denominator: Column) -> Column:
    """`12.3% (n/d)`, or `unavailable` without a denominator."""
    return F.when(denominator > 0, F.format_string("%.1f%% (%d/%d)", 100.0 * numerator / F.when(denominator > 0, denominator), numerator.cast("long"), denominator.cast("long"))).otherwise(F.lit("unavailable"))


def minutes(ms: Column) -> Column:
    return ms / 60_000


def hours(ms: Column) -> Column:
    return ms / 3_600_000
