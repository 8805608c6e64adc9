"""Report values: every number with numerator, denominator and excluded count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import percentage

LABELS = ("observed", "sampled", "projected", "unavailable")


def value_name(key: Column, fixed: dict[str, str] | None = None) -> Column:
    """A readable name of a dotted key: a fixed one, or spaces for dots and underscores and a capital first."""
    plain = F.translate(key, "._", "  ")
    name = F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))
    if not fixed:
        return name
    known = F.create_map(*(F.lit(x) for kv in fixed.items() for x in kv))
    return F.coalesce(F.try_element_at(known, key), name)


def metric_values(rows: DataFrame, label: str = "observed") -> DataFrame:
    """Values from (key, numerator, denominator, excluded_count, value)."""
    return rows.select("key", value_name(F.col("key")).alias("name"), F.lit(label).alias("label"), F.col("value").cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str"), *(F.col(c).cast("double") for c in ("numerator", "denominator", "excluded_count")))


def count_values(rows: DataFrame, label: str = "observed") -> DataFrame:
    """Values from (key, value) that are counts of themselves."""
    return metric_values(rows.select("key", F.col("value").alias("numerator"), F.col("value").alias("denominator"), F.lit(0).alias("excluded_count"), "value"), label)


def unavailable_values(rows: DataFrame) -> DataFrame:
    """Values from (key, reason) that nobody measured: null, with the reason."""
    return rows.select("key", value_name(F.col("key")).alias("name"), F.lit("unavailable").alias("label"), F.lit(None).cast("double").alias("value_num"), F.col("reason").alias("value_str"), *(F.lit(None).cast("double").alias(c) for c in ("numerator", "denominator", "excluded_count")))


def unaccounted(values: DataFrame) -> DataFrame:
    """Values that break the rules: a number without its accounting, an unknown label, a repeated key."""
    naked = F.col("value_num").isNotNull() & (F.col("numerator").isNull() | F.col("denominator").isNull() | F.col("excluded_count").isNull())
    repeated = values.groupBy("key").count().where("count > 1").select("key", F.lit("repeated key").alias("problem"))
    bad = values.where(naked | ~F.col("label").isin(*LABELS)).select("key", F.when(naked, "number without accounting").otherwise("unknown label").alias("problem"))
    return bad.unionByName(repeated)


def markdown(values: DataFrame, title: str) -> str:
    """A table of the values; a report's size is that of its list of keys."""
    rows = values.orderBy("key").select("name", "label", F.coalesce("value_str", percentage(F.col("numerator"), F.col("denominator"))).alias("shown")).collect()
    return "\n".join([f"# {title}", "", "| Value | Label | Result |", "|-|-|-|", *(f"| {r['name']} | {r['label']} | {r['shown']} |" for r in rows), ""])
