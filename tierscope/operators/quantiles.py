"""Exact ranks by distributed selection: no task holds a group's values, however many a group has.

A rank is looked for in a range of values, at first all of its group. Each round counts the range's values by bins,
in partial aggregates, and goes on with the one bin that holds the rank, its own least and greatest value as the next
range. Bins follow the logarithm in the first round, so that outliers don't fill the scale, and are equally wide
afterwards; both are monotone in floating point (each operation is correctly rounded, the logarithm is
semi-monotonic), so no value is ever taken for a greater one's. When ranges have few rows, one look at them ends it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import written

#: Bins of a round, and rows that a range may have for the last look.
BINS, FEW = 1024, 20_000


def _log_bin(v: Column) -> Column:
    """Bins of 1/8 in the natural logarithm, negative values mirrored, 0 between them."""
    size = F.floor(F.ln(F.abs(v)) * 8) + 8000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("long")


def _even_bin(v: Column, low: Column, high: Column) -> Column:
    """Equally wide bins; halves keep the width finite."""
    share = (v / 2 - low / 2) / F.when(high > low, high / 2 - low / 2)
    return F.coalesce(F.floor(share * BINS), F.lit(0)).cast("long")


def select_ranks(rows: DataFrame, ranks: DataFrame, value: str = "v", few: int = FEW) -> DataFrame:
    """(key, rank, value) for ranks (key, rank), 1 for the least value of a key; ranks beyond a key's rows give no row.

    rows: key, value (double, no null or NaN) and n, how many times it counts; repeated rows add up. It is read once a
    round, so it should be a written table.
    """
    sizes = rows.groupBy("key").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("n").alias("size"))
    wanted = written(ranks.distinct().join(sizes.hint("merge"), "key").where("rank BETWEEN 1 AND size").select("key", "rank", F.col("rank").alias("left"), "low", "high", "size"), "ranks")
    first = True
    while wanted.where((F.col("size") > few) & (F.col("low") < F.col("high"))).limit(1).count():
        inside = rows.join(wanted.select("key", "low", "high").distinct().hint("merge"), "key").where(F.col(value).between(F.col("low"), F.col("high")))
        bin_ = _log_bin(F.col(value)) if first else _even_bin(F.col(value), F.col("low"), F.col("high"))
        bins = inside.groupBy("key", "low", "high", bin_.alias("bin")).agg(F.sum("n").alias("n"), F.min(value).alias("bin_low"), F.max(value).alias("bin_high"))
        # As many rows a range as there are bins.
        before = Window.partitionBy("key", "low", "high").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("n").over(before))
        found = wanted.drop("size").join(bins.hint("merge"), ["key", "low", "high"]).where((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
        wanted = written(found.select("key", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("bin_low").alias("low"), F.col("bin_high").alias("high"), F.col("n").alias("size")), "ranks")
        first = False
    looked = rows.join(wanted.select("key", "low", "high").where("low < high").distinct().hint("merge"), "key").where(F.col(value).between(F.col("low"), F.col("high")))
    counted = looked.groupBy("key", "low", "high", value).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("key", "low", "high").orderBy(value)))
    last = wanted.where("low < high").join(counted.hint("merge"), ["key", "low", "high"]).where((F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n"))).select("key", "rank", value)
    return wanted.where("low = high").select("key", "rank", F.col("low").alias(value)).unionByName(last)


def _keyed(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """key (the group's columns as one text, nulls included), value as double v, and n, equal values summed."""
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(key.alias("key"), v.alias("v")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, by: list[str], value: str, nearest: Mapping[str, float] | None = None, between: Mapping[str, float] | None = None, few: int = FEW) -> DataFrame:
    """By group: key (to_json of the group's columns) and one column a percentile of the values that aren't null.

    nearest: the least value that at least this share of the values doesn't exceed. between: at this share of the way
    from the least to the greatest, interpolated between the two neighbours (0.5: the median). Groups without a
    value have no row.
    """
    rows = written(_keyed(df, by, value), "percentile-values")
    sizes = rows.groupBy("key").agg(F.sum("n").alias("n_values"))
    n = F.col("n_values")
    rank = {name: (F.greatest(F.lit(1), F.ceil(n * p)),) * 2 for name, p in (nearest or {}).items()}
    rank |= {name: (F.floor((n - 1) * p) + 1, F.ceil((n - 1) * p) + 1) for name, p in (between or {}).items()}
    asked = sizes.select("key", F.explode(F.array_distinct(F.array(*(r.cast("long") for pair in rank.values() for r in pair)))).alias("rank"))
    got = select_ranks(rows, asked, "v", few).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = sizes.join(got.hint("merge"), "key")
    at = lambda r: F.element_at("at", r.cast("long"))
    columns = {}
    for name, (lower, upper) in rank.items():
        p = (between or {}).get(name)
        share = F.lit(0.0) if p is None else (n - 1) * p - F.floor((n - 1) * p)
        columns[name] = F.when(share == 0, at(lower)).otherwise(at(lower) * (1 - share) + at(upper) * share) if p is not None else at(lower)
    return out.select("key", *(c.alias(name) for name, c in columns.items()))


def with_percentiles(groups: DataFrame, found: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """One row a group, with its percentiles (null for a group without a value)."""
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")
    return groups.withColumn("key_", key).join(found.select(F.col("key").alias("key_"), *names).hint("merge"), "key_", "left").drop("key_")
