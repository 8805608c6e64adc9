"""Edit-similarity join by pieces: which texts of two sides are alike enough, without comparing all of a group.

Two texts are alike if their distance is at most a share of the longer one's length, so a reference text of length n has
at most some number e of edits to any partner. Cut into e + 1 pieces, one of them stands unchanged in the partner, at most
e places away. The pieces of one side meet the segments of that size of the other side in an equi-join on their hashes;
only pairs that share one are measured, with the distance bounded. Equal texts of a group count as one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that segments are cut from at a time: cutting at a place costs as much as what lies before it.
STRETCH = 256
_SLACK = 1e-9


def most_edits(length: Column, threshold: float) -> Column:
    """Most edits between a text of this length and any text that is alike enough."""
    return F.floor(length * ((1 - threshold) / threshold) + _SLACK).cast("int")


def _piece(length: Column, threshold: float) -> Column:
    return F.floor(length / (most_edits(length, threshold) + 1)).cast("int")


def text_classes(rows: DataFrame, by: list[str], idx: str, text: str) -> DataFrame:
    """(by, rep, text, copies): the different texts of each group, named by their least idx."""
    return rows.where(F.col(text).isNotNull()).groupBy(*by, F.col(text).alias("text")).agg(F.min(idx).alias("rep"), F.count("*").alias("copies"))


def candidates(left: DataFrame, right: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, left_rep, right_rep): pairs of classes that have a piece of the left one in common, near enough the same place."""
    n = F.length("text")
    cut = left.select(*by, F.col("rep").alias("left_rep"), "text", n.alias("n"), most_edits(n, threshold).alias("e"), _piece(n, threshold).alias("q"))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    place = F.col("i") * F.col("q")
    pieces = cut.select(*by, "left_rep", "n", "e", place.alias("at"), F.xxhash64("q", F.substring("text", place + 1, F.col("q"))).alias("h"))
    # The sizes that pieces of possible partners have.
    sizes = F.array_distinct(F.transform(F.sequence(F.ceil(n * threshold - _SLACK).cast("int"), F.floor(n / threshold + _SLACK).cast("int")), lambda m: _piece(m, threshold)))
    each = right.select(*by, F.col("rep").alias("right_rep"), "text", n.alias("m"), F.explode(sizes).alias("q")).where("q <= m")
    stretches = each.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("m") - F.col("q")), F.lit(STRETCH))))
    stretches = stretches.select(*by, "right_rep", "m", "q", "start", F.substring("text", F.col("start") + 1, F.col("q") + STRETCH - 1).alias("part"))
    last = F.least(F.lit(STRETCH - 1), F.col("m") - F.col("q") - F.col("start"))
    places = stretches.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), last))))
    segments = places.select(*by, "right_rep", "m", (F.col("start") + F.col("j")).alias("place"), F.xxhash64("q", F.substring("part", F.col("j") + 1, F.col("q"))).alias("h"))
    met = pieces.join(segments.hint("merge"), [*by, "h"]).where((F.abs(F.col("at") - F.col("place")) <= F.col("e")) & (F.abs(F.col("n") - F.col("m")) <= (1 - threshold) * F.greatest("n", "m") + _SLACK))
    return met.select(*by, "left_rep", "right_rep").distinct()


def alike(left: DataFrame, right: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, left_rep, right_rep, similarity) of classes whose similarity, 1 less distance by the longer length, is at least
    the threshold; two empty texts have 1."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    sides = [side.select(*by, F.col("rep").alias(f"{name}_rep"), F.col("text").alias(name)) for side, name in ((left, "left"), (right, "right"))]
    if threshold > 0.5:
        pairs = candidates(left, right, by, threshold)
        pairs = pairs.join(sides[0].hint("merge"), [*by, "left_rep"]).join(sides[1].hint("merge"), [*by, "right_rep"])
    else:  # half a text may change, so that no piece need be left
        pairs = sides[0].join(sides[1].hint("merge"), by)
    longest = F.greatest(F.length("left"), F.length("right"))
    most = F.floor((1 - threshold) * longest + _SLACK).cast("int")
    pairs = pairs.where(F.abs(F.length("left") - F.length("right")) <= most).withColumn("most", most).withColumn("edits", F.expr("CASE WHEN left = right THEN 0 ELSE levenshtein(left, right, most) END"))
    measured = pairs.where("edits >= 0").withColumn("similarity", F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.col("edits") / F.when(longest > 0, longest)))
    return measured.where(F.col("similarity") >= threshold).select(*by, "left_rep", "right_rep", "similarity")
