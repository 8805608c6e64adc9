"""A lexicon for scripts without spaces, learned from the corpus, and the segmenter that uses it.

Runs of the script are cut to units (a base with its marks, which no word can begin within). A string of units is a
likely word if what follows it and what stands before it varies: the entropy of the next and of the previous unit is
high at the borders of words and low within them. Both are sums over counted strings, so they are grouped aggregates;
borders of runs count as units that always differ. Texts are then cut where the product of the words'
probabilities is greatest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import default_segmenter
from .work import written

#: Runs of the script, and its units.
RUN, UNIT = r"[\x{0E00}-\x{0E7F}]+", r"[\x{0E00}-\x{0E30}\x{0E32}\x{0E33}\x{0E3F}-\x{0E46}\x{0E4F}-\x{0E7F}][\x{0E31}\x{0E34}-\x{0E3E}\x{0E47}-\x{0E4E}]*|[\x{0E31}\x{0E34}-\x{0E3E}\x{0E47}-\x{0E4E}]+"
#: Most units of a word, fewest occurrences, and least entropy on either side in bits.
MOST_UNITS, LEAST_COUNT, LEAST_ENTROPY = 6, 5, 1.0
#: How much more often than by chance two words stand together to be one, and units of a word where chance is reckoned.
COHESION, UNITS_PER_WORD = 3.0, 2
#: A lexicon goes to every task: beyond this many bytes it is refused.
MOST_BYTES = 64 << 20

_RUNS = regex.compile(r"[฀-๿]+")
_UNITS = regex.compile(r"[฀-ะาำ฿-ๆ๏-๿][ัิ-฾็-๎]*|[ัิ-฾็-๎]+")


def counted_strings(df: DataFrame, text: str = "text", most: int = MOST_UNITS) -> DataFrame:
    """(units, n): every string of up to most + 1 units within runs, with how often it occurs; borders are a unit of their own, ''."""
    runs = df.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    border = F.array(F.lit(""))
    units = F.concat(border, F.regexp_extract_all("run", F.lit(UNIT), F.lit(0)), border)
    begun = runs.select("n", units.alias("u")).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("u"))))
    taken = begun.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(most + 2), F.size("u") - F.col("i") + 1))))
    return taken.groupBy(F.slice("u", F.col("i"), F.col("size")).alias("units")).agg(F.sum("n").alias("n"))


def _entropy(strings: DataFrame, inner: F.Column, outer: F.Column, name: str) -> DataFrame:
    """Bits of the unit that stands beside each string; a border is as many different units as it occurs."""
    n = F.col("n").cast("double")
    plain = F.when(outer == "", 0.0).otherwise(n * F.log2(n))
    out = strings.where(F.size("units") > 1).select(inner.alias("units"), n.alias("n"), plain.alias("nlogn")).groupBy("units").agg(F.sum("n").alias("total"), F.sum("nlogn").alias("nlogn"))
    return out.select("units", (F.log2("total") - F.col("nlogn") / F.col("total")).alias(name))


def learn_lexicon(df: DataFrame, text: str = "text", most: int = MOST_UNITS, least_count: int = LEAST_COUNT, least_entropy: float = LEAST_ENTROPY, cohesion: float = COHESION) -> DataFrame:
    """(word, n, before, after): strings of units that occur often enough, whose neighbours on both sides vary enough, and that
    are not two words that meet by chance."""
    strings = written(counted_strings(df, text, most), "lexicon-strings")
    size = F.size("units")
    after = _entropy(strings, F.slice("units", F.lit(1), size - 1), F.element_at("units", -1), "after")
    before = _entropy(strings, F.slice("units", F.lit(2), size - 1), F.element_at("units", 1), "before")
    words = strings.where((F.col("n") >= least_count) & (size <= most) & ~F.array_contains("units", ""))
    found = words.join(after.hint("merge"), "units").join(before.hint("merge"), "units")
    least = least_entropy - 1e-9  # sums of doubles have no one order
    likely = written(found.where((F.col("after") >= least) & (F.col("before") >= least)), "lexicon-likely")
    # Two words that often meet have varied neighbours too, but no more occurrences than their shares make them have.
    one = strings.where((size == 1) & ~F.array_contains("units", "")).agg((F.coalesce(F.sum("n"), F.lit(0)) / UNITS_PER_WORD).alias("tokens"))
    cuts = likely.where(size > 1).select("units", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    halves = [likely.select(F.col("units").alias(name), F.col("n").alias(f"n_{name}")).hint("merge") for name in ("left", "right")]
    cuts = cuts.withColumns({"left": F.slice("units", F.lit(1), F.col("k")), "right": F.slice("units", F.col("k") + 1, size - F.col("k"))}).join(halves[0], "left").join(halves[1], "right")
    chance = cuts.crossJoin(F.broadcast(one)).where(F.col("n") * F.col("tokens") <= cohesion * F.col("n_left") * F.col("n_right")).select("units").distinct()
    return likely.join(chance.hint("merge"), "units", "left_anti").select(F.array_join("units", "").alias("word"), "n", "before", "after")


def lexicon_costs(lexicon: DataFrame) -> dict[str, float]:
    """Each word with the negative logarithm of its share, on the driver; raises where the lexicon is too large to send along."""
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if size["b"] > MOST_BYTES:
        raise ValueError(f"a lexicon of {size['b']} bytes isn't sent to tasks; raise the least count")
    return {r["word"]: math.log(size["n"] / r["n"]) for r in lexicon.select("word", "n").collect()}


def cut(run: str, costs: dict[str, float], most: int = MOST_UNITS) -> list[str]:
    """The words of a run: the cheapest way through its units; a unit that is no word costs more than any word."""
    units = _UNITS.findall(run)
    unknown = 2 * max(costs.values(), default=1.0) + 1
    best, last = [0.0] + [math.inf] * len(units), [0] * (len(units) + 1)
    for i in range(len(units)):
        for j in range(i + 1, min(len(units), i + most) + 1):
            cost = costs.get("".join(units[i:j]), unknown if j == i + 1 else math.inf)
            if best[i] + cost < best[j]:
                best[j], last[j] = best[i] + cost, i
    out, j = [], len(units)
    while j:
        out.append("".join(units[last[j] : j]))
        j = last[j]
    return out[::-1]


def lexicon_segmenter(costs: dict[str, float], most: int = MOST_UNITS) -> Callable[[str, str], list[str]]:
    """A segmenter for word_tokens: runs of the script by the lexicon, everything else as the default has it."""

    def segment(text: str, script: str) -> list[str]:
        out, at = [], 0
        for m in _RUNS.finditer(text):
            out += default_segmenter(text[at : m.start()], script) + cut(m.group(), costs, most)
            at = m.end()
        return out + default_segmenter(text[at:], script)

    return segment
