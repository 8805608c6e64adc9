"""A lexicon learned from runs of planted words."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tierscope.functions.text import word_tokens
from tierscope.operators import lexicon

BASES, MARKS = "กขคงจชซดตทนบปพมยรลวสหอ", ["", "", "", "ิ", "ี", "ุ", "่", "้", "ั้"]


def planted(seed, n_words=150, n_runs=4000):
    rng = random.Random(seed)
    unit = lambda: rng.choice(BASES) + rng.choice(MARKS)
    words = sorted({"".join(unit() for _ in range(rng.choice([2, 2, 3, 3, 4]))) for _ in range(n_words)})
    rng.shuffle(words)
    weights = [1 / (i + 3) for i in range(len(words))]
    return [rng.choices(words, weights, k=rng.randrange(1, 9)) for _ in range(n_runs)]


def borders(words):
    out, at = set(), 0
    for w in words[:-1]:
        at += len(w)
        out.add(at)
    return out


def test_planted_words_are_found(spark):
    runs = planted(1)
    texts = [(" and ".join("".join(r) for r in runs[i : i + 10]),) for i in range(0, 3000, 10)] + [(None,), ("no run",)]
    costs = lexicon.lexicon_costs(lexicon.learn_lexicon(spark.createDataFrame(texts, "text string")))
    hit = found = true = 0
    for words in runs[3000:]:  # what it hasn't seen
        got, want = borders(lexicon.cut("".join(words), costs)), borders(words)
        hit, found, true = hit + len(got & want), found + len(got), true + len(want)
    assert 2 * hit / (found + true) > 0.9, (hit, found, true)


def test_entropies_against_counts(spark):
    """Both entropies of each string, counted one by one."""
    runs = ["".join(r) for r in planted(2, 12, 60)]
    got = {r["word"]: r for r in lexicon.learn_lexicon(spark.createDataFrame([(" ".join(runs[:30]),), (" ".join(runs[30:]),)], "text string"), least_count=1, least_entropy=0.0, cohesion=0.0).collect()}
    after, before, n = defaultdict(Counter), defaultdict(Counter), Counter()
    for k, run in enumerate(runs):
        u = lexicon._UNITS.findall(run)
        for i in range(len(u)):
            for j in range(i + 1, min(len(u), i + lexicon.MOST_UNITS) + 1):
                w = "".join(u[i:j])
                n[w] += 1
                after[w][u[j] if j < len(u) else ("end", k, j)] += 1
                before[w][u[i - 1] if i else ("begin", k, j)] += 1
    bits = lambda c: math.log2(c.total()) - sum(v * math.log2(v) for v in c.values()) / c.total()
    assert {w: r["n"] for w, r in got.items()} == dict(n)
    for w, r in got.items():
        assert math.isclose(r["after"], bits(after[w]), abs_tol=1e-9) and math.isclose(r["before"], bits(before[w]), abs_tol=1e-9)


def test_segmenter_plugs_in(spark):
    costs = {"กินข้าว": 2.0, "กิน": 1.0, "ข้าว": 1.5, "ไป": 1.0}
    assert lexicon.cut("กินข้าวไปx", costs) == ["กินข้าว", "ไป"] and lexicon.cut("", costs) == []
    assert lexicon.cut("ไปยกิน", costs) == ["ไป", "ย", "กิน"]
    tokens = word_tokens(lexicon.lexicon_segmenter(costs))
    row = spark.range(1).select(tokens(F.lit("It's กินข้าว 3.5 ไปกิน km"), F.lit("thai")).alias("t")).first()
    assert row["t"] == ["It's", "กินข้าว", "3.5", "ไป", "กิน", "km"]
    empty = lexicon.learn_lexicon(spark.createDataFrame([("abc",)], "text string"))
    assert lexicon.lexicon_costs(empty) == {} and lexicon.cut("กิน", {}) == ["กิ", "น"]
