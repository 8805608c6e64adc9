"""Distances, similarity joins, matchings and percentiles against plain Python, on Unicode texts and skewed groups."""

import random
import time
from collections import defaultdict
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from tierscope.functions import distance
from tierscope.operators import graphs, metrics, quantiles, similarity


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def edited(rng, tokens, alphabet, edits):
    out = list(tokens)
    for _ in range(edits):
        i = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not out:
            out.insert(i, rng.choice(alphabet))
        elif kind == 1:
            del out[min(i, len(out) - 1)]
        else:
            out[min(i, len(out) - 1)] = rng.choice(alphabet)
    return out


@pytest.mark.parametrize("first_band", [1, 64])
def test_distance_against_the_whole_table(monkeypatch, first_band):
    monkeypatch.setattr(distance, "FIRST_BAND", first_band)
    rng = random.Random(first_band)
    for _ in range(1500):
        alphabet = [f"t{i}" for i in range(rng.choice([1, 2, 5]))]
        a = [rng.choice(alphabet) for _ in range(rng.randrange(0, 40))]
        b = edited(rng, a, alphabet, rng.randrange(0, 9)) if rng.random() < 0.6 else [rng.choice(alphabet) for _ in range(rng.randrange(0, 40))]
        want = slow_distance(a, b)
        assert distance.edit_distance(a, b) == distance.edit_distance(b, a) == want
        for k in (0, 1, 3, 7, 40):
            assert distance.edit_distance(a, b, k) == (want if want <= k else None)
            if a:
                assert distance._banded(a, b, k) == (want if want <= k else None)


def test_distance_of_long_texts():
    rng = random.Random(5)
    a, b = ([f"w{rng.randrange(3000)}" for _ in range(20_000)] for _ in range(2))
    begun = time.time()
    far = distance.edit_distance(a, b)
    assert 15_000 < far <= 20_000 and time.time() - begun < 5, "a fraction of a second alone"
    # Each edit is a token of its own: none can be saved.
    c = a[:]
    for n, i in enumerate(rng.sample(range(20_000), 300)):
        c[i] = f"new{n}"
    assert distance.edit_distance(a, c) == distance.edit_distance(a, c, 300) == 300 and distance.edit_distance(a, c, 299) is None


def test_token_distance_column(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), ([], []), (None, ["a"]), (["é", "😀"], ["😀"])], "a array<string>, b array<string>")
    assert [r["d"] for r in rows.select(distance.token_edit_distance("a", "b").alias("d")).collect()] == [2, 1, 0, None, 1]


# --- similarity join ------------------------------------------------------------------------------------

SIDE = "doc_id string, type string, idx int, text string"


def sides(seed, n_docs=3, n=14):
    rng = random.Random(seed)
    alphabet = "abé😀 ก"
    ref, out = [], []
    for d in range(n_docs):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 9, 12, 30, 90, 700]))) for _ in range(n)]
        texts += texts[:3] + [None]
        for i, t in enumerate(texts):
            kind = rng.choice(["body", "head"])
            ref.append((f"d{d}", kind, i, t))
            copy = None if t is None else "".join(edited(rng, t, alphabet, rng.choice([0, 0, 1, 2, len(t) // 15, len(t) // 9])))
            out.append((f"d{d}", rng.choice([kind, kind, "body"]), i, copy))
    return ref, out


def alike(a, b, threshold):
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - slow_distance(a, b) / longest


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.9), (2, 0.8), (3, 0.6), (4, 0.4), (5, 1.0)])
def test_similar_elements_against_all_pairs(spark, seed, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "STRETCH", 16)
    ref, out = sides(seed)
    want = set()
    for d, t, i, a in ref:
        for e, u, j, b in out:
            if (d, t) == (e, u) and a is not None and b is not None and abs(len(a) - len(b)) <= (1 - threshold) * max(len(a), len(b)) + 1e-9 and (s := alike(a, b, threshold)) >= threshold:
                want.add((d, i, j, round(s, 9)))
    got = metrics.similar_elements(spark.createDataFrame(ref, SIDE), spark.createDataFrame(out, SIDE), threshold).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["ref_idx"], r["out_idx"], round(r["similarity"], 9)) for r in got} == want
    assert len(want) > 20


def test_only_texts_with_a_common_piece_are_measured(spark):
    rng = random.Random(8)
    rows = [("d", "body", i, "".join(rng.choice("abcdefghijklmnop") for _ in range(60))) for i in range(400)]
    changed = [(d, t, i, "".join(edited(rng, x, "xyz", 3))) for d, t, i, x in rows]
    left, right = (similarity.text_classes(spark.createDataFrame(r, SIDE), ["doc_id", "type"], "idx", "text") for r in (rows, changed))
    pairs = {(r["left_rep"], r["right_rep"]) for r in similarity.candidates(left, right, ["doc_id", "type"], 0.9).collect()}
    assert {(i, i) for i in range(400)} <= pairs and len(pairs) < 800, "160,000 pairs before"


def test_a_document_of_many_elements(spark):
    """50,000 elements of one type, many of them equal, are matched without listing pairs of equal ones."""
    n = 50_000
    ids = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("body").alias("type"), F.col("id").cast("int").alias("idx"))
    text = F.when(F.col("idx") % 3 == 0, F.lit("a cell that says the same")).otherwise(F.sha2(F.col("idx").cast("string"), 256))
    ref = ids.withColumn("text", text)
    out = ids.withColumn("text", F.when(F.col("idx") % 5 == 1, F.concat(F.lit("xy"), text)).when(F.col("idx") % 3 == 0, F.lit("a cell that says the same.")).otherwise(text))
    r = metrics.structure_metrics(ref, out).first()
    # Cells of 25 and 26 characters are alike; with "xy" in front 27 and 25 are too.
    assert (r["true_positives"], r["false_positives"], r["false_negatives"]) == (n, 0, 0)


# --- matchings ------------------------------------------------------------------------------------------

def kuhn(near):
    taken = {}

    def augment(x, seen):
        for y in near.get(x, ()):
            if y not in seen:
                seen.add(y)
                if y not in taken or augment(taken[y], seen):
                    taken[y] = x
                    return True
        return False

    return sum(augment(x, set()) for x in near)


def graph(rng, n, p, copies=(1, 1, 2, 4)):
    edges = [(i, j) for i in range(n) for j in range(rng.randrange(1, n + 1)) if rng.random() < p]
    return edges, {i: rng.choice(copies) for i in range(n)}, {j: rng.choice(copies) for j in range(n)}


def single(edges, left, right):
    near = defaultdict(list)
    for i, j in edges:
        for c in range(left[i]):
            near[i, c] += [(j, d) for d in range(right[j])]
    return dict(near)


def test_matching_against_single_paths():
    rng = random.Random(3)
    for _ in range(1500):
        edges, left, right = graph(rng, rng.randrange(1, 8), rng.choice([0.15, 0.4, 0.8]))
        assert graphs.largest_matching(edges, left, right) == kuhn(single(edges, left, right))
    edges, left, right = graph(rng, 60, 0.05, (1,))
    assert graphs.largest_matching(edges, left, right) == kuhn(single(edges, left, right))
    # A chain whose every edge has to be changed, longer than Python's stack.
    chain = [(i, j) for i in range(5000) for j in (i, i + 1)][1:]
    assert graphs.largest_matching(chain, dict.fromkeys(range(5000), 1), dict.fromkeys(range(5001), 1)) == 5000


def test_matching_by_component(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for d in ("x", "y", "z"):
        edges, left, right = graph(rng, 12, 0.2)
        rows += [(d, i, j, left[i], right[j]) for i, j in edges]
        want[d] = kuhn(single(edges, left, right))
    df = spark.createDataFrame(rows, "doc_id string, left_id long, right_id long, n_left long, n_right long")
    assert {r["doc_id"]: r["matched"] for r in graphs.matched_by_component(df, "doc_id").collect()} == want
    assert graphs.matched_by_component(df.limit(0), "doc_id").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (500, 499)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 499: 499, 500: 499, **dict.fromkeys(range(1000, 1060), 1000)}


# --- percentiles ----------------------------------------------------------------------------------------

def values(rng, kind, n):
    one = {"even": lambda: rng.uniform(-5, 5), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "ties": lambda: float(rng.randrange(3)), "ints": lambda: float(rng.randrange(10**6)), "tiny": lambda: rng.choice([5e-324, 0.0, -0.0, 1e-310, 1.7e308, -1.7e308]), "near": lambda: 1.0 + rng.randrange(50) * 2.220446049250313e-16}[kind]
    return [one() for _ in range(n)]


@pytest.mark.parametrize("few", [20_000, 3])
def test_percentiles_against_sorted_values(spark, few):
    rng = random.Random(9)
    groups = {(kind, i): values(rng, kind, n) for kind in ("even", "wide", "ties", "ints", "tiny", "near") for i, n in enumerate((1, 2, 7, 300))}
    rows = [(k, i if i else None, v) for (k, i), vs in groups.items() for v in vs] + [("even", 2, None), ("nothing", 1, None), ("even", 2, float("nan"))]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(4)
    found = quantiles.percentiles(df, ["g", "i"], "v", nearest={"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, between={"median": 0.5, "q": 0.3}, few=few)
    got = quantiles.with_percentiles(df.groupBy("g", "i").agg(F.count("*").alias("n")), found, ["g", "i"], ["p0", "p50", "p95", "p100", "median", "q"]).collect()
    assert len(got) == len(groups) + 1
    for r in got:
        if r["g"] == "nothing":
            assert r["p50"] is None and r["median"] is None
            continue
        vs = sorted(groups[r["g"], r["i"] or 0])
        for name, p in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            assert r[name] == vs[max(1, ceil(len(vs) * p)) - 1]
        for name, p in (("median", 0.5), ("q", 0.3)):
            at = (len(vs) - 1) * p
            want = vs[floor(at)] if floor(at) == at else vs[floor(at)] * (1 - (at - floor(at))) + vs[ceil(at)] * (at - floor(at))
            assert r[name] == pytest.approx(want, rel=1e-12)


def test_percentiles_of_one_large_group(spark):
    """A million different values of one group: ranges narrow by bins until few rows are looked at."""
    df = spark.range(1_000_000, numPartitions=4).select(F.exp((F.col("id") * 7919 % 1_000_000) / 50_000.0).alias("v"))
    found = quantiles.percentiles(df, [], "v", nearest={"p50": 0.5, "p99": 0.99}, few=500).first()
    exact = df.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("p50"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY v)").alias("p99")).first()
    assert (found["p50"], found["p99"]) == (exact["p50"], exact["p99"])
    assert quantiles.percentiles(df.limit(0), [], "v", nearest={"p": 0.5}).count() == 0
