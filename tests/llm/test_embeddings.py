"""Lattice decoding against search, and linked vectors against all pairs."""

import math

import numpy as np
import pytest

from tierscope.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, label int, key string, links long, root int"


def test_nearest_lattice_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    got = E.nearest_e8(x)
    whole = np.isclose(got % 1, 0).all(1)
    half = np.isclose(got % 1, 0.5).all(1)
    assert (whole | half).all() and np.isclose(got.sum(1) % 2, 0).all()
    assert len(E._MINIMAL) == 240 and np.allclose((E._MINIMAL**2).sum(1), 2)
    # A point is nearest when no minimal vector leads closer: those are the Voronoi-relevant ones, with the 2160 of norm 4.
    d = ((x - got) ** 2).sum(1)
    for v in E._MINIMAL:
        assert (((x - got - v) ** 2).sum(1) >= d - 1e-9).all()
    assert d.max() <= 1 + 1e-9, "the covering radius of E8 is 1"


def near(rng, base, cosine):
    noise = rng.normal(size=len(base))
    noise -= noise @ base * base
    noise /= np.linalg.norm(noise)
    return cosine * base + math.sqrt(1 - cosine**2) * noise


def brute(vectors):
    ids = sorted(vectors)
    ok = {i: np.array(vectors[i], float) for i in ids if vectors[i] and all(x is not None and math.isfinite(x) for x in vectors[i]) and any(vectors[i])}
    links, root = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(ok)
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            u, v = ok[a], ok[b]
            if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= E.COSINE:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("tile", [512, 8])
def test_links(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(2)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=64))
    rows = [unit() for _ in range(150)]
    for _ in range(12):
        base = unit()
        rows += [base, 3 * base, near(rng, base, 0.99), near(rng, base, 0.97), near(rng, base, 0.9)]
    base = unit()
    rows += [near(rng, base, 0.99) for _ in range(70)] + [base] * 20
    vectors = dict(enumerate([list(map(float, v)) for v in rows]))
    for bad in (None, [], [0.0] * 64, [math.nan] + [1.0] * 63, [math.inf] * 64, [None] + [1.0] * 63, [1.0], [2.0], [1.0] * 3):
        vectors[len(vectors)] = bad
    df = spark.createDataFrame([(i, v, 0, "k", 7, 7) for i, v in vectors.items()], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.link_vectors(df).collect()}
    want = brute(vectors)
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want), "no false link"
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert [got[i] for i in range(len(rows), len(vectors)) if vectors[i] not in ([1.0], [2.0])] == [(0, i, True) for i in range(len(rows), len(vectors)) if vectors[i] not in ([1.0], [2.0])]
    assert E.link_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.stack([near(rng, v, 0.951) for v in a])
    x, y = E.cells_of(a), E.cells_of(b)
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert met.mean() >= 0.95
    apart = np.roll(y, 1, axis=0)
    assert ((x[:, :, :1] == apart).any(2) | (apart[:, :, :1] == x).any(2)).any(1).mean() < 0.02


def test_extreme_components_null_ids_and_repeated_rows(spark):
    """Components whose squares leave the range of doubles, rows without an id, and rows alike in id and vector or in one of them."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    base /= np.linalg.norm(base)
    rows = [(1, base * 1e200), (2, near(rng, base, 0.99) * 1e-200), (3, near(rng, base, 0.99) * 1e-310), (4, -base * 1e300), (5, near(rng, base, 0.5)), (None, base), (None, base), (2, near(rng, base, 0.5) * 1e5)]
    rows = [(i, list(map(float, v)), 0, "k", 7, 7) for i, v in rows]
    df = spark.createDataFrame([*rows, rows[0], rows[1], (None, None, 0, "k", 7, 7)], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.link_vectors(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (None, 0, None, True), (None, 0, None, True)], key=str)
    tied = spark.createDataFrame([(i, [0.0, 3.0, 4.0], 0, "k", 7, 7) for i in (9, 8, 7, 7)], SCHEMA)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.link_vectors(tied).collect()) == [(7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False)]


def test_sql_of_planted_links(spark):
    """The query's SQL on vectors with groups of near copies, chains and odd rows, where links are many."""
    import duckdb

    rng = np.random.default_rng(77)
    rows, at = [], 0
    for size in (1, 1, 2, 3, 12, 40):
        centre = rng.normal(size=24)
        for _ in range(size):
            rows.append((at, (centre + rng.normal(size=24) * 0.05).tolist()))
            at += 1
    rows += [(at, None), (at + 1, [0.0] * 24), (at + 2, [float("nan")] + [1.0] * 23), (at + 3, []), (at + 4, (np.array(rows[0][1]) * 3).tolist())]
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    columns = ["vec_id", "n_links", "component_id", "kept"]
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({E.ORACLE_SQL})").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in E.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == want and sum(r[1] for r in got) > 1000
