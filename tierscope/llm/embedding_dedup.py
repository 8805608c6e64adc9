"""Embedding near-dedup: random projections decoded to E8 lattice points, neighbouring cells, exact cosine.

Each of TABLES tables projects a unit vector to two random 8-dimensional spaces, scales, and decodes each part
to the nearest point of the E8 lattice; both points name the vector's home cell. It also enters the PROBES
nearest neighbouring cells, one minimal lattice vector away. Vectors meet in a cell that is home to one of
them, and their cosine is then computed in double precision, so no false pair is linked.

A pair can meet more than once: it counts in the first table where it does, in the home cell of the smaller
id if the other vector has entered that, else of the larger. So pairs are counted where they meet and are
never listed. Equal vectors are one class with a number of copies. A cell with many classes is dealt out as
pairs of tiles.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; nor do vectors
of different lengths, nor rows without an id. Ids must be integers; rows that share id and vector are one row.
An id names a vector: of rows that share an id and differ in their vectors, each gets what all of them have.
Vectors are held scaled by a power of two, which changes no digit and lets components of any size be multiplied.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_batches, join_checked, map_frames, mix, signed, stored, tidy
from .ngram_jaccard import _groups

COSINE = 0.95
TABLES, PROBES, CELL = 8, 3, 0.25
#: Classes of a tile; a larger group than SMALL is compared as a matrix.
TILE, SMALL = 512, 48


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


_MINIMAL = _minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: rounding, and the worst coordinate the other way if odd."""
    point = np.rint(x)
    rest = x - point
    worst = np.abs(rest).argmax(axis=-1)
    odd = np.flatnonzero(point.sum(axis=-1) % 2 != 0)
    point[odd, worst[odd]] += np.where(rest[odd, worst[odd]] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


def _code(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), np.uint64(salt))
    for c in range(points.shape[1]):
        h = mix(h, 31) + np.rint(points[:, c] * 2).astype(np.int64).view(np.uint64)
    return mix(h, 7)


def cells_of(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, cell: float = CELL) -> np.ndarray:
    """Cell codes by vector, table and slot: slot 0 is the home cell, the others are its nearest neighbours."""
    n, dim = unit.shape
    wide = max(16, dim)
    unit = np.pad(unit, ((0, 0), (0, wide - dim)))
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng((dim, t))
        basis = np.linalg.qr(rng.normal(size=(wide, 16)))[0]
        x = unit @ basis * np.sqrt(wide / 64) / cell + rng.uniform(0, 1, 16)
        home = np.concatenate([nearest_e8(x[:, :8]), nearest_e8(x[:, 8:])], axis=1)
        out[:, t, 0] = _code(home, dim * 1000 + t)
        rest = x - home
        gain = np.concatenate([rest[:, :8] @ _MINIMAL.T, rest[:, 8:] @ _MINIMAL.T], axis=1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            step = np.zeros_like(home)
            late = best[:, p] >= len(_MINIMAL)
            step[~late, :8], step[late, 8:] = _MINIMAL[best[~late, p]], _MINIMAL[best[late, p] - len(_MINIMAL)]
            out[:, t, 1 + p] = _code(home + step, dim * 1000 + t)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """x times a power of two, its largest component between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max())[1])


def _counts(cells: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b), met at table and cell, count there."""
    swap = ids[a] > ids[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    at_a, at_b = cells[a], cells[b]
    in_b = (at_a[:, :, :1] == at_b).any(axis=2)
    in_a = (at_b[:, :, :1] == at_a).any(axis=2)
    first = (in_a | in_b).argmax(axis=1)
    k = np.arange(len(a))
    own = np.where(in_b[k, first], at_a[k, first, 0], at_b[k, first, 0])
    return (first == table) & (own == cell)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that links reach, for each of n rows."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _meet(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of whole groups by (table, cell, x, y): (id, links, root), links counted in copies."""
    ids, copies, slot = frame["id_"].to_numpy(), frame["copies"].to_numpy(), frame["home"].to_numpy(bool)
    vectors = [np.frombuffer(v, np.float64) for v in frame["vector"]]
    length = np.array([len(v) for v in vectors])
    cells = np.stack([np.frombuffer(c, np.int64) for c in frame["cells"]]).reshape(len(frame), TABLES, -1)
    table, cell, tile = frame["t"].to_numpy(), frame["cell"].to_numpy(), frame["tile"].to_numpy()
    x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
    head = np.flatnonzero(np.append(True, (np.diff(table) != 0) | (np.diff(cell) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)))
    size = np.diff(np.append(head, len(frame)))
    pairs_a, pairs_b = [], []
    few = np.flatnonzero((size > 1) & (size <= SMALL))
    for g in np.unique(size[few]):
        i, j = np.triu_indices(g, 1)
        starts = head[few[size[few] == g]]
        pairs_a.append((starts[:, None] + i).ravel())
        pairs_b.append((starts[:, None] + j).ravel())
    a, b = (np.concatenate([*p, np.zeros(0, np.int64)]) for p in (pairs_a, pairs_b))
    found_a, found_b = [], []
    for s in range(0, len(a), 32_768):
        p, q = a[s : s + 32_768], b[s : s + 32_768]
        fine = (slot[p] | slot[q]) & ((x[p] == y[p]) | (tile[p] != tile[q])) & (ids[p] != ids[q]) & (length[p] == length[q])
        p, q = p[fine], q[fine]
        for n in np.unique(length[p]):
            alike = length[p] == n
            own_p, own_q = p[alike], q[alike]
            u, v = np.stack([vectors[i] for i in own_p]), np.stack([vectors[i] for i in own_q])
            ok = np.einsum("ij,ij->i", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)) >= cosine
            found_a.append(own_p[ok])
            found_b.append(own_q[ok])
    for h, n in zip(head[size > SMALL], size[size > SMALL], strict=True):
        own = np.arange(h, h + n)
        left, right = (own, own) if x[h] == y[h] else (own[tile[own] == x[h]], own[tile[own] == y[h]])
        if not len(left) or not len(right):
            continue
        u, v = np.stack([vectors[i] for i in left]), np.stack([vectors[i] for i in right])
        near = u @ v.T / np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)) >= cosine
        near &= slot[left][:, None] | slot[right][None, :]
        i, j = np.nonzero(near & (left[:, None] < right[None, :]) if x[h] == y[h] else near)
        fine = ids[left[i]] != ids[right[j]]
        found_a.append(left[i[fine]])
        found_b.append(right[j[fine]])
    a, b = (np.concatenate([*p, np.zeros(0, np.int64)]) for p in (found_a, found_b))
    links = np.zeros(len(frame), np.int64)
    for s in range(0, len(a), 32_768):
        p, q = a[s : s + 32_768], b[s : s + 32_768]
        ok = _counts(cells, ids, p, q, table[p], cell[p])
        np.add.at(links, p[ok], copies[q[ok]])
        np.add.at(links, q[ok], copies[p[ok]])
    root = ids[_labels(len(frame), a, b)]
    some = (links > 0) | (root != ids)
    return pd.DataFrame({"id_": ids[some], "links": links[some], "root": root[some]})


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per distinct id and vector: id, n_links (other vectors of at least that cosine found), component_id (the
    smallest id that links reach, its own included), kept (whether that is its own id)."""

    v = F.col("vector_")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id_": frame["id_"], "vector": [None if x is None else scaled(np.asarray(x, np.float64)).tobytes() for x in frame["vector_"]]})

    rows = in_batches(df).select(F.col(id_col).cast("long").alias("id_"), F.col(vector_col).cast("array<double>").alias("vector_")).withColumn("vector_", F.when(fine, v))
    rows = map_frames(rows, packed, "id_ long, vector binary").distinct()
    rows = stored(rows.withColumn("key", F.when(F.col("id_").isNotNull(), F.sha2("vector", 256))), "vectors")
    classes = stored(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id_").alias("id_"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vector-classes")

    def entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, part in frame.groupby(frame["vector"].map(len)):
                x = np.stack([np.frombuffer(v, np.float64) for v in part["vector"]])
                found = signed(cells_of(x / np.linalg.norm(x, axis=1, keepdims=True)).ravel()).reshape(len(part), -1)
                yield pd.DataFrame({"id_": part["id_"], "copies": part["copies"], "vector": part["vector"], "places": list(found), "cells": [c.tobytes() for c in found]})

    placed = stored(classes.mapInPandas(tidy(entered), "id_ long, copies long, vector binary, places array<long>, cells binary"), "vector-cells")
    spread = placed.select("id_", F.posexplode("places").alias("at", "cell")).select("id_", "cell", F.expr(f"at div {1 + PROBES}").alias("t"), (F.col("at") % (1 + PROBES) == 0).alias("home"))
    sizes = spread.groupBy("t", "cell").agg(F.count("*").alias("c"), F.max("home").alias("any")).where("c > 1 AND any").select("t", "cell", F.ceil(F.col("c") / TILE).alias("tiles"))
    meeting = spread.join(sizes.hint("merge"), ["t", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id_"), F.col("tiles")))
    meeting = meeting.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    meeting = meeting.select("t", "cell", "id_", "home", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
    meeting = meeting.join(placed.select("id_", "copies", "vector", "cells").hint("merge"), "id_").repartition("t", "cell", "x", "y").sortWithinPartitions("t", "cell", "x", "y", "id_")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _groups(frames, ["t", "cell", "x", "y"]):
            yield _meet(batch, cosine)

    found = stored(meeting.mapInPandas(tidy(compared), "id_ long, links long, root long"), "vector-links")
    links = found.groupBy("id_").agg(F.sum("links").alias("links"))
    joined = components(found, "id_", "root").select(F.col("node").alias("id_"), F.col("root").alias("component_"))
    named = classes.select("key", "id_", "copies").join(links, "id_", "left").join(joined, "id_", "left")
    named = stored(named.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_", "id_").alias("component_id")), "vector-names")
    out = join_checked(rows.select("id_", "key"), named, "key", "left")
    out = out.select(F.col("id_").cast(df.schema[id_col].dataType).alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id_").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, min(r.y) AS component_id, min(r.y) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.x = e.vec_id GROUP BY e.vec_id
"""
