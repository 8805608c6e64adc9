"""Graphs: connected components in rounds of joins, and largest matchings component by component."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), root the least node that edges lead to, for every node of an edge between two.

    Rounds of large and small stars: each node points its neighbours to the least one it knows. A round combines minima
    before it shuffles, and its edges are written, so lineage stays short.
    """
    pairs = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), "components")
    while True:
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.where("y > x").join(least.hint("merge"), "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low.hint("merge"), "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        after = written(small.unionByName(low.select("x", F.col("m").alias("y"))).distinct(), "components")
        # Stars of one root each are the end: no edge leads to a node that leads on, and none leads to two.
        onward = after.select(F.col("y").alias("x")).distinct().join(after.select("x").hint("merge"), "x", "left_semi")
        if onward.unionByName(after.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")).isEmpty():
            break
        pairs = after
    return after.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(after.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


def largest_matching(edges: list[tuple[int, int]], left: dict[int, int], right: dict[int, int]) -> int:
    """Most pairs of a bipartite graph whose nodes stand for several equal elements each: left and right are their numbers.

    Hopcroft and Karp's phases: shortest augmenting paths are found level by level and used up, as many as don't share a
    free element, until none is left.
    """
    near: dict[int, list[int]] = {}
    for x, y in edges:
        near.setdefault(x, []).append(y)
    free, room = {x: left[x] for x in near}, {y: right[y] for _, y in edges}
    flow: dict[int, dict[int, int]] = {}  # by right node: matched with left nodes, and how often
    total = 0
    while True:
        level = {x: 0 for x, n in free.items() if n}
        queue, ends = deque(level), None
        while queue:
            x = queue.popleft()
            if ends is not None and level[x] >= ends:
                break
            for y in near[x]:
                if room[y]:
                    ends = level[x]
                for z in flow.get(y, ()):
                    if z not in level:
                        level[z] = level[x] + 1
                        queue.append(z)
        if ends is None:
            return total
        at = dict.fromkeys(level, 0)  # by left node, the right node it tries
        for start in [x for x, n in free.items() if n]:
            path = [start]  # left nodes; the right node between two is the one the first tries
            while path and free[start]:
                x = path[-1]
                if at[x] == len(near[x]):  # nothing leads on from here
                    level[x] = -1
                    path.pop()
                    continue
                y = near[x][at[x]]
                if not room[y]:
                    onward = next((z for z in flow.get(y, ()) if level.get(z) == level[x] + 1), None)
                    if onward is None:
                        at[x] += 1
                    else:
                        path.append(onward)
                    continue
                # How many equal elements can take the path: what is free, what has room, and what it takes from others.
                tried = [near[x][at[x]] for x in path]
                n = min(free[start], room[y], *(flow[y][z] for y, z in zip(tried, path[1:])))
                free[start] -= n
                room[y] -= n
                for x, y in zip(path, tried):
                    flow.setdefault(y, {})[x] = flow.get(y, {}).get(x, 0) + n
                for y, z in zip(tried, path[1:]):
                    flow[y][z] -= n
                    if not flow[y][z]:
                        del flow[y][z]
                total += n
                path = [start]


def matched_by_component(edges: DataFrame, key: str) -> DataFrame:
    """(key, matched): the size of the largest matching by key.

    edges: key, left_id, right_id (longs), n_left, n_right (how many equal elements a node stands for). One group is a
    component of the graph, not a key.
    """
    kind = edges.schema[key].dataType.simpleString()
    named = written(edges.select(F.col(key).alias("key_"), "left_id", "right_id", "n_left", "n_right", F.struct(F.col(key).alias("k"), F.lit(0).alias("side"), F.col("left_id").alias("i")).alias("a"), F.struct(F.col(key).alias("k"), F.lit(1).alias("side"), F.col("right_id").alias("i")).alias("b")), "matching-edges")
    roots = connected_components(named).select(F.col("node").alias("a"), "root")

    def match(table: pa.Table) -> pa.Table:
        x, y, n_x, n_y = (table[c].to_pylist() for c in ("left_id", "right_id", "n_left", "n_right"))
        n = largest_matching(list(zip(x, y)), dict(zip(x, n_x)), dict(zip(y, n_y)))
        return pa.table({"key_": table["key_"].slice(0, 1), "matched": pa.array([n], pa.int64())})

    parts = named.join(roots.hint("merge"), "a").groupBy("root").applyInArrow(match, f"key_ {kind}, matched long")
    return parts.groupBy(F.col("key_").alias(key)).agg(F.sum("matched").alias("matched"))
