"""JSON lines in an order, with one hash for all of them: a tree over blocks of lines.

Lines get their place in the whole order from their place in a sorted partition and the sizes of those before it. A block
is BLOCK lines that follow one another, wherever partitions end; its hash is the SHA-256 of its lines, the next level's
that of BLOCK hashes, up to one. So the root depends on the rows and their order only, no task hashes more than a block
at a time, and nothing but the root reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.work import written
from .files import write_new

#: Lines of a block, and hashes of one on the next level.
BLOCK = 1000
_EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Written:
    """Lines of an output, and the root of their hashes."""

    path: str
    rows: int
    root: str


def placed_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(place, line): each row as JSON, numbered from 0 in the order of columns; equal rows in any order are equal lines."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), line.alias("line"))
    keys = [*(f"o{i}" for i in range(len(order))), "line"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Numbered where they are written: high bits are the partition, low ones the row in it.
    numbered = written(ordered.select(F.monotonically_increasing_id().alias("n"), "line"), "lines")
    part = F.shiftright("n", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))  # a row a partition
    return numbered.join(F.broadcast(before), part == F.col("part")).select((F.col("before") + F.col("n").bitwiseAND((1 << 33) - 1)).alias("place"), "line")


def _level(df: DataFrame, value: str) -> DataFrame:
    """The hashes of the blocks of a level, numbered."""
    block = F.floor(F.col("place") / BLOCK).alias("place")
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), F.col(value).alias("v")))), lambda x: x["v"]), "\n")
    return df.groupBy(block).agg(F.sha2(own, 256).alias("hash"))


def tree_root(lines: DataFrame) -> tuple[int, str]:
    """Number of lines (place, line) and the root of their tree; the empty text's hash without lines."""
    n = lines.count()
    if not n:
        return 0, _EMPTY
    level, left = _level(lines, "line"), -(-n // BLOCK)
    while left > 1:
        level, left = _level(level, "hash"), -(-left // BLOCK)
    return n, level.first()["hash"]


def write_lines(df: DataFrame, path: str, order: list[str]) -> Written:
    """Write rows as JSON lines, files and lines in order, where nothing is yet; beside it, as path.manifest, rows and root."""
    lines = written(placed_lines(df, order), "placed")
    n, root = tree_root(lines)
    write_new(lines.repartitionByRange("place").sortWithinPartitions("place").select(F.col("line").alias("value")), path, "text")
    manifest = json.dumps({"rows": n, "root": root, "block": BLOCK}, sort_keys=True)
    write_new(df.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1), f"{path}.manifest", "text")
    return Written(path, n, root)


def verify_lines(df: DataFrame, path: str, order: list[str]) -> bool:
    """Whether rows have the root that the manifest of an output tells."""
    told = json.loads(df.sparkSession.read.text(f"{path}.manifest").first()["value"])
    return tree_root(placed_lines(df, order)) == (told["rows"], told["root"])
