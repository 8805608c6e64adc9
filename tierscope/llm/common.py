"""Shared parts: vectorised word hashing, work tables in the shared folder, checked broadcasts, components.

Words are found and hashed with numpy over UTF-8 bytes of a block of texts, never one Python object a
word: about 10 ns a byte, in memory proportional to the block (BLOCK_BYTES, or one longer text).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: Bytes of text that one block of the vectorised operators holds at a time.
BLOCK_BYTES = 1 << 20
#: Most bytes of a side that is broadcast; beyond it the same join runs as a shuffle.
BROADCAST_BYTES = 6 << 20
#: Bytes of an Arrow batch on the way to Python, unless the session has a bound of its own.
BATCH_BYTES = 2 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Separator bytes: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is neither a letter nor a digit; bytes of other scripts belong to words.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, other bytes as they are.
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, order becomes pseudo-random."""
    h = h ^ np.uint64(salt & (2**64 - 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


@dataclass
class Words:
    """The words of a block: data[start:end] is a word of text number doc; h is its 64-bit hash."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """Word offsets by text: the words of text i are bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def words_of(texts: list[str | None], separators: np.ndarray = SPACES, fold: np.ndarray | None = None) -> Words:
    """Words of the texts (null: none). fold maps bytes before hashing; data keeps folded bytes."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    data = b" ".join(parts) + b" "
    raw = np.frombuffer(data, np.uint8)
    if fold is not None:
        raw = fold[raw]
        data = raw.tobytes()
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separators[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, doc, h, len(texts))


def shingles_of(w: Words, k: int, short_as_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of each run of k words within a text, in order, repeats kept.

    short_as_one: a text with 1 to k - 1 words has its whole sequence as its one shingle.
    """
    n = len(w.h)
    if n >= k:
        h = w.h[: n - k + 1].copy()
        for i in range(1, k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w.h[i : n - k + 1 + i]
        ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
        doc, h = w.doc[: n - k + 1][ok], mix(h[ok], k)
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if short_as_one:
        b = w.bounds()
        size = np.diff(b)
        few = np.flatnonzero((size > 0) & (size < k))
        if len(few):
            own = np.zeros(len(few), np.uint64)
            for i in range(k - 1):
                more = size[few] > i
                own[more] = own[more] * np.uint64(0xD6E8FEB86659FD93) + w.h[b[few[more]] + i]
            own = mix(own, 1000 + k) + size[few].astype(np.uint64)
            doc, h = np.concatenate([doc, few]), np.concatenate([h, own])
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
    return doc, h


def blocks(frames: Iterable[pd.DataFrame], text: str, size: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """The rows again in frames of about size characters of text each; a longer text stands alone."""
    for frame in frames:
        lengths = frame[text].str.len().fillna(0).to_numpy(np.int64) if len(frame) else np.zeros(0, np.int64)
        first, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield frame.iloc[first:i].reset_index(drop=True)
                first, held = i, 0
            held += n + 1
        if first < len(frame):
            yield frame.iloc[first:].reset_index(drop=True)


def texts_in(frame: pd.DataFrame, text: str) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in frame[text]]


_stores: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Says how to empty what an operator keeps in a Python worker from task to task."""
    _stores[owner] = drop


def _begin(owner: str) -> None:
    """A task of an operator begins: the stores of the others are emptied."""
    for name, drop in _stores.items():
        if name != owner:
            drop()


def _end() -> None:
    """A task is over. Workers live on, and the next stage's tasks may use others: free memory goes back."""
    global _powers
    _powers = (_powers[0][:1].copy(), _powers[1][:1].copy())
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def tidy(run: Run, owner: str = "") -> Run:
    """The same function for mapInPandas; its tasks empty the stores of other operators and leave no free memory held.
    What is sent to the workers names the module's functions only, so that these act on the worker's own module."""

    def tidied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _begin(owner)
        try:
            yield from run(frames)
        finally:
            _end()

    return tidied


def map_frames(df: DataFrame, run: Run, schema: str, owner: str = "") -> DataFrame:
    """mapInPandas that keeps whole numbers whole: where a batch has nulls in a column of longs, pandas would make it doubles,
    which hold 53 bits; here it has Python's numbers and None. Tasks are tidied as tidy() does."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (batch.to_pandas(integer_object_nulls=True) for batch in batches)
        for frame in tidy(run, owner)(frames):
            yield from pa.Table.from_pandas(frame, schema=arrow, preserve_index=False).to_batches()

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(mapped, schema)


def in_batches(df: DataFrame) -> DataFrame:
    """The same rows, to go to Python in batches of bounded bytes, however long the texts are: rows by count alone
    would hold ten thousand texts at once. The bound is a setting of the session; one of its own stays."""
    conf = df.sparkSession.conf
    if int(str(conf.get(_BATCH, str(_BATCH_DEFAULT))).rstrip("bB") or 0) == _BATCH_DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def read(spark: SparkSession, sf_dir: str, table: str, even: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if even else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, where a small input has fewer; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder from spark.checkpoint.dir; only where that is unset and all runs in one process, as in tests,
    one of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tierscope-")
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a work table to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and broadcasts of finished steps; it follows the driver's collector, and
    that Python's, whose objects for Java's hold each other."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            size = size + F.greatest(F.size(f.name), F.lit(0)) * 8
        size = size + 8
    return size


def join_checked(df: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner", most: int | None = None) -> DataFrame:
    """Join with a stored table: broadcast if it has at most so many bytes, otherwise a sorted join of the same result, which
    Spark doesn't turn into a broadcast by the size of compressed files."""
    size = small.agg(F.sum(_row_bytes(small))).first()[0] or 0
    return df.join(F.broadcast(small) if size <= (BROADCAST_BYTES if most is None else most) else small.hint("merge"), on, how)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over the edges, for every node that has one.

    Alternates large-star and small-star rounds; each round's edges are checkpointed. Joins on a
    node are plain equi-joins, so AQE splits hot nodes; minima are combined before the shuffle.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct().checkpoint()
    before = None
    while True:
        near = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = near.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = near.where(F.col("y") > F.col("x")).join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        pairs = small.unionByName(low.select("x", F.col("m").alias("y"))).distinct().checkpoint()
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return pairs.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(pairs.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
