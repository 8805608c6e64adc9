"""Byte-level BPE encoding and decoding by a segment tree of pair ranks.

Each leaf of the tree belongs to a byte position and holds the rank of the pair of live parts that begins
there; an inner node holds the smaller child, the left one of two equal ranks. A merge reads the root,
joins two neighbours in a linked list and updates at most three leaves, each in logarithmic time, so a
piece of n bytes takes O(n log n) whatever it looks like. Pieces up to 32 bytes, nearly all, go through
the same tree many at a time, one row of arrays each.

Null texts count as empty. Rows are independent. Pieces repeat a lot, so results by piece are kept in a
store of bounded size; it changes the time only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, in_batches, keeps, map_frames, texts_in

#: Pieces kept by the store of a Python worker, at about 200 bytes each.
KEPT_PIECES = 250_000
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the leftmost pair of lowest rank merges until none is known."""
    if not piece:
        return []
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift = n.bit_length()
    mask = (1 << shift) - 1
    tree = [_NONE] * (2 * size)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            if a > b:
                a = b
            if tree[i] == a:
                return
            tree[i] = a
            i >>= 1

    while (top := tree[1]) != _NONE:
        i = top & mask
        j = after[i]
        end[i] = end[j]
        after[i] = k = after[j]
        put(j, _NONE)
        if k < n:
            before[k] = i
            r = get(piece[i : end[k]])
            put(i, _NONE if r is None else r << shift | i)
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            r = get(piece[h : end[i]])
            put(h, _NONE if r is None else r << shift | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class PairTable:
    """(left id, right id) to the id of their concatenation, as an open-addressed table for numpy lookups."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(a, b): r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.bits = max(8, (4 * len(pairs) + 1).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values, slots = np.array(list(pairs.values()), np.int64), self._slot(keys)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            free = left[self.key[slots[left]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            free = free[first]
            self.key[slots[free]], self.value[slots[free]] = keys[free], values[free]
            left = np.setdiff1d(left, free, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids, -1 where the concatenation isn't a token."""
        keys = a << 32 | b
        slots = self._slot(keys)
        found, out = self.key[slots], self.value[slots]
        out = np.where(found == keys, out, -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.value[slots[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def merge_pieces(pieces: list[bytes], width: int, pairs: PairTable, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge_piece for many pieces of at most width bytes (a power of two) in lockstep: ids one after the
    other, and how many each piece has. Row r of levels[0] holds the leaves of piece r's tree."""
    n, shift = len(pieces), width.bit_length()
    length = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    token = byte_ids[raw]
    place = np.arange(width)
    live = place < length[:, None]
    after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
    leaf = np.full((n, width), _NONE, np.int64)
    if width > 1:
        ranks = pairs.get(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
        leaf[:, :-1] = np.where((ranks >= 0) & live[:, 1:], ranks << shift | place[:-1], _NONE)
    levels = [leaf]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
    rows = np.arange(n)
    while len(rows := rows[levels[-1][rows, 0] != _NONE]):
        top = levels[-1][rows, 0]
        i = top & ((1 << shift) - 1)
        j = after[rows, i]
        k = after[rows, j]
        token[rows, i], after[rows, i], live[rows, j] = top >> shift, k, False
        more = k < length[rows]
        before[rows[more], k[more]] = i[more]
        h = before[rows, i]
        first = h < 0
        h = np.where(first, i, h)
        right = pairs.get(token[rows, i], token[rows, np.minimum(k, width - 1)])
        right = np.where((right >= 0) & more, right << shift | i, _NONE)
        left = pairs.get(token[rows, h], token[rows, i])
        left = np.where(left >= 0, left << shift | h, _NONE)
        leaf[rows, j], leaf[rows, i] = _NONE, right
        leaf[rows, h] = np.where(first, right, left)
        for low, high in zip(levels, levels[1:], strict=False):
            h, i, j = h >> 1, i >> 1, j >> 1
            for x in (h, i, j):
                high[rows, x] = np.minimum(low[rows, 2 * x], low[rows, 2 * x + 1])
    return token[live], live.sum(axis=1)


class ByteBPE:
    """Encoder and decoder for a rank file's pieces, cut by a pattern; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = KEPT_PIECES):
        self.ranks, self.pattern, self.keep = ranks, regex.compile(pattern), keep
        self.token = {i: b for b, i in ranks.items()}
        self.pairs, self.byte_ids = PairTable(ranks), np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.name = [str(i) for i in range(max(self.token) + 1)]
        # Ids of pieces, joined by commas; what the ids of a piece decode to where that isn't the piece.
        self.store: dict[str, str] = {}
        self.changed: dict[str, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return [i for m in self.pattern.finditer(text) for i in merge_piece(m.group().encode(), self.ranks)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces, by width of the tree that they need, over 32 bytes one at a time, and decode their ids."""
        by: dict[int, list[str]] = {}
        for p in pieces:
            n = len(p.encode())
            by.setdefault(8 if n <= 8 else 16 if n <= 16 else 32 if n <= 32 else 0, []).append(p)
        for width, group in by.items():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                if width:
                    ids, counts = merge_pieces([p.encode() for p in part], width, self.pairs, self.byte_ids)
                    ids, ends = ids.tolist(), np.cumsum(counts).tolist()
                else:
                    each = [merge_piece(p.encode(), self.ranks) for p in part]
                    ids, ends = [i for x in each for i in x], np.cumsum([len(x) for x in each]).tolist()
                names, data = list(map(self.name.__getitem__, ids)), list(map(self.token.__getitem__, ids))
                a = 0
                for p, b in zip(part, ends, strict=True):
                    self.store[p] = ",".join(names[a:b])
                    if (decoded := b"".join(data[a:b])) != p.encode():
                        self.changed[p] = decoded
                    a = b

    def encoded(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """For each text: number of tokens, ids joined by commas, and the bytes that the ids decode to."""
        cut = [self.pattern.findall(t) for t in texts]
        wanted: set[str] = set().union(*cut)
        if len(self.store) + len(wanted) > self.keep:
            self.store = {p: x for p in wanted if (x := self.store.get(p)) is not None}
            self.changed = {p: x for p, x in self.changed.items() if p in self.store}
        self.learn([p for p in wanted if p not in self.store])
        out = []
        for pieces in cut:
            ids = ",".join(map(self.store.__getitem__, pieces))
            data = b"".join(self.changed[p] if p in self.changed else p.encode() for p in pieces) if self.changed else "".join(pieces).encode()
            out.append((ids.count(",") + 1 if ids else 0, ids, data))
        return out


_codecs: dict[tuple[str, str], ByteBPE] = {}
keeps(__name__, _codecs.clear)


def codec(path: str, pattern: str) -> ByteBPE:
    """The codec of a rank file, loaded once in each Python worker; a file sent with addFile also does."""
    if (path, pattern) not in _codecs:
        try:
            ranks = load_ranks(path)
        except FileNotFoundError:
            ranks = load_ranks(SparkFiles.get(path.rsplit("/", 1)[-1]))
        _codecs[path, pattern] = ByteBPE(ranks, pattern)
    return _codecs[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, token count, ids joined by commas, decoded text. path must exist on every node of the cluster."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for frame in frames:
            for part in blocks([frame], "text_"):
                rows = own.encoded([t or "" for t in texts_in(part, "text_")])
                yield pd.DataFrame({id_col: part["id_"].to_numpy(), "n_tokens": [r[0] for r in rows], "ids": [r[1] for r in rows], "decoded": [r[2] for r in rows]})

    return map_frames(in_batches(df).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), run, f"`{id_col}` {kind}, n_tokens long, ids string, decoded binary", __name__)


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, token count, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for frame in blocks(frames, "text_"):
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()) for n, ids, data in own.encoded([t or "" for t in texts_in(frame, "text_")])]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, frame["id_"])
            yield out

    return map_frames(in_batches(df).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", __name__)
