"""Benchmark decontamination: block-max WAND over a BM25 index of test items, then question and answer overlap.

The test items are the indexed side, and every passage of every document is a query. Impacts are BM25 scores
divided by the item's own score, so one threshold fits short and long items. An item of more
than PASSAGE words, of which a passage holds too small a share, is indexed as pieces of at most PIECE words, each
with its own score: a copy of a piece lies whole in some passage. A find of a piece is verified on the whole item.

Posting lists are sparse and lie in blocks of items, and keep the largest impact of the list and of each block. Both bounds are taken with numpy for many
passages at once: the sum of the terms' list maxima must reach the threshold, then the sum of their maxima for a
block of items. The blocks left, few, are walked by pivots: the lists' cursors in the order of their items, the pivot
where the maxima so far reach the threshold, and a score in full only where all cursors before it stand there too.
Bounds never fall short, so every passage and item above the threshold is found. A find is verified on words: at least
OVERLAP of the item's runs of five words stand near the passage, and both its question and its answer are covered.

The index goes to every task: it has 8 bytes for each distinct word of an item, so it follows the benchmark and not
the corpus; more than MOST_POSTINGS of them are refused. Documents are read once. Null texts count as empty and match
nothing; items without words are left out; repeated items and rows repeat finds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, Words, blocks, in_batches, join_checked, map_frames, stored, texts_in, words_of

#: Words in a passage, and from one passage's begin to the next one's.
PASSAGE, STRIDE = 64, 32
#: Most words of a piece of a longer item: a run of so many words lies within a passage, wherever it begins.
PIECE = PASSAGE - STRIDE
#: Least BM25 score of a find, as a share of the item's own score.
THRESHOLD = 0.4
#: Words in a run, and the share of an item's runs that make it a leak.
RUN, OVERLAP = 5, 0.8
#: Share of the question's words, and of the answer's, that found runs must cover.
PART_OVERLAP = 0.5
K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
#: Cells of passages by blocks that are bounded at once; most postings of an index, 400 MB.
CELLS, MOST_POSTINGS = 1 << 19, 50_000_000


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    question: int  # its first words; the others are the answer
    k: int
    runs: np.ndarray


@dataclass
class Piece:
    """What is indexed: an item's words, or a run of them."""

    item: Item
    words: np.ndarray


@dataclass
class Index:
    """Postings by term, in the order of the pieces: first[t]:first[t + 1] of piece and impact, and likewise of blocks."""

    pieces: list[Piece]
    terms: np.ndarray  # sorted hashes
    first: np.ndarray
    piece: np.ndarray
    impact: np.ndarray
    first_block: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    list_max: np.ndarray


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
    return out


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence or line, or without one the last quarter of the words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _words(texts: list[str | None]) -> Words:
    return words_of([t.lower() if t else t for t in texts], NON_WORD)


def build_items(rows: list[tuple[object, str | None]]) -> list[Item]:
    items = []
    for item_id, text in rows:
        question, answer = split_item(text or "")
        w = _words([question, answer])
        if len(w.h):
            k = min(RUN, len(w.h))
            items.append(Item(item_id, w.h, int((w.doc == 0).sum()), k, run_hashes(w.h, k)))
    return items


def pieces_of(item: Item) -> list[Piece]:
    """The whole item where two passages that follow each other hold it, so that one has half of its score; else pieces of like size."""
    n = len(item.words)
    return [Piece(item, part) for part in np.array_split(item.words, 1 if n <= PASSAGE else -(-n // PIECE))]


def build_index(items: list[Item], k1: float = K1, b: float = B) -> Index | None:
    """Inverse document frequencies are over items; impacts are by piece."""
    if not items:
        return None
    terms, df = np.unique(np.concatenate([np.unique(i.words) for i in items]), return_counts=True)
    idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
    # Pieces of like length stand together, which makes tight block maxima.
    pieces = sorted((p for i in items for p in pieces_of(i)), key=lambda p: len(p.words))
    mean = np.mean([len(p.words) for p in pieces])
    term, impact = [], []
    for p in pieces:
        own, tf = np.unique(p.words, return_counts=True)
        at = np.searchsorted(terms, own)
        w = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(p.words) / mean))
        term.append(at)
        impact.append((w / w.sum()).astype(np.float32))
    if (n := sum(map(len, term))) > MOST_POSTINGS:
        raise ValueError(f"a benchmark of {n} postings doesn't go to every task; split it")
    piece, term, impact = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(t) for t in term]), np.concatenate(term), np.concatenate(impact)
    order = np.argsort(term, kind="stable")
    piece, term, impact = piece[order], term[order], impact[order]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    heads = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(piece // BLOCK_ITEMS, prepend=-1) != 0))
    return Index(pieces, terms, first, piece, impact, np.searchsorted(term[heads], np.arange(len(terms) + 1)), piece[heads] // BLOCK_ITEMS, np.maximum.reduceat(impact, heads), np.maximum.reduceat(impact, first[:-1]))


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last word of each passage; the last passage of a text reaches its end."""
    bounds = w.bounds()
    size = np.diff(bounds)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - PASSAGE) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[doc] + number * STRIDE
    return first, np.minimum(first + PASSAGE, bounds[doc + 1])


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last]."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[last] - total[first]


def walk(index: Index, terms: list[int], block: int, threshold: float) -> Iterator[tuple[int, float]]:
    """(piece, score) of the pieces of a block that reach the threshold with the terms, by pivots."""
    low, high = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
    cursors = []  # [piece, place of its posting, past the last place, largest impact in the block]
    for a, b in zip(index.first[terms].tolist(), index.first[np.add(terms, 1)].tolist(), strict=True):
        a = bisect_left(index.piece, low, a, b)
        b = bisect_left(index.piece, high, a, b)
        if a < b:
            cursors.append([int(index.piece[a]), a, b, max(index.impact[a:b].tolist())])
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for c in cursors:
            bound += c[3]
            if bound >= threshold - 1e-6:
                pivot = c[0]
                break
        if pivot < 0:
            return
        if cursors[0][0] == pivot:
            score = float(sum(index.impact[c[1]] for c in cursors if c[0] == pivot))
            if score >= threshold:
                yield pivot, score
            pivot += 1
        for c in cursors:
            while c[0] < pivot:
                c[1] += 1
                c[0] = int(index.piece[c[1]]) if c[1] < c[2] else high
        cursors = [c for c in cursors if c[0] < high]


def search(w: Words, index: Index, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, float]]:
    """(first word, past-the-last word, piece number, score) of every passage and piece at or above the threshold."""
    first, last = passages(w)
    at = np.minimum(np.searchsorted(index.terms, w.h), len(index.terms) - 1)
    known = index.terms[at] == w.h
    # A term counts once in a query, but its repeats may stay in an upper bound.
    fit = np.flatnonzero(_sums(np.where(known, index.list_max[at], 0.0), first, last) >= threshold - 1e-6)
    # Only the known words of those passages are looked at any more.
    seen, where = np.concatenate([[0], np.cumsum(known)]), np.flatnonzero(known)
    n_blocks = -(-len(index.pieces) // BLOCK_ITEMS)
    step = max(1, CELLS // n_blocks)
    for chunk in (fit[i : i + step] for i in range(0, len(fit), step)):
        a, b = seen[first[chunk]], seen[last[chunk]]
        owner = np.repeat(np.arange(len(chunk)), b - a)
        term = at[where[np.arange(len(owner)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]]
        pair = np.unique(owner * np.int64(len(index.terms)) + term)
        owner, term = pair // len(index.terms), pair % len(index.terms)
        size = index.first_block[term + 1] - index.first_block[term]
        entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(index.first_block[term], size)
        bound = np.bincount(np.repeat(owner, size) * n_blocks + index.block[entry], index.block_max[entry], len(chunk) * n_blocks)
        cut = np.searchsorted(owner, np.arange(len(chunk) + 1))
        for cell in np.flatnonzero(bound >= threshold - 1e-6).tolist():
            p, block = divmod(cell, n_blocks)
            for piece, score in walk(index, term[cut[p] : cut[p + 1]].tolist(), block, threshold):
                yield int(first[chunk[p]]), int(last[chunk[p]]), piece, score


def verify(h: np.ndarray, item: Item) -> tuple[float, float, float]:
    """Share of the item's runs that stand in a region of words, and the shares of its question and answer they cover."""
    hit = np.isin(item.runs, run_hashes(h, item.k))
    covered = np.zeros(len(item.words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + item.k, -1)
    covered = np.cumsum(covered)[:-1] > 0
    q, a = covered[: item.question], covered[item.question :]
    return float(hit.mean()), float(q.mean()) if len(q) else 1.0, float(a.mean()) if len(a) else 1.0


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and item that it holds: id, item id, score, overlap, question_overlap, answer_overlap.

    The benchmark is gathered on the driver: its size is that of a published test set, not of the corpus.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    index = build_index(build_items([tuple(r) for r in benchmark.select(item_col, item_text).orderBy(item_col, item_text).collect()]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_"):
            w = _words(texts_in(frame, "text_"))
            bounds, best = w.bounds(), {}
            for first, last, i, score in search(w, index, threshold) if index is not None and len(w.h) else ():
                item, doc = index.pieces[i].item, int(w.doc[first])
                wide = len(item.words)
                found = verify(w.h[max(bounds[doc], first - wide) : min(bounds[doc + 1], last + wide)], item)
                if found[0] >= OVERLAP and min(found[1:]) >= PART_OVERLAP:
                    key = (doc, id(item))
                    if key not in best or best[key][1:] < (found[0], score):
                        best[key] = (item.item_id, found[0], score, *found[1:])
            rows = [(frame["id_"][doc], item_id, score, overlap, q, a) for (doc, _), (item_id, overlap, score, q, a) in best.items()]
            yield pd.DataFrame(rows, columns=[id_col, item_col, "score", "overlap", "question_overlap", "answer_overlap"], dtype=object)

    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, overlap double, question_overlap double, answer_overlap double"
    return map_frames(in_batches(docs).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id has no find."""
    leaks = stored(find_leaks(docs, benchmark, id_col, text_col).select(id_col).distinct(), "leaks")
    return join_checked(docs, leaks, id_col, "left_anti").select(docs.columns)
