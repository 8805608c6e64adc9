"""Edit distance of token sequences, a column of the dynamic programme at a time as bits of whole numbers.

The vertical differences of a column are two bit vectors, one bit a row (Myers 1999, in the form of Hyyrö 2003), so a
token costs some operations on numbers of as many bits as the other sequence has tokens. Where at most k edits matter,
only the 2k + 1 rows around the diagonal do (Ukkonen's band), and the vectors slide along it. Without a bound, bands of
growing width are tried first: distance d costs about d times the length, not the product of both.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Width in tokens from which bands are tried, and how much wider the next one is.
FIRST_BAND, WIDER = 64, 4


def _places(tokens: Sequence[Hashable]) -> dict[Hashable, int]:
    """By token, a number with the bits of the places where it stands."""
    found: dict[Hashable, list[int]] = {}
    for i, t in enumerate(tokens):
        found.setdefault(t, []).append(i)
    out = {}
    for t, at in found.items():
        bits = bytearray(at[-1] // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[t] = int.from_bytes(bits, "little")
    return out


def _whole(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Distance by whole columns; a isn't empty."""
    at, m = _places(a), len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for t in b:
        same = at.get(t, 0)
        x = same | down
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(level | up)), up & level
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(x | rise)) & full, rise & x
    return score


def _banded(a: Sequence[Hashable], b: Sequence[Hashable], k: int) -> int | None:
    """Distance within k rows of the diagonal, None if it is more than k. Bit i of column j stands for row j - k + i."""
    shift = len(a) - len(b)
    if abs(shift) > k:
        return None
    at, width = _places(a), 2 * k + 1
    full, end = (1 << width) - 1, 1 << (k + shift)  # the diagonal that ends in the last row of the last column
    up, down, score = full & ~((1 << k) - 1), 0, abs(shift)
    for j, t in enumerate(b, 1):
        same = at.get(t, 0)
        skip = j - k - 1
        same = (same >> skip if skip > 0 else same << -skip) & full
        level = ((((same & up) + up) ^ up) | same | down) & full
        if j > -shift and not level & end:
            score += 1
            if score > k:  # a diagonal never falls
                return None
        rise, fall = down | (full & ~(level | up)), level & up
        level >>= 1
        up, down = fall | (full & ~(level | rise)), level & rise
    return score


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], most: int | None = None) -> int | None:
    """Fewest inserted, deleted or replaced tokens between two sequences; None where that is more than most."""
    if len(a) > len(b):
        a, b = b, a
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if most is not None and len(b) - len(a) > most:
        return None
    if not a:
        return len(b)
    # Of at most k edits every band that reaches them is right; wider ones than half of a column save nothing.
    limit, k = len(b) if most is None else most, FIRST_BAND
    while 4 * k < len(a):
        found = _banded(a, b, min(k, limit))
        if found is not None or k >= limit:
            return found
        k *= WIDER
    if 4 * limit < len(a):
        return _banded(a, b, limit)
    found = _whole(a, b)
    return found if found <= limit else None


@F.pandas_udf(LongType())
def token_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance of two arrays of tokens; null where one of them is."""
    return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")
