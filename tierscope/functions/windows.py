"""Where the pages of a document lie in a flat text without page marks, all of them found in one pass.

The lines that may tell a page's place, its longest ones, and those that may border another page are gathered over all
pages of a document into one Aho-Corasick automaton. The flat text runs through it once and gives every place of every
line; which of them begins or ends a page is then a search among sorted places.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import bound_batches

# Least length and number of lines that tell a place and the lengths of them that are looked for, least
# length of lines at a border and what is looked for of them, what a page has at least before a near border is believed,
# and the least and greatest width without a border and how much wider than the page's text it is.
PLACE_LENGTH, PLACE_LINES, PLACE_WIDTHS = 24, 5, (80, 48, 30)
BORDER_LENGTH, BORDER_WIDTH, NEAR = 12, 60, 200
LEAST_WIDTH, MOST_WIDTH, TIMES_TEXT = 600, 4000, 3

_SPACES = re.compile("[\\x09-\\x0d\\x20\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
_PLAIN = {c: to for first, last, to in ((0x2018, 0x201B, "'"), (0x201C, 0x201F, '"'), (0x2010, 0x2015, "-")) for c in range(first, last + 1)}


def folded(text: str | None) -> str:
    """Curly quotes and dashes plain, white space single, none at the ends."""
    return _SPACES.sub(" ", (text or "").translate(_PLAIN)).strip(" ")


@dataclass
class Page:
    """What is looked for of a page: starts of its longest lines, best first, and its lines with the starts that border."""

    places: list[str]
    borders: dict[str, str]
    size: int

    @classmethod
    def of(cls, text: str | None) -> Page:
        lines = [folded(x) for x in (text or "").split("\n")]
        longest = sorted((x for x in lines if len(x) >= PLACE_LENGTH), key=len, reverse=True)[:PLACE_LINES]
        return cls([x[:w] for x in longest for w in PLACE_WIDTHS if len(x) >= w], {x: x[:BORDER_WIDTH] for x in lines if x}, len(folded(text)))


class Places:
    """Every place of every line of some pages in a flat text, in order."""

    def __init__(self, flat: str, pages: Sequence[Page]):
        self.found: dict[str, list[int]] = {}
        automaton = ahocorasick.Automaton()
        for page in pages:
            for line in (*page.places, *(start for line, start in page.borders.items() if len(line) >= BORDER_LENGTH)):
                automaton.add_word(line, line)
        if len(automaton):
            automaton.make_automaton()
            for last, line in automaton.iter(flat):
                self.found.setdefault(line, []).append(last - len(line) + 1)

    def of(self, page: Page | None) -> int:
        """Where the best line that occurs at all stands first; -1 without one."""
        return next((self.found[x][0] for x in (page.places if page else ()) if x in self.found), -1)

    def border(self, page: Page | None, after: int, other: Page | None = None) -> int:
        """The nearest of the page's lines, those of another page left out, that stands next behind a place; -1 without. A
        line that stands right at the place borders nothing."""
        best = -1
        for line, start in page.borders.items() if page else ():
            if len(line) < BORDER_LENGTH or (other is not None and line in other.borders):
                continue
            at = self.found.get(start, ())
            i = bisect_left(at, after)
            if i < len(at) and at[i] > after and not 0 <= best <= at[i]:
                best = at[i]
        return best


def windows(flat: str | None, texts: Sequence[str | None]) -> list[tuple[str, bool] | None]:
    """For each page of a document, in order: the part of the flat text it seems to be and whether its end is known.

    A page begins at its nearest line behind the place of the page before, or else at its own place; None without either.
    It ends at the nearest line of the page after, unless that is so near that the page after's own place is believed
    instead; without both its width follows its text.
    """
    flat, pages = folded(flat), [Page.of(t) for t in texts]
    places = Places(flat, pages)
    own = [places.of(p) for p in pages]
    out: list[tuple[str, bool] | None] = []
    for i, page in enumerate(pages):
        start = places.border(page, own[i - 1]) if i and own[i - 1] >= 0 else -1
        start = own[i] if start < 0 else start
        if start < 0:
            out.append(None)
            continue
        after, end = (pages[i + 1], own[i + 1]) if i + 1 < len(pages) else (None, -1)
        near = places.border(after, start, page)
        if near > start + NEAR or end <= start:
            end = near
        bounded = end > start
        out.append((flat[start : end if bounded else start + min(MOST_WIDTH, max(LEAST_WIDTH, TIMES_TEXT * page.size))], bounded))
    return out


def page_windows(flat: DataFrame, pages: DataFrame, key: str = "doc_id", text: str = "text", page: str = "page") -> DataFrame:
    """(key, page, text, bounded) for the pages (key, page, text) of documents with a flat text (key, text); null where a page has
    no place in it. A document's pages go together, as they look for one another's lines; pages of one number keep no order."""
    bound_batches(flat.sparkSession)
    together = pages.groupBy(F.col(key).alias("key_")).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text")))).alias("pages_"))

    @F.pandas_udf("array<struct<text:string,bounded:boolean>>")
    def found(flats: pd.Series, listed: pd.Series) -> pd.Series:
        return pd.Series([[{"text": w and w[0], "bounded": w and w[1]} for w in windows(f, list(texts))] for f, texts in zip(flats, listed, strict=True)], dtype=object)

    rows = flat.select(F.col(key).alias("key_"), F.col(text).alias("flat_")).join(together.hint("merge"), "key_")
    rows = rows.select("key_", "pages_", found("flat_", F.transform("pages_", lambda p: p["text"])).alias("windows_"))
    return rows.select(F.col("key_").alias(key), F.inline(F.arrays_zip(F.col("pages_.page").alias(page), F.col("windows_.text").alias("text"), F.col("windows_.bounded").alias("bounded"))))
