"""Unicode counting, sanity, script and comparison functions over text columns.

Character classes are spelled out, as the engines' shorthands differ. Counts are of code points; where the
specified behaviour is in UTF-16 units, it says so.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .core import bound_batches
from .distance import token_edit_distance

# Unicode classes as regular-expression sets.
ECMA_SPACE = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WHITE_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
THAI_BLOCK = r"[\x{0E00}-\x{0E7F}]"
LATIN = r"\p{IsLatin}"
LATIN_LETTER = r"[\p{L}&&\p{IsLatin}]"
LINE_ENDS = ("\n", "\r", "\u2028", "\u2029")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """The text in NFC. Code points below U+0300 are so already; only texts with others go to Python."""
    wide = (F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x{0000}-\x{02FF}]")
    return F.when(wide, _nfc(F.when(wide, text))).otherwise(text)


def count_of(text: Column, pattern: str) -> Column:
    """Code points of a class, by the length that a text loses without them: no match becomes an object."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))).cast("long")


#: What one pass counts of each text, as ranges of code points; of letters and Latin characters only those below U+0300, where
#: every code point has been assigned for long. Those beyond go back as a text, for the engine's own tables.
_RANGES = {
    "ecma_space": [(0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)],
    "white_space": [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)],
    "signal_anomaly": [(0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F), (0xE000, 0xF8FF), (0xFFFD, 0xFFFD), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)],
    "gate_anomaly": [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x7F), (0xE000, 0xF8FF), (0xFFFD, 0xFFFD)],
    "thai_letter": [(0x0E01, 0x0E30), (0x0E32, 0x0E33), (0x0E40, 0x0E46)],
    "thai_block": [(0x0E00, 0x0E7F)],
    "letter": [(c, c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L"],
    "latin": [(c, c) for c in range(0x300) if regex.match(r"\p{Script=Latin}", chr(c))],
    "latin_letter": [(c, c) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L" and regex.match(r"\p{Script=Latin}", chr(c))],
}
_COUNTS = StructType([*(StructField(n, LongType()) for n in (*_RANGES, "run_penalty", "length")), StructField("wide", StringType())])


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(the kind of each code point, the classes of each kind): code points of one kind are in the same classes."""
    bits = np.zeros(0x110000, np.uint16)
    for i, ranges in enumerate(_RANGES.values()):
        for first, last in ranges:
            bits[first : last + 1] |= 1 << i
    found, kind = np.unique(bits, return_inverse=True)
    return kind.astype(np.uint8), (found[:, None] >> np.arange(len(_RANGES)) & 1).astype(np.int64)


def _penalties(points: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """By text, over all maximal runs of 8 or more of one character that ends no line: their UTF-16 length less 7."""
    out = np.zeros(n, np.int64)
    if len(points) < 8:
        return out
    same = points[1:] == points[:-1]
    border = starts[(starts > 0) & (starts < len(points))]
    same[border - 1] = False
    two = same[:-1] & same[1:]
    four = two[:-2] & two[2:]
    at = np.flatnonzero(four[:-3] & four[3:])  # where eight alike begin
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        size, char = np.diff(first, append=len(at)) + 7, points[at[first]]
        cost = np.where(np.isin(char, [ord(c) for c in LINE_ENDS]), 0, size * np.where(char > 0xFFFF, 2, 1) - 7)
        np.add.at(out, np.searchsorted(starts, at[first], side="right") - 1, cost)
    return out


def _count_batch(texts: list[str]) -> pa.StructArray:
    """_COUNTS of texts, by numpy over the code points of all of them together."""
    n, (kind, classes) = len(texts), _kinds()
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.diff(ends, prepend=0)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(n) * len(classes), ends - starts)
    counts = np.bincount(text + kind[points], minlength=n * len(classes)).reshape(n, -1) @ classes
    wide = [""] * n
    beyond = points >= 0x300
    if beyond.any():
        by_text = np.concatenate([[0], np.cumsum(beyond)])
        joined = points[beyond].tobytes().decode("utf-32-le", "surrogatepass")
        wide = [joined[i:j] for i, j in zip(by_text[starts].tolist(), by_text[ends].tolist(), strict=True)]
    columns = [*counts.T, _penalties(points, starts, n), ends - starts]
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(wide, pa.string())], names=[*_RANGES, "run_penalty", "length", "wide"])


def _counter(normalise: bool) -> Callable[[Column], Column]:
    @F.arrow_udf(_COUNTS)
    def counts(text: pa.Array) -> pa.Array:
        found = ["" if t is None else t for t in text.to_pylist()]
        return _count_batch([t if t.isascii() else unicodedata.normalize("NFC", t) for t in found] if normalise else found)

    return counts


_counts_of, _counts_of_nfc = _counter(False), _counter(True)


def character_counts(text: Column, normalise: bool = False) -> Column:
    """Of NFC text, or of any text's NFC: non-space characters, anomalies, letters, Thai and Latin letters."""
    bound_batches()
    c = (_counts_of_nfc if normalise else _counts_of)(text)
    n = lambda column: F.when(text.isNotNull(), column)
    return F.struct(
        n(c["length"] - c["ecma_space"]).alias("text_chars"),
        n(c["signal_anomaly"]).alias("anomalous_chars"),
        n(c["letter"] + count_of(c["wide"], r"\p{L}")).alias("letter_chars"),
        n(c["thai_letter"]).alias("thai_chars"),
        n(c["latin_letter"] + count_of(c["wide"], LATIN_LETTER)).alias("latin_chars"),
    )


def gate_counts(text: Column) -> dict[str, Column]:
    """What the gate counts in a text, one pass for all: solid_, bad_, thai_, latin_. bad_ has, beside anomalies, the penalty of
    runs: over all maximal ones of 8 or more of one character that ends no line, their UTF-16 length less 7."""
    bound_batches()
    c = _counts_of(text)
    n = lambda column: F.when(text.isNotNull(), column)
    return {"solid_": n(c["length"] - c["white_space"]), "bad_": n(c["gate_anomaly"] + c["run_penalty"]), "thai_": n(c["thai_block"]), "latin_": n(c["latin"] + count_of(c["wide"], LATIN))}


def character_sanity(solid: Column, bad: Column) -> Column:
    """1 less the share of anomalies and run penalty among the non-space characters, at least 0."""
    return F.when(solid == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - bad / F.when(solid > 0, solid)))


def script_consistency(thai: Column, latin: Column, thai_ratio: Column, latin_ratio: Column) -> Column:
    """Least share of an expected script against what the inspection saw; null if neither is expected."""
    total = thai + latin

    def share(n: Column, expected: Column) -> Column:
        return F.when(expected >= 0.1, F.least(F.lit(1.0), n / F.when(total > 0, total) / F.when(expected > 0, expected)))

    return F.when((thai_ratio < 0.1) & (latin_ratio < 0.1), F.lit(None).cast("double")).when(total == 0, F.lit(0.0)).otherwise(F.least(share(thai, thai_ratio), share(latin, latin_ratio)))


def strip_markup(text: Column) -> Column:
    """Tags, quotes respected, become one space; paired $$ and $ are unwrapped, a $ before a digit isn't paired."""
    out = F.regexp_replace(text, r"""<[A-Za-z/!?](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""", " ")
    out = F.regexp_replace(out, r"\$\$([\s\S]*?)\$\$", "$1")
    return F.regexp_replace(out, r"\$((?:[^0-9$][^$]*)?)\$", "$1")


def for_cer(text: Column) -> Column:
    """NFC, no markup, no white space."""
    return nfc(F.regexp_replace(strip_markup(nfc(text)), WHITE_SPACE + "+", ""))


def for_wer(text: Column, script: Column) -> Column:
    """NFC, no markup; Thai without white space, other scripts with single spaces, trimmed."""
    plain = strip_markup(nfc(text))
    spaced = F.regexp_replace(F.regexp_replace(plain, ECMA_SPACE + "+", " "), "^ +| +$", "")
    return F.when(script == "thai", F.regexp_replace(plain, WHITE_SPACE + "+", "")).otherwise(spaced)


#: Word segments by the rules for letters, marks, digits and connectors; scripts that need a dictionary give
#: clusters of a base and its marks instead, one token each.
_WORD = regex.compile(r"\p{Script=Thai}\p{M}*|(?:[\p{L}\p{N}_--\p{Script=Thai}]\p{M}*(?:[.'\u2019](?=\p{L})|[.,](?=\p{N}))?)+", regex.V1)


def default_segmenter(text: str, script: str) -> list[str]:
    return _WORD.findall(text)


def word_tokens(segmenter=default_segmenter):
    """A function of (normalised text, script) to word tokens; another segmenter can be plugged in."""

    @F.pandas_udf(ArrayType(StringType()))
    def tokens(text: pd.Series, script: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else segmenter(t, s) for t, s in zip(text, script, strict=True)], dtype=object)

    return tokens


def error_rate(edits: Column, reference_length: Column, output_length: Column) -> Column:
    """Edits by reference length; an empty reference with output is excluded, not zero."""
    from .core import metric

    lost = (reference_length == 0) & (output_length > 0)
    return metric(F.when(lost, F.lit(0).cast("long")).otherwise(edits), reference_length.cast("long"), F.when(lost, 1).otherwise(0))


def character_error_rate(reference: Column, output: Column) -> Column:
    return error_rate(F.levenshtein(reference, output).cast("long"), F.length(reference), F.length(output))


def word_error_rate(reference: Column, output: Column) -> Column:
    """Of token arrays."""
    return error_rate(token_edit_distance(reference, output), F.size(reference), F.size(output))


def text_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.when(longest > 0, longest))


def metadata_text(text: Column) -> Column:
    """NFC, white space collapsed and trimmed, null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(nfc(text), ECMA_SPACE + "+", " "), "^ +| +$", ""), F.lit(""))


def control_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(nfc(text)), ECMA_SPACE + "+", "")


def fold_typography(text: Column) -> Column:
    """Curly quotes and dashes to plain ones, white space collapsed, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\x{2018}-\x{201B}]", "'"), r"[\x{201C}-\x{201F}]", '"'), r"[\x{2010}-\x{2015}]", "-")
    return F.trim(F.regexp_replace(plain, ECMA_SPACE + "+", " "))


def short_thai_runs(text: Column) -> Column:
    """Thai code points in white-space-bounded runs of one or two, by all Thai code points (a metric value)."""
    from .core import metric

    words = F.split(text, WHITE_SPACE + "+")
    short = F.aggregate(F.filter(words, lambda w: (F.length(w) <= 2) & w.rlike(f"^{THAI_BLOCK}{{1,2}}$")), F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    return metric(short, count_of(text, THAI_BLOCK))
