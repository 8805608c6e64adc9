"""Secret scans: base patterns, and credentials linked from weak parts that stand together.

Three base kinds are reported wherever they match. Weak parts (account identifiers, endpoints, opaque
tokens) say little alone: they are reported only when complementary parts lie in the same scope. A scope
is a run of lines without a blank one; within it each part's interval is widened by REACH on both sides
and joined with the others by a sweep over sorted bounds, so no pair of parts is ever listed. A part gives
support only from outside the span that it supports, and the value of an identifier or a piece of an endpoint is
no part of its own.

Null texts count as empty. Rows are independent: repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, map_frames, texts_in

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Most code points between two parts of one credential.
REACH = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WEAK_ID = re.compile(r"""(?:access[_-]?key[_-]?id|client[_-]?id|account(?:[_-]?name)?|user(?:[_-]?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"""(?:https?|ftps?|s3|redis|amqps?|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z0-9]+)://[^\s"'<>]{3,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?""", re.I | re.A)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, index of kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the base kinds, leftmost and non-overlapping for each kind, failing lengths dropped."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _opaque(token: str) -> bool:
    """Mixed letters and digits, with enough different characters to be a key."""
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token) and len(set(token)) >= 10


def _overlaps(spans: list[Span], others: list[Span]) -> list[int]:
    """How many of the others each span overlaps: those begun before its end less those ended by its begin."""
    starts, ends = sorted(s for s, _, _ in others), sorted(e for _, _, e in others)
    return [bisect_left(starts, e) - bisect_right(ends, s) for s, _, e in spans]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that complementary parts support: an identifier with a secret, an opaque token with an
    identifier, an endpoint with both. Weak parts that overlap a base span are left to it."""
    weak: list[Span] = [(m.start(), 4, m.end()) for m in _WEAK_SECRET.finditer(text) if _opaque(m.group())]
    if ":" in text or "=" in text:
        named = [(m.start(), 3, m.end()) for m in _WEAK_ID.finditer(text)] + [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
        weak = [w for w, n in zip(weak, _overlaps(weak, named), strict=True) if not n] + named
    weak = [w for w, n in zip(weak, _overlaps(weak, base), strict=True) if not n]
    if not weak:
        return []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    role = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "endpoint"}
    held: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
    for s, k, e in sorted([*base, *weak]):
        at = held.setdefault((role[k], bisect_right(cuts, s)), ([], []))
        at[0].append(s)
        at[1].append(e)
    for at in held.values():
        at[1].sort()

    def near(part: Span, what: str) -> bool:
        """Whether an interval of that role overlaps the part's widened one, but not the part: those begun less those ended."""
        at = held.get((what, bisect_right(cuts, part[0])))
        if at is None:
            return False
        around = bisect_right(at[0], part[2] + reach) - bisect_left(at[1], part[0] - reach)
        return around > bisect_left(at[0], part[2]) - bisect_right(at[1], part[0])

    needs = {3: ("secret",), 4: ("id",), 5: ("id", "secret")}
    return sorted(w for w in set(weak) if all(near(w, what) for what in needs[w[1]]))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: id, counts by base kind, SHA-256 of the base spans, all spans, number of linked weak parts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in texts_in(frame, "text_"):
                base = base_spans(text or "")
                more = linked_spans(text or "", base, reach)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + more)), len(more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])
            out.insert(0, id_col, frame["id_"])
            yield out

    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return map_frames(in_batches(df).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), run, schema)


def redact(text: str | None, mark: str = "[REDACTED]", reach: int = REACH) -> str | None:
    """The text with every base span and linked part replaced; overlapping spans share one mark."""
    if text is None:
        return None
    base = base_spans(text)
    out, at = [], 0
    for s, _, e in sorted(base + linked_spans(text, base, reach)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with secrets replaced in the text; length_col follows where it exists. Null stays null."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t if isinstance(t, str) else None, mark) for t in texts], dtype=object)

    out = in_batches(df).withColumn(text_col, cleaned(F.col(text_col)))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(df.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out
