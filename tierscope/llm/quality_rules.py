"""Quality rules: a ledger of failure bits and measurements, with versioned policies and ablations over it.

Every rule is evaluated once. A row of the ledger has what was measured on the whole text and one bit for each
rule that the text fails; a policy is a named set of rules, so applying one, or another version of it, or leaving
rules out of it, is a bitwise comparison and never reads a text again. Rules are conditions on measurements in
plain SQL, the same for Spark and any other engine.

Words are runs of other characters than space and tab to carriage return; lines are split at newlines. Words,
windows and lines are compared whole, not by hashes. Capitals and letters are counted in ASCII, so a text in
another script fails no rule on them. A null text has no words. Rows are independent: repeated rows give repeated results,
other columns are left aside. An empty table gives an empty ledger, and ablations of zero rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, in_batches, map_frames, texts_in

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks")

#: Rules in the order of their bits: name and the condition of failing. Bits keep their meaning: new rules go last.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 40 * n_words",
    "capitals": "n_letters >= 50 AND 100 * n_capitals > 60 * n_letters",
    "marks": "100 * n_marks > 30 * n_words",
    "some_repetition": "100 * n_repeat_words > 20 * n_words",
    "some_repeated_lines": "100 * n_dup_lines > 30 * n_lines",
}
#: Policies by version: the rules that a kept text passes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "capitals", "marks"),
    "strict": tuple(RULES),
}
BASE, CURRENT = "base", "2"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPACES, _SYMBOLS, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def _words(data: bytes) -> Iterator[bytes]:
    """The words in order, found in pieces of bounded size that end between words."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + BLOCK_BYTES)
        end = cut.start() if cut else len(data)
        yield from data[at:end].split()  # of bytes: by space and tab to carriage return
        at = end


def repeated_words(data: bytes) -> tuple[int, int]:
    """Number of words, and of those in 3-word windows found twice or more: windows are numbered as pairs of pairs."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in _words(data)), np.int64)
    n = len(ids)
    if n < 4:  # two windows need four words
        return n, 0
    _, pair = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)
    _, window, times = np.unique(pair * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return n, int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n_words, n_repeat = repeated_words(data)
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return n_words, len(text or "") - count(_SPACES), count(_SYMBOLS), len(lines) - len(set(lines)), n_repeat, len(lines), count(_CAPITALS), count(_LETTERS), count(_MARKS)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: Sequence[str]) -> int:
    return sum(bit(r) for r in set(rules))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, MEASURES and fail_bits, a bit for each rule that the whole text fails."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([measure(t) for t in texts_in(frame, "text_")], columns=list(MEASURES), dtype="int64")
            out.insert(0, "id_", frame["id_"])
            yield out

    rows = in_batches(df).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    measured = map_frames(rows, run, f"id_ {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(condition), F.lit(bit(name)).cast("long")).otherwise(0) for name, condition in RULES.items()), F.lit(0).cast("long"))
    return measured.select(F.col("id_").alias(id_col), *MEASURES, bits.alias("fail_bits"))


def fails(policy: str, bits: str = "fail_bits") -> Column:
    """Whether a row of the ledger fails any rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def with_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept, the verdict of a policy, which never keeps what the base fails."""
    return rows.withColumn("base_failed", fails(BASE)).withColumn("kept", ~(fails(BASE) | fails(policy)))


def ablations(rows: DataFrame, policy: str = CURRENT, size: int = 2) -> DataFrame:
    """What leaving out one rule of a policy, or up to size of them together, would change.

    One row a set of left-out rules (the empty one first): rules, n_rows, n_failing (rows that fail one of them),
    n_kept (rows kept without them) and n_gained (kept without them only). The ledger is summed to its failure
    patterns of the policy first, at most 2 to the number of its rules, whatever the number of rows.
    """
    names = POLICIES[policy]
    whole = F.lit(mask(names)).cast("long")
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(whole).alias("p")).agg(F.count("*").alias("n"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    made = []
    for left_out in (c for k in range(size + 1) for c in combinations(names, k)):
        out = F.lit(mask(left_out)).cast("long")
        remaining = F.col("p").bitwiseAND(F.lit(mask(names) & ~mask(left_out)).cast("long"))
        made.append(F.struct(F.lit(",".join(left_out)).alias("rules"), total(F.lit(True)).alias("n_rows"), total(F.col("p").bitwiseAND(out) != 0).alias("n_failing"), total(remaining == 0).alias("n_kept"), total((remaining == 0) & (F.col("p") != 0)).alias("n_gained")))
    return patterns.agg(F.array(*made).alias("a")).select(F.inline("a"))


def judge_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """Per row: id, the measurements, base_failed, kept by the policy, and the ledger's bits."""
    rows = with_policy(ledger(df, id_col, text_col), policy)
    return rows.select(id_col, *MEASURES[:5], "base_failed", "kept", *MEASURES[5:], "fail_bits")


def oracle_sql(policy: str = CURRENT) -> str:
    """DuckDB SQL for judge_documents: the rules are the same text, the measurements are made with lists."""
    bits = " + ".join(f"CASE WHEN {condition} THEN {bit(name)} ELSE 0 END" for name, condition in RULES.items())
    without = lambda chars: f"length(regexp_replace(t, '[{chars}]', '', 'g'))"
    counted = ", ".join(f"(length(t) - {without(chars)})::BIGINT AS {name}" for name, chars in (("n_symbols", "#*$%&|<>"), ("n_capitals", "A-Z"), ("n_letters", "A-Za-z"), ("n_marks", "!?")))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT row_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
often AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, a, b, c) AS n FROM windows),
repeats AS (SELECT row_id, count(DISTINCT i + k) AS n_repeat_words FROM often, range(3) AS r(k) WHERE n > 1 GROUP BY row_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, {without("^\\x20\\x09-\\x0D")}::BIGINT AS n_spaces, length(t) AS n_chars, {counted},
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN repeats USING (row_id)),
judged AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM (SELECT *, (n_chars - n_spaces)::BIGINT AS word_chars FROM measured))
SELECT doc_id, {", ".join(MEASURES)}, fail_bits, fail_bits & {mask(POLICIES[BASE])} <> 0 AS base_failed, fail_bits & {mask(POLICIES[BASE]) | mask(POLICIES[policy])} = 0 AS kept FROM judged"""
