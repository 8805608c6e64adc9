"""Spelling variants: words of a corpus that one edit turns into a far more frequent word, by two sorted dictionaries.

One edit between two words leaves one half of them intact. The forward dictionary (words by prefix) has those whose
first half it leaves in one range, the reversed one (words by suffix, read backwards) those whose second half it
leaves. Lengths go by classes: class m compares words of m letters with each other and with those of m + 1, so both
sides of a pair cut the same half. A range that is too long is divided again: the rest of its words has one edit as
well, which leaves a half of the rest intact, and so on until one letter is free and the range is bounded by the
alphabet. Sizes are counted before words are gathered, so no task ever has a long range to itself. Ranges are read in
order, divided in the same way in memory, and pairs of the last small ranges are verified letter by letter. A pair
may share several halves; only the range of the first one it shares, at each division, reports it.

Counting combines within each task before the shuffle: a task keeps at most MOST_COUNTS words. Roots follow
forms by doubling; each form is several times as frequent as its word, so paths are short.

Defined results: a null text has no words; a null id is written as nothing; rows that share an id and repeated rows
count each. Words are code points and ordered by them. Other columns are left aside. An empty table, or one without
frequent words, gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, join_checked, map_frames, stored, texts_in

#: Fewest code points and occurrences of a word, how often more a form occurs, and the divisor that marks runs to change.
LEAST_LENGTH, LEAST_COUNT, TIMES, MARKED = 6, 5, 5, 199
#: Words that a range may have to be read as one; from SMALL on it is divided in memory.
MOST_RANGE, SMALL = 2000, 24
#: Different words that a counting task keeps before it sends them on.
MOST_COUNTS = 200_000

#: Maximal runs of Latin letters: A to Z, a to z and U+00C0 to U+00FF; shorter ones never become words.
_LETTERS = r"[a-zÀ-ÿ]"
_RANGE = ["path", "m", "head", "back"]

Entry = tuple[str, str, int]  # what is free in the range, whole word, occurrences


def changed(prefix_crc: int, run: str, marked: int = MARKED) -> str:
    """The run, less one code point if its checksum (begun with the document's) says so."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % marked:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, marked: int = MARKED) -> DataFrame:
    """word and n, for words of the corpus with enough code points and occurrences."""
    runs = re.compile(f"{_LETTERS}{{{least_length},}}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        made = lambda: pd.DataFrame({"word": list(counts), "n": list(counts.values())})
        for frame in frames:
            for doc, text in zip(frame["id_"].tolist(), texts_in(frame, "text_")):
                if not text:
                    continue
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: A to Z only
                own: dict[str, int] = {}
                for m in runs.finditer(lower):
                    own[m.group()] = own.get(m.group(), 0) + 1
                begun = zlib.crc32(f"{doc}:".encode() if doc is not None else b":")
                for word, n in own.items():
                    word = changed(begun, word, marked)
                    if len(word) >= least_length:
                        counts[word] = counts.get(word, 0) + n
            if len(counts) > MOST_COUNTS:
                yield made()
                counts.clear()
        yield made()

    rows = in_batches(df).select(F.col(id_col).cast("string").alias("id_"), F.col(text_col).alias("text_"))
    return map_frames(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(path: str | Column, m: Column, head: Column, back: Column, rest: Column, free: Column) -> Column:
    """The two entries of a word in smaller ranges: free letters of the class's short words cut in two, either half joins
    what is shared. back is the shared end read backwards."""
    k = F.floor(free / 2).cast("int")
    length = F.length(rest)
    path = F.lit(path) if isinstance(path, str) else path
    first = F.struct(F.concat(path, F.lit("P")).alias("path"), m.alias("m"), F.concat(head, F.substring(rest, F.lit(1), k)).alias("head"), back.alias("back"), F.substring(rest, k + 1, length).alias("rest"), (free - k).alias("free"))
    kept = length - (free - k)
    second = F.struct(F.concat(path, F.lit("S")).alias("path"), m.alias("m"), head.alias("head"), F.concat(back, F.reverse(F.substring(rest, kept + 1, length))).alias("back"), F.substring(rest, F.lit(1), kept).alias("rest"), k.alias("free"))
    return F.array(first, second)


def dictionary_entries(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Each word's entries in the forward (path P) and the reversed dictionary (S): as a short word of the class of its
    length, and as a long one of the class below."""
    length, nothing = F.length("word"), F.lit("")
    classes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= least_length)
    made = classes.select("word", "n", F.explode(_halves("", F.col("m"), nothing, nothing, F.col("word"), F.col("m"))).alias("e"))
    return made.select("e.*", "word", "n")


def divided(entries: DataFrame, most: int = MOST_RANGE) -> DataFrame:
    """The same pairs in ranges of at most so many entries, or with one free letter: longer ranges are cut in two ways, round by
    round, where most of their words sit. Ranges without two words to compare go."""
    done: DataFrame | None = None
    while True:
        sizes = entries.groupBy(_RANGE).agg(F.count("*").alias("size"), F.max("free").alias("r"))
        long = stored(sizes.where((F.col("size") > most) & (F.col("r") > 1)).select(*_RANGE), "spelling-long")
        if long.isEmpty():
            return entries if done is None else done.unionByName(entries)
        small = join_checked(entries, long, _RANGE, "left_anti")
        done = small if done is None else done.unionByName(small)
        again = join_checked(entries, long, _RANGE, "left_semi")
        cut = again.select("word", "n", F.explode(_halves(F.col("path"), F.col("m"), F.col("head"), F.col("back"), F.col("rest"), F.col("free"))).alias("e"))
        entries = stored(cut.select("e.*", "word", "n"), "spelling-entries")


def first_shared(a: str, b: str, m: int, path: str) -> bool:
    """Whether the pair, whole words of class m, reaches the range of this path by the first half it shares each time."""
    for way in path:
        k = m // 2
        if way == "P":
            a, b, m = a[k:], b[k:], m - k
        elif a[:k] == b[:k]:
            return False
        else:
            a, b, m = a[: len(a) - (m - k)], b[: len(b) - (m - k)], k
    return True


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def pairs_of(entries: list[Entry], free: int, m: int, path: str) -> Iterator[tuple[Entry, Entry]]:
    """The near pairs of a range, but two long words, that this range is the first to have."""
    short = [e for e in entries if len(e[0]) == free]
    if not short or len(entries) < 2:
        return
    if len(entries) <= SMALL or free <= 1:
        long = [e for e in entries if len(e[0]) > free]
        if len(entries) > SMALL:  # one free letter: short words are all near each other, a long one has two letters to look up
            at = {e[0]: e for e in short}
            found = [(a, b) for i, a in enumerate(short) for b in short[:i]] + [(at[c], e) for e in long for c in {e[0][:1], e[0][1:]} if c in at]
        else:
            found = [(a, b) for i, a in enumerate(short) for b in (*short[:i], *long) if near(a[0], b[0])]
        yield from ((a, b) for a, b in found if first_shared(a[1], b[1], m, path))
        return
    k = free // 2
    for _, part in groupby(sorted(entries), key=lambda e: e[0][:k]):
        yield from pairs_of([(e[0][k:], *e[1:]) for e in part], free - k, m, path + "P")
    tail = free - k
    for _, part in groupby(sorted(entries, key=lambda e: e[0][::-1]), key=lambda e: e[0][len(e[0]) - tail :]):
        yield from pairs_of([(e[0][: len(e[0]) - tail], *e[1:]) for e in part], k, m, path + "S")


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads ranges in order; per word of a range: how many near words it found, and the most frequent of them."""
    columns = [*_RANGE, "rest", "free", "word", "n"]
    rows: Iterable[tuple] = (row for frame in frames for row in zip(*(frame[c].tolist() for c in columns)))
    out: list[tuple] = []
    for (path, m, _, _), part in groupby(rows, key=lambda r: r[:4]):
        held = list(part)
        free = held[0][5]
        best: dict[str, tuple[int, int, str]] = {}
        for a, b in pairs_of([(r[4], r[6], r[7]) for r in held], free, m, path):
            for x, y in ((a, b), (b, a)):
                n, lead, word = best.get(x[1], (0, 0, ""))
                best[x[1]] = (n + 1, *min((lead, word), (-y[2], y[1])))
        out += [(word, *found) for word, found in best.items()]
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=["word", "n_near", "lead", "near"])
            out = []
    yield pd.DataFrame(out, columns=["word", "n_near", "lead", "near"])


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST_RANGE) -> DataFrame:
    """word, n_near and the most frequent near word (near, near_n; ties: smallest), for words (word, n) that have one."""
    entries = divided(dictionary_entries(words, least_length), most)
    ordered = in_batches(entries).repartitionByRange(*_RANGE).sortWithinPartitions(*_RANGE, "rest")
    found = map_frames(ordered, _scan, "word string, n_near long, lead long, near string")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("lead", "near")).alias("first"))
    return merged.select("word", "n_near", F.col("first.near").alias("near"), (-F.col("first.lead")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of its forms, for words that have a form (word, form)."""
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        steps = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(join_checked(found, steps, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        found = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return found


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, most: int = MOST_RANGE) -> DataFrame:
    """One row a word: word, n, n_near, form (the most frequent near word, where it is at least so many times as frequent),
    form_n, and root, the last of the forms that follow."""
    words = stored(count_words(df, id_col, text_col, least_length, least_count), "spelling-words")
    linked = words.join(near_words(words, least_length, most).hint("merge"), "word", "left")
    has_form = F.col("near_n") >= times * F.col("n")
    rows = stored(linked.select("word", F.when(has_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return join_checked(rows, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
coded AS (SELECT *, hex(encode(doc || ':' || run)) AS code FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(code) // 2), lambda i: [('0x' || substr(code, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) AS h FROM coded),
made AS (SELECT CASE WHEN h % {MARKED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
shorter AS (SELECT DISTINCT l.word AS a, l.n AS na, w.word AS b, w.n AS nb FROM less l JOIN words w ON l.d = w.word),
pairs AS (
  SELECT x.word AS a, y.word AS b, y.n AS nb FROM less x JOIN less y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
  UNION ALL SELECT a, b, nb FROM shorter UNION ALL SELECT b, a, na FROM shorter),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY nb DESC, b) AS near, first(nb ORDER BY nb DESC, b) AS near_n FROM pairs GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END::BIGINT AS form_n FROM words LEFT JOIN best ON a = word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w USING (word) JOIN forms r ON r.word = w.root WHERE r.form IS NULL"""
