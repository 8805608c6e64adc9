"""Spelling variants against plain Python and their SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tierscope.llm import spelling_variants as q

from .test_documents import ODD

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if brute_near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = [n, len(others)]
    rows = []
    for w, (n, near) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, near, words.get(form[w])))
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def variants(rng, word):
    i = rng.randrange(len(word) + 1)
    c = rng.choice("abàÿé×")
    return rng.choice([word[:i] + c + word[i:], word[: max(0, i - 1)] + word[i:], word[: max(0, i - 1)] + c + word[i:]])


def corpus(seed, n_words=25, letters="ab", n_docs=12):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 13))) for _ in range(n_words)]
    pool, weights = [], []
    for w in stems:
        for weight in (rng.choice([300, 900]), 60, 60, 8, 8, 1):
            pool.append(w)
            weights.append(weight)
            w = variants(rng, w)
    return [(i, " ".join(rng.choices(pool, weights, k=1500))) for i in range(n_docs)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", 3, "f") for d, t in rows], "doc_id long, text string, word string, n long, form string").repartition(3)


@pytest.mark.parametrize(("seed", "letters", "most"), [(1, "ab", 2000), (2, "ab", 9), (3, "abcdeé", 2000), (4, "abcd", 3)])
def test_variants_against_brute_force(spark, seed, letters, most):
    rows = corpus(seed, letters=letters)
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and (letters == "ab" or any(r[1] != r[2] for r in want if r[1]))
    assert found(q.group_variants(frame(spark, rows), most=most)) == want


def test_every_pair_is_found_once():
    """All words of two and three letters, in every size of a range that is divided in memory."""
    rng = random.Random(5)
    for small in (1, 3, 24):
        q.SMALL, kept = small, q.SMALL
        try:
            for _ in range(60):
                m = rng.randrange(1, 8)
                pool = {"".join(rng.choice("ab") for _ in range(m + rng.randrange(2))) for _ in range(40)}
                entries = [(w, w, 1) for w in pool]
                got = Counter(frozenset((a[1], b[1])) for a, b in q.pairs_of(entries, m, m, ""))
                want = {frozenset((a, b)) for a in pool for b in pool if brute_near(a, b) and min(len(a), len(b)) == m}
                assert set(got) == want and all(n == 1 for n in got.values())
        finally:
            q.SMALL = kept
    assert all(q.near(a, b) == brute_near(a, b) for a in ("ab", "abc", "aab", "", "a") for b in ("ab", "abc", "aab", "ba", "", "a"))


def test_ranges_are_bounded(spark):
    """Most words share a prefix: ranges are divided until they are short, or one letter is free."""
    rng = random.Random(6)
    words = sorted({"prefix" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = q.divided(q.dictionary_entries(df), 40).groupBy(*q._RANGE).agg({"*": "count", "free": "max"}).collect()
    assert max(r["count(1)"] for r in sizes if r["max(free)"] > 1) <= 40
    got = {r["word"]: r["n_near"] for r in q.near_words(df, most=40).collect()}
    other = "abcdef"
    want = {w: sum(w[:i] + c + w[i + 1 :] in set_ for i in range(6, 12) for c in other if c != w[i]) for set_ in [set(words)] for w in words}
    assert got == {w: n for w, n in want.items() if n}


def test_edges_of_variants(spark):
    texts = [*ODD, "Straße STRASSE straße " * 6, "ÀÉÎÕÜÿ àéîõüÿ " * 5, "short short " * 9, "unique words only", "x" * 4000 + " " + "x" * 3999, *[f"{'x' * 4000} {'x' * 3999}"] * 30]
    rows = [*enumerate(texts), (None, "nameless nameless namelesss"), (None, "nameless nameless nameless namelesss namelesss namelesss namelesss"), (3, "A"), (3, "A")]
    df = spark.createDataFrame([(d, t, "w", 3) for d, t in rows], "doc_id long, text string, word string, n long")
    assert found(q.group_variants(df)) == brute(rows)
    assert q.group_variants(df.limit(0)).count() == 0
    assert q.group_variants(df.where("text = 'A'")).count() == 0
    big = [((1 << 60) + 1, "abcdefg abcdefg " * 9), ((1 << 60) + 3, "abcdefg bcdefgh " * 9), (None, "abcdefg")]
    assert found(q.group_variants(spark.createDataFrame(big, "doc_id long, text string"))) == brute(big)


def test_counts_are_sent_on(spark, monkeypatch):
    rows = corpus(8)
    want = Counter({r[0]: r[3] for r in brute(rows)})
    monkeypatch.setattr(q, "MOST_COUNTS", 3)
    assert {r["word"]: r["n"] for r in q.count_words(frame(spark, rows)).collect()} == want


def test_sql_of_variants(spark):
    rows = corpus(7, letters="abé") + [(100 + i, t) for i, t in enumerate(ODD) if not t or "\x00" not in t]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({q.ORACLE_SQL})").fetchall(), key=str) == brute(rows)
