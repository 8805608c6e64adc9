"""Quality rules: measurements, bits, policies and ablations against plain Python."""

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import pytest

from tierscope.llm import quality_rules as q

from .test_documents import ODD, docs_of, sentence, words


def brute(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}
    return m | {"n_lines": lines, "n_capitals": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)), "n_marks": len(re.findall("[!?]", text))}


def brute_bits(m):
    rules = [m["n_words"] < 50, 2 * m["n_repeat_words"] > m["n_words"], 10 * m["n_symbols"] > m["n_words"], m["n_lines"] >= 4 and m["n_dup_lines"] > 0.6 * m["n_lines"], m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 40 * m["n_words"]]
    rules += [m["n_letters"] >= 50 and 5 * m["n_capitals"] > 3 * m["n_letters"], 10 * m["n_marks"] > 3 * m["n_words"], 5 * m["n_repeat_words"] > m["n_words"], 10 * m["n_dup_lines"] > 3 * m["n_lines"]]
    return sum(1 << i for i, failed in enumerate(rules) if failed)


def samples():
    rng = random.Random(110)
    out = [*ODD, "a b c a b c", "a a a a", "x y z", "A\nA\n A\n\n \nA", "line\r\nline\r\nline", "é# $%&|<>* !?" * 30, "LOUD WORDS OF ALL KINDS " * 20, " ".join("w" * 60 for _ in range(60))]
    for _ in range(60):
        lines = [sentence(rng, rng.randrange(0, 30), rng.choice([3, 40, 400])) + rng.choice(["", " ###", "!!", "?"]) for _ in range(rng.randrange(0, 12))]
        out.append("\n".join(lines + rng.choices(lines or [""], k=rng.randrange(0, 8))))
    return out


def test_rules_against_brute_force(spark):
    texts = samples()
    rows = {r["doc_id"]: r.asDict() for r in q.judge_documents(docs_of(spark, texts)).collect()}
    seen = 0
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: rows[i][k] for k in want} == want, t
        bits = brute_bits(want)
        seen |= bits
        assert rows[i]["fail_bits"] == bits and rows[i]["base_failed"] == bool(bits & 3) and rows[i]["kept"] == (bits & 255 == 0)
    assert seen == 1023, "every rule fails somewhere"


def test_pieces_end_between_words(monkeypatch):
    monkeypatch.setattr(q, "BLOCK_BYTES", 7)
    for t in samples():
        assert q.measure(t) == tuple(brute(t)[k] for k in q.MEASURES)


def test_policies_and_ablations(spark):
    rows = q.ledger(docs_of(spark, samples())).persist()
    bits = [r["fail_bits"] for r in rows.collect()]
    for policy, names in q.POLICIES.items():
        m = q.mask(names)
        assert q.with_policy(rows, policy).where("kept").count() == sum(b & (m | 3) == 0 for b in bits)
        got = {r["rules"]: r.asDict() for r in q.ablations(rows, policy).collect()}
        sets = [c for k in range(3) for c in combinations(names, k)]
        assert len(got) == len(sets)
        for c in sets:
            left = m & ~q.mask(c)
            want = (len(bits), sum(b & q.mask(c) != 0 for b in bits), sum(b & left == 0 for b in bits), sum(b & left == 0 and b & m != 0 for b in bits))
            assert tuple(got[",".join(c)][k] for k in ("n_rows", "n_failing", "n_kept", "n_gained")) == want
    assert {r["n_rows"] for r in q.ablations(rows.limit(0)).collect()} == {0}
    rows.unpersist()


def test_edges_of_rules(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a", 1), (None, None, 2), (big + 2, "a", 3), (big, "a", 1)], "doc_id long, text string, n_words int")
    assert sorted(repr((r["doc_id"], r["n_words"])) for r in q.judge_documents(docs).collect()) == sorted(map(repr, [(big, 1), (None, 0), (big + 2, 1), (big, 1)]))
    assert q.judge_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("policy", list(q.POLICIES))
def test_sql_of_rules(spark, policy):
    texts = [t for t in samples() if t is None or "\x00" not in t]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.sql(q.oracle_sql(policy)).df()
    got = q.judge_documents(docs_of(spark, texts), policy=policy).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.astype(int).values.tolist())) == sorted(map(repr, want.astype(int).values.tolist()))
