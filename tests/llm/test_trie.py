"""The conversation prefix trie against plain Python and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tierscope.llm import conversation_trie as q

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children(node), sum(children(n) == 0 for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations(seed, ids):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for turn in range(rng.randrange(0, 9)):
            text = rng.choice([None, "", "a", "é😀", "long text"]) if turn > 1 else rng.choice(["hello", "hi"])
            rows.append((c, rng.choice([turn, turn, None, 2]), rng.choice(["user", "assistant", None]) if turn > 2 else "user", text))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()))


BIG = (1 << 60) + 100
FAMILIES = [list(range(40)), [*range(-130, 130, 7), 0, -100, 100], [BIG, BIG + 1, BIG + 2, None, 5, 205], [101, 150, 199]]


@pytest.mark.parametrize("ids", FAMILIES)
@pytest.mark.parametrize("most", [500_000, 6])
def test_trie_against_brute_force(spark, ids, most):
    rows = conversations(len(ids), ids)
    assert found(q.prefix_trie(frame(spark, rows), most=most)) == brute(rows)


def test_copies_share_their_nodes(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1000) for t in range(6)] + [(5000, 0, "user", "turn 0")]
    got = found(q.prefix_trie(frame(spark, rows)))
    assert got == brute(rows) and got[0][3] == 1001


def test_rebuilt_turns(spark):
    rows = conversations(3, list(range(0, 500, 9)))
    got = defaultdict(list)
    for r in sorted(q.rebuilt_turns(frame(spark, rows)).collect(), key=lambda r: r["depth"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(got) == {c: t for c, t in rebuilt(rows).items() if t}
    # The last turn's text of a node is found by its name.
    names = {bytes(r["node"]) for r in q.prefix_trie(frame(spark, rows)).collect()}
    assert {bytes(r["node"]) for r in q.rebuilt_turns(frame(spark, rows)).collect()} == names - {q.ROOT}


def test_long_pieces_and_texts(spark, monkeypatch):
    monkeypatch.setattr(q, "PIECE_BYTES", 30)
    rows = [(c, 0, "user", "same") for c in range(0, 30000, 50)] + [(7, 0, "user", "x" * 3_000_000), (7, 1, "user", "end")]
    assert found(q.prefix_trie(frame(spark, rows))) == brute(rows)


def test_empty_trie(spark):
    empty = frame(spark, [(1, 1, "a", "b")]).limit(0)
    assert q.prefix_trie(empty).count() == 0 and q.rebuilt_turns(empty).count() == 0
    assert found(q.prefix_trie(frame(spark, [(None, 1, "a", "b")]))) == []


def test_sql_of_trie(spark):
    rows = conversations(9, [*range(0, 300, 3), *range(-120, 0, 11)])
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({q.ORACLE_SQL})").fetchall()) == brute(rows)
