"""Conversation prefix trie, merged family first.

Conversations of a hundred ids are a family: each is rebuilt from the first turns of the family's base conversation
and its own later turns. A family's turns meet in one stream, ordered by conversation and turn, which rebuilds its
conversations and combines them to a small trie; only its nodes, named by a 128-bit hash of all turns to the root,
go on. Nodes of the same name are summed over all families by the shuffle's partial aggregates, so a node that
every conversation shares, such as the root, costs a row a family and then a row a task.

Sums over subtrees need paths, which the families know. Each merged node goes back to the one family that has its
smallest member; there, the nodes with one smallest member are the end of that conversation's path, so reading
conversations from the largest id and nodes from the deepest adds up every subtree in one pass that keeps a number
a conversation. What a family adds to a node is summed over families again.

The ids of conversations that end at a node are hashed in order: families send them in ascending pieces, equal
ranges of (node, id) join pieces, and a last pass over few long pieces updates the digest without holding them.

Defined results: rows with a null id belong to no conversation and are left out; null roles and texts are empty;
turns of a conversation are ordered by turn (null first), then role, then text, so that ties have one order, and
repeated rows are turns of their own. A negative id's base is truncated towards zero, as SQL's remainder has it. An
empty table has no node. Other columns are left aside. Memory follows the distinct turns of one family, without
their texts: from MOST_NODES on it goes on as several tries of the same family, with the same result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, map_frames, stored

#: Ids of a family, and one more than the most turns that are taken from its base conversation.
FAMILY, COPIED = 100, 6
#: Nodes that a family's trie may have before it is sent on in parts.
MOST_NODES = 500_000
#: Bytes of ids in a piece of a node's ends, and rows of a frame on the way back to Spark.
PIECE_BYTES, FRAME_ROWS = 256 << 10, 5000

ROOT = bytes(16)
_NODE = "node binary, parent binary, base long, conv_id long, depth long, n long, chars long, first long, ids string"
_NODE_COLUMNS = ["node", "parent", "base", "conv_id", "depth", "n", "chars", "first", "ids"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

Turn = tuple[int, int, str, str]  # base, conversation, role, text


def copied_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its base conversation."""
    return zlib.crc32(str(conv_id).encode()) % COPIED


def _base(conv: str | Column) -> Column:
    c = F.col(conv) if isinstance(conv, str) else conv
    return c - c % FAMILY


def _families(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns by family, each family in one partition and in order: its base conversation, then the others by id."""
    rows = in_batches(df).where(F.col(conv).isNotNull()).select(
        _base(F.col(conv).cast("long")).alias("base"), F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return rows.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "role", "text").drop("turn")


def _turns(frames: Iterable[pd.DataFrame]) -> Iterator[Turn]:
    for frame in frames:
        yield from zip(*(frame[c].tolist() for c in ("base", "conv", "role", "text")))


def _rebuilt(turns: Iterable[Turn]) -> Iterator[tuple[int, int, Iterator[Turn]]]:
    """(base, conversation, its rebuilt turns) of ordered turns; each conversation is read before the next one."""

    def kept(own: Iterable[Turn], head: list[Turn]) -> Iterator[Turn]:
        for turn in own:
            if len(head) < COPIED - 1:
                head.append(turn)
            yield turn

    for base, family in groupby(turns, key=lambda t: t[0]):
        head: list[Turn] = []
        for conv, own in groupby(family, key=lambda t: t[1]):
            n = copied_turns(conv)
            yield base, conv, kept(own, head) if conv == base else chain(head[:n], islice(own, n, None))


def step(parent: bytes, role: str, text: str) -> bytes:
    """The name of the node that a turn leads to from another node."""
    said = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(parent + len(said).to_bytes(8, "little") + said + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _framed(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while part := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(part, columns=columns, dtype=object)


def _family_nodes(frames: Iterator[pd.DataFrame], most: int = MOST_NODES) -> Iterator[tuple]:
    """The combined nodes of each family (or part of one), and the ids that end at them in ascending pieces."""
    nodes: dict[bytes, list] = {}
    ends: dict[bytes, list[int]] = {}

    def sent(base: int) -> Iterator[tuple]:
        for node, (parent, depth, n, conv, chars) in nodes.items():
            yield node, parent, base, conv, depth, n, chars, None, None
        for node, ids in ends.items():
            ids.sort()
            # The base comes first whatever its number: by itself, pieces of several parts stay apart.
            for part in ([i for i in ids if i < base], [i for i in ids if i == base], [i for i in ids if i > base]):
                if part:
                    yield node, None, base, None, None, None, None, part[0], ",".join(map(str, part))
        nodes.clear()
        ends.clear()

    before = None
    for base, conv, turns in _rebuilt(_turns(frames)):
        if nodes and (base != before or len(nodes) > most):
            yield from sent(before)
        before, node, depth, parent, chars = base, ROOT, 0, None, 0
        for _, _, role, text in chain([(0, 0, "", "")], turns):
            if depth:
                parent, node, chars = node, step(node, role, text), len(text)
            known = nodes.get(node)
            if known is None:
                nodes[node] = [parent, depth, 1, conv, chars]
            else:
                known[2] += 1
                known[3] = min(known[3], conv)
            depth += 1
        ends.setdefault(node, []).append(conv)
    if nodes:
        yield from sent(before)


def _subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(node, leaves, saved) that a family adds to its nodes. Rows come by family, then conversation and depth falling; what
    is known of an owned node of all families stands before the node itself."""
    waiting: dict[bytes, tuple[int, int]] = {}
    family, last, above, total, known = None, None, None, (0, 0), None
    rows = (row for frame in frames for row in zip(*(frame[c].tolist() for c in ("base", "conv_id", "depth", "node", "parent", "leaf", "saved"))))
    for base, conv, depth, node, parent, leaf, saved in rows:
        if (base, conv) != (family, last):
            if above is not None:
                old = waiting.get(above, (0, 0))
                waiting[above] = (old[0] + total[0], old[1] + total[1])
            if base != family:
                waiting.clear()
            family, last, above, total, known = base, conv, None, (0, 0), None
        if node is None:
            known = (depth, leaf, saved)
            continue
        more = waiting.pop(node, (0, 0))
        own = known[1:] if known is not None and known[0] == depth else (0, 0)
        total = (total[0] + more[0] + own[0], total[1] + more[1] + own[1])
        above = parent
        yield node, *total


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Neighbouring pieces of a node's ends as longer ones."""
    node, first, held, size = None, None, [], 0
    for frame in frames:
        for n, f, ids in zip(frame["node"].tolist(), frame["first"].tolist(), frame["ids"].tolist()):
            if held and (n != node or size > PIECE_BYTES):
                yield node, first, ",".join(held)
                held, size = [], 0
            if not held:
                node, first = n, f
            held.append(ids)
            size += len(ids) + 1
    if held:
        yield node, first, ",".join(held)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """SHA-256 of each node's pieces in order, comma-joined; none is held."""
    rows = (row for frame in frames for row in zip(frame["node"].tolist(), frame["ids"].tolist()))
    for node, pieces in groupby(rows, key=lambda r: r[0]):
        digest, comma = hashlib.sha256(), b""
        for _, ids in pieces:
            digest.update(comma + ids.encode())
            comma = b","
        yield node, digest.hexdigest()


def end_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256 from pieces (node, first, ids) whose ranges of ids don't meet."""
    joined = map_frames(ends.repartitionByRange("node", "first").sortWithinPartitions("node", "first"), lambda f: _framed(_pieces(f), ["node", "first", "ids"]), "node binary, first long, ids string")
    ordered = in_batches(joined).repartition("node").sortWithinPartitions("node", "first").drop("first")
    return map_frames(ordered, lambda f: _framed(_digests(f), ["node", "ends_sha256"]), "node binary, ends_sha256 string")


def rebuilt_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of all rebuilt conversations: conv_id, depth (from 1), role, text and the node that the turn leads to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for _, conv, turns in _rebuilt(_turns(frames)):
                node = ROOT
                for depth, (_, _, role, text) in enumerate(turns, 1):
                    node = step(node, role, text)
                    yield conv, depth, role, text, node

        # Rows hold texts: few to a frame.
        found = rows()
        while part := list(islice(found, 200)):
            yield pd.DataFrame(part, columns=["conv_id", "depth", "role", "text", "node"], dtype=object)

    return map_frames(_families(df, conv_col, turn_col, role_col, text_col), run, "conv_id long, depth long, role string, text string, node binary")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = MOST_NODES) -> DataFrame:
    """One row a node of the trie over all rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the node's name, which rebuilt_turns has too."""
    families = _families(df, conv_col, turn_col, role_col, text_col)
    sent = stored(map_frames(families, lambda f: _framed(_family_nodes(f, most), _NODE_COLUMNS), _NODE), "trie-families")
    nodes = sent.where("ids IS NULL").drop("first", "ids")
    merged = stored(nodes.groupBy("node").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.sum("n").alias("n_convs")), "trie-nodes")
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    whole = merged.join(children.hint("merge"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    # Back to the family of the smallest member: its own nodes, and what is known of those that it has alone to count.
    none = F.lit(None)
    known = whole.select(_base("conv_id").alias("base"), "conv_id", "depth", none.cast("binary").alias("node"), none.cast("binary").alias("parent"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    paths = nodes.select("base", "conv_id", "depth", "node", "parent", none.cast("long").alias("leaf"), none.cast("long").alias("saved"))
    met = known.unionByName(paths).repartition("base").sortWithinPartitions("base", F.desc("conv_id"), F.desc("depth"), F.col("node").isNotNull())
    added = map_frames(met, lambda f: _framed(_subtrees(f), ["node", "n_leaves", "saved_tokens"]), "node binary, n_leaves long, saved_tokens long")
    sums = added.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    digests = end_digests(sent.where("ids IS NOT NULL").select("node", "first", "ids"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(sums.hint("merge"), "node").join(digests.hint("merge"), "node", "left").join(parents.hint("merge"), "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "node")


#: CRC-32 by bits: a list of the id's characters, each followed by seven zeros, folded from all ones.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"

ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {COPIED} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.role, t.text, t.i AS place FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.role, t.text, t.i FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
said AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, sha256(length(role) || ':' || role || ':' || text) AS one FROM rebuilt),
paths AS (
  SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(one, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM said
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
linked AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS ends, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(chars) AS chars, min(parent) AS parent, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM linked GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
sums AS (
  SELECT p.node, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens
  FROM whole w JOIN paths p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node)
SELECT w.conv_id::BIGINT AS conv_id, w.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = w.parent"""
