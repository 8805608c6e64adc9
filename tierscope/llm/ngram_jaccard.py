"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their components.

Search is exact. Signature trees find the pairs: a leaf holds one set's size and a bitmap of its hashed
shingles; a node holds the OR of its children's bitmaps and the range of their sizes. Two trees are walked
together, and a pair of nodes is left out when the largest overlap that any of their sets can have, from
common bits, sizes and hash collisions inside a set, is below the least overlap that a link needs.

1. Equal sets are one class from here on, whatever their number.
2. Classes that share their smallest shingle in one of a few hash orders form blocks. A large block is dealt out in tiles of bounded
   size, each with a copy of the first tile, and each tile is joined with itself by its tree. Links found join
   classes into components, which takes in copies of all group sizes with few links sent on.
3. With s = n - ceil(p n) + 1, p being the least similarity, a linked pair has m shingles in common among the first s + m - 1 of both sets
   in any fixed order. For m about s / 3, a class goes on only if so many of its first shingles are held by
   other components as well; passages that texts merely share don't come near that.
4. Of the classes left, pairs of different components with a shingle in common among the first s are joined by
   trees for each shingle, large groups as pairs of tiles, and what passes is compared in full: first the most
   promising pair of each two components, then, between those that are still apart, every pair. Here the order
   puts the shingles with most holders last (a list of bounded length).

Null texts, and texts without words, have an empty set and link with nothing. Rows that share id and text
are alike; an id must be an integer. Rows that share an id and differ in text are each judged by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, blocks, components, in_batches, join_checked, map_frames, mix, shingles_of, signed, stored, texts_in, tidy, words_of

SHINGLE = 4
#: A pair links when 100 * intersection >= PERCENT * union, unless another percentage is given.
PERCENT = 85
#: 64-bit words of a signature; sets of a tile; children of a node.
SIGNATURE_WORDS, TILE, FAN = 32, 256, 8
#: Shingles at most that the order puts last.
FREQUENT = 65_536
#: Orders whose smallest shingle makes blocks.
ORDERS = 3


def needed(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least intersection with which sets of a and b shingles link."""
    return -(-percent * (a + b) // (100 + percent))


def signature(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(SIGNATURE_WORDS * 64, bool)
    bits[(mix(shingles, 5) % np.uint64(SIGNATURE_WORDS * 64)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


@dataclass
class Level:
    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spare: np.ndarray  # most shingles of a set beyond its bits


class SignatureTree:
    """Sets in a given order, FAN of them to a node and so on up to one root; levels[0] are the sets."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.levels = [Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64))]
        while len(self.levels[-1].low) > 1:
            x = self.levels[-1]
            at = np.arange(0, len(x.low), FAN)
            self.levels.append(Level(np.bitwise_or.reduceat(x.bits, at, axis=0), np.minimum.reduceat(x.low, at), np.maximum.reduceat(x.high, at), np.maximum.reduceat(x.spare, at)))

    def level(self, k: int) -> Level:
        return self.levels[min(k, len(self.levels) - 1)]


def _may_link(a: Level, i: np.ndarray, b: Level, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs can hold a link, and the largest overlap of each."""
    most = np.empty(len(i), np.int64)
    for at in range(0, len(i), 16_384):
        s = slice(at, at + 16_384)
        most[s] = np.bitwise_count(a.bits[i[s]] & b.bits[j[s]]).sum(axis=1)
    most = np.minimum(most + np.minimum(a.spare[i], b.spare[j]), np.minimum(a.high[i], b.high[j]))
    fits = (100 * a.high[i] >= percent * b.low[j]) & (100 * b.high[j] >= percent * a.low[i])
    return fits & (most >= needed(a.low[i], b.low[j], percent)), most


def walk(a: SignatureTree, b: SignatureTree | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets that may link, most overlapping first, with their largest overlap; b None: a with itself."""
    own, other = b is None, a if b is None else b
    top = max(len(a.levels), len(other.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        ok, most = _may_link(a.level(k), i, other.level(k), j, percent)
        i, j, most = i[ok], j[ok], most[ok]
        if k:
            wide_a, wide_b = (FAN if k < len(t.levels) else 1 for t in (a, other))
            step = np.arange(wide_a * wide_b)
            i, j = (i[:, None] * wide_a + step // wide_b).ravel(), (j[:, None] * wide_b + step % wide_b).ravel()
            ok = (i < len(a.level(k - 1).low)) & (j < len(other.level(k - 1).low))
            ok &= (i <= j if k > 1 else i < j) if own else True
            i, j = i[ok], j[ok]
        elif own:
            ok = i < j
            i, j, most = i[ok], j[ok], most[ok]
    order = np.argsort(-most, kind="stable")
    return i[order], j[order], most[order]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    least = int(needed(np.int64(len(a)), np.int64(len(b)), percent))
    if min(len(a), len(b)) < least:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= least


def join_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links enough to join the components of the sets: each pair that may link is compared unless both ends
    are together already."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda x: (sets[x][1] if len(sets[x]) > 1 else 0, len(sets[x])))
    tree = SignatureTree(np.stack([signature(sets[x]) for x in order]), np.array([len(sets[x]) for x in order]))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i, j, _ in zip(*(x.tolist() for x in walk(tree, percent=percent)), strict=True):
        p, q = find(i), find(j)
        if p != q and linked(sets[order[i]], sets[order[j]], percent):
            root[q] = p
            found.append((order[i], order[j]))
    return found


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    doc, h = shingles_of(words_of(texts, fold=ASCII_LOWER), k, short_as_one=True)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _class_of(s: np.ndarray) -> int:
    """A hash of a whole set; 0 stands for the empty one."""
    return int(mix(np.array([mix(s, 11).sum() + np.uint64(len(s))], np.uint64), 3).view(np.int64)[0]) if len(s) else 0


def _prefix(s: np.ndarray, last: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(n * percent / 100) + 1 of a set, by hash, those in last behind all others."""
    n = len(s)
    size = n - -(-percent * n // 100) + 1 if n else 0
    if not len(last):
        return s[:size]
    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
    return np.concatenate([s[~late], s[late]])[:size]


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of rows sorted by keys again, so that no group is cut."""
    held = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        same = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        first = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = frame.iloc[first:].reset_index(drop=True)
        if first:
            yield frame.iloc[:first].reset_index(drop=True)
    if held is not None:
        yield held


def describe(rows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(id_, n, set_, least_) of each row of (id_, text_): size and hash of its set, its smallest shingle in each order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_"):
            sets = shingle_sets(texts_in(frame, "text_"), k)
            yield pd.DataFrame({"id_": frame["id_"], "n": [len(s) for s in sets], "set_": [_class_of(s) for s in sets], "least_": [signed(np.array([mix(s, salt).min() if len(s) else 0 for salt in range(ORDERS)], np.uint64)) for s in sets]})

    return map_frames(rows, run, "id_ long, n long, set_ long, least_ array<long>")


def block_links(rows: DataFrame, classes: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between classes whose smallest shingle in an order is the same, as many as join their components."""
    classes = classes.select("id_", "set_", F.posexplode("least_").alias("order_", "least_")).withColumn("least_", F.xxhash64("order_", "least_"))
    sizes = classes.groupBy("least_").agg(F.count("*").alias("c")).where("c > 1")
    chosen = classes.join(sizes.hint("merge"), "least_").withColumn("tiles", F.ceil(F.col("c") / TILE)).withColumn("tile", F.pmod(F.xxhash64("set_"), F.col("tiles")))
    chosen = stored(chosen.select("id_", "set_", "least_", "tiles", "tile"), "jaccard-blocks")
    # The first tile goes along with every other one.
    to = F.when(F.col("tile") == 0, F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array("tile"))
    dealt = join_checked(rows, chosen, "id_").withColumn("tile", F.explode(to)).select("least_", "tile", "set_", "text_")
    dealt = dealt.repartition("least_", "tile").sortWithinPartitions("least_", "tile")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _groups(frames, ["least_", "tile"]):
            found = []
            for _, group in batch.groupby(["least_", "tile"], sort=False):
                sets = {}
                for part in blocks([group], "text_"):
                    for c, s in zip(part["set_"], shingle_sets(texts_in(part, "text_"), k), strict=True):
                        if _class_of(s) == c:
                            sets[c] = s
                names = list(sets)
                found += [(names[i], names[j]) for i, j in join_sets(list(sets.values()), percent)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return dealt.mapInPandas(tidy(run), "a long, b long")


def _least_shared(size: int) -> int:
    """How many shingles a linked pair must share among the first size + this - 1 of both, for size as in _prefix."""
    return 1 + size // 3


def may_have_more(rows: DataFrame, classes: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(set_, id_, n) of the classes that can be in a link between components.

    rows: (id_, text_, known_, root_, skip_), the class that is known by the id, its component where it has
    others, and whether another row stands for the class. Among its first shingles a class needs as many that other components hold too. A
    shingle that a block of texts holds in several components is known to be shared at once, so it sends on one
    row for the block, however many texts hold it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_"):
            sets = shingle_sets(texts_in(frame, "text_"), k)
            name = np.array([_class_of(s) for s in sets], np.int64)
            # An id can stand for several texts; what is known is of one of them.
            known_of = np.array([c is not None and c == c and int(c) == n for c, n in zip(frame["known_"], name, strict=True)], bool)
            root = np.array([int(r) if ok and r is not None and r == r else n for r, ok, n in zip(frame["root_"], known_of, name, strict=True)], np.int64)
            keep = np.flatnonzero(~(known_of & frame["skip_"].to_numpy(bool)))
            sets, name, root = [sets[i] for i in keep], name[keep], root[keep]
            firsts = []
            for s in sets:
                size = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                firsts.append(s[: size + _least_shared(size) - 1 if size else 0])
            token = np.concatenate([*firsts, np.zeros(0, np.uint64)])
            doc = np.repeat(np.arange(len(sets)), [len(f) for f in firsts])
            if not len(token):
                continue
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            lo, hi = np.minimum.reduceat(root[doc], head), np.maximum.reduceat(root[doc], head)
            size = np.diff(np.append(head, len(token)))
            shared = np.repeat(lo < hi, size)
            known = np.bincount(doc[shared], minlength=len(sets))
            some, both = np.flatnonzero(known), lo < hi
            # What is known already travels under a shingle of its own that counts as shared.
            own = mix(name[some].view(np.uint64) ^ token[0], 99)
            yield pd.DataFrame({
                "shingle": signed(np.concatenate([token[~shared], token[head[both]], own])),
                "lo": np.concatenate([root[doc[~shared]], lo[both], np.zeros(len(some), np.int64)]),
                "hi": np.concatenate([root[doc[~shared]], hi[both], np.ones(len(some), np.int64)]),
                "set_": np.concatenate([name[doc[~shared]], np.zeros(both.sum(), np.int64), name[some]]),
                "w": np.concatenate([np.ones((~shared).sum(), np.int32), np.zeros(both.sum(), np.int32), known[some].astype(np.int32)]),
            })

    sent = rows.mapInPandas(tidy(run), "shingle long, lo long, hi long, set_ long, w int")
    by = Window.partitionBy("shingle")
    marked = sent.withColumns({"least": F.min("lo").over(by), "most": F.max("hi").over(by)})
    counts = marked.where("w > 0 AND least < most").groupBy("set_").agg(F.sum("w").alias("w"))
    size = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    return classes.join(counts.hint("merge"), "set_").withColumn("size", size).where(F.col("w") >= F.expr("1 + size div 3")).select("set_", "id_", "n")


def first_shingles(sets: DataFrame, last: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(shingle, set_, root) for the first shingles of each stored set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [_prefix(np.frombuffer(s, np.uint64), last, percent) for s in frame["shingles"]]
            size = [len(p) for p in own]
            yield pd.DataFrame({"shingle": signed(np.concatenate([*own, np.zeros(0, np.uint64)])), "set_": np.repeat(frame["set_"].to_numpy(), size), "root": np.repeat(frame["root"].to_numpy(), size)})

    return sets.select("set_", "root", "shingles").mapInPandas(tidy(run), "shingle long, set_ long, root long")


def _between(sets: DataFrame, last: np.ndarray, percent: int) -> DataFrame:
    """(shingle, c): first shingles held in more than one component, with the number of their holders."""
    held = first_shingles(sets, last, percent).groupBy("shingle").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return held.where("lo < hi").select("shingle", "c")


def other_links(rows: DataFrame, described: DataFrame, classes: DataFrame, joined: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): all links between classes of different components. joined: (set_, root), stored."""
    # Stored first: then a class with very many copies is split where its documents are joined.
    named = stored(classes.select("set_", F.col("id_").alias("first_"), "copies").join(joined, "set_", "left").where("copies > 1 OR root IS NOT NULL"), "jaccard-named")
    known = stored(join_checked(described.select("id_", "set_"), named, "set_").select("id_", F.col("set_").cast("string").alias("known_"), F.col("root").cast("string").alias("root_"), (F.col("id_") != F.col("first_")).alias("skip_")).distinct(), "jaccard-known")
    told = join_checked(rows, known, "id_", "left").withColumn("skip_", F.coalesce("skip_", F.lit(False)))
    left = stored(join_checked(may_have_more(told, classes, k, percent), joined, "set_", "left").withColumn("root", F.coalesce("root", "set_")), "jaccard-left")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_"):
            sets = shingle_sets(texts_in(frame, "text_"), k)
            ok = [i for i, (s, c) in enumerate(zip(sets, frame["set_"], strict=True)) if _class_of(s) == c]
            yield pd.DataFrame({"set_": frame["set_"].to_numpy()[ok], "root": frame["root"].to_numpy()[ok], "n": [len(sets[i]) for i in ok], "bits": [signature(sets[i]).tobytes() for i in ok], "shingles": [sets[i].tobytes() for i in ok]})

    # An id seen with several texts can give a set twice; where a set occurs twice below, its pairs do, and no more.
    sets = stored(join_checked(rows, left.select("set_", "id_", "root"), "id_").mapInPandas(tidy(whole), "set_ long, root long, n long, bits binary, shingles binary"), "jaccard-sets")
    first = stored(_compared(sets, _candidates(sets, True, percent), percent), "jaccard-first")
    ends = sets.select("set_", "root").distinct()
    roots = first.join(ends.toDF("a", "x").hint("merge"), "a").join(ends.toDF("b", "y").hint("merge"), "b").select("x", "y")
    merged = stored(components(roots, "x", "y").toDF("root", "into"), "jaccard-merged")
    rest = join_checked(sets, merged, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into")
    return first.unionByName(_compared(sets, _candidates(rest, False, percent), percent))


def _candidates(sets: DataFrame, best: bool, percent: int) -> DataFrame:
    """(a, b): pairs of classes of different components that may link by their signatures and have a first shingle
    in common. best: of each two components that a shingle brings together only the pair that may overlap most."""
    often = _between(sets, np.zeros(0, np.uint64), percent).orderBy(F.desc("c"), "shingle").limit(FREQUENT).select("shingle").toPandas()
    last = np.sort(often["shingle"].to_numpy(np.int64).view(np.uint64))
    shared = stored(_between(sets, last, percent), "jaccard-shared")
    held = join_checked(first_shingles(sets, last, percent), shared, "shingle")
    dealt = held.withColumn("tiles", F.ceil(F.col("c") / TILE)).withColumn("tile", F.pmod(F.xxhash64("set_"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("shingle", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "set_", "root")
    dealt = dealt.join(sets.select("set_", "n", "bits").hint("merge"), "set_").repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "n")

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _groups(frames, ["shingle", "x", "y"]):
            found = []
            keys = batch[["shingle", "x", "y"]].to_numpy()
            head = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            name, root, tile, n = (batch[c].to_numpy() for c in ("set_", "root", "tile", "n"))
            bits = np.frombuffer(b"".join(batch["bits"]), np.uint64).reshape(len(batch), -1)
            for a, b in zip(head, np.append(head[1:], len(batch)), strict=True):
                at = np.arange(a, b)
                parts = [at] if keys[a, 1] == keys[a, 2] else [at[tile[at] == keys[a, 1]], at[tile[at] == keys[a, 2]]]
                if (root[at] == root[a]).all() or not all(map(len, parts)):
                    continue
                i, j, _ = walk(*(SignatureTree(bits[p], n[p]) for p in parts), percent=percent)
                i, j = parts[0][i], parts[-1][j]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                if best and len(i):  # the pairs come most overlapping first
                    ends = np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j])], 1)
                    one = np.unique(ends, axis=0, return_index=True)[1]
                    i, j = i[one], j[one]
                found.append(np.stack([np.minimum(name[i], name[j]), np.maximum(name[i], name[j])], 1))
            yield pd.DataFrame(np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0), columns=["a", "b"])

    return stored(dealt.mapInPandas(tidy(pairs), "a long, b long").distinct(), "jaccard-maybe")


def _compared(sets: DataFrame, maybe: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""
    left, right = (sets.select(F.col("set_").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(frame["s_a"], frame["s_b"], strict=True)]
            yield frame.loc[np.array(ok, bool), ["a", "b"]]

    return maybe.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInPandas(tidy(compare), "a long, b long").distinct()


def group_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id, the smallest id that links reach, its own included."""
    rows = in_batches(df).select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    described = stored(describe(rows, k), "jaccard-described")
    classes = stored(described.where("n > 0").groupBy("set_", "n", "least_").agg(F.min("id_").alias("id_"), F.count("*").alias("copies")), "jaccard-classes")
    links = stored(block_links(rows, classes, k, percent), "jaccard-links")
    joined = stored(components(links).select(F.col("node").alias("set_"), "root"), "jaccard-joined")
    more = stored(other_links(rows, described, classes, joined, k, percent), "jaccard-more")
    if more.limit(1).count():
        joined = stored(components(links.unionByName(more)).select(F.col("node").alias("set_"), "root"), "jaccard-all")
    # Only classes with copies or links need more than their own id.
    named = classes.join(joined, "set_", "left").where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "set_"))
    first = named.groupBy("root").agg(F.min("id_").alias("component_"))
    names = stored(named.join(first, "root").select("set_", "component_"), "jaccard-names")
    out = join_checked(described, names, "set_", "left")
    return out.select(F.col("id_").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_", "id_").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 4),
k AS (SELECT doc_id, string_agg(x, ' ') OVER ahead AS key, count(*) OVER ahead AS n FROM p WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, key FROM k WHERE n = 4 UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY 1, 2),
one_way AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
links AS (SELECT x, y FROM one_way UNION ALL SELECT y, x FROM one_way),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
