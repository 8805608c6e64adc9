"""Substring dedup: windows of WINDOW words that occur before are found through super-k-mers.

A window's minimiser is the run of MINIMISER words in it whose hash comes first, the leftmost of equal ones.
Consecutive windows with the same minimiser occurrence form a super-k-mer; its words travel once, packed with
all others of the block for the same bucket into one compressed string. Equal windows have equal minimisers,
so a bucket sees all copies of its windows. There, words become exact numbers, windows are ranked by doubling
(1, 2, 4, 8, 16, 20 words) and sorted, and of equal windows all but the earliest are repeats. The windows of
one super-k-mer all differ, as each has the minimiser at another place, so a minimiser seen once is skipped.

The number of buckets grows with the text, so a bucket's size doesn't. A minimiser that would fill a good part
of a bucket by itself is counted beforehand; its windows travel one by one, by their own hash. Of those that are
alike in a block only the earliest travels: the others are known to be repeats there and then, so a passage that a
third of all documents share sends one window a block.

Counts are summed by stretch of text; a stretch keeps a minimiser to itself only below a share of the bound that
all stretches together can't reach unseen. So every minimiser above the bound is found, and the list of those has at
most MOST_HOT entries, whatever the input.

Null texts have no words. Rows that share an id count as one document seen several times: what is removed at a
place of it is removed in all of them. Documents under WINDOW words stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, in_batches, join_checked, map_frames, mix, signed, stored, texts_in, tidy, words_of

WINDOW, MINIMISER = 20, 3
#: Characters of text for each bucket, and in each block.
BUCKET_CHARS, BLOCK_CHARS = 4 << 20, 1 << 20
#: Characters of the stretches that minimisers are counted by, and most minimisers that travel as windows.
STRETCH_CHARS, MOST_HOT = 32 << 20, 1 << 22
_PLACE_BITS = 24
_MOST = np.uint64(2**64 - 1)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    out = h[: max(0, len(h) - k + 1)].copy()
    for i in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(out) + i]
    return mix(out, k)


def super_kmers(w: Words, window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, number of windows) of each super-k-mer of a block's texts."""
    n = len(w.h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = _grams(w.h, m)
    key, first, count = [], [], []
    for at in range(0, n, 1 << (_PLACE_BITS - 1)):
        size = min(n - at, 1 << (_PLACE_BITS - 1))
        span = window - m + 1
        part = grams[at : at + size + span - 1]
        least = (part >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        done = 1
        while 2 * done <= span:
            least = np.minimum(least[: len(least) - done], least[done:])
            done *= 2
        if done < span:
            least = np.minimum(least[: size], least[span - done : span - done + size])
        place = (least[:size] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        ok = np.flatnonzero(w.doc[at : at + size] == w.doc[at + window - 1 : at + window - 1 + size])
        heads = np.flatnonzero((np.diff(ok, prepend=-2) != 1) | (np.diff(place[ok], prepend=-1) != 0))
        key.append(part[place[ok[heads]]])
        first.append(ok[heads] + at)
        count.append(np.diff(np.append(heads, len(ok))))
    return np.concatenate(key), np.concatenate(first), np.concatenate(count)


def _split_hot(w: Words, hot: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers, those of hot minimisers as single windows keyed by their own hash, and which ones are such."""
    key, first, count = super_kmers(w, window, m)
    is_hot = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
    if not is_hot.any():
        return key, first, count, is_hot
    n = count[is_hot]
    single = np.repeat(first[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = _grams(w.h, window)[single]
    return (np.concatenate([key[~is_hot], own]), np.concatenate([first[~is_hot], single]),
            np.concatenate([count[~is_hot], np.ones(len(single), np.int64)]), np.repeat([False, True], [(~is_hot).sum(), len(single)]))


def _later_in_block(text: bytes, a: np.ndarray, b: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of single windows text[a:b] at (doc, start): which have to travel, and which repeat an earlier one of them."""
    order = np.lexsort((start, doc))
    earliest: dict[bytes, int] = {}
    travel, later = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        before = earliest.setdefault(text[x:y], i)
        travel[i] = before == i
        later[i] = doc[before] != doc[i] or start[before] != start[i]
    return travel, later


def _normal(w: Words) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and where each begins."""
    size = w.end - w.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(begin[-1], 32, np.uint8)
    to = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
    raw = np.frombuffer(w.data, np.uint8)
    out[to] = raw[np.arange(size.sum()) + np.repeat(w.start - (np.cumsum(size) - size), size)]
    return out.tobytes(), begin


def pack(ids: np.ndarray, w: Words, n_buckets: int, hot: np.ndarray, window: int = WINDOW, m: int = MINIMISER) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, packed numbers, packed words) for each bucket that the block has super-k-mers for; without words, the
    numbers are the ids and places of windows that are known to be repeats."""
    key, first, count, single = _split_hot(w, hot, window, m)
    if not len(key):
        return
    text, begin = _normal(w)
    bounds = w.bounds()
    squeeze = zstandard.ZstdCompressor(level=3)
    if single.any():
        at = first[single]
        doc, start = ids[w.doc[at]], at - bounds[w.doc[at]]
        travel, later = _later_in_block(text, begin[at], begin[at + window] - 1, doc, start)
        if later.any():
            yield int(mix(key[single][later][:1], 5)[0] % np.uint64(n_buckets)), squeeze.compress(np.concatenate([doc[later], start[later]]).tobytes()), None
        keep = ~single
        keep[single] = travel
        key, first, count = key[keep], first[keep], count[keep]
    bucket = ((mix(key, 77) >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    key, first, count, bucket = key[order], first[order], count[order], bucket[order]
    a, b = begin[first], begin[first + count + window - 1] - 1
    doc = ids[w.doc[first]]
    start = first - bounds[w.doc[first]]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    for x, y in zip(heads, np.append(heads[1:], len(bucket)), strict=True):
        numbers = np.concatenate([signed(key[x:y]), doc[x:y], start[x:y], count[x:y]]).astype(np.int64)
        words = b"\n".join([text[i:j] for i, j in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True)])
        yield int(bucket[x]), squeeze.compress(numbers.tobytes()), squeeze.compress(words)


def _ranges(doc: np.ndarray, start: np.ndarray, window: int) -> pd.DataFrame:
    """(doc, start, end) of windows, adjoining ones as one range."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    joined = (np.diff(doc) == 0) & (np.diff(start) <= 1)
    first, last = np.flatnonzero(np.append(True, ~joined)), np.flatnonzero(np.append(~joined, True))
    return pd.DataFrame({"doc": doc[first], "start": start[first], "end": start[last] + window})


def repeats(packed: list[tuple[bytes, bytes | None]], window: int = WINDOW) -> pd.DataFrame:
    """Of one bucket: (doc, start, end) word ranges of windows that occur earlier, adjoining windows as one range."""
    open_ = zstandard.ZstdDecompressor()
    none = pd.DataFrame({"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)})
    known = [np.frombuffer(open_.decompress(a), np.int64).reshape(2, -1) for a, b in packed if b is None]
    packed = [x for x in packed if x[1] is not None]
    found = _repeats(packed, window, open_) if packed else none
    return pd.concat([found, *(_ranges(doc, start, window) for doc, start in known)], ignore_index=True) if known else found


def _repeats(packed: list[tuple[bytes, bytes]], window: int, open_: zstandard.ZstdDecompressor) -> pd.DataFrame:
    numbers = np.concatenate([np.frombuffer(open_.decompress(a), np.int64).reshape(4, -1) for a, _ in packed], axis=1)
    key, doc, start, count = numbers
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    multi = np.zeros(len(key), bool)
    multi[order[1:][same]] = multi[order[:-1][same]] = True
    none = pd.DataFrame({"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)})
    if not multi.any():
        return none
    words, at = [], 0
    for a, b in packed:
        lines = open_.decompress(b).split(b"\n")
        words += [lines[i] for i in np.flatnonzero(multi[at : at + len(lines)])]
        at += len(lines)
    doc, start, count = doc[multi], start[multi], count[multi]
    code = pd.factorize(np.array(b" ".join(words).split(b" "), dtype=object))[0].astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(count + window - 1)])[:-1]
    place = np.repeat(offset, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rank, done, tails = code, 1, []
    while 2 * done <= window:
        tails.append((done, rank))
        rank = np.unique(rank[: len(rank) - done] * (rank.max() + 1) + rank[done:], return_inverse=True)[1]
        done *= 2
    window_id, covered = rank[place], done
    for size, r in reversed(tails):
        if covered + size <= window:
            part = r[place + covered]
            window_id = np.unique(window_id * (part.max() + 1) + part, return_inverse=True)[1]
            covered += size
    doc, start = np.repeat(doc, count), np.repeat(start, count) + place - np.repeat(offset, count)
    order = np.lexsort((start, doc, window_id))
    window_id, doc, start = window_id[order], doc[order], start[order]
    head = np.flatnonzero(np.diff(window_id, prepend=-1))
    of = np.repeat(head, np.diff(np.append(head, len(window_id))))
    later = (doc != doc[of]) | (start != start[of])
    doc, start = doc[later], start[later]
    return _ranges(doc, start, window) if len(doc) else none


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that touch or overlap as one."""
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > end[:-1])
    return start[first], end[np.append(first[1:], True)]


def repeated_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(doc, starts, ends): by id, the word ranges to remove, apart from one another and in order."""
    rows = in_batches(df).select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    chars, last = (x or 0 for x in rows.select(F.length("text_").alias("n"), F.spark_partition_id().alias("p")).agg(F.sum("n"), F.max("p")).first())
    n_stretches = last + 1 + chars // STRETCH_CHARS
    n_buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / BUCKET_CHARS))

    # A super-k-mer has about half as many windows as a window has runs, and a word about six characters. The bound on
    # a minimiser is half of what a bucket has, and no lower than keeps the list of those above it short.
    every = chars / 6 / ((window - m + 2) / 2)
    bound = max(64.0, every / n_buckets / 2, 2 * every / MOST_HOT)
    share = int(bound / 2 / n_stretches)

    def frequent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def told() -> pd.DataFrame:
            return pd.DataFrame({"key": signed(key[n > share]), "n": n[n > share]})

        for frame in blocks(frames, "text_", BLOCK_CHARS):
            own, more = np.unique(super_kmers(words_of(texts_in(frame, "text_")), window, m)[0], return_counts=True)
            both, at = np.unique(np.concatenate([key, own]), return_inverse=True)
            key, n = both, np.bincount(at, np.concatenate([n, more]), len(both)).astype(np.int64)
            seen += int(frame["text_"].str.len().fillna(0).sum())
            if seen >= STRETCH_CHARS:
                yield told()
                key, n, seen = key[:0], n[:0], 0
        yield told()

    counts = rows.mapInPandas(tidy(frequent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # What stretches kept to themselves is at most half of the bound.
    hot = np.sort(counts.where(F.col("n") > bound / 2).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_", BLOCK_CHARS):
            found = list(pack(frame["id_"].to_numpy(np.int64), words_of(texts_in(frame, "text_")), n_buckets, hot, window, m))
            yield pd.DataFrame(found, columns=["bucket", "numbers", "words"])

    def sorted_(bucket: pd.DataFrame) -> pd.DataFrame:
        return repeats(list(zip(bucket["numbers"], bucket["words"], strict=True)), window)

    # As many partitions as buckets: few of them have more than one or two.
    dealt = rows.where("id_ IS NOT NULL").mapInPandas(tidy(packed), "bucket long, numbers binary, words binary").repartition(n_buckets, "bucket")
    found = dealt.groupBy("bucket").applyInPandas(sorted_, "doc long, start long, end long")

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [_merge(np.asarray(a), np.asarray(b)) for a, b in zip(frame["starts"], frame["ends"], strict=True)]
            yield pd.DataFrame({"doc": frame["doc"], "starts": [a for a, _ in out], "ends": [b for _, b in out]})

    gathered = found.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return stored(gathered.mapInPandas(merged, "doc long, starts array<long>, ends array<long>"), "repeats")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Per row: id (an integer), n_words, n_removed, kept_text, the words that stay joined by one space."""
    kind = df.schema[id_col].dataType.simpleString()
    ranges = repeated_ranges(df, id_col, text_col, window, m)
    rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.col(id_col).cast("long").alias("doc"))
    rows = join_checked(rows, ranges, "doc", "left").select("id_", "text_", F.col("starts").alias("starts_"), F.col("ends").alias("ends_"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_"):
            out = []
            for text, starts, ends in zip(texts_in(frame, "text_"), frame["starts_"], frame["ends_"], strict=True):
                words = (text or "").encode().split()
                gone = 0
                if starts is not None:
                    cover = np.zeros(len(words) + 1, np.int64)
                    ok = np.asarray(starts) < len(words)
                    np.add.at(cover, np.asarray(starts)[ok], 1)
                    np.add.at(cover, np.minimum(np.asarray(ends)[ok], len(words)), -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    gone = len(words) - int(stay.sum())
                    kept = [words[i] for i in np.flatnonzero(stay)]
                else:
                    kept = words
                out.append((len(words), gone, b" ".join(kept).decode()))
            part = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])
            part.insert(0, id_col, frame["id_"])
            yield part

    return map_frames(rows, run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, string_agg(x, ' ') OVER ahead AS key, count(*) OVER ahead AS n FROM p WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, i FROM k WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
m AS (SELECT p.doc_id, p.i, p.x, coalesce(max(CASE WHEN l.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone FROM p LEFT JOIN later l ON l.doc_id = p.doc_id AND l.i = p.i),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS t FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
