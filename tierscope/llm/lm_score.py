"""LM scoring: cross-entropy difference of matched bigram models of a target and of the background.

Both models are interpolated bigram models of the same form over one vocabulary: every word that the corpus has
at least LEAST_COUNT times, and classes by shape for the rarer words. Nothing else bounds the vocabulary or the
bigrams; both are tables spread over the cluster.

1. Texts become blocks: their distinct words, and their tokens as places among these.
2. Each block deals its words with their counts to buckets, which are ranges of hashes. A bucket sums the counts
   of all blocks and sends every block the sums of its words. Pairs of words go the same way.
3. A block then has all counts that its texts need.

A word or pair goes to its bucket once a block, however often it occurs, so hot ones make no large groups. The
number of buckets follows the input. Words and pairs go by hashes with SPARE_BITS bits more than the corpus has places
in binary, so that they take few bytes and yet hardly ever meet by chance. A document's score is its mean loss per token under the target less that
under the background: lower means closer to the target.

Null texts count as empty; texts without words have loss and score 0. Rows are independent; repeated rows
get repeated results. Target ids that are null or repeated count once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Words, blocks, in_batches, join_checked, mix, stored, texts_in, tidy, words_of

#: Fewest occurrences in the corpus that make a word one of the vocabulary.
LEAST_COUNT = 2
#: Shape classes: bytes in four ranges of length, by whether it has digits, symbols or other scripts.
CLASSES = 32
#: Weight of the bigram estimate at a context seen c times is c / (c + BACKOFF).
BACKOFF = 20.0
#: Characters of a block; entries of a bucket, about.
BLOCK, BUCKET = 2 << 20, 1 << 20
#: Blocks of a partition that waits for its counts.
WAITING = 4
#: Bits of a hash beyond those of the number of characters.
SPARE_BITS = 15
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:!?'" for b in range(256)])
_WIDE = np.arange(256) >= 128
#: Ids of the classes, and of the begin of a text.
_CLASS_ID = mix(np.arange(1, CLASSES + 1, dtype=np.uint64), 0x51)
_BEGIN = mix(np.zeros(1, np.uint64), 0x51)[0]


def _shape(w: Words) -> np.ndarray:
    raw = np.frombuffer(w.data, np.uint8)

    def has(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        return (total[w.end] > total[w.start]).astype(np.int64)

    length = np.searchsorted([4, 8, 14], w.end - w.start)
    return length * 8 + has(_DIGIT) * 4 + has(_SYMBOL) * 2 + has(_WIDE)


def _packed(x: np.ndarray) -> bytes:
    """The values by byte planes, compressed: small numbers take little room."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _count(at: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    """How often each of n places occurs, in all texts and in those of the target."""
    return np.stack([np.bincount(at, minlength=n), np.bincount(at[chosen], minlength=n)])


class Block:
    """A row of the block table; with totals, the counts of its words in the corpus, also its pairs."""

    def __init__(self, row: pd.Series):
        self.name, self.ids = row["block"], row["ids"]
        self.sizes = _unpacked(row["sizes"], np.int64)
        self.target = np.frombuffer(row["target"], bool)
        self.words, self.shapes = _keys(row["words"]), _unpacked(row["shapes"], np.uint8)
        # Tokens are stored by the rank of their words, the most frequent first.
        self.tokens = np.argsort(-_unpacked(row["counts"], np.int64), kind="stable")[_unpacked(row["tokens"], np.uint32)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.chosen = self.target[self.doc]
        end = np.cumsum(self.sizes)
        self.first, self.last = (end - self.sizes)[self.sizes > 0], end[self.sizes > 0] - 1

    def word_counts(self) -> np.ndarray:
        """By word: occurrences, and occurrences before another word, each in all texts and in the target."""
        n, ends = _count(self.tokens, len(self.words), self.chosen), _count(self.tokens[self.last], len(self.words), self.chosen[self.last])
        return np.concatenate([n, n - ends])

    def totals(self, row: pd.Series) -> np.ndarray:
        """The corpus's counts of the words."""
        return _unpacked(row["totals"], np.int64).reshape(4, -1) if len(self.words) else np.zeros((4, 0), np.int64)

    def pairs(self, totals: np.ndarray, least: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct pairs, a token that ends each, and the pair of each token."""
        own = np.where(totals[0] >= least, self.words, _CLASS_ID[self.shapes])[self.tokens]
        before = np.roll(own, 1)
        before[self.first] = _BEGIN
        return np.unique(mix(before * np.uint64(0xD6E8FEB86659FD93) + own, 2) >> np.uint64(64 - bits), return_index=True, return_inverse=True)

    def alone(self, totals: np.ndarray, least: int, at: np.ndarray) -> np.ndarray:
        """Which pairs, ended by the tokens at, have a word that no other block has: their counts here are all there are."""
        own = ((totals[0] >= least) & (totals[0] == np.bincount(self.tokens, minlength=len(self.words))))[self.tokens]
        return own[at] | (own[at - 1] & ~np.isin(at, self.first))


def make_blocks(docs: DataFrame, bits: int) -> DataFrame:
    """The block table of rows (id_, text_, target_); ids as strings, words by hashes of so many bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_", BLOCK):
            w = words_of(texts_in(frame, "text_"), fold=ASCII_LOWER)
            words, first, tokens, counts = np.unique(w.h >> np.uint64(64 - bits), return_index=True, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.uint32)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(words), dtype=np.uint32)
            yield pd.DataFrame({
                "block": [uuid.uuid4().int >> 65],
                "ids": [[i if isinstance(i, str) else None for i in frame["id_"]]],
                "n_words": [len(words)],
                "n_tokens": [len(tokens)],
                "sizes": [_packed(np.bincount(w.doc, minlength=len(frame)).astype(np.int64))],
                "target": [frame["target_"].to_numpy(bool).tobytes()],
                "words": [_packed_keys(words)],
                "shapes": [_packed(_shape(w)[first].astype(np.uint8))],
                "counts": [_packed(counts.astype(np.int64))],
                "tokens": [_packed(rank[tokens])],
            })

    return in_batches(docs).mapInPandas(tidy(run), _BLOCK)


_BLOCK = "block long, ids array<string>, n_words long, n_tokens long, sizes binary, target binary, words binary, shapes binary, counts binary, tokens binary"


def _deal(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int, bits: int) -> pd.DataFrame:
    """One row for each bucket that has some of the sorted keys, which have so many bits."""
    cut = np.append(np.searchsorted(keys, np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)), len(keys))
    some = np.flatnonzero(np.diff(cut))
    counts = counts.astype(np.uint32)
    parts = [slice(cut[b], cut[b + 1]) for b in some]
    return pd.DataFrame({"block": block, "bucket": some, "keys": [_packed_keys(keys[s]) for s in parts], "counts": [_packed(counts[:, s]) for s in parts]})


def totals_of(dealt: DataFrame, buckets: int, kinds: int, least: int = 0) -> DataFrame:
    """(block, bucket, totals, model): sums over all blocks for the keys of each row, in their order.

    Counts are of some kinds. With least, each key has its class as one more: model is, on one row of a bucket, the
    number of keys with a first sum of at least least, and the sums by kind and class of the other keys.
    """
    dealt = dealt.repartition(max(buckets, dealt.sparkSession.sparkContext.defaultParallelism), "bucket")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_keys(k) for k in group["keys"]]
        cut = np.cumsum([len(k) for k in parts])[:-1]
        counts = np.concatenate([_unpacked(c, np.uint32).reshape(-1, len(k)) for k, c in zip(parts, group["counts"], strict=True)], axis=1)
        u, at, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        sums = np.stack([np.bincount(inverse, c, len(u)) for c in counts[:kinds]]).astype(np.int64)
        model: list[list[int]] = [[] for _ in parts]
        if least:
            rare = sums[0] < least
            shapes = counts[kinds][at][rare]
            model[0] = [int((~rare).sum()), *(int(n) for c in sums for n in np.bincount(shapes, c[rare], CLASSES))]
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "totals": [_packed(sums[:, x]) for x in np.split(inverse, cut)], "model": model})

    return dealt.groupBy("bucket").applyInPandas(add, "block long, bucket long, totals binary, model array<long>")


def _joined(replies: pd.DataFrame, kinds: int) -> np.ndarray:
    """The totals of a block's keys, in the order of the keys."""
    parts = [_unpacked(t, np.int64).reshape(kinds, -1) for t in replies.sort_values("bucket")["totals"]]
    return np.concatenate([np.zeros((kinds, 0), np.int64), *parts], axis=1)


def word_totals(table: DataFrame, n_words: int, waiting: int, least: int, bits: int) -> DataFrame:
    """(block, totals, model): the corpus's counts of each block's words; the models add up to the whole one."""
    buckets = max(1, -(-n_words // BUCKET))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                b = Block(row)
                yield _deal(b.name, b.words, np.concatenate([b.word_counts(), b.shapes[None].astype(np.int64)]), buckets, bits)

    def gather(replies: pd.DataFrame) -> pd.DataFrame:
        model = np.sum([np.zeros(1 + 4 * CLASSES, np.int64), *(np.array(m, np.int64) for m in replies["model"] if len(m))], axis=0)
        return pd.DataFrame({"block": replies["block"].iloc[:1], "totals": [_packed(_joined(replies, 4))], "model": [model.tolist()]})

    replies = totals_of(table.mapInPandas(tidy(deal), "block long, bucket long, keys binary, counts binary"), buckets, 4, least)
    return replies.repartition(waiting, "block").groupBy("block").applyInPandas(gather, "block long, totals binary, model array<long>")


def score_by_models(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """Per row: id, n_tokens, loss_target and loss_background (means per token, natural log), score (their difference).

    target_ids: one column, the ids of the documents that make up the target. The loss is -log P(later | earlier):
    the bigram estimate interpolated with the unigram one, which has one case added for each id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = stored(target_ids.toDF("id_").where("id_ IS NOT NULL").distinct().withColumn("target_", F.lit(True)), "lm-target")
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    flagged = join_checked(rows, chosen, "id_", "left").select(F.col("id_").cast("string").alias("id_"), "text_", F.coalesce("target_", F.lit(False)).alias("target_"))
    places = rows.agg(F.sum(F.length("text_"))).first()[0] or 0
    bits = min(64, math.ceil(math.log2(places + 2)) + SPARE_BITS)
    table = stored(make_blocks(flagged, bits), "lm-blocks")
    n_blocks, n_words, n_tokens = (x or 0 for x in table.agg(F.count("*"), F.sum("n_words"), F.sum("n_tokens")).first())
    waiting = max(-(-n_blocks // WAITING), docs.sparkSession.sparkContext.defaultParallelism)
    told = stored(word_totals(table, n_words, waiting, least, bits), "lm-words")
    model = np.zeros(1 + 4 * CLASSES)
    for at, n in told.select(F.posexplode("model").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect():
        model[at] = n
    ids, of_class = model[0] + 1 + CLASSES, model[1:].reshape(4, CLASSES)
    # Tokens, and texts with tokens: the begin of a text stands before its first one.
    sides = table.mapInPandas(_sides, "n long, n_target long, begins long, begins_target long").groupBy().sum().first()
    every, begins = [x or 0 for x in sides[:2]], [x or 0 for x in sides[2:]]
    # Both uses of this have the same exchanges, which Spark makes once. A block without words is in no bucket.
    whole = table.repartition(waiting, "block").join(told.select("block", "totals").repartition(waiting, "block"), "block", "left")
    buckets = max(1, -(-n_tokens // BUCKET))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                b = Block(row)
                totals = b.totals(row)
                pair, at, of = b.pairs(totals, least, bits)
                sent = ~b.alone(totals, least, at)
                yield _deal(b.name, pair[sent], _count(of, len(pair), b.chosen)[:, sent], buckets, bits)

    replies = totals_of(whole.mapInPandas(tidy(deal), "block long, bucket long, keys binary, counts binary"), buckets, 2)

    def score(left: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = Block(left.iloc[0])
        totals = b.totals(left.iloc[0])
        pair, at, of = b.pairs(totals, least, bits)
        both, known = _count(of, len(pair), b.chosen), totals[0] >= least
        both[:, ~b.alone(totals, least, at)] = _joined(replies, 2)
        counts = np.where(known, totals, of_class[:, b.shapes])
        starts = np.isin(at, b.first)
        mean = []
        for side in (1, 0):
            single = (counts[side][b.tokens[at]] + 1.0) / (every[side] + ids)
            context = np.where(starts, begins[side], counts[2 + side][b.tokens[at - 1]])
            weight = context / (context + BACKOFF)
            loss = -np.log(weight * both[side] / np.maximum(context, 1) + (1 - weight) * single)
            mean.append(np.bincount(b.doc, loss[of], len(b.sizes)) / np.maximum(b.sizes, 1))
        return pd.DataFrame({"id_": list(b.ids), "n_tokens": b.sizes, "loss_target": mean[0], "loss_background": mean[1], "score": mean[0] - mean[1]})

    out = whole.groupBy("block").cogroup(replies.drop("model").repartition(waiting, "block").groupBy("block")).applyInPandas(score, "id_ string, n_tokens long, loss_target double, loss_background double, score double")
    return out.select(F.col("id_").cast(kind).alias(id_col), "n_tokens", "loss_target", "loss_background", "score")


def _sides(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        parts = [Block(row) for _, row in frame.iterrows()]
        yield pd.DataFrame({"n": [len(b.tokens) for b in parts], "n_target": [int(b.chosen.sum()) for b in parts], "begins": [len(b.first) for b in parts], "begins_target": [int(b.target[b.sizes > 0].sum()) for b in parts]})
