"""Language ID: unigram models over a fixed public piece vocabulary, summed over all segmentations.

A word's probability in a language is the sum, over all ways to cut it into pieces, of the product of the
pieces' probabilities; a forward pass over its bytes gives it. Piece probabilities are learned by
expectation maximisation, whose expected counts come from the same forward pass and a backward one.
Words (runs of letters, lower case, with a leading space) are independent, so each distinct word of a
block is scored once, all words of a block in step, one array column for each language. Words and pieces may have any
length: the pass keeps the last bytes that a piece can reach back to, scaled, and a text without spaces is one word.

Null texts and texts without a letter are `und` with score 0, and so is everything where there is nothing
to learn from. Rows are independent; repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import load_ranks
from .common import _BYTE, _power_tables, blocks, held_out, in_batches, join_checked, keeps, map_frames, mix, stored, texts_in, tidy, words_of

#: Training documents for each language at most: those whose hashed ids come first, among the first few times as many.
TRAIN_DOCS = 400
EM_ROUNDS = 3
#: To learn from, longer words are cut into runs of so many bytes; to be scored they aren't.
LEARN_BYTES = 40
#: Bytes after which the forward pass is scaled; a longer word than LONG_BYTES goes by itself.
SCALED_BYTES, LONG_BYTES = 8, 2048
#: Words that count in full for the posterior; longer texts are as sure as one of this length.
FULL_WORDS = 20
#: Word log-probabilities that a Python worker keeps.
KEPT_WORDS = 300_000

NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


class Pieces:
    """The vocabulary: lower-case letter runs with or without a leading space, and every byte."""

    def __init__(self, path: str):
        def usable(t: bytes) -> bool:
            body = t[1:] if t[:1] == b" " else t
            return t.lower() == t and not any(NOT_LETTER[b] for b in body)

        kept = sorted({t for t in load_ranks(path) if usable(t)} | {bytes([b]) for b in range(256)})
        self.size = len(kept)
        self.lengths = sorted({len(t) for t in kept})
        self.hash = self.hashes(kept)
        self.order = np.argsort(self.hash)
        self.sorted = self.hash[self.order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def hashes(pieces: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        return substring_hashes(*prefix(data), ends - [len(p) for p in pieces], ends)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), self.size - 1)
        hit = self.sorted[at] == h[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def substring_hashes(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Lattice:
    """All pieces of some words: arcs[e] has rows, start and piece of the arcs that end at byte e of a row.
    Rows are the words, longest first."""

    length: np.ndarray
    arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def lattice(words: list[bytes], pieces: Pieces) -> tuple[Lattice, np.ndarray]:
    """The lattice of short words, and the order of its rows."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-length, kind="stable")
    total, down = prefix(np.frombuffer(b"".join(words), np.uint8))
    first = (np.cumsum(length) - length)[order]
    out = Lattice(length[order])
    for e in range(1, int(length.max(initial=0)) + 1):
        n = int(np.searchsorted(-out.length, -e, side="right"))
        rows, starts, found = [], [], []
        for s in (e - k for k in pieces.lengths if k <= e):
            p = pieces.find(substring_hashes(total, down, first[:n] + s, first[:n] + e))
            at = np.flatnonzero(p >= 0)
            rows.append(at.astype(np.int32))
            starts.append(np.full(len(at), s, np.int32))
            found.append(p[at].astype(np.int32))
        out.arcs.append((np.concatenate(rows), np.concatenate(starts), np.concatenate(found)))
    return out, order


def forward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """alpha[row, byte, language]: the summed probability of all segmentations of the bytes before."""
    alpha = np.zeros((len(lat.length), len(lat.arcs) + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for e, (rows, starts, found) in enumerate(lat.arcs, 1):
        flow = alpha[rows, starts] * prob[found]
        for c in range(prob.shape[1]):
            alpha[:, e, c] = np.bincount(rows, flow[:, c], len(alpha))
    return alpha


def log_sums(words: list[bytes], prob: np.ndarray, pieces: Pieces) -> np.ndarray:
    """By word and language, the log of the summed probability of all segmentations; words of any length."""
    n, wide = len(words), pieces.lengths[-1] + 1
    length = np.fromiter(map(len, words), np.int64, n)
    order = np.argsort(-length, kind="stable")
    total, down = prefix(np.frombuffer(b"".join(words), np.uint8))
    first, length = (np.cumsum(length) - length)[order], length[order]
    # alpha[row, e % wide, language] is of the bytes before e, divided by exp(scale).
    alpha, scale = np.zeros((n, wide, prob.shape[1])), np.zeros((n, prob.shape[1]))
    alpha[:, 0] = 1
    out = np.zeros((n, prob.shape[1]))
    live = n
    for e in range(1, int(length.max(initial=0)) + 1):
        here = np.zeros((live, prob.shape[1]))
        for k in pieces.lengths:
            if k > e:
                break
            p = pieces.find(substring_hashes(total, down, first[:live] + (e - k), first[:live] + e))
            at = np.flatnonzero(p >= 0)
            here[at] += alpha[at, (e - k) % wide] * prob[p[at]]
        alpha[:live, e % wide] = here
        going = int(np.searchsorted(-length[:live], -e, side="left"))
        out[order[going:live]] = np.log(here[going:]) + scale[going:live]
        live = going
        if e % SCALED_BYTES == 0 and live:
            top = alpha[:live].max(axis=1)
            alpha[:live] /= top[:, None]
            scale[:live] += np.log(top)
    return out


def log_sum_long(word: bytes, prob: np.ndarray, pieces: Pieces, part: int = 1 << 16) -> np.ndarray:
    """log_sums of one long word: the pieces of a part of it are found at once, then summed byte by byte."""
    wide = pieces.lengths[-1] + 1
    alpha, scale = np.zeros((wide, prob.shape[1])), np.zeros(prob.shape[1])
    alpha[0] = 1
    for at in range(0, len(word), part):
        before = min(at, wide)
        data = np.frombuffer(word[at - before : at + part], np.uint8)
        total, down = prefix(data)
        ends, starts, found = [], [], []
        for k in pieces.lengths:
            end = np.arange(max(before + 1, k), len(data) + 1)
            p = pieces.find(substring_hashes(total, down, end - k, end))
            hit = np.flatnonzero(p >= 0)
            ends.append(end[hit])
            starts.append(end[hit] - k)
            found.append(p[hit])
        end, start, p = (np.concatenate(x) for x in (ends, starts, found))
        by = np.argsort(end, kind="stable")
        cut = np.searchsorted(end[by], np.arange(before + 1, len(data) + 2)).tolist()
        start, p = (start[by] + (at - before)) % wide, p[by]
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            e = at + i + 1
            alpha[e % wide] = (alpha[start[a:b]] * prob[p[a:b]]).sum(axis=0)
            if e % SCALED_BYTES == 0:
                top = alpha.max(axis=0)
                alpha /= top
                scale += np.log(top)
    return np.log(alpha[len(word) % wide]) + scale


def expected(lat: Lattice, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts over the words' segmentations, each word weighing as often as it occurs."""
    alpha = forward(lat, prob[:, None])[:, :, 0]
    beta = np.zeros_like(alpha)
    rows = np.arange(len(lat.length))
    beta[rows, lat.length] = 1
    z = alpha[rows, lat.length]
    counts = np.zeros(len(prob))
    for e in range(len(lat.arcs), 0, -1):
        r, s, p = lat.arcs[e - 1]
        back = beta[r, e] * prob[p]
        counts += np.bincount(p, alpha[r, s] * back * weight[r] / z[r], len(prob))
        np.add.at(beta, (r, s), back)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray
    path: str


_pieces: dict[str, Pieces] = {}
keeps(__name__, _pieces.clear)


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def cut(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words with their leading space in runs of LEARN_BYTES, and the number of the word of each run."""
    runs, of = [], []
    for i, w in enumerate(words):
        w = b" " + w
        for at in range(0, len(w), LEARN_BYTES):
            runs.append(w[at : at + LEARN_BYTES])
            of.append(i)
    return runs, np.array(of, np.int64)


def word_log_probs(words: list[bytes], model: LanguageModel) -> np.ndarray:
    out = np.zeros((len(words), len(model.languages)))
    prob, pieces = np.exp(model.log_prob), pieces_of(model.path)
    usual = [i for i, w in enumerate(words) if len(w) < LONG_BYTES]
    for at in range(0, len(usual), 10_000):
        part = usual[at : at + 10_000]
        out[part] = log_sums([b" " + words[i] for i in part], prob, pieces)
    for i in set(range(len(words))).difference(usual) if len(usual) < len(words) else ():
        out[i] = log_sum_long(b" " + words[i], prob, pieces)
    return out


def distinct_words(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Hashes and bytes of a block's distinct words, then each word's number among them and its text."""
    w = words_of([t.lower() if t else t for t in texts], NOT_LETTER)
    h, first, inverse = np.unique(w.h, return_index=True, return_inverse=True)
    return h, [w.data[a:b] for a, b in zip(w.start[first], w.end[first], strict=True)], inverse, w.doc


def train(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from the rows that aren't held out, of train_docs documents by language at most, from all their words."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id_"), F.col(lang_col).cast("string").alias("lang_"), F.col(text_col).alias("text_"))
    ids = rows.select("id_", "lang_", F.pmod(F.xxhash64("id_"), F.lit(1 << 40)).alias("place")).distinct()
    # Hashed places are even, so a few times as many ids as wanted lie below this bound, whatever the language's size.
    sizes = stored(ids.groupBy("lang_").agg(F.count("*").alias("size")), "lang-sizes")
    first = join_checked(ids, sizes, "lang_").where(F.col("place") < (1 << 40) * F.lit(4.0 * train_docs) / F.col("size"))
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("lang_").orderBy("place", "id_"))).where(F.col("n") <= train_docs)
    sample = join_checked(rows, stored(chosen.select("id_", "lang_"), "lang-sample"), ["id_", "lang_"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_"):
            for lang, part in frame.groupby("lang_"):
                _, words, inverse, _ = distinct_words(texts_in(part, "text_"))
                yield pd.DataFrame({"lang": lang, "word": words, "n": np.bincount(inverse, minlength=len(words))})

    # The words of a bounded number of documents, on the driver.
    words = in_batches(sample).mapInPandas(tidy(count, __name__), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(words["lang"].unique())
    pieces = pieces_of(path)
    columns = []
    for lang in languages:
        own = words[words["lang"] == lang].sort_values(["n", "word"], ascending=[False, True])
        runs, of = cut([bytes(w) for w in own["word"]])
        weight = own["n"].to_numpy(float)[of]
        parts = [(lattice(runs[at : at + 20_000], pieces), weight[at : at + 20_000]) for at in range(0, len(runs), 20_000)]
        prob = np.full(pieces.size, 1 / pieces.size)
        for _ in range(EM_ROUNDS):
            counts = sum((expected(lat, prob, w[order]) for (lat, order), w in parts), np.zeros(pieces.size)) + 0.05
            prob = counts / counts.sum()
        columns.append(np.log(prob))
    return LanguageModel(languages, np.stack(columns, 1) if columns else np.zeros((pieces.size, 0)), path)


class _Known:
    """Log-probabilities of the words seen so far in this worker, sorted by hash; emptied when full."""

    def __init__(self, model: LanguageModel):
        self.model, self.h, self.value = model, np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def of(self, h: np.ndarray, words: list[bytes]) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        hit = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        out = np.empty((len(h), len(self.model.languages)))
        out[hit] = self.value[at[hit]]
        miss = np.flatnonzero(~hit)
        out[miss] = word_log_probs([words[i] for i in miss], self.model)
        if len(self.h) + len(miss) > KEPT_WORDS:
            self.h, self.value = h, out
        else:
            self.h, self.value = np.concatenate([self.h, h[miss]]), np.concatenate([self.value, out[miss]])
            order = np.argsort(self.h)
            self.h, self.value = self.h[order], self.value[order]
        return out


def posteriors(texts: list[str | None], model: LanguageModel, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and its posterior over FULL_WORDS words, `und` and 0 for texts without a letter."""
    n = len(texts)
    letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    if not model.languages or not letters.any():
        return np.full(n, "und", object), np.zeros(n)
    h, words, inverse, doc = distinct_words([t if ok else None for t, ok in zip(texts, letters, strict=True)])
    logs = known.of(h, words)
    total = np.stack([np.bincount(doc, logs[inverse, c], n) for c in range(len(model.languages))], 1)
    count = np.bincount(doc, minlength=n)
    total *= (np.minimum(count, FULL_WORDS) / np.maximum(count, 1))[:, None]
    post = np.exp(total - total.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    return np.where(letters, np.array(model.languages, object)[post.argmax(1)], "und"), np.where(letters, post.max(1), 0.0)


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, and score, the posterior of the predicted language over FULL_WORDS words."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(model)
        for frame in blocks(frames, "text_"):
            lang, score = posteriors(texts_in(frame, "text_"), model, known)
            yield pd.DataFrame({id_col: frame["id_"], "lang_pred": lang, "score": score})

    return map_frames(in_batches(df).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), run, f"`{id_col}` {kind}, lang_pred string, score double", __name__)


def accepted(df: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known with a posterior of least or more."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model)
        for batch in batches:
            frame = pd.DataFrame({"text_": pd.Series(batch.column(at).to_pylist(), dtype=object)})
            parts = [posteriors(texts_in(f, "text_"), model, known) for f in blocks([frame], "text_")]
            keep = np.concatenate([np.zeros(0, bool), *((lang != "und") & (score >= least) for lang, score in parts)])
            yield batch.filter(pa.array(keep))

    return in_batches(df).mapInArrow(tidy(run, __name__), df.schema)
