"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Statistics come from the bytes, words and lines of the whole text. Class means and covariances are sums of
moments over all labelled training documents, combined in Spark; each class covariance shrinks to the pooled
one and to its mean variance, and its Cholesky factor is kept, so a score needs triangular products only:
the difference of the classes' log densities, by Mahalanobis distance and log determinant, plus log priors.

Null texts count as empty. Labels that are null or neither 0 nor 1 are left out, repeated ones count once.
With labels of one class only every score is that class; with none it is 0.5. Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, in_batches, map_frames, shingles_of, stored, texts_in, words_of

#: Share of the pooled covariance, and of the mean variance as a multiple of the identity.
POOL, RIDGE = 0.2, 0.02

FEATURES = ("bytes", "words", "lines", "letters", "upper", "digits", "symbols", "stops", "wide", "word_mean", "word_sd", "symbol_ends", "symbol_words", "short_words", "distinct", "line_repeat", "line_words", "gram_repeat", "top_word")
_BYTES = np.arange(256)
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STOP = np.isin(_BYTES, [ord(c) for c in ".,"])
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT & ~_STOP
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: items, distinct items, and how often the most frequent one occurs."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(first)
    top = np.zeros(n)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(doc, minlength=n), np.bincount(d[at], minlength=n), top


def _logit(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds of a share, with half a case added on both sides."""
    return np.log((hits + 0.5) / (np.maximum(total - hits, 0) + 0.5))


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES by text: counts as logs, shares as log odds."""
    n = len(texts)
    w = words_of(texts)
    raw = np.frombuffer(w.data, np.uint8)
    size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    doc = np.repeat(np.arange(n), size + 1)
    of = lambda table: np.bincount(doc, table[raw], n)
    letters, upper, digits, symbols, stops = (of(t) for t in (_LETTER, _UPPER, _DIGIT, _SYMBOL, _STOP))
    wide = of(_BYTES >= 128)
    count = np.bincount(w.doc, minlength=n)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, n) / np.maximum(count, 1)
    sd = np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / np.maximum(count, 1) - mean**2, 0))
    last, first = _SYMBOL[raw[w.end - 1]], _SYMBOL[raw[w.start]]
    ends = np.bincount(w.doc, last, n)
    alone = np.bincount(w.doc, first & last & (length <= 2), n)
    short = np.bincount(w.doc, length <= 3, n)
    _, distinct, top = _repeats(w.doc, w.h, n)
    lines = words_of(texts, _NEWLINE)
    n_lines, distinct_lines, _ = _repeats(lines.doc, lines.h, n)
    grams, distinct_grams, _ = _repeats(*shingles_of(w, 3), n)
    return np.stack([np.log1p(size), np.log1p(count), np.log1p(n_lines), _logit(letters, size), _logit(upper, letters), _logit(digits, size), _logit(symbols, size), _logit(stops, size), _logit(wide, letters), np.log1p(mean), np.log1p(sd), _logit(ends, count), _logit(alone, count), _logit(short, count), _logit(distinct, count), _logit(n_lines - distinct_lines, n_lines), np.log1p(count / np.maximum(n_lines, 1)), _logit(grams - distinct_grams, grams), _logit(top, count)], axis=1)


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats, an array of FEATURES, for every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text_"):
            yield pd.DataFrame({id_col: frame["id_"], "stats": list(statistics(texts_in(frame, "text_")))})

    return map_frames(in_batches(df).select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), run, f"`{id_col}` {kind}, stats array<double>")


@dataclass
class QDA:
    """Means, inverse Cholesky factors and log determinants of the two classes in standardised statistics."""

    shift: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    inverse_factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.shift) / self.scale
        logs = []
        for c in (0, 1):
            y = (z - self.mean[c]) @ self.inverse_factor[c].T
            logs.append(self.log_prior[c] - 0.5 * (y * y).sum(axis=1) - 0.5 * self.log_det[c])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(n: np.ndarray, total: np.ndarray, outer: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> QDA | float:
    """The model from counts, sums and sums of outer products by class; a constant score where a class is missing."""
    if not n.sum():
        return 0.5
    if not n.all():
        return float(n[1] > 0)
    shift = total.sum(0) / n.sum()
    spread = np.diagonal(outer.sum(0)) / n.sum() - shift**2
    scale = np.sqrt(np.where(spread > 1e-12, spread, 1))
    mean = (total / n[:, None] - shift) / scale
    cov = []
    for c in (0, 1):
        m = total[c] / n[c]
        cov.append((outer[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors, log_det = [], []
    for c in (0, 1):
        s = (1 - pool) * cov[c] + pool * pooled
        s = (1 - ridge) * s + (ridge * max(np.trace(s) / len(s), 1e-6) + 1e-9) * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diagonal(factor)).sum())
    return QDA(shift, scale, mean, np.stack(factors), np.array(log_det), np.log(n / n.sum()))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QDA | float:
    """Fit to all labelled documents that aren't held out; moments are summed by position, so the driver
    gets as many numbers as two covariances have."""
    k = len(FEATURES)
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("label_")).distinct()
    rows = stats.where(~held_out(id_col)).select(F.col(id_col).alias("id_"), "stats").join(known, "id_").select("label_", "stats")

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + k + k * k))
        for frame in frames:
            for c in (0, 1):
                part = frame.loc[frame["label_"] == c, "stats"]
                if len(part):
                    x = np.stack(part.to_numpy())
                    sums[c] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], sums.shape[1]), "at": np.tile(np.arange(sums.shape[1]), 2), "v": sums.ravel()})

    got = rows.mapInPandas(moments, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((2, 1 + k + k * k))
    sums[got["label"], got["at"]] = got["v"]
    return fit(sums[:, 0], sums[:, 1 : 1 + k], sums[:, 1 + k :].reshape(2, k, k))


def classify(stats: DataFrame, model: QDA | float, id_col: str = "doc_id") -> DataFrame:
    kind = stats.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = np.full(len(frame), model) if isinstance(model, float) or not len(frame) else model.score(np.stack(frame["stats"].to_numpy()))
            yield pd.DataFrame({id_col: frame[id_col], "score": score, "predicted": (score >= 0.5).astype(int)})

    return map_frames(stats.select(id_col, "stats"), run, f"`{id_col}` {kind}, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id, held_out, score from 0 to 1 (higher: label 1 likelier), predicted."""
    stats = stored(with_statistics(docs, id_col, text_col), "quality-stats")
    scored = classify(stats, train(stats, labels, id_col, label_col), id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
