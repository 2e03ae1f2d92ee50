"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled of quality 1, at most POSITIVE_ROWS of them; unlabelled web text is all of the
documents, good and bad. No negative label is used. With the class prior pi (the share of positives in the unlabelled
text) the risk pi R+(f) + max(0, R-unlabelled(f) - pi R-positive(f)) is minimised: the non-negative unbiased risk (Kiryo
et al., 2017). f is linear in the features below, the loss is the sigmoid, the descent is Adam in numpy.

Everything about the unlabelled text is counted over all documents, in whole numbers, so that the result doesn't depend
on how the table is cut into tasks. One pass gives the features' means and scales. One gives CELLS cells of like documents (signs of fixed
random projections, and how far a document is from the mean), of each the number of documents and the mean features: the
descent takes a cell as that many documents. One gives the histogram of a first classifier's scores, of positives
against unlabelled text, each document scored by a classifier that hasn't seen it (FOLDS folds by hashed doc_id).
Positives are scored out of fold as well. There is one rule for tables of any size.

pi is estimated from that histogram: of all thresholds the least ratio of the share of unlabelled text above to that of
positives above, with a confidence term, bounds it from above (best bin estimation, Garg et al., 2021). A document is
kept if its score is at least the threshold: 0, or, where less, the score that all positives reach out of fold but for
LOSS of them and SPARE more: an odd or wrongly labelled positive sets no threshold. (Out of fold they are harder than
for the classifier that has seen them.)

Features: shares of character classes, of words that repeat, of lines that repeat, of words that end in symbols; word
and line lengths; compression by repeated neighbours; and the shares of class trigrams (letters, capitals, digits,
spaces, kinds of symbols). They don't depend on the language's words. All are of the whole text.

Null and empty texts, and those without a word, are rejected with score null. Without positives, or with only one,
everything else is kept with score null. Rows without a doc_id are left out by score(), and kept by keep_good() if their text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, documents, small_batches
from .textvec import Words, column_bytes, slices

POSITIVE_ROWS, LOSS, SPARE, FOLDS, BITS, STEPS, BATCH = 3000, 0.002, 2, 5, 6, 600, 512
#: Cells: signs of BITS projections, and four distances from the mean.
CELLS = 4 << BITS
#: Features are counted in these parts; scores in bins of this width, from -RANGE to RANGE.
#: Weight decay: few positives would make out-of-fold scores wild without it.
L2 = 0.01
PARTS, BIN, RANGE = 1 << 20, 0.01, 30.0
#: Character classes: 0 lower case and non-ASCII, 1 capital, 2 digit, 3 space, 4 line end, 5 . , and the like, 6 |, 7 the rest.
_CLASS = np.array([4 if b == 10 else 3 if b in b" \t\r\f" else 2 if chr(b).isdigit() and b < 128 else 1 if 65 <= b <= 90 else 0 if b >= 128 or 97 <= b <= 122 else 5 if chr(b) in ".,;:'\"()-?" else 6 if chr(b) == "|" else 7 for b in range(256)], np.uint8)
KINDS, DENSE = 8, 14
SIZE = DENSE + KINDS**3


def _features(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows, SIZE) features and the number of words of each row."""
    rows, n = len(offsets) - 1, len(data)
    at = offsets - offsets[0]
    length = np.diff(at)
    out = np.zeros((rows, SIZE), np.float32)
    row = np.repeat(np.arange(rows), length)
    kind = _CLASS[data].astype(np.int64)
    if n >= 3:
        code = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
        same = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][same] * KINDS**3 + code[same], minlength=rows * KINDS**3).reshape(rows, -1)
        out[:, DENSE:] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    kinds = np.bincount(row * KINDS + kind, minlength=rows * KINDS).reshape(rows, KINDS) / np.maximum(length, 1)[:, None]
    out[:, :6] = kinds[:, [1, 2, 3, 4, 6, 7]]
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes, first, end, ends = words(folded, offsets)
    counts = np.diff(ends)
    wrow = np.repeat(np.arange(rows), counts)
    many = np.maximum(counts, 1)
    share = lambda x: np.bincount(wrow, x, minlength=rows) / many
    out[:, 6] = np.log1p(share(end - first)) / 4
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (wrow[1:] == wrow[:-1])
    out[:, 7] = share(again)
    # Words seen before among the last 64 distinct places: repeats of neighbours, in any length of text alike.
    order = np.lexsort((hashes, wrow))
    gap = np.full(len(hashes), 1 << 30)
    twin = (hashes[order][1:] == hashes[order][:-1]) & (wrow[order][1:] == wrow[order][:-1])
    gap[order[1:][twin]] = order[1:][twin] - order[:-1][twin]
    long = (end - first) >= 5
    longs = np.maximum(np.bincount(wrow, long, minlength=rows), 1)
    out[:, 8] = np.bincount(wrow, long & (gap < 64), minlength=rows) / longs
    out[:, 9] = np.bincount(wrow, long & (gap < 1 << 29), minlength=rows) / longs
    after = np.minimum(end - offsets[0], n - 1)
    tail = kind[after] if n else after
    out[:, 10] = share((tail >= 6) & (end - offsets[0] < n)) if n else 0
    upper = (data >= 65) & (data <= 90)
    second = np.minimum(first - offsets[0] + 1, n - 1)
    out[:, 11] = share(upper[second] & (end - first > 1)) if n else 0
    lines = np.bincount(row, kind == 4, minlength=rows) + 1
    out[:, 12] = np.log1p(counts / lines) / 6
    out[:, 13] = np.log1p(counts) / 10
    return out, counts


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, share: np.ndarray, prior: float | None, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias, from positives p and cells u with their shares of the unlabelled text. With a prior by non-negative risk; without, positives against unlabelled by logistic loss."""
    rng, dim = np.random.RandomState(seed), p.shape[1] + 1
    p, u = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for k in range(1, steps + 1):
        xp = p[rng.randint(0, len(p), BATCH)]
        sp, su = _sigmoid(xp @ w), _sigmoid(u @ w)
        if prior is None:
            g = -xp.T @ (1 - sp) / len(xp) + u.T @ (share * su)
        else:
            # sigmoid loss: l(z) = sigmoid(-z) for positives, sigmoid(z) for negatives
            dp, du = xp.T @ (sp * (1 - sp)) / len(xp), u.T @ (share * su * (1 - su))
            g = -prior * dp + du - prior * dp if share @ su >= prior * sp.mean() else prior * dp - du
        g = g + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def bins(scores: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(scores, -RANGE, RANGE) + RANGE) / BIN).astype(np.int64)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled text, from out-of-fold scores: bins of positives, counts by bin of unlabelled text."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.9, 91), method="lower"))
    above, n = np.cumsum(unlabelled[::-1])[::-1], unlabelled.sum()
    ratio = []
    for c in cuts:
        qp, qu = (positive >= c).mean(), above[c] / n
        ratio.append(((qu + np.sqrt(np.log(40) / (2 * n)) + np.sqrt(np.log(40) / (2 * len(positive)))) / qp, qu / qp))
    return float(np.clip(min(ratio)[1], 0.01, 0.99))


#: Of (features, folds) of some documents: a key for each, and numbers to add up by key (none: only count).
Keyed = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]
#: Key -> (documents, sums in PARTS).
Sums = dict[int, tuple[int, np.ndarray]]


def _moments(x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(x), np.int64), np.hstack([x, x * x])


def _cells(mean: np.ndarray, scale: np.ndarray, typical: float) -> Keyed:
    turn = np.random.RandomState(41).randn(SIZE, BITS)

    def keyed(x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - mean) / scale
        far = np.searchsorted([0.7, 1.0, 1.5], np.sqrt((z * z).sum(1)) / typical)
        return (fold * 4 + far << BITS) + ((z @ turn[: x.shape[1]] > 0) << np.arange(BITS)).sum(1), x

    return keyed


def _histogram(models: list[Model]) -> Keyed:
    def keyed(x: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, None]:
        scores = np.stack([m.score(x) for m in models])[fold, np.arange(len(x))] if len(x) else np.zeros(0)
        return bins(scores), None

    return keyed


def add(sums: Sums, keys: np.ndarray, values: np.ndarray | None) -> None:
    """Adds documents to sums; whole numbers, so in any order."""
    order = np.argsort(keys, kind="stable")
    known, first, n = np.unique(keys[order], return_index=True, return_counts=True)
    totals = np.zeros((len(known), 0), np.int64) if values is None or not len(known) else np.add.reduceat(np.rint(values[order].astype(np.float64) * PARTS).astype(np.int64), first, axis=0)
    for k, c, t in zip(known.tolist(), n.tolist(), totals):
        sums[k] = (sums[k][0] + c, sums[k][1] + t) if k in sums else (c, t)


def train(positive: np.ndarray, folds: np.ndarray, gathered: Callable[[Keyed], Sums], seed: int = 3) -> Model | None:
    """From the features and folds of positives, and what gathered(keyed) adds up over all documents."""
    if len(set(folds.tolist())) < 2:  # none are left to score out of fold
        return None
    moments = gathered(_moments)
    if not moments:
        return None
    n, total = moments[0]
    mean, square = (total[: total.size // 2] / PARTS / n, total[total.size // 2 :] / PARTS / n)
    variance = np.maximum(square - mean * mean, 0)
    scale = np.sqrt(variance) + 0.01
    cells = sorted(gathered(_cells(mean, scale, float(np.sqrt((variance / scale**2).sum())) + 1e-9)).items())
    size = np.array([c for _, (c, _) in cells], float)
    p, u = (positive - mean) / scale, (np.stack([t for _, (_, t) in cells]) / PARTS / size[:, None] - mean) / scale
    where = np.array([k // CELLS for k, _ in cells])

    def model(apart: int, prior: float | None, steps: int) -> Model:
        """Of what isn't in the fold apart; where that is nothing, of all."""
        own = where != apart if (where != apart).any() else where >= 0
        share = size[own] / size[own].sum()
        fit = folds != apart if (folds != apart).any() else folds >= 0
        return Model(*_descend(p[fit], u[own], share, prior, seed, steps), mean, scale, prior or 0.0, 0.0)

    first = [model(k, None, STEPS // 4) for k in range(FOLDS)]
    out = lambda models: np.stack([m.score(positive) for m in models])[folds, np.arange(len(positive))]
    counts = np.zeros(int(2 * RANGE / BIN) + 1)
    for k, (c, _) in gathered(_histogram(first)).items():
        counts[k] = c
    prior = class_prior(bins(out(first)), counts)
    held = out([model(k, prior, STEPS) for k in range(FOLDS)])
    final = model(-1, prior, STEPS)
    final.threshold = min(0.0, float(np.sort(held)[min(len(held) - 1, int(LOSS * len(held)) + SPARE)]))
    return final


def _text_features(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that have a word, and their features."""
    words = Words()
    for batch in batches:
        data, offsets = column_bytes(batch.column(column))
        for lo, hi in slices(offsets, 1 << 19, 512):
            x, counts = _features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], words)
            yield batch.slice(lo, hi - lo).filter(pa.array(counts > 0)), x[counts > 0]


def text_features(texts: list[str]) -> np.ndarray:
    """Features of those texts that have a word."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    return np.concatenate([np.zeros((0, SIZE), np.float32), *(x for _, x in _text_features(iter([batch]), 0))])


def _gathered(rows: DataFrame, keyed: Keyed) -> Sums:
    """Of rows (fold, text). Tasks add up what they read; of each key the tasks' sums meet in one task."""

    def packed(sums: Sums) -> Iterator[pa.RecordBatch]:
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tobytes() for k in keys], pa.binary())], names=["key", "n", "sums"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch, x in _text_features(batches, 1):
            add(sums, *keyed(x, batch.column(0).to_numpy()))
        yield from packed(sums)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            for k, c, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = np.frombuffer(t, np.int64)
                sums[k] = (sums[k][0] + c, sums[k][1] + t) if k in sums else (c, t)
        yield from packed(sums)

    schema = "key BIGINT, n BIGINT, sums BINARY"
    return {r["key"]: (r["n"], np.frombuffer(r["sums"], np.int64)) for r in rows.mapInArrow(each, schema).repartition(8, "key").mapInArrow(merged, schema).collect()}


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS) -> Model | None:
    """None if there are no two positives. Of a doc_id with several labels one of quality 1 suffices."""
    texts = documents(docs).where("text IS NOT NULL")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    good = bounded_sample(labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", positive_rows)
    # One text of each: of rows that repeat a doc_id the least.
    trusted = texts.join(F.broadcast(good), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _text_features(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "fold", "x"])

    rows = sorted(trusted.select("doc_id", fold, "text").mapInArrow(features, "doc_id BIGINT, fold INT, x BINARY").collect())
    if not rows:
        return None
    positive = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    return train(positive, np.array([r["fold"] for r in rows]), partial(_gathered, texts.select(fold, "text")))


def _score(model: Model):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in slices(offsets, 1 << 19, 512):
                x, counts = _features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], words)
                score = np.where(counts > 0, model.score(x), -np.inf)
                kept = score >= model.threshold
                shown = pa.array(np.where(counts > 0, np.round(score, 6), 0.0), mask=counts == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), shown, pa.array(kept)], names=["doc_id", "score", "keep"])

    return each


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, keep."""
    if model is None:
        return documents(docs).select("doc_id", F.lit(None).cast("double").alias("score"), F.coalesce(F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"), F.lit(False)).alias("keep"))
    return documents(docs).mapInArrow(_score(model), "doc_id BIGINT, score DOUBLE, keep BOOLEAN")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are kept, with all columns: one pass over them, no join."""
    text = F.col("text").cast("string")
    if model is None:
        return docs.where(text.rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    keeps = _score(model)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(column: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), pa.array(column, pa.string())], names=["doc_id", "text"])
        return pd.Series([x for b in keeps(iter([batch])) for x in b.column(2).to_pylist()], dtype=bool)

    return docs.where(kept(F.coalesce(text, F.lit(""))))
