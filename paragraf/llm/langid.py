"""Language identification with averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2, 3 and 4 bytes of the lower-cased text that have no ASCII separator inside (one may stand at
either end and marks a word's edge). Each is hashed to a bucket with a vector of DIM numbers; the mean vector of a
text goes through a linear softmax. Vectors and softmax are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows: SAMPLE_ROWS rows. Every fifth of them is held out, the first among them. Training
takes STEPS steps of a row, of few rows as of many.

Rejection is calibrated on the held-out rows. A temperature makes the probabilities honest; a text is rejected
(accepted = false, lang as guessed) if its probability is below that of all but REJECT of the held-out rows, or if
the share of its subwords that training saw is below that of all but REJECT of them.

For scoring, vectors and softmax are folded into one table of a number for each bucket and language, so a text costs
one lookup for each subword. Null and empty texts and those without a subword get lang null, probability 0 and
accepted false. So do all texts where there is nothing to learn from: no rows to train on that have subwords, or rows of
one language only. Equally probable languages: the first by name. Rows without a doc_id are left out; repeated rows are
answered each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, documents
from .textvec import column_bytes, slices

SIZES, BUCKET_BITS, DIM, SAMPLE_ROWS, REJECT = (2, 3, 4), 15, 16, 3000, 0.002
#: Steps that training takes, one row each.
STEPS = 15_000
BUCKETS = len(SIZES) << BUCKET_BITS
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, row after row, and the rows' offsets."""
    n, base = len(data), offsets[0]
    rows, found, where = offsets - base, [], []
    gap = _SEPARATOR[data]
    code = data.astype(np.uint32)
    for k, size in enumerate(SIZES):
        if n < size:
            break
        acc = np.zeros(n - size + 1, np.uint32)
        for j in range(size):
            acc = (acc << np.uint32(8)) | code[j : n - size + 1 + j]
        ok = np.ones(n - size + 1, bool)
        for j in range(1, size - 1):
            ok &= ~gap[j : n - size + 1 + j]
        if size == 2:
            ok &= ~(gap[:-1] & gap[1:])
        for j in range(1, size):
            cut = rows[1:-1] - j
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        at = np.flatnonzero(ok)
        found.append(((acc[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + (k << BUCKET_BITS))
        where.append(np.searchsorted(at, rows))
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
    return found, where


def _row_buckets(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    found, _ = subwords(data, np.array([0, len(data)]))
    return np.concatenate(found) if isinstance(found, list) else found


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, languages), float32
    bias: np.ndarray
    seen: np.ndarray  # of each bucket: whether training had it
    temperature: float = 1.0
    least_probability: float = 0.0
    least_seen: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _scores(model: Model, buckets: np.ndarray) -> tuple[np.ndarray, float]:
    return model.table[buckets].mean(0) + model.bias, float(model.seen[buckets].mean())


def train(rows: list[tuple[str, str]], count: int = STEPS, rate: float = 0.5, seed: int = 1) -> Model | None:
    """rows: (lang, text). Stochastic gradient descent, one document a step; None if there is nothing to learn."""
    langs = sorted({lang for lang, _ in rows})
    data = [(langs.index(lang), b) for lang, text in rows if len(b := _row_buckets(text))]
    rng = np.random.RandomState(seed)
    rng.shuffle(order := np.arange(len(data)))
    held, fit = [data[i] for i in order[::5]], [data[i] for k, i in enumerate(order) if k % 5]
    if len({y for y, _ in fit}) < 2:
        return None
    # a text's mean vector is its distinct buckets' vectors weighted by their shares
    compact = [(y, *(lambda u, c: (u, (c / c.sum()).astype(np.float32)))(*np.unique(b, return_counts=True))) for y, b in fit]
    emb = (rng.randn(BUCKETS, DIM) * 0.1).astype(np.float32)
    out, bias = (rng.randn(DIM, len(langs)) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32)
    k = 0
    while k < count:
        for i in rng.permutation(len(compact))[: count - k]:
            y, u, share = compact[i]
            step = rate * (1 - k / count)
            k += 1
            mean = share @ emb[u]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * p
            emb[u] -= (step * len(u) ** 0.5 * share)[:, None] * back
    seen = np.zeros(BUCKETS, bool)
    for _, u, _ in compact:
        seen[u] = True
    model = Model(langs, (emb @ out).astype(np.float32), bias, seen)
    scored = [_scores(model, b) for _, b in held]
    logits, truth = np.array([s for s, _ in scored]), np.array([y for y, _ in held])
    losses = {}
    for t in np.geomspace(0.05, 5, 60):
        model.temperature = float(t)
        losses[float(t)] = -np.log(model.probabilities(logits)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = min(losses, key=losses.get)
    model.least_probability = float(np.quantile(model.probabilities(logits).max(1), REJECT, method="lower"))
    model.least_seen = float(np.quantile([s for _, s in scored], REJECT, method="lower"))
    return model


def _identify(model: Model):
    langs = pa.array([*model.langs, None], pa.string())
    k = len(model.langs)
    wide = np.zeros((BUCKETS, k + 1), np.float32)
    wide[:, :k], wide[:, k] = model.table, model.seen

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in slices(offsets, 1 << 19):
                sums, counts = np.zeros((hi - lo, k + 1)), np.zeros(hi - lo)
                found, where = subwords(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                for b, at in zip(found, where) if isinstance(found, list) else ():
                    n = np.diff(at)
                    full = np.flatnonzero(n)
                    if len(full):
                        sums[full] += np.add.reduceat(wide[b], at[:-1][full], axis=0)
                    counts += n
                means = sums / np.maximum(counts, 1)[:, None]
                p = model.probabilities(means[:, :k] + model.bias)
                best = np.where(counts > 0, p.argmax(1), k)
                top = np.where(counts > 0, p.max(1), 0.0)
                ok = (counts > 0) & (top >= model.least_probability - 1e-6) & (means[:, k] >= model.least_seen - 1e-6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), langs.take(pa.array(best)), pa.array(top), pa.array(ok)], names=["doc_id", "lang", "probability", "accepted"])

    return each


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Trained on at most rows rows of docs with doc_id, lang and text; None if there is nothing to learn."""
    labelled = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = [(r["lang"], r["text"]) for r in bounded_sample(labelled, "doc_id", rows).collect() if r["text"] is not None]
    return train(sample) if sample else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, probability, accepted."""
    texts = documents(docs)
    if model is None:
        return texts.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"))
    return texts.withColumn("text", F.lower("text")).mapInArrow(_identify(model), "doc_id BIGINT, lang STRING, probability DOUBLE, accepted BOOLEAN")
