"""Quality classifier: supervised subword embeddings.

A document's features are its white-space words and their byte n-grams (3 and
4, word edges included), hashed to 2**15 buckets, plus one bucket that counts
words equal to the word before them.  Every bucket has a learned vector; a
document is the mean of its features' vectors, a linear layer and a softmax
give the class probabilities.  Vectors and layer are trained together by numpy
stochastic gradient descent with a falling rate, over a bounded sample of
labelled rows (``sample``).  Scoring is one pass over all rows and whole
texts.

The softmax over two classes depends on the difference of the two rows of the
layer only, so scoring needs one number per bucket: its vector times that
difference.  A null or empty text has the zero vector: its score comes from the
layer's bias.  Without labelled rows of both kinds the model is the constant
share of label 1.  Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import IS_NOT_SPACE, U64, blocks, ngrams, rows_of, runs, sorted_unique, span_hash
from quire.llm.frames import documents_of, labelled_part, remainder, stored

BITS = 15
SAME = 0  # bucket of "equal to the word before"
SIZES = (3, 4)
SAMPLE = 4000
WIDTH = 16
UPDATES = 48_000  # documents seen in training; a small sample is seen more often
RATE = 0.5
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


@dataclass
class QualityModel:
    vectors: np.ndarray  # buckets x width
    layer: np.ndarray    # 2 x width
    bias: np.ndarray     # 2

    def bucket_scores(self) -> np.ndarray:
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32)


def _features(data: np.ndarray, offsets: np.ndarray):
    """(rows, buckets) of every feature occurrence of a block."""
    starts, ends, rows = runs(data, offsets, IS_NOT_SPACE)
    words = span_hash(data, starts, ends)
    out_rows, out = [rows], [(words >> U64(64 - BITS)).astype(np.int64)]
    same = np.flatnonzero((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])) + 1
    out_rows.append(rows[same])
    out.append(np.full(len(same), SAME, np.int64))
    for n in SIZES:
        h, at = ngrams(data, offsets, n)
        out_rows.append(rows_of(offsets, at))
        out.append((h >> np.uint32(32 - BITS)).astype(np.int64))
    return out_rows, out


def _vectors(batches):
    """Label, buckets and their counts of each row."""
    for batch in batches:
        y = np.asarray(batch.column("y"))
        for first, data, offsets in blocks(batch.column("text")):
            n = len(offsets) - 1
            rows, buckets = (np.concatenate(x) for x in _features(data, offsets))
            keys = np.sort((rows << BITS) | buckets)
            unique = sorted_unique(keys)
            count = np.diff(np.r_[np.searchsorted(keys, unique), len(keys)])
            cut = pa.array(np.searchsorted(unique >> BITS, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(y[first:first + n]),
                 pa.ListArray.from_arrays(cut, pa.array(unique & ((1 << BITS) - 1), pa.int32())),
                 pa.ListArray.from_arrays(cut, pa.array(count, pa.int32()))], ["y", "buckets", "counts"])


def _sgd(index, weight, cut, y, seed=1, batch=16) -> QualityModel:
    """Stochastic gradient descent on the mean-of-vectors softmax model."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    n, steps = len(y), 0
    epochs = -(-UPDATES // n)
    total = epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            pick = order[i:i + batch]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = np.stack([weight[cut[k]:cut[k + 1]] @ vectors[index[cut[k]:cut[k + 1]]] for k in pick])
            z = mean @ layer.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ layer
            layer -= rate / len(pick) * (p.T @ mean)
            bias -= rate / len(pick) * p.sum(0)
            for k, g in zip(pick, back):  # a document's buckets are distinct: plain indexed updates
                s = slice(cut[k], cut[k + 1])
                vectors[index[s]] -= rate * weight[s, None] * g
    return QualityModel(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT,
        sample: int = SAMPLE) -> QualityModel:
    part = stored(labelled_part(docs, labels, label, folds, held_out, sample).select("text", "y")
                  .mapInArrow(_vectors, "y int, buckets array<int>, counts array<int>"))
    data = part.orderBy(F.xxhash64("buckets"), "y").toArrow().combine_chunks()  # at most ``sample`` rows
    y = np.asarray(data.column("y")).astype(np.int64)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return QualityModel(np.zeros((1 << BITS, WIDTH), np.float32), np.zeros((2, WIDTH), np.float32),
                            np.array([0.0, np.log(share / (1 - share))], np.float32))
    buckets, counts = (data.column(c).combine_chunks() for c in ("buckets", "counts"))
    cut = np.asarray(buckets.offsets)
    index, weight = np.asarray(buckets.flatten()), np.asarray(counts.flatten()).astype(np.float32)
    length = np.diff(cut)
    sums = np.bincount(np.repeat(np.arange(len(y)), length), weight, len(y))
    weight /= np.repeat(np.maximum(sums, 1), length).astype(np.float32)
    return _sgd(index, weight, cut, y)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and ``score`` of every row."""
    value = docs.sparkSession.sparkContext.broadcast(model.bucket_scores())  # 128 KB, whatever the input
    bias = float(model.bias[1] - model.bias[0])

    def run(batches):
        v = value.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, data, offsets in blocks(batch.column("text")):
                n = len(offsets) - 1
                total, count = np.zeros(n), np.zeros(n)
                for rows, buckets in zip(*_features(data, offsets)):
                    total += np.bincount(rows, v[buckets].astype(float), n)
                    count += np.bincount(rows, minlength=n)
                z = total / np.maximum(count, 1) + bias
                out[first:first + n] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    source = documents_of(docs)
    return source.mapInArrow(run, source.select("doc_id").withColumn("score", F.lit(0.0)).schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
