"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of 3 to 5 lower-cased characters,
hashed to 2**20 buckets.  Bucket counts per label are summed in Spark; the
log-count ratio r of a bucket is the naive Bayes weight of its presence.  The
``features`` buckets with the largest G statistic stay (a fixed number, so
that the model has a fixed size), and a logistic regression is fitted over the
presence vectors scaled by r.  Scoring is one pass over all texts.

Learning uses a bounded sample of labelled rows (``sample``); scores cover
every row and whole texts.  A null or empty text has no features: its score is
the model's intercept.  Without a labelled row of either kind the model is
constant (the share of label 1, or 0).  Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import mix32, row_blocks, sorted_unique, text_buffers
from quire.llm.frames import documents_of, labelled_part, remainder, stored, table

SIZES = (3, 4, 5)
BITS = 20
SAMPLE = 8000
FEATURES = 8192
MIN_DOCS = 3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


@dataclass
class ToxicModel:
    weights: np.ndarray  # per bucket: regression weight times log-count ratio, 0 if not selected
    intercept: float


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts in one array, and offsets."""
    low = [t.lower() for t in texts]
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=offsets[1:])
    return np.frombuffer("".join(low).encode("utf-32-le"), np.uint32), offsets


def _hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character (uint32)."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    h = np.full(m, n, np.uint32)
    for i in range(n):
        h *= np.uint32(0x01000193)
        h += chars[i:i + m]
    return mix32(h) >> np.uint32(32 - BITS)


def _text_blocks(column: pa.Array):
    _, offsets = text_buffers(column)
    for i, j in row_blocks(offsets):
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]


def _count(batches):
    """Documents per bucket and label of a task's rows."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    last = np.empty(1 << BITS, np.int64)
    for batch in batches:
        y = np.asarray(batch.column("y"))
        for first, texts in _text_blocks(batch.column("text")):
            chars, offsets = _characters(texts)
            for k in range(len(texts)):
                own = chars[offsets[k]:offsets[k + 1]]
                h = np.concatenate([_hashes(own, n) for n in SIZES])
                order = np.arange(len(h))
                last[h] = order  # one position of each distinct bucket stays
                counts[y[first + k]][h[last[h] == order]] += 1
    used = np.flatnonzero(counts.sum(0))
    for i in range(0, len(used), 100_000):
        u = used[i:i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(counts[1][u]), pa.array(counts[0][u])],
                                         ["bucket", "pos", "neg"])


def _hits(column: pa.Array, selected: np.ndarray):
    """(first row, number of rows, rows, buckets): the distinct selected
    buckets of each row of a block, in row order."""
    for first, texts in _text_blocks(column):
        chars, offsets = _characters(texts)
        keys = []
        for n in SIZES:
            h = _hashes(chars, n)
            at = np.flatnonzero(selected[h])
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[row + 1]
            keys.append((row[inside] << BITS) | h[at[inside]].astype(np.int64))
        keys = sorted_unique(np.concatenate(keys))
        yield first, len(texts), keys >> BITS, keys & ((1 << BITS) - 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT,
        sample: int = SAMPLE, features: int = FEATURES, ridge: float = 0.5, rounds: int = 300) -> ToxicModel:
    part = stored(labelled_part(docs, labels, label, folds, held_out, sample))
    size = {r["y"]: r["n"] for r in part.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        share = min(max(n_pos / max(1, n_pos + n_neg), 1e-6), 1 - 1e-6)
        return ToxicModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    pos, neg = F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    p, q = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("neg") + 0.5) / (n_neg + 1.0)
    both = (F.col("pos") + F.col("neg") + 1.0) / (n_pos + n_neg + 2.0)
    g = (n_pos * (p * F.log(p / both) + (1 - p) * F.log((1 - p) / (1 - both)))
         + n_neg * (q * F.log(q / both) + (1 - q) * F.log((1 - q) / (1 - both))))
    top = (part.select("text", "y").mapInArrow(_count, "bucket long, pos long, neg long")
           .groupBy("bucket").agg(pos, neg).where(F.col("pos") + F.col("neg") >= MIN_DOCS)
           .select("bucket", F.log(p / q).alias("ratio"), g.alias("g"))
           .orderBy(F.desc("g"), "bucket").limit(features).toPandas())
    selected = np.zeros(1 << BITS, bool)
    selected[top.bucket.to_numpy()] = True

    def rows(batches):
        for batch in batches:
            y = np.asarray(batch.column("y"))
            for first, n, row, bucket in _hits(batch.column("text"), selected):
                cut = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[first:first + n]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32()))],
                    ["y", "buckets"])

    data = part.select("text", "y").mapInArrow(rows, "y int, buckets array<int>").toArrow()
    column = {b: i for i, b in enumerate(top.bucket)}
    place = np.zeros(1 << BITS, np.int32)
    place[list(column)] = list(column.values())
    ratio = top.ratio.to_numpy()
    buckets = data.column("buckets").combine_chunks()
    length = np.diff(np.asarray(buckets.offsets))
    cols = place[np.asarray(buckets.flatten())]
    y = np.asarray(data.column("y")).astype(float)
    del data, buckets
    w, b = _logistic(np.repeat(np.arange(len(y), dtype=np.int32), length), cols, ratio, y, ridge, rounds)
    weights = np.zeros(1 << BITS, np.float32)
    weights[top.bucket.to_numpy()] = w * ratio
    return ToxicModel(weights, float(b))


def _logistic(rows, cols, ratio, y, ridge, rounds):
    """Ridge logistic regression on the sparse matrix (rows, cols) -> ratio,
    by accelerated gradient steps; the intercept is not shrunk."""
    n, m, value = len(y), len(ratio), ratio[cols]

    def forward(w):
        return np.bincount(rows, value * w[cols], n)

    def backward(e):
        return np.bincount(cols, value * e[rows], m)

    v = np.random.default_rng(0).standard_normal(m)
    for _ in range(15):  # largest eigenvalue of the Gram matrix
        v = backward(forward(v)) + 1e-12
        top = np.linalg.norm(v)
        v /= top
    step = 1.0 / (0.25 * (top + n) + ridge)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-np.clip(forward(zw) + zb, -40, 40))) - y
        nw, nb = zw - step * (backward(e) + ridge * zw), zb - step * e.sum()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / u * (nw - w), nb + (t - 1) / u * (nb - b)
        w, b, t = nw, nb, u
    return w, b


def score(docs: DataFrame, model: ToxicModel, *more: str) -> DataFrame:
    """doc_id, the named columns and ``score`` of every row."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # 4 MB, whatever the input
    intercept = model.intercept

    def run(batches):
        w = weights.value
        selected = w != 0
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, n, row, bucket in _hits(batch.column("text"), selected):
                z = np.bincount(row, w[bucket].astype(float), n) + intercept
                out[first:first + n] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            keep = [i for i, c in enumerate(names) if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(out)],
                                             [names[i] for i in keep] + ["score"])

    source = documents_of(docs, *more)
    names = source.columns
    schema = source.drop("text").withColumn("score", F.lit(0.0)).schema
    return source.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the classifier calls toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return score(whole, model, "row").where(F.col("score") < THRESHOLD).select("row.*")
