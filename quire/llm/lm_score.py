"""Language-model scores from a hashed maximum-entropy model with
class-factored softmax.

Tokens are white-space words (A-Z lower-cased) and one end per document.  Token
counts over all documents that may be learnt from are exact: they are summed in
Spark, frequent tokens (at most ``HOT``) travel to the tasks as a table, the
others are joined by token.

The model predicts symbols: the end, each frequent word, and one symbol for
each bucket of the other words (by crc32), which are then spelled by their own
smoothed frequency in the bucket.  The buckets grow with the counted vocabulary,
about eight words each up to ``MOST_BUCKETS`` of them.

Symbols are factored into classes, a cluster and a band of frequency: a symbol's
place by frequency in its cluster has a binary length, the band, and the rest of
its digits tell the symbols of a class apart.  Clusters come from the company that
words keep: a spectral clustering of the ``SEEDS`` most frequent symbols by how
often they stand within two places of each other, and for every other symbol the
cluster that its neighbours favour.  The probability of a symbol is that of its
cluster (softmax over clusters), times that of its band (softmax over bands of the
cluster), times that of its digits (binary decisions).  Each starts from the
exact smoothed frequencies and adds the weights of the context's features: the
word before and the word before that (a skip feature) for the cluster, the word
before for band and digits.  Features are hashed into tables of fixed numbers of
rows.

Texts become arrays of symbols once, stored; counting neighbours, training and
scoring read those.  Training is one distributed pass over parts of about
``TASK_TOKENS`` tokens: every task counts its (two words before, cluster) and
(word before, symbol) tuples, makes adaptive gradient updates on them in numpy
batches and emits its tables in blocks; Spark averages each weight, weighted by
its summed squared gradients.  Scoring evaluates each distinct (word before,
symbol) pair of a block once.

A null or empty text has one token, the end.  A very long text is one row of a
task.  If nothing can be learnt from, counts are zero and all weights are: scores
are finite.  Words of equal counts are ordered by their bytes.  Repeated rows are
documents of their own: they count and score one by one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import mix32, row_blocks, text_buffers
from quire.llm.frames import documents_of, remainder, stored

FOLDS, HELD_OUT = 7, 2
HOT = 1 << 18
BUCKET_WORDS, MOST_BUCKETS = 8, 1 << 18
END = 0
SEEDS, CLUSTERS = 256, 4
ROW_BITS = 16              # rows of a softmax table
LEAST_BITS, MOST_BITS = 14, 22  # of the table of digit weights
BLOCK = 1024
RATE, PAIR_RATE = 0.1, 0.2
BATCH = 4096
TASK_TOKENS = 8_000_000
CHUNK = 1_500_000        # symbols that a task counts and learns at a time
FLUSH = 500_000
LN10 = np.log(10.0)


def _token_rows(column: pa.Array):
    """(first row, words of each row) of each block."""
    raw, offsets = text_buffers(column)
    for i, j in row_blocks(offsets):
        yield i, [raw[offsets[r]:offsets[r + 1]].tobytes().lower().split() for r in range(i, j)]


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c over all rows of ``docs`` (without the ends)."""

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], ["token", "c"])
        counts: Counter = Counter()
        for batch in batches:
            for _, rows in _token_rows(batch.column("text")):
                for words in rows:
                    counts.update(words)
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    tokens: DataFrame     # token, c: all tokens
    least: int            # tokens with c >= least are in ``hot``
    hot: list[bytes]      # by falling count
    counts: np.ndarray
    total: int            # tokens learnt from, ends included
    size: int             # distinct tokens, the end included
    ends: int
    spelled: np.ndarray   # per bucket of the other tokens: occurrences plus distinct tokens

    @property
    def bits(self) -> int:
        """Of the places in the table of digit weights: 16 weights per distinct token."""
        return min(MOST_BITS, max(LEAST_BITS, (16 * self.size).bit_length()))

    def symbol_counts(self) -> np.ndarray:
        """Occurrences of each symbol: the end, the frequent words, the buckets
        (theirs with their distinct tokens)."""
        return np.concatenate([[self.ends], self.counts, self.spelled]).astype(np.float64)


def vocabulary(docs: DataFrame, hot: int = HOT) -> Vocabulary:
    tokens = stored(token_counts(docs))
    ends = docs.count()
    # how many tokens have at least 2**(b/16) occurrences: at most about a thousand rows
    by = (tokens.groupBy(F.floor(F.log2("c") * 16).alias("b"))
          .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("b")).collect())
    seen, least = 0, None
    for r in by:
        if seen + r["n"] > hot:
            break
        seen, least = seen + r["n"], r["least"]
    size = sum(r["n"] for r in by)
    rows = tokens.where(F.col("c") >= least).toArrow() if least is not None else tokens.limit(0).toArrow()
    names, counts = rows.column("token").to_pylist(), np.asarray(rows.column("c")).astype(np.int64)
    order = np.lexsort((np.array(names, dtype=object), -counts)) if len(names) else []
    least = least if least is not None else 2**62
    n = min(MOST_BUCKETS, max(1, (size - len(names)) // BUCKET_WORDS))
    got = (tokens.where(F.col("c") < least).groupBy((F.crc32("token") % n).alias("at"))
           .agg((F.sum("c") + F.count(F.lit(1))).alias("n")).toArrow())  # at most n rows
    spelled = np.zeros(n, np.int64)
    spelled[np.asarray(got.column("at")).astype(np.int64)] = np.asarray(got.column("n"))
    return Vocabulary(tokens, least, [names[i].encode() for i in order],
                      counts[order] if len(names) else counts, sum(r["c"] for r in by) + ends, size + (ends > 0), ends, spelled)


class _Symbols(dict):
    """Word -> symbol: of the word itself if it is frequent, else of its bucket."""

    def __init__(self, hot: list[bytes], n_buckets: int):
        super().__init__(zip(hot, range(1, len(hot) + 1)))
        self.first, self.n = len(hot) + 1, n_buckets

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word) % self.n


def _triples(symbols: np.ndarray) -> np.ndarray:
    """One number for each (symbol two before, symbol before, symbol) of a row
    of documents, each of which ends with END."""
    one = np.r_[END, symbols[:-1]]
    two = np.r_[END, one[:-1]]
    two[one == END] = END
    return (two << 40) | (one << 20) | symbols


def coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, learnt, n_tokens, known, logs, symbols and rare (tokens outside
    the table, with their counts) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((words.hot, words.counts, len(words.spelled)))  # fixed bounds
    ends = words.ends
    source = documents_of(docs).withColumn("learnt", remainder("doc_id", FOLDS) != HELD_OUT)

    def run(batches):
        hot, counts, buckets = shared.value
        get = _Symbols(hot, buckets).__getitem__
        last = len(hot)
        logs = np.r_[np.log10(counts + 1.0), 0.0]  # the last: tokens that are joined later
        end = np.array([END])
        for batch in batches:
            for first, rows in _token_rows(batch.column("text")):
                n = len(rows)
                parts, rare = [], []
                for own in rows:
                    found = np.fromiter(map(get, own), np.int64, len(own))
                    parts += (found, end)
                    rare.append(Counter([own[i] for i in np.flatnonzero(found > last)]))
                symbols = np.concatenate(parts)
                size = np.array([len(own) + 1 for own in rows])
                start = np.r_[0, np.cumsum(size)[:-1]]
                late = symbols > last
                log = np.where(symbols == END, np.log10(ends + 1.0), logs[np.where(late, len(counts), symbols - 1)])
                items = pa.StructArray.from_arrays(
                    [pa.array([w for c in rare for w in c], pa.binary()).cast(pa.string()),
                     pa.array([k for c in rare for k in c.values()], pa.int64())], ["token", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("learnt").slice(first, n), pa.array(size),
                     pa.array(np.add.reduceat((~late & ((symbols != END) | (ends > 0))).astype(np.int64), start)),
                     pa.array(np.add.reduceat(log, start)),
                     pa.ListArray.from_arrays(pa.array(np.r_[start, len(symbols)], pa.int32()), pa.array(symbols.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(c) for c in rare])], pa.int32()), items)],
                    ["doc_id", "learnt", "n_tokens", "known", "logs", "symbols", "rare"])

    long = F.lit(0).cast("long")
    schema = source.select("doc_id", "learnt", long.alias("n_tokens"), long.alias("known"), F.lit(0.0).alias("logs"),
                           F.array(F.lit(0)).alias("symbols"),
                           F.from_json(F.lit("[]"), "array<struct<token:string,tf:bigint>>").alias("rare")).schema
    return source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _symbol_blocks(column: pa.Array, limit: int = 250_000):
    """(first row, cuts, symbols) of runs of rows with about ``limit`` symbols."""
    cut = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values).astype(np.int64)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(cut, cut[i] + limit, "right")) - 1))
        yield i, cut[i:j] - cut[i], values[cut[i]:cut[j]]
        i = j


def _neighbours(symbols: np.ndarray):
    """Pairs of symbols within two places inside a document, both ways."""
    for gap in (1, 2):
        a, b = symbols[:-gap], symbols[gap:]
        good = (a != END) & (b != END)
        if gap == 2:
            good &= symbols[1:-1] != END
        yield a[good], b[good]
        yield b[good], a[good]


def _seed_clusters(near: np.ndarray, k: int) -> np.ndarray:
    """Spectral clusters of the seeds from their counts of being neighbours:
    positive mutual information, its leading vectors, k-means from far points."""
    total = near.sum(1) + 1
    with np.errstate(divide="ignore"):
        info = np.maximum(np.log(near * near.sum() / np.outer(total, total)), 0)
    left, size, _ = np.linalg.svd(info)
    points = left[:, :k] * size[:k]
    points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-9
    centres = points[:1]
    while len(centres) < min(k, len(points)):
        far = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.concatenate([centres, points[[far.argmax()]]])
    for _ in range(30):
        label = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([points[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
    return label


def _counted(rows: DataFrame, numbers, size: int) -> DataFrame:
    """key, n: counts of the numbers under ``size`` that each block of symbols
    gives."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, symbols in _symbol_blocks(batch.column("symbols")):
                for found in numbers(symbols):
                    total += np.bincount(found, minlength=size)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 100_000):
            at = used[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "n"])

    return rows.select("symbols").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def clusters(learnt: DataFrame, counts: np.ndarray, k: int = CLUSTERS, seeds: int = SEEDS) -> np.ndarray:
    """The cluster of every symbol."""
    n = len(counts)
    order = np.argsort(-counts[1:], kind="stable")[:seeds] + 1
    order = order[counts[order] > 0]
    out = np.zeros(n, np.int64)
    if len(order) < k:
        return out
    place = np.full(n, -1, np.int64)
    place[order] = np.arange(len(order))
    shared = learnt.sparkSession.sparkContext.broadcast(place)  # a number per symbol

    def seed_pairs(symbols):
        at = shared.value
        for a, b in _neighbours(symbols):
            yield (at[a] * len(order) + at[b])[(at[a] >= 0) & (at[b] >= 0)]

    got = _counted(learnt, seed_pairs, len(order) ** 2).toArrow()  # at most SEEDS ** 2 rows
    near = np.zeros(len(order) ** 2)
    near[got.column("key").to_numpy()] = got.column("n").to_numpy()
    of_seed = _seed_clusters(near.reshape(len(order), -1), k)
    label = np.full(n, -1, np.int64)
    label[order] = of_seed
    known = learnt.sparkSession.sparkContext.broadcast(label)

    def company(symbols):
        of = known.value
        for a, b in _neighbours(symbols):
            yield (a * k + of[b])[of[b] >= 0]

    # a task's table has a fixed size: parts of a fixed number of tokens
    parts = learnt.coalesce(max(1, -(-int(counts.sum()) // TASK_TOKENS)))
    both = stored(_counted(parts, company, n * k).select((F.col("key") / k).cast("long").alias("symbol"), (F.col("key") % k).cast("int").alias("c"), "n"))
    mass = np.zeros(k)
    for r in both.groupBy("c").agg(F.sum("n").alias("n")).collect():
        mass[r["c"]] = r["n"]
    share = mass / max(mass.sum(), 1)
    # what a symbol's neighbours say beyond the clusters' own shares; ties: the first cluster
    beyond = [(F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0)) + float(share[c])) / float(max(share[c], 1e-12)) for c in range(k)]
    best = both.groupBy("symbol").agg(F.array(*beyond).alias("v")).select("symbol", (F.array_position("v", F.array_max("v")) - 1).alias("c")).toArrow()
    out[best.column("symbol").to_numpy()] = best.column("c").to_numpy()
    return out


@dataclass
class Classes:
    """Cluster, band and number of every symbol, and what is known of them
    without a context."""
    cluster: np.ndarray
    number: np.ndarray       # from 1, by falling count in the cluster
    band: np.ndarray         # binary length of the number, less one
    log_cluster: np.ndarray  # clusters
    log_band: np.ndarray     # clusters x bands
    digit: np.ndarray        # log odds of every binary decision

    @property
    def bands(self) -> int:
        return self.log_band.shape[1]


def classes(counts: np.ndarray, cluster: np.ndarray, k: int = CLUSTERS) -> Classes:
    number = np.empty(len(counts), np.int64)
    order = np.argsort(-counts, kind="stable")
    for c in range(k):
        own = order[cluster[order] == c]
        number[own] = np.arange(1, len(own) + 1)
    band = np.frexp(number.astype(float))[1].astype(np.int64) - 1
    bands = int(band.max()) + 1
    mass = counts + 0.5
    by = np.bincount(cluster * bands + band, mass, k * bands).reshape(k, bands)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_cluster = np.maximum(np.log(by.sum(1) / by.sum()), -60)
        log_band = np.maximum(np.nan_to_num(np.log(by / by.sum(1, keepdims=True)), nan=-60), -60)
    digit = np.zeros(k * (2 << bands), np.float32)
    for c in range(k):
        for b in range(1, bands):
            row = np.zeros(1 << b)
            own = (cluster == c) & (band == b)
            row[number[own] - (1 << b)] = mass[own]
            for j in range(b):
                half = row.reshape(1 << j, 2, -1).sum(2)
                at = _nodes(np.int64(c), np.int64(b), np.arange(1 << j, 2 << j), bands)
                digit[at] = np.log(np.maximum(half[:, 1], 1e-6) / np.maximum(half[:, 0], 1e-6))
    return Classes(cluster, number, band, log_cluster.astype(np.float32), log_band.astype(np.float32), digit)


def _nodes(cluster, band, prefix, bands: int):
    """Place of a binary decision: of the digits after ``prefix``."""
    return cluster * (2 << bands) + (1 << band) + prefix - 1


def _feature(word: np.ndarray, salt: int) -> np.ndarray:
    return mix32(word.astype(np.uint32) + np.uint32(salt))


ONE, TWO = 0x51ED27, 0x2F0B4C47  # salts of the two features
LEAST_LOG = np.float32(np.log(1e-30))


class _Model:
    """Weights: softmax tables (cluster by either word before, band by the word
    before) and digit weights, one after another in one array."""

    def __init__(self, shape: Classes, bits: int, weights: np.ndarray | None = None):
        self.of, k, rows = shape, len(shape.log_cluster), 1 << ROW_BITS
        self.mask = np.uint32((1 << bits) - 1)
        self.ends = np.cumsum([rows * k, rows * k, rows * shape.bands, 1 << bits])
        self.flat = np.zeros(-(-int(self.ends[-1]) // BLOCK) * BLOCK, np.float32) if weights is None else weights
        self.tables = self.parts(self.flat)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        a = np.r_[0, self.ends]
        k, b = len(self.of.log_cluster), self.of.bands
        return [flat[a[i]:a[i + 1]].reshape(-1, w) for i, w in enumerate((k, k, b))] + [flat[a[3]:a[4]]]

    # rows are read by take, which is several times faster than an index

    def cluster_odds(self, two, one):
        """(log odds of the clusters, tables, rows)."""
        shift = np.uint32(32 - ROW_BITS)
        at = [(_feature(w, salt) >> shift).astype(np.uint16) for w, salt in ((one, ONE), (two, TWO))]
        z = self.tables[0].take(at[0], 0)
        z += self.tables[1].take(at[1], 0)
        z += self.of.log_cluster
        return z, (0, 1), at

    def clusters(self, two, one):
        """(probabilities of the clusters, tables, rows)."""
        z, tables, rows = self.cluster_odds(two, one)
        return _softmax(z), tables, rows

    def band_odds(self, one, symbol):
        """(log odds of the bands in the symbol's cluster, tables, rows)."""
        c = self.of.cluster.take(symbol)
        row = ((_feature(one, ONE) + c.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - ROW_BITS)).astype(np.uint16)
        z = self.tables[2].take(row, 0)
        z += self.of.log_band.take(c, 0)
        return z, (2,), [row]

    def bands(self, one, symbol):
        """(probabilities of the bands in the symbol's cluster, tables, rows)."""
        z, tables, rows = self.band_odds(one, symbol)
        return _softmax(z), tables, rows

    def digits(self, one, symbol):
        """The binary decisions of a batch: symbol of each, digit, log odds, place
        of its weight."""
        which, digit, odds, place = self.decisions(one, symbol)
        odds += self.tables[3].take(place)
        return which, digit, odds, place

    def decisions(self, one, symbol):
        """``digits`` with the log odds that hold without a context; symbols of equal
        length stand side by side, so that whole columns are worked at once."""
        length = self.of.band.take(symbol)
        order = np.argsort(length.astype(np.uint8), kind="stable")
        cut = np.searchsorted(length.take(order), np.arange(self.of.bands + 1))
        symbol, size = symbol.take(order), int(length.sum())
        n = self.of.number.take(symbol).astype(np.int32)
        base = _nodes(self.of.cluster.take(symbol), length.take(order), 0, self.of.bands).astype(np.int32)
        feature = _feature(one.take(order), ONE)
        which, digit, node, salt = np.empty(size, np.int64), np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, np.uint32)
        at = 0
        for b in range(1, self.of.bands):
            i, j = cut[b], cut[b + 1]
            if i == j:
                continue
            left = np.arange(b, 0, -1, dtype=np.int32)[:, None]
            here, at = slice(at, at + b * (j - i)), at + b * (j - i)
            which[here].reshape(b, -1)[:] = order[i:j]
            salt[here].reshape(b, -1)[:] = feature[i:j]
            np.right_shift(n[i:j], left - 1, out=digit[here].reshape(b, -1))
            np.right_shift(n[i:j], left, out=node[here].reshape(b, -1))
            node[here].reshape(b, -1)[:] += base[i:j]
        digit &= 1
        salt += mix32(node.view(np.uint32))
        salt &= self.mask
        return which, digit, self.of.digit.take(node), salt.astype(np.int64)


def _row_max(z: np.ndarray) -> np.ndarray:
    return reduce(np.maximum, z.T)  # by columns: rows are short


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= _row_max(z)[:, None]
    np.exp(z, out=z)
    z /= reduce(np.add, z.T)[:, None]
    return z


def _log_share(z: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """log of the softmax at each row's answer."""
    z -= _row_max(z)[:, None]
    own = z[np.arange(len(z)), answer]
    np.exp(z, out=z)
    return np.maximum(own - np.log(reduce(np.add, z.T)), LEAST_LOG)


LAST = (1 << 20) - 1  # a symbol's bits in a triple


def _contexts(triples: np.ndarray, shape: Classes) -> np.ndarray:
    """(two before, before, cluster) of each triple, as one number."""
    return triples & ~LAST | shape.cluster[triples & LAST]


def _pairs(triples: np.ndarray) -> np.ndarray:
    """(before, symbol) of each triple, as one number."""
    return triples & ((1 << 40) - 1)


def _power_of(gradient: np.ndarray) -> np.ndarray:
    """What a gradient adds to the sum of squares.  A tuple that occurs n times
    counts as n small steps, not as one of n times the size."""
    size = np.abs(gradient)
    return size * np.minimum(size, 1)


def _step(model: _Model, squares: list[np.ndarray], softmax, answer: np.ndarray, count: np.ndarray, rate: float):
    """One adaptive gradient step of a softmax's tables."""
    p, tables, rows = softmax
    p[np.arange(len(answer)), answer] -= 1
    p *= count[:, None]
    for t, at in zip(tables, rows):
        order = np.argsort(at, kind="stable")  # of 16 bits: by digits
        own = at.take(order)
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        gradient, own = np.add.reduceat(p.take(order, 0), start), own.take(start)
        total = squares[t].take(own, 0)
        total += _power_of(gradient)
        squares[t][own] = total
        total += np.float32(1e-6)
        gradient *= np.float32(rate)
        gradient /= np.sqrt(total, out=total)
        model.tables[t][own] = model.tables[t].take(own, 0) - gradient


def _learn_contexts(model: _Model, squares, keys: np.ndarray, count: np.ndarray):
    _step(model, squares, model.clusters(keys >> 40, (keys >> 20) & LAST), keys & LAST, count, RATE)


def _learn_pairs(model: _Model, squares, both: np.ndarray, slot: np.ndarray, keys: np.ndarray, count: np.ndarray):
    """``both`` holds the digit weights and, beside them (as the imaginary part),
    their sums of squares, so that one read finds the two.  ``slot`` is scratch: of
    the decisions at one place, the last one written gathers their gradients.  Places
    that occur several times are written several times with the same value."""
    one, symbol = keys >> 20, keys & LAST
    _step(model, squares, model.bands(one, symbol), model.of.band.take(symbol), count, PAIR_RATE)
    which, digit, odds, place = model.decisions(one, symbol)
    own = both.take(place)
    odds += own.real
    np.negative(odds, out=odds)
    np.exp(odds, out=odds)
    odds += 1
    np.reciprocal(odds, out=odds)
    odds -= digit.astype(np.float32)
    odds *= count.take(which)
    slot[place] = np.arange(len(place), dtype=np.int32)
    owner = slot.take(place)
    gradient = np.bincount(owner, odds, len(place)).astype(np.float32).take(owner)
    own.imag += _power_of(gradient)
    gradient *= np.float32(PAIR_RATE)
    gradient /= np.sqrt(own.imag + np.float32(1e-6))
    own.real -= gradient
    both[place] = own


def train(learnt: DataFrame, shape: Classes, bits: int, tokens: int) -> np.ndarray:
    """The weights from one pass over the symbols of ``learnt``."""
    shared = learnt.sparkSession.sparkContext.broadcast(shape)  # a few numbers per symbol

    def run(batches):
        model = _Model(shared.value, bits)
        flat = np.zeros(len(model.flat), np.float32)
        squares, both, slot = model.parts(flat), np.zeros(1 << bits, np.complex64), np.zeros(1 << bits, np.int32)
        rng = np.random.default_rng(11)

        def mixed(keys):
            keys, counts = np.unique(keys, return_counts=True)
            order = rng.permutation(len(keys))
            keys, counts = keys[order], counts[order].astype(np.float32)
            for i in range(0, len(keys), BATCH):
                yield keys[i:i + BATCH], counts[i:i + BATCH]

        def learn(found):
            triples = np.concatenate(found)
            for keys, counts in mixed(_contexts(triples, model.of)):
                _learn_contexts(model, squares, keys, counts)
            for keys, counts in mixed(_pairs(triples)):
                _learn_pairs(model, squares, both, slot, keys, counts)

        found, size = [], 0
        for batch in batches:
            for _, _, symbols in _symbol_blocks(batch.column("symbols")):
                found.append(_triples(symbols))
                size += len(symbols)
                if size > CHUNK:
                    learn(found)
                    found, size = [], 0
        if found:
            learn(found)
        model.tables[3][:], squares[3][:] = both.real, both.imag
        weights, total = model.flat.reshape(-1, BLOCK), flat.reshape(-1, BLOCK)
        used = np.flatnonzero(total.any(1))
        for i in range(0, len(used), 256):
            at = used[i:i + 256]
            yield emitted(at, weights[at] * total[at], total[at])

    def emitted(at, weights, squares):
        cut = pa.array(np.arange(len(at) + 1, dtype=np.int32) * BLOCK)
        return pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array(weights.ravel().astype(np.float32))),
             pa.ListArray.from_arrays(cut, pa.array(squares.ravel().astype(np.float32)))], ["at", "weights", "squares"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}  # of this partition's blocks
        for batch in batches:
            both = np.stack([np.asarray(batch.column(c).flatten()).reshape(-1, BLOCK) for c in ("weights", "squares")], 1)
            for at, own in zip(batch.column("at").to_pylist(), both):
                sums[at] = sums[at] + own if at in sums else own.astype(float)
        if sums:
            done = np.stack(list(sums.values()))
            yield emitted(np.array(list(sums)), done[:, 0] / np.maximum(done[:, 1], 1e-30), done[:, 1])

    schema = "at long, weights array<float>, squares array<float>"
    # a task's tables have a fixed size: parts of a fixed number of tokens
    parts = learnt.select("symbols").coalesce(max(1, -(-tokens // TASK_TOKENS))).mapInArrow(run, schema)
    got = parts.repartition("at").mapInArrow(merge, schema).select("at", "weights").toArrow()  # the size of one model
    out = _Model(shape, bits).flat
    for batch in got.to_batches():
        if batch.num_rows:
            out.reshape(-1, BLOCK)[np.asarray(batch.column("at"))] = np.asarray(batch.column("weights").flatten()).reshape(-1, BLOCK)
    return out


def _log10_each(model: _Model, symbols: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol of a row of documents."""
    triples = _triples(symbols)
    keys, out = _contexts(triples, model.of), np.empty(len(triples))
    for i in range(0, len(keys), BATCH):
        k = keys[i:i + BATCH]
        out[i:i + BATCH] = _log_share(model.cluster_odds(k >> 40, (k >> 20) & LAST)[0], k & LAST)
    keys, back = np.unique(_pairs(triples), return_inverse=True)
    value = np.empty(len(keys))
    for i in range(0, len(keys), BATCH):
        one, symbol = keys[i:i + BATCH] >> 20, keys[i:i + BATCH] & LAST
        own = _log_share(model.band_odds(one, symbol)[0], model.of.band.take(symbol))
        which, digit, odds, _ = model.digits(one, symbol)
        odds *= 1 - 2 * digit.astype(np.float32)  # against the digit that it has
        np.exp(np.clip(odds, -60, 60, out=odds), out=odds)
        odds += 1
        value[i:i + BATCH] = own - np.bincount(which, np.log(odds, out=odds), len(symbol))
    return (out + value[back]) / LN10


def score(rows: DataFrame, words: Vocabulary, shape: Classes, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``coded``."""
    shared = rows.sparkSession.sparkContext.broadcast((len(words.hot), words.spelled, shape, weights))  # fixed bounds
    bits = words.bits
    source = rows.select("row", "symbols")

    def run(batches):
        last, spelled, of, flat = shared.value
        model = _Model(of, bits, flat)
        spell = -np.log10(spelled + 1.0)
        for batch in batches:
            for first, start, symbols in _symbol_blocks(batch.column("symbols")):
                each = _log10_each(model, symbols)
                late = symbols > last
                each[late] += spell[symbols[late] - last - 1]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, len(start)), pa.array(np.add.reduceat(each, start))],
                                                 ["m_row", "model"])

    modelled = source.mapInArrow(run, "m_row long, model double")
    each = rows.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.tf")
    joined = each.join(words.tokens.where(F.col("c") < words.least), "token", "left")
    c = F.coalesce("c", F.lit(0).cast("long"))
    late = joined.groupBy("row").agg(F.sum(F.col("tf") * F.log10(c + 1.0)).alias("late"),
                                     F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("late_known"))
    rest = F.coalesce("late", F.lit(0.0))
    all_log = float(np.log10(words.total + words.size + 1.0))
    return (rows.drop("rare", "symbols").join(modelled, F.col("row") == F.col("m_row")).join(late, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("late_known", F.lit(0).cast("long"))).alias("n_known"),
        (F.col("logs") + rest - F.col("n_tokens") * all_log).alias("base_score"),
        (F.col("model") + rest).alias("score")))


def fitted(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, Vocabulary, Classes, np.ndarray]:
    """(coded rows, vocabulary, classes, weights) learnt from ``docs``."""
    words = vocabulary(documents_of(docs).where(remainder("doc_id", FOLDS) != HELD_OUT), hot)
    rows = stored(coded(docs, words))
    learnt, counts = rows.where("learnt"), words.symbol_counts()
    shape = classes(counts, clusters(learnt, counts))
    return rows, words, shape, train(learnt, shape, words.bits, words.total)


def lm_score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    rows, words, shape, weights = fitted(docs)
    scored = score(rows, words, shape, weights)
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                         F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
