"""Document fingerprints: quartile bucket digests.

Windows of five bytes slide over the UTF-8 text; each gives the byte triplets of
its last byte with two earlier ones.  A triplet is hashed into one of ``BUCKETS``
counters.  The digest has, per bucket, which quartile of all the counts its count
lies in (two bits), and the text's length on a logarithmic scale (one byte).
Two digests are compared by the steps between their quartiles, a jump over the
whole range counting double, and by the steps between their lengths: the
difference is bounded, and likeness is one minus its share of the bound at which
texts count as unrelated.

``fingerprints`` gives the digest of every row.  ``edited_fingerprints`` also puts
the rows in descending order of doc_id and compares each with the next and with a
text that ends with the next one's beginning.  The order comes from a range
partitioning; only the first and last row of each partition are joined in a
second step, by the numbers of the partitions.

A null or empty text is an empty text: all its buckets are in the lowest quartile
and its length is 0.  Texts under five bytes have a digest of fewer triplets.
Equal texts have equal fingerprints.  Rows with equal ids are ordered by a hash of
their texts, null ids come last, and repeated rows follow each other as documents
of their own; a single row is its own next.  A very long text is one row of a
task.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import blocks
from quire.llm.frames import documents_of, stored, text_key

BUCKETS = 256
LENGTH_STEPS = 8     # of the length scale, per doubling
UNRELATED = 320      # difference from which likeness is 0
LENGTH_FREE, LENGTH_MOST, LENGTH_COST = 2, 32, 2  # steps of length without cost, the most that count, and what each costs
SMALL_BLOCK = 1 << 18
#: Places of the two earlier bytes of each triplet, before the last one of the window.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_MIX = np.random.default_rng(1301).integers(0, BUCKETS, (len(TRIPLETS), 3, 256)).astype(np.uint8)


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x BUCKETS counts of the hashed triplets of each row of a block."""
    n, m = len(offsets) - 1, len(data)
    total = np.zeros((n + 1) * BUCKETS, np.int64)  # the last row: triplets that cross the start of a text
    base = np.repeat(np.arange(n) * BUCKETS, np.diff(offsets))
    reach = 0
    for t, (a, b) in enumerate(TRIPLETS):
        if m <= b:
            break
        while reach < b:
            starts = offsets[:-1] + reach
            base[starts[starts < offsets[1:]]] = n * BUCKETS
            reach += 1
        mixed = _MIX[t, 0][data[b:]] + _MIX[t, 1][data[b - a:m - a]] + _MIX[t, 2][data[:m - b]]  # modulo 256
        total += np.bincount(base[b:] + mixed, minlength=len(total))
    return total[:n * BUCKETS].reshape(n, BUCKETS)


def digests(texts: list[str]) -> np.ndarray:
    """rows x (1 + BUCKETS): step of the length, quartile (0 to 3) of each bucket."""
    out = np.empty((len(texts), 1 + BUCKETS), np.int16)
    if texts:
        out[:, 0] = np.minimum(255, LENGTH_STEPS * np.log2(1.0 + np.array([len(t) for t in texts]))).astype(np.int16)
    for first, data, offsets in blocks(pa.array(texts, pa.large_string()), SMALL_BLOCK):
        counts = bucket_counts(data, offsets)
        edges = np.sort(counts, 1)[:, [BUCKETS * i // 4 - 1 for i in (1, 2, 3)]]
        out[first:first + len(counts), 1:] = sum((counts > edges[:, [i]]).astype(np.int16) for i in range(3))
    return out


def encoded(digest: np.ndarray) -> list[str]:
    """Digests as hexadecimal text: the length, then four buckets a byte."""
    q = digest[:, 1:].reshape(len(digest), -1, 4)
    body = q[:, :, 0] | q[:, :, 1] << 2 | q[:, :, 2] << 4 | q[:, :, 3] << 6
    return [row.tobytes().hex() for row in np.concatenate([digest[:, :1], body], 1).astype(np.uint8)]


def decoded(fingerprints: list[str]) -> np.ndarray:
    """The digests that ``encoded`` wrote."""
    raw = np.array([list(bytes.fromhex(f)) for f in fingerprints], np.int16).reshape(len(fingerprints), 1 + BUCKETS // 4)
    q = raw[:, 1:, None] >> np.array([0, 2, 4, 6], np.int16) & 3
    return np.concatenate([raw[:, :1], q.reshape(len(raw), BUCKETS)], 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 (unrelated) to 1 (equal digests), row by row."""
    step = np.abs(a - b).astype(np.int64)
    length = np.clip(step[:, 0] - LENGTH_FREE, 0, LENGTH_MOST) * LENGTH_COST
    body = step[:, 1:].sum(1) + 3 * (step[:, 1:] == 3).sum(1)
    return 1 - np.minimum(length + body, UNRELATED) / UNRELATED


def edited(text: str, following: str) -> str:
    """``text`` whose last third is replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


COMPARED = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
FIELDS = [c.split()[0] for c in COMPARED.split(", ")]


def _compare(texts: list[str]) -> list[pa.Array]:
    """FIELDS of all texts but the last, each with the one after it."""
    own = digests(texts)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    other = digests(changed)
    return [pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(encoded(own[:-1]), pa.string()), pa.array(encoded(other), pa.string()),
            pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))]


def _pieces(texts: list[str], limit: int = 4 << 20):
    """Runs of texts of about ``limit`` characters, as (first, end)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row."""
    source = documents_of(docs)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in _pieces(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()),
                                                  pa.array(encoded(digests(texts[i:j])), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return source.mapInArrow(run, source.select("doc_id", F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("fingerprint")).schema)


DONE, HEAD, TAIL = 0, 1, 2


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows by falling doc_id in range partitions, each partition compared
    within itself: role (DONE: a result; HEAD, TAIL: first and last row of the
    partition with its text), part, doc_id, FIELDS, text."""
    order = (F.col("doc_id").desc_nulls_last(), F.col("key"), F.col("row"))
    source = (documents_of(docs).withColumn("key", text_key()).withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order)
              .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part")))

    def run(batches):
        ids = None  # of the row that waits for the next one
        waiting, part, names = None, None, ["role", "part", "doc_id", *FIELDS, "text"]

        def edge(role, one, text):
            return pa.RecordBatch.from_arrays([pa.array([role], pa.int32()), part, one, *[pa.nulls(1, t) for t in types], pa.array([text], pa.string())], names)

        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts, own = batch.column("text").to_pylist(), batch.column("doc_id")
            if waiting is None:
                part = batch.column("part").slice(0, 1)
                yield edge(HEAD, own.slice(0, 1), texts[0])
                ids = own
            else:
                texts, ids = [waiting, *texts], pa.concat_arrays([ids, own])
            n = len(texts) - 1
            for i, j in _pieces(texts[:-1]):
                out = _compare(texts[i:j + 1])
                yield pa.RecordBatch.from_arrays([pa.array([DONE] * (j - i), pa.int32()), pa.array(part.to_pylist() * (j - i), pa.int32()),
                                                  ids.slice(i, j - i), *out, pa.nulls(j - i, pa.string())], names)
            waiting, ids = texts[-1], ids.slice(n, 1)
        if waiting is not None:
            yield edge(TAIL, ids, waiting)

    head = source.select(F.lit(0).alias("role"), F.lit(0).alias("part"), "doc_id").schema
    return source.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in head] + [COMPARED, "text string"]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    rows = stored(_in_order(docs))
    heads = rows.where(F.col("role") == HEAD)
    parts = sorted(r["part"] for r in heads.select("part").collect())  # a number per partition
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "at int, after int")
    pairs = (rows.where(F.col("role") == TAIL).select("part", "doc_id", "text").join(after, F.col("part") == F.col("at"))
             .join(heads.select(F.col("part").alias("head"), F.col("text").alias("following")), F.col("after") == F.col("head"))
             .select("doc_id", "text", "following"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                texts = [batch.column("text")[i].as_py(), batch.column("following")[i].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *_compare(texts)], ["doc_id", *FIELDS])

    done = rows.where(F.col("role") == DONE).select("doc_id", *FIELDS)
    return done.union(pairs.mapInArrow(run, done.schema))
