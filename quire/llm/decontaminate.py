"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of digits, lower-cased letters and bytes from 0x80 on.  Every
benchmark item gives windows of 13 consecutive words (a shorter item is one
window).  A window is a set of five-word shingles (a window of fewer words is
one shingle); it occurs in a document only if all its shingles do, so one
necessary prefix token is enough to find it: its rarest shingle.

1. Rarity: the documents' counts of the benchmark's shingles.  Tasks count the
   shingles that pass a bit table of the benchmark's shingle hashes (2 MB,
   whatever the size of the benchmark) and Spark sums them.
2. Per window, shingles are ordered by rarity and the first is kept with its
   place.
3. Tasks emit the document places of prefix shingles (again behind a bit
   table), with the words around them.
4. The join on the shingle gives candidates; the length and position bounds
   (the window must fit before and after the shared shingle) and the comparison
   of all words of the window make them exact.
5. Windows found in a document become intervals; their union counts the hit
   words.

No text is shuffled.  A null or empty text has no words.  Rows equal in doc_id
and text are one document, and each of them gets its result.  Items with equal
or null ids are kept apart only by id: a null id is counted in n_items but
cannot stand in the list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.arrays import LOWER, U64, blocks, byte_set, runs, shingle_hash, span_hash
from quire.llm.frames import documents_of, stored, table, text_key

WINDOW = 13
SHINGLE = 5
TABLE_BITS = 24
PART_OF_TEXT = 20  # contaminated if 20 * n_hit >= n_words
IS_WORD = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _words(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, rows) of a block's words."""
    low = LOWER[data]
    return (low, *runs(low, offsets, IS_WORD))


def _windows(batches):
    """item_id, the words of each window, and its shingles' hashes and places."""
    for batch in batches:
        ids = batch.column("item_id")
        for first, data, offsets in blocks(batch.column("text")):
            low, starts, ends, rows = _words(data, offsets)
            words = [low[a:b].tobytes().decode() for a, b in zip(starts, ends)]
            hashes = span_hash(low, starts, ends)
            cut = np.searchsorted(rows, np.arange(len(offsets)))
            out = []
            for r in range(len(offsets) - 1):
                own, h = words[cut[r]:cut[r + 1]], hashes[cut[r]:cut[r + 1]]
                for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
                    w = own[i:i + WINDOW]
                    k = min(SHINGLE, len(w))
                    out.append((first + r, w, shingle_hash(h[i:i + len(w)], k).view(np.int64).tolist(), k))
            for i in range(0, len(out), 5000):
                at, w, s, k = zip(*out[i:i + 5000])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(w, pa.list_(pa.string())), pa.array(s, pa.list_(pa.int64())), pa.array(k, pa.int32())],
                    ["item_id", "words", "shingles", "k"])


def _bit_table(hashes: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A table of 2**24 bits of the column ``shingle`` (64-bit hashes) and the
    shingle lengths in use (at most five)."""
    words = (hashes.select("k", F.shiftrightunsigned("shingle", 64 - TABLE_BITS).alias("b"))
             .groupBy("k", F.shiftright("b", 6).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toArrow())
    table_ = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    at = np.asarray(words.column("at")).astype(np.int64)
    np.bitwise_or.at(table_, at, np.asarray(words.column("bits")).astype(np.int64).view(np.uint64))
    return table_, sorted(set(np.asarray(words.column("k")).tolist()))


def _in_table(table_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    b = hashes >> U64(64 - TABLE_BITS)
    return (table_[b >> U64(6)] >> (b & U64(63))) & U64(1) == 1


def _passing(low, starts, ends, rows, table_, lengths):
    """(k, word places, hashes) of the shingles that pass the bit table."""
    h = span_hash(low, starts, ends)
    for k in lengths:
        s = shingle_hash(h, k)
        at = np.flatnonzero(_in_table(table_, s))
        at = at[rows[at] == rows[at + k - 1]]
        yield k, at, s[at]


def shingle_counts(docs: DataFrame, table_, lengths) -> DataFrame:
    """shingle, n: how often the documents hold each shingle of the table."""
    shared = docs.sparkSession.sparkContext.broadcast((table_, lengths))  # 2 MB

    def run(batches):
        bits, ks = shared.value
        for batch in batches:
            found = []
            for _, data, offsets in blocks(batch.column("text")):
                found += [s for _, _, s in _passing(*_words(data, offsets), bits, ks)]
            s, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, table_, lengths, reach: int = WINDOW) -> DataFrame:
    """doc_id, key, shingle, at (word place), before and after (the words
    around it, as far as a window can reach)."""
    shared = docs.sparkSession.sparkContext.broadcast((table_, lengths))
    source = documents_of(docs).withColumn("key", text_key())

    def run(batches):
        bits, ks = shared.value
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for first, data, offsets in blocks(batch.column("text")):
                low, starts, ends, rows = _words(data, offsets)
                cut = np.searchsorted(rows, np.arange(len(offsets)))
                for k, at, s in _passing(low, starts, ends, rows, bits, ks):
                    for i in range(0, len(at), 5000):
                        a = at[i:i + 5000]
                        row = rows[a]
                        begin = np.maximum(cut[row], a - (reach - k))
                        end = np.minimum(cut[row + 1], a + reach)
                        context = [[low[x:y].tobytes().decode() for x, y in zip(starts[b:e], ends[b:e])] for b, e in zip(begin, end)]
                        pick = pa.array(first + row)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pick), keys.take(pick), pa.array(s[i:i + 5000].view(np.int64)), pa.array(a - cut[row]),
                             pa.array(a - begin), pa.array(context, pa.list_(pa.string()))],
                            ["doc_id", "key", "shingle", "at", "before", "context"])

    schema = source.select("doc_id", "key", F.lit(0).cast("long").alias("shingle"), F.lit(0).cast("long").alias("at"),
                           F.lit(0).cast("long").alias("before"), F.array(F.lit("")).alias("context")).schema
    return source.mapInArrow(run, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words of every row."""
    source = documents_of(docs).withColumn("key", text_key())

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in blocks(batch.column("text")):
                rows = _words(data, offsets)[3]
                n[first:first + len(offsets) - 1] = np.bincount(rows, minlength=len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n)], ["doc_id", "key", "n_words"])

    return source.mapInArrow(run, source.select("doc_id", "key", F.lit(0).cast("long").alias("n_words")).schema)


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, key, item_id, start, length: every occurrence of a window."""
    windows = stored(items.select("item_id", "text").mapInArrow(
        _windows, items.select("item_id", F.array(F.lit("")).alias("words"), F.array(F.lit(0).cast("long")).alias("shingles"),
                               F.lit(0).alias("k")).schema).distinct())
    each = windows.select("words", "k", F.posexplode("shingles").alias("place", "shingle")).distinct()
    seen = shingle_counts(docs, *_bit_table(each))
    rarest = Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "shingle", "place")
    prefix = stored(each.join(seen, "shingle", "left").withColumn("rank", F.row_number().over(rarest))
                    .where("rank = 1").select("words", "k", "place", "shingle"))
    found = places(docs, *_bit_table(prefix))
    length = F.size("words")
    first = F.col("before") - F.col("place") + 1  # place of the window's first word in the context, from 1
    fits = (F.col("at") >= F.col("place")) & (first >= 1) & (first + length - 1 <= F.size("context"))
    same = F.slice("context", F.greatest(first, F.lit(1)).cast("int"), length) == F.col("words")
    hits = (found.join(prefix, "shingle").where(fits & same)
            .select("doc_id", "key", "words", (F.col("at") - F.col("place")).alias("start"), length.alias("length")).distinct())
    return hits, windows.select("item_id", "words").distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated."""
    hits, windows = occurrences(docs, items)
    hits = stored(hits)
    spans = hits.groupBy("doc_id", "key", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    n_hit = (spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0)))
             .groupBy("doc_id", "key").agg(F.sum("new").alias("n_hit")))
    found = (hits.select("doc_id", "key", "words").distinct().join(windows, "words")
             .select("doc_id", "key", "item_id").distinct()
             .groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_items"),
                                           F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items")))
    both = n_hit.alias("a").join(found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")))
    both = both.select(F.col("a.doc_id").alias("h_id"), F.col("a.key").alias("h_key"), "n_hit", "n_items", "items")
    joined = word_counts(docs).join(both, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "key", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                         F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
                         ((n > 0) & (PART_OF_TEXT * n >= F.col("n_words"))).alias("contaminated"))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold benchmark text."""
    bad = (decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
           .select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), text_key().alias("own_key"))
    return (whole.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key")), "left_anti")
            .select("row.*"))


#: The same rows in SQL, written apart from the code above.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 12], ' ') AS g, least(len(ws), 13) AS n
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT k, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
       FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT dw.k, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
w AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS j FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN w ON w.k = d.k LEFT JOIN t ON t.k = d.k
"""
