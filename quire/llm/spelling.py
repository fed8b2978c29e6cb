"""Spelling variant grouping with an index of variable-length grams.

Words are runs of letters of the texts; those with enough letters and occurrences
are compared.  Two words are near if one inserted, deleted or replaced code point
makes one of them the other.

1. Gram dictionary: the grams of 2 to ``LONGEST`` letters of all words, edges
   marked, are counted in Spark.  A gram that occurs more than ``prune`` times is
   extendable, others need no longer form; the bound grows with the words so that
   the extendable grams stay under ``MOST_GRAMS`` and fit a broadcast.
2. Decomposition: at each place of a word stands the shortest gram that is not
   extendable (or as long as the word's class allows).  It depends on its own
   letters only, so an edit affects just the grams that cover it.
3. Per-word bound: a word looks for its near words through a few of its grams, the
   rarest ones that no single edit affects together.  For two grams that do not
   overlap the bound is one: every near word has one of the two, at the same
   place or one further.  Lists are kept by class, length and place: class n holds
   the pairs of words of n letters with words of n or n + 1.
4. The lists of the chosen grams are merged in a Spark join; a list longer than
   ``LIST`` is split, by the dictionary's counts, and looked up in parts.  A mask
   of the letters and the edit distance verify each pair, so no other pair stays.
5. A word's form is its most frequent near word, if that is ``RATIO`` times as
   frequent; forms are followed to the root by pointer jumping.

Only places within ``EDGE`` letters of either end are used, which is enough for
the bound and keeps very long words cheap.  Null or empty texts have no words; a
null id counts as the empty text in the deletion rule.  Repeated rows count again.
Ties of a form are broken by code-point order.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import U64, mix64
from quire.llm.frames import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP_EVERY = 199     # a run whose hash it divides loses a letter
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
SHORTEST, LONGEST = 2, 8   # letters of a gram
PRUNE, MOST_GRAMS = 32, 1 << 20
LIST = 4096
EDGE = 32
FLUSH = 500_000
FAR = np.int64(1) << 60


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n over all texts, letters dropped by the hash rule."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("id"),
                         F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column("id"), batch.column("text")):
                start = zlib.crc32(name.as_py() + b":")
                for w, k in Counter(RUN.findall(text.as_py().lower().decode())).items():  # bytes: A-Z only
                    if len(w) < least_length:
                        continue
                    h = zlib.crc32(w.encode(), start)
                    if h % DROP_EVERY == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < least_length:
                            continue
                    counts[w] += k
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return (source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def _grams(words: list[str]):
    """Per length: (letters, rows, places, keys), where keys[g] packs the g letters
    from each place (rows x places; 0 where the word ends before)."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        letters = np.frombuffer("".join(f"^{words[i]}$" for i in rows).encode("latin-1"), np.uint8).reshape(len(rows), n + 2)
        padded = np.zeros((len(rows), n + 2 + LONGEST), np.uint64)
        padded[:, :n + 2] = letters
        places = np.arange(n + 1)
        places = places[(places <= EDGE) | (places >= n - EDGE)]
        keys = {1: padded[:, places]}
        for g in range(2, LONGEST + 1):
            fits = places + g <= n + 2
            keys[g] = np.where(fits, (keys[g - 1] << U64(8)) | padded[:, places + g - 1], U64(0))
        yield n, rows, places, keys


@dataclass
class Dictionary:
    """Extendable grams (sorted packed letters) and how often they occur."""
    grams: np.ndarray
    counts: np.ndarray
    prune: int

    def often(self, keys: np.ndarray) -> np.ndarray:
        """Occurrences of each gram, 0 if it is not extendable."""
        if len(self.grams) == 0:
            return np.zeros(keys.shape, np.int64)
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        return np.where(self.grams[at] == keys, self.counts[at], 0)

    def lengths(self, n: int, places: np.ndarray, keys: dict) -> np.ndarray:
        """Letters of the gram at each place, before the limit of a class."""
        out = np.full(keys[1].shape, SHORTEST)
        for g in range(SHORTEST, LONGEST):
            longer = (out == g) & (places + g + 1 <= n + 2) & (self.often(keys[g]) > 0)
            out[longer] = g + 1
        return out


def dictionary(words: DataFrame, prune: int = PRUNE, most: int = MOST_GRAMS) -> Dictionary:
    """Count all grams and keep the extendable ones (at most ``most``)."""

    def run(batches):
        found, size = [], 0

        def out():
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

        for batch in batches:
            for _, _, _, keys in _grams(batch.column("word").to_pylist()):
                for g in range(SHORTEST, LONGEST + 1):
                    found.append(keys[g][keys[g] > 0])
                    size += len(found[-1])
            if size > 4_000_000:
                yield out()
                found, size = [], 0
        if size:
            yield out()

    counted = stored(words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    prune = max(prune, -(-total // most))  # fewer than ``most`` grams occur more often than total / most
    got = counted.where(F.col("n") > prune).toArrow()
    grams, counts = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(grams)
    return Dictionary(grams[order], counts[order], prune)


def _limit(letters: int) -> int:
    """The longest gram of a class: half a word with its edges, so that two
    grams at its ends never overlap."""
    return min(LONGEST, (letters + 2) // 2)


def _class_grams(keys: dict, lengths: np.ndarray, limit: int):
    """(letters of each gram, gram) under the limit of a class."""
    short = np.minimum(lengths, limit)
    gram = np.zeros(short.shape, np.uint64)
    for g in range(SHORTEST, limit + 1):
        gram = np.where(short == g, keys[g], gram)
    return short, gram


def _list_key(gram: np.ndarray, letters: int, n: int, place: np.ndarray) -> np.ndarray:
    """Name of the list of a gram: class, length of the words in it, place."""
    at = mix64((np.asarray(place).astype(np.uint64) << U64(2)) + U64(n - letters))
    return mix64(gram ^ mix64(at + U64(letters) * U64(0x9E3779B97F4A7C15)))


def _chosen(places: np.ndarray, short: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the two cheapest grams of each word that no single edit affects
    together: they do not overlap."""
    m, k = cost.shape
    best, pair = np.full(m, FAR), np.zeros((2, m), np.int64)
    early, early_at, done = np.full(m, FAR), np.zeros(m, np.int64), 0  # the cheapest gram that surely ends before
    for b in range(k):
        while places[done] + LONGEST <= places[b]:
            less = cost[:, done] < early
            early[less], early_at[less] = cost[less, done], done
            done += 1
        options = [(early, early_at)] + [(np.where(places[a] + short[:, a] <= places[b], cost[:, a], FAR), np.full(m, a)) for a in range(done, b)]
        for c, at in options:
            total = np.where(c < FAR, c + cost[:, b], FAR)
            less = total < best
            best[less], pair[0][less], pair[1][less] = total[less], at[less], b
    return pair[0], pair[1]


def _letters_mask(words: list[str]) -> np.ndarray:
    """A bit per letter that occurs (modulo 64): one edit changes two at most."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        m = 0
        for c in w:
            m |= 1 << (ord(c) & 63)
        out[i] = m
    return out.view(np.int64)


def lists_and_lookups(words: DataFrame, grams: Dictionary, least_length: int = LEAST_LENGTH, list_size: int = LIST) -> DataFrame:
    """key, part, lookup, word, mask: the words of every list (lookup false),
    and the lists that each word looks up."""
    shared = words.sparkSession.sparkContext.broadcast(grams)  # at most MOST_GRAMS grams

    def run(batches):
        known: Dictionary = shared.value
        for batch in batches:
            column = batch.column("word")
            words_ = column.to_pylist()
            masks = _letters_mask(words_)
            own_hash = mix64(masks.view(np.uint64) + np.array([zlib.crc32(w.encode()) for w in words_], np.uint64))
            for n, rows, places, keys in _grams(words_):
                lengths = known.lengths(n, places, keys)
                for letters in (n - 1, n):
                    if letters < least_length:
                        continue
                    short, gram = _class_grams(keys, lengths, _limit(letters))
                    often = known.often(gram)
                    parts = np.maximum(1, -(-often // list_size))
                    part = (own_hash[rows][:, None] % parts.astype(np.uint64)).astype(np.int64)
                    yield rows_out(column, masks, np.repeat(rows, len(places)), _list_key(gram, letters, n, places).ravel(), part.ravel(), False)
                cost = np.where(often > 0, often, known.prune)
                inner = (places < EDGE) | (places > n - EDGE)
                cost = np.where(inner, cost, FAR // 4)
                r = np.arange(len(rows))
                for at in _chosen(places, short, cost):
                    for other, shift in ((n, 0), (n + 1, 0), (n + 1, 1)):
                        key = _list_key(gram[r, at], n, other, places[at] + shift)
                        copies = parts[r, at]
                        each = np.repeat(r, copies)
                        first = np.cumsum(copies) - copies
                        yield rows_out(column, masks, rows[each], key[each], np.arange(len(each)) - first[each], True)

    def rows_out(column, masks, rows, key, part, lookup):
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(np.full(len(rows), lookup)),
             column.take(pa.array(rows)), pa.array(masks[rows])], ["key", "part", "lookup", "word", "mask"])

    return words.select("word").mapInArrow(run, "key long, part int, lookup boolean, word string, mask long")


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, list_size: int = LIST, prune: int = PRUNE) -> DataFrame:
    """a, b: all pairs of near words, both ways."""
    both = stored(lists_and_lookups(words, dictionary(words, prune), least_length, list_size))
    listed = both.where("NOT lookup").select("key", "part", F.col("word").alias("b"), F.col("mask").alias("mask_b"))
    sought = both.where("lookup").select("key", "part", F.col("word").alias("a"), F.col("mask").alias("mask_a"))
    alike = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2
    found = (sought.join(listed, ["key", "part"]).where(alike & (F.levenshtein("a", "b", 1) == 1))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = stored(found)
    return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last.  Every form is more frequent
    than its word, so there are no circles; each round doubles the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("from"), F.col("root").alias("to"))
        after = stored(now.join(ahead, F.col("root") == F.col("from"), "left")
                       .select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
                      list_size: int = LIST, prune: int = PRUNE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stored(word_counts(docs, least_length, least_count))
    pairs = near_pairs(words, least_length, list_size, prune)
    near = (pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").groupBy("a")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word"))).alias("best")))
    strong = -F.col("best.less") >= ratio * F.col("n")
    base = stored(words.join(near, F.col("word") == F.col("a"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    roots = _roots(base.where("form IS NOT NULL")).select(F.col("word").alias("r_word"), "root")
    return (base.join(roots, F.col("word") == F.col("r_word"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
