"""Near-duplicate removal.

Token sets are per-row arrays (float16 embedding elements, I4, or word
shingles, I8).  The work is arranged so that no group ever expands into all
of its pairs:

1. ``collapse_copies``: identical sets are grouped by a 128-bit fingerprint
   of the sorted set (two salted xxhash64 values + size); the first row in
   order represents the group, the others are its copies.  A group of
   copies holding a third of all rows costs one partial aggregation.
2. ``marked``: from a threshold of ``MARKED`` on, tokens are dealt into buckets
   by their hash, about nine tokens each.  Two sets with a Jaccard similarity of
   t or more differ in few tokens, so in a set's first ``d + 1`` buckets (``d``: the
   most tokens it may differ in) at least one is the same in both: candidates meet
   in the lists of bucket hashes.  A set is reduced to one hash per nine tokens
   inside its task; sets are neither written nor shuffled, and those that meet
   another one are made anew for exact verification.  ``prefix_tokens`` does the same for lower
   thresholds: tokens have one order in all sets, their own with the
   frequent ones last; a set's prefix is its first ``n - ceil(t n) + 1`` tokens,
   and two similar sets always share a prefix token.  Size (and position) filters
   follow, then exact verification.
3. ``leader_rounds``: the reference's rule - in row order, a row is a duplicate
   iff it is similar to an already *kept* row.  A row that is the earliest
   undecided one of all its lists is kept for certain and leads them; members
   of a list are compared with its leader only, and similar ones are dropped
   and need no further comparison.  A round's candidates are at most the
   entries of the lists, however many near copies a family has.
4. ``jaccard_pairs`` + ``greedy_keep_first``: what the rounds leave undecided
   (or, for the pair table, every representative) is compared list by list.  A
   list over ``BLOCK`` rows is dealt into blocks and compared block against
   block.  Keep-first over the verified pairs is the lexicographically first
   maximal independent set, not connected components.
5. ``lsh_keep_first``: the reference's own relation (MinHash, 64 hashes,
   3 bands x 21 rows; colliding in a band bucket with a kept row makes a
   duplicate) decided by bucket *claims*: per round, a row that is the
   earliest undecided row of every bucket it is in is kept and claims its
   buckets; undecided rows in a claimed bucket are duplicates.  Work per
   round is linear in rows x bands.  The hashes are modular (``a x + b`` modulo
   a prime over 31-bit bases from md5), so any engine gets the same values.

Every round writes its undecided rows only; an empty set is a copy of the first
empty set in every mode.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import col
from quire.session import stored, stored_counted
from quire.operators.skew import BLOCK, lookup_join, meet_in_lists

NUM_PERM = 64
BANDS = 3
ROWS = 21
#: Leader rounds go on while a round decides this share of what was undecided.
WORTH = 0.1
#: So many ids go to every task; a list of more rows than HOT_LIST is long.
FEW_IDS = 1_000_000
HOT_LIST = 100
#: Sets of about so many tokens are compared with as many others in one place, and so many pairs.
BLOCK_TOKENS = 1 << 21
BLOCK_PAIRS = 50_000
#: From this threshold on, sets meet in the lists of their marks; below, buckets would hold too few tokens.
MARKED = 0.8
#: Modulus of the portable hashes, and the base of a shingle's polynomial.
PRIME = (1 << 31) - 1
SHINGLE_BASE = 1_000_003
#: Inside a task: texts worked at a time, words whose hashes are kept, elements hashed at a time.
TEXTS = 256
KNOWN_WORDS = 1 << 18
CHUNK = 1 << 15


# ------------------------------------------------------------ token sets --

def float16(x) -> Column:
    """I4: a float rounded to the nearest half-precision value (ties to
    even), computed arithmetically: spacing 2^(max(e, -14) - 10) for
    binade e.  The binade is corrected against exact powers of two, so a
    log rounding error can never pick the wrong spacing."""
    v = col(x).cast("double")
    a = F.abs(v)
    e0 = F.floor(F.log2(a))
    e1 = F.when(F.pow(F.lit(2.0), e0 + 1) <= a, e0 + 1).otherwise(e0)
    e = F.when(F.pow(F.lit(2.0), e1) > a, e1 - 1).otherwise(e1)
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.rint(v / step) * step)


def embedding_set(c) -> Column:
    """I4: distinct float16 elements of an embedding (order ignored)."""
    return F.array_sort(F.array_distinct(F.transform(col(c), lambda x: float16(x))))


def words_of(c) -> Column:
    """Lower-cased whitespace words of a text."""
    return F.array_remove(F.split(F.lower(col(c)), r"\s+"), "")  # blanks at an end leave an empty word


def word_shingles(words, k: int = 3) -> Column:
    """I8: distinct k-word shingles of a *words column* (see ``words_of``;
    stage the words as a column first so the split runs once per row).  A
    text shorter than k words is one shingle."""
    w = col(words)
    n = F.size(w)
    sh = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                     lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.array_sort(F.array_distinct(F.filter(sh, lambda s: F.length(s) > 0)))


def shingle_sets(df, id_col: str, text_col: str, k: int = 3, hashed: bool = True):
    """(id, tokens): the distinct k-word shingles of each text.

    ``hashed`` (the default) represents a shingle by a 64-bit hash of its k
    word hashes: words are hashed once, k shifted copies of the hash array
    are zipped natively, and no shingle string is ever built.  Sizes and
    Jaccard values are those of the string shingles unless two distinct
    shingles of the corpus collide (odds about n^2 / 2^65 for n distinct
    shingles).  ``hashed=False`` returns the shingle strings."""
    words = df.select(F.col(id_col), words_of(text_col).alias("_w"))
    if not hashed:
        return words.select(F.col(id_col), word_shingles("_w", k).alias("tokens"))
    h = words.select(F.col(id_col), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    zipped = F.arrays_zip(*[F.slice("_h", i + 1, 1 << 30) for i in range(k)])  # fields "0".."k-1"
    firsts = F.slice(zipped, 1, F.greatest(F.size("_h") - k + 1, F.lit(1)))
    sh = F.transform(firsts, lambda z: F.xxhash64(*[z[str(i)] for i in range(k)]))
    return h.select(F.col(id_col), F.sort_array(F.array_distinct(sh)).alias("tokens"))  # no comparator to interpret, as array_sort has


def embed_texts(df: DataFrame, text_col: str, embed, out_col: str = "embedding",
                batch_size: int = 256) -> DataFrame:
    """L2: text -> embedding with a user model, as an iterator pandas UDF
    (the model loads once per task and sees Arrow batches).  ``embed`` maps
    a list of texts to a list of float vectors."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for start in range(0, len(texts), batch_size):
                out.extend(embed(list(texts.iloc[start:start + batch_size])))
            yield pd.Series([list(map(float, v)) for v in out])

    return df.withColumn(out_col, run(F.col(text_col)))


# ------------------------------------------------------------ exact sets --

class Collapsed(NamedTuple):
    reps: DataFrame    # id, ord, tokens, n
    copies: DataFrame  # id, copy_of
    rows: DataFrame    # id, ord, n of the representatives, with marks if a threshold was given


def _known(ids: DataFrame, n: int) -> DataFrame:
    """``n`` stored ids as the small side of a semi or anti join: up to ``FEW_IDS``
    are sent to the tasks, so that token sets are filtered where they are read."""
    return F.broadcast(ids) if n <= FEW_IDS else ids


def collapse_copies(sets: DataFrame, id_col: str, order_col: str, tokens_col: str,
                    threshold: float | None = None) -> Collapsed:
    """Identical sets -> one representative (first in order) + copy rows.  One
    pass over the sets writes a fingerprint of each (and its marks for
    ``threshold``); copies are found by that and id alone.  The sets themselves are
    not written: where ``reps`` is read they are made anew, so a source that is
    costly beyond its tokens should be stored."""
    s = sets.select(F.col(id_col).alias("id"), F.col(order_col).alias("ord"), F.col(tokens_col).alias("tokens"))
    s = s.withColumn("n", F.size("tokens")).withColumn(
        "_fp", F.struct("n", F.xxhash64(F.lit("a"), "tokens").alias("h1"), F.xxhash64(F.lit("b"), "tokens").alias("h2")))
    rows = stored(s.drop("tokens") if threshold is None else marked(s, threshold))
    rep = rows.groupBy("_fp").agg(F.min_by("id", "ord").alias("rep"), F.count(F.lit(1)).alias("_rows"))
    tagged = lookup_join(rows.select("id", "_fp"), rep, "_fp", count_col="_rows").drop("_rows")  # a group of copies is a hot key: salted
    copies, n = stored_counted(tagged.where(F.col("id") != F.col("rep")).select("id", "_fp", F.col("rep").alias("copy_of")))
    gone = _known(copies.select("id", "_fp"), n)
    own = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").isEmpty()  # else an id has several sets
    reps = s.join(gone.select("id"), "id", "left_anti") if own else s.join(gone, ["id", "_fp"], "left_anti")
    return Collapsed(reps.select("id", "ord", "tokens", "n"), copies.select("id", "copy_of"),
                     rows.join(gone, ["id", "_fp"], "left_anti").drop("_fp"))


def _sets_of(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of the given distinct ids, stored.  Ids are sent to the tasks,
    ``FEW_IDS`` or so at a time, so that no other set is shuffled, written or made (as a
    condition, unlike a join, the ids go below what makes the tokens)."""
    ids, n = stored_counted(ids)
    parts = max(1, -(-n // FEW_IDS))
    part = lambda df, k: df.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k) if parts > 1 else df
    return reduce(DataFrame.union, [stored(part(reps, k).where(F.col("id").isin(F.broadcast(part(ids, k))))) for k in range(parts)])


def marked(sets: DataFrame, threshold: float) -> DataFrame:
    """``sets`` with ``marks`` (whole numbers) in place of ``tokens``: two different
    sets with a Jaccard similarity of ``threshold`` or more share a mark.

    Similar sets of ``na`` and ``nb`` tokens differ in at most ``d`` = (1 - t) / (1 + t)
    (na + nb) of them.  Tokens are dealt into buckets by hash, as many for all sets
    of a size class (a power of two), and a bucket's mark is a hash of its tokens.
    A token that one set lacks changes one bucket, so of any ``d + 1`` buckets
    in which either has a token one is the same in both: each set's first ``d + 1``
    filled buckets, taken in their order, hold such a one.  A set that may be similar to one
    of the next class has marks of that class as well, and a set with too few filled
    buckets has one more mark, which all such sets share."""
    longs = sets.schema["tokens"].dataType.simpleString() == "array<bigint>"
    keep = [c for c in sets.columns if c != "tokens"]
    x = sets.select(*keep, F.col("tokens") if longs else F.transform("tokens", lambda v: F.xxhash64(v)).alias("tokens"))
    schema = x.select(*keep, F.array(F.lit(0).cast("long")).alias("marks")).schema

    def run(batches):
        for batch in batches:
            tokens, n = batch.column("tokens"), batch.num_rows
            size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
            flat = np.asarray(pc.fill_null(tokens.flatten(), 0)).astype(np.int64).view(np.uint64)
            end, i = np.cumsum(size), 0
            while i < n:  # rows with about CHUNK elements
                start = end[i] - size[i]
                j = max(i + 1, int(np.searchsorted(end, start + CHUNK, "right")))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in keep]
                                                 + [_marks(flat[start:end[j - 1]], size[i:j], threshold)], schema.names)
                i = j

    return x.mapInArrow(run, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _most_apart(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    return np.floor((na + nb) * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)


def _marks(tokens: np.ndarray, size: np.ndarray, threshold: float) -> pa.ListArray:
    """The marks of each row's set."""
    t = threshold - 1e-9
    step = np.uint64(32)
    largest = np.floor(size / t).astype(np.int64)  # a similar set's size at most
    top = np.left_shift(1, np.ceil(np.log2(np.maximum(size, 1) + 1)).astype(np.int64))  # of the class: 2^(k-1) to 2^k - 1 tokens
    rows, marks = [], []
    x, of = _mixed(tokens), np.repeat(np.arange(len(size)), size)
    for limit, most in ((top, np.minimum(largest, top - 1)), (2 * top, np.where(largest >= top, largest, 0))):
        need = np.where(most >= size, _most_apart(size, most, t) + 1, 0)
        need[need == 1] = 0  # nothing may differ: such a pair would be copies
        if not need.any():
            continue
        buckets = np.where(need > 0, _most_apart(limit, limit, t) + 1, 0)
        start = np.cumsum(buckets) - buckets
        used = need[of] > 0
        own, mine = of[used], x[used]
        at = start[own] + (((mine >> step) * buckets[own].astype(np.uint64)) >> step).astype(np.int64)
        total = np.zeros(int(buckets.sum()), np.uint64)
        np.add.at(total, at, mine)
        filled = np.bincount(at, minlength=len(total)) > 0
        row = np.repeat(np.arange(len(size)), buckets)
        before = np.r_[0, np.cumsum(filled)]
        first = filled & (before[1:] - before[start[row]] <= need[row])
        place = (limit[row].astype(np.uint64) << step) + (np.arange(len(row)) - start[row]).astype(np.uint64)
        rows.append(row[first])
        marks.append(_mixed(total[first] ^ _mixed(place[first])))
        few = np.flatnonzero((need > 0) & (np.bincount(row[first], minlength=len(size)) < need))
        rows.append(few)
        marks.append(_mixed(limit[few].astype(np.uint64)))
    row = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(row, kind="stable")
    flat = np.concatenate([*marks, np.empty(0, np.uint64)])[order].view(np.int64)
    cut = np.r_[0, np.cumsum(np.bincount(row, minlength=len(size)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))


def shared_marks(rows: DataFrame) -> DataFrame:
    """id, ord, n, token, pos: the marks (``token``) of each row that another row
    has, too.  They have no place in a set: ``pos`` is 1, which filters nothing."""
    x = rows.select("id", "ord", "n", F.explode("marks").alias("token"))
    sizes, n = stored_counted(x.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    met = x.join(F.broadcast(sizes), "token") if n <= FEW_IDS else lookup_join(x, sizes, "token", count_col="m")
    return stored(met.select("id", "ord", "n", "token", F.lit(1).alias("pos")))


def prefix_tokens(reps: DataFrame, threshold: float = 0.9, hot: int = HOT_LIST) -> DataFrame:
    """id, ord, n, token, pos: the prefix of each set, as far as another set's
    prefix has the token; ``pos`` is the token's place (from 1) in the set.

    Any order of the tokens that holds for all sets will do.  Theirs is the
    tokens' own, which needs no count, so that only prefixes (a tenth of the
    tokens) leave the rows; the frequent tokens come last, rarest first.  Those
    are found in the sets that a list of more than ``hot`` rows holds, by counting
    all of their tokens; there are at most a million (``hot`` grows for that),
    which are sent to the tasks.  With them, prefixes are taken once more inside
    the rows (``_moved_last``): no set is written or shuffled for its order."""
    plen = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")

    def heads(sets: DataFrame, first: Column) -> DataFrame:  # _outer: a plain explode would infer a filter that sorts again
        x = sets.select("id", "ord", "n", F.posexplode_outer(first).alias("_p", "token")).where(F.col("token").isNotNull())
        return stored(x.select("id", "ord", "n", "token", (F.col("_p") + 1).alias("pos")))

    def lists(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))

    rows = heads(reps, F.slice(F.sort_array("tokens"), F.lit(1), plen))
    hot = max(hot, (reps.agg(F.sum("n")).first()[0] or 0) // 1_000_000)
    sizes = lists(rows)
    long = sizes.where(F.col("m") > hot).select("token")
    if not long.isEmpty():
        ids, n = stored_counted(rows.join(F.broadcast(long), "token", "left_semi").select("id").distinct())
        df = (reps.join(_known(ids, n), "id", "left_semi").select(F.explode("tokens").alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("df")))
        late = stored(df.where(F.col("df") > hot)).orderBy("df", "token").select("token").toArrow().column("token")
        ordered = reps.select("id", "ord", "n", plen.alias("_k"), F.sort_array("tokens").alias("_tokens"))
        rows = heads(_moved_last(ordered, late.combine_chunks()), F.col("_tokens"))
        sizes = lists(rows)
    return stored(lookup_join(rows, sizes, "token", count_col="m").drop("m"))


def _moved_last(ordered: DataFrame, late: pa.Array) -> DataFrame:
    """id, ord, n, _tokens: the first ``_k`` tokens of each sorted set once the
    ``late`` ones have gone to its end, in the order of ``late``."""
    schema = ordered.drop("_k").schema

    def run(batches):
        for batch in batches:
            tokens, most = batch.column("_tokens"), np.asarray(pc.fill_null(batch.column("_k"), 0))
            size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
            flat, start, row = tokens.flatten(), np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
            rank = np.asarray(pc.fill_null(pc.index_in(flat, value_set=late), -1)).astype(np.int64) + 1
            order = np.argsort(row * (len(late) + 1) + rank, kind="stable")  # others keep their order, as rank 0
            first = order[np.arange(len(flat)) - np.repeat(start, size) < np.repeat(most, size)]
            cut = pa.array(np.r_[0, np.cumsum(np.minimum(size, most))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "ord", "n")]
                                             + [pa.ListArray.from_arrays(cut, flat.take(pa.array(first)))], schema.names)

    return ordered.mapInArrow(run, schema)


def _may_reach(threshold: float, a: str = "a", b: str = "b") -> Column:
    """Size and position filter of a candidate that meets in one list.  The
    first common token of two sets bounds their overlap by itself and what
    follows it in either set, so a similar pair passes in that list."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) + 1
    return ((nb >= na * threshold - 1e-9) & (na >= nb * threshold - 1e-9)
            & (rest >= (na + nb) * (threshold / (1 + threshold)) - 1e-9))


def _ends(cand: DataFrame) -> DataFrame:
    return cand.select(F.col("a").alias("id")).union(cand.select("b")).distinct()


def _verified(cand: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK_TOKENS,
              most: int = BLOCK_PAIRS) -> DataFrame:
    """(a, b, inter, jaccard) of the stored candidate pairs (a, b, na, nb) that reach
    the threshold, from the stored ``sets`` of both sides.

    The pairs of a family meet in one place, the group ``_g`` of the first row that its
    ``a`` is a candidate of, and a set travels once for all of them, not once a
    pair.  A group of more than ``block`` tokens or ``most`` pairs is dealt into
    blocks, and the pairs of two blocks are a group of their own."""
    if "_g" not in cand.columns:
        least = cand.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("_g"))
        cand = stored(cand.join(least, "a", "left").withColumn("_g", F.coalesce("_g", "a")))
    ends = lambda x, *cols: x.select("a", "na", *cols).union(x.select("b", "nb", *cols)).toDF("id", "n", *cols).distinct()
    m, tokens = cand.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("na") + F.col("nb")), F.lit(0))).first()
    if m <= most and tokens <= block:  # no group can be larger
        pairs = cand.withColumn("_i", F.lit(0)).withColumn("_j", F.lit(0))
    else:
        sizes = (ends(cand, "_g").groupBy("_g").agg(F.sum("n").alias("_n")).join(cand.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")), "_g")
                 .select("_g", F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.sqrt(F.col("_m") / most))).alias("_blocks"), F.col("_m")))
        own = lambda c: F.pmod(F.xxhash64(c), F.col("_blocks"))
        pairs = stored(lookup_join(cand, sizes, "_g", count_col="_m").select("a", "b", "na", "nb", "_g", own("a").alias("_i"), own("b").alias("_j")))
    group = ["_g", "_i", "_j"]
    sent, n = stored_counted(ends(pairs, *group).drop("n"))
    met = sets.select("id", "tokens").join(_known(sent, n), "id")
    schema = pairs.select("a", "b", "na", "nb", F.lit(0).cast("long").alias("inter")).schema
    inter = pairs.groupBy(*group).cogroup(met.groupBy(*group)).applyInArrow(_common, schema)
    j = F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
    return inter.select("a", "b", F.col("inter").cast("int").alias("inter"), j.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def _common(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs of a group with the number of their sets' common tokens."""
    tokens = sets.column("tokens").combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
    flat = tokens.flatten()
    if pa.types.is_floating(flat.type):
        flat = pc.add(flat, 0.0)  # -0.0 is 0.0
    code = flat.dictionary_encode(null_encoding="encode")
    known, code = len(code.dictionary), np.asarray(code.indices).astype(np.int64)
    start = np.cumsum(size) - size
    of: dict = {}
    for row, i in enumerate(sets.column("id").to_pylist()):
        of.setdefault(i, []).append(row)
    pairs = pairs.select(["a", "b", "na", "nb"]).sort_by("a")
    in_a, kept, inter = np.zeros(known, bool), [], []
    firsts, seconds = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
    i = 0
    while i < len(firsts):
        j = i + 1
        while j < len(firsts) and firsts[j] == firsts[i]:
            j += 1
        for row in of.get(firsts[i], ()):
            mine = code[start[row]:start[row] + size[row]]
            in_a[mine] = True
            for k in range(i, j):
                for other in of.get(seconds[k], ()):
                    kept.append(k)
                    inter.append(int(np.count_nonzero(in_a[code[start[other]:start[other] + size[other]]])))
            in_a[mine] = False
        i = j
    return pairs.take(pa.array(kept, pa.int64())).append_column("inter", pa.array(inter, pa.int64()))


def _met(reps: DataFrame, threshold: float) -> DataFrame:
    """The lists in which sets may meet a similar one."""
    if threshold >= MARKED:
        return shared_marks(stored(marked(reps.select("id", "ord", "n", "tokens"), threshold)))
    return prefix_tokens(reps, threshold)


def _candidates(prefix: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, na, nb), stored: pairs of a list that may reach the threshold, a before b."""
    dealt, meet, once = meet_in_lists(prefix, "token", "id", block)
    return stored(dealt.alias("a").join(dealt.alias("b"), meet).where((F.col("a.ord") < F.col("b.ord")) & once & _may_reach(threshold))
                  .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct())


def jaccard_pairs(reps: DataFrame, threshold: float = 0.9, prefix: DataFrame | None = None,
                  block: int = BLOCK) -> DataFrame:
    """(a, b, inter, jaccard) for representatives a < b (by ``ord``) with
    Jaccard >= threshold - exact, via the lists of marks or prefix tokens +
    verification.  Lists of more than ``block`` rows are compared block against block."""
    cand = _candidates(_met(reps, threshold) if prefix is None else prefix, threshold, block)
    return _verified(cand, _sets_of(reps, _ends(cand)), threshold)


class Rounds(NamedTuple):
    decided: DataFrame     # id, kept
    open: DataFrame        # prefix rows of what is undecided
    lone: DataFrame        # id of undecided rows that share no list any more
    candidates: int        # pairs that were verified


def leader_rounds(reps: DataFrame, prefix: DataFrame, threshold: float = 0.9, worth: float = WORTH) -> Rounds:
    """Decide rows against the leaders of their lists, round by round, while a
    round decides at least the share ``worth`` of the undecided ones.  All
    decisions are those of the sequential rule.  ``reps`` is read in every round."""
    decided, compared = [], 0
    open_, lone = prefix, reps.join(prefix.select("id").distinct(), "id", "left_anti").select("id")
    while True:
        first = open_.groupBy("token").agg(F.min(F.struct("ord", "id", "n", "pos")).alias("f"), F.count(F.lit(1)).alias("m"))
        first = stored(first.select("token", "m", F.col("f.id").alias("first"), F.col("f.n").alias("n_first"),
                                    F.col("f.pos").alias("pos_first")))
        # every entry with its list's first row; a list of one row holds nothing to compare
        led = stored(lookup_join(open_, first, "token", count_col="m"))
        state = led.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("leads"), F.max("m").alias("most"))
        state = stored(state)
        n = state.count()
        if n == 0:
            break
        leads = stored(state.where("leads").select(F.col("id").alias("leader")))
        ruled = first.where("m > 1").join(leads, F.col("first") == F.col("leader"), "left_semi").select("token", "m")
        x = lookup_join(led.drop("m"), ruled, "token", count_col="m").where(F.col("id") != F.col("first"))
        a = F.struct(F.col("n_first").alias("n"), F.col("pos_first").alias("pos"))
        x = x.select(F.struct("n", "pos").alias("b"), a.alias("a"), F.col("first").alias("a_id"), F.col("id").alias("b_id"))
        cand = stored(x.where(_may_reach(threshold)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct())
        compared += cand.count()
        alone = cand.withColumn("_g", F.col("a"))  # no leader is led
        gone = stored(_verified(alone, reps, threshold).select(F.col("b").alias("id")).distinct())
        done = leads.select(F.col("leader").alias("id"), F.lit(True).alias("kept")).union(gone.select("id", F.lit(False).alias("kept")))
        done = stored(done)
        decided.append(done)
        open_ = stored(open_.join(done, "id", "left_anti"))
        if done.count() < worth * n:
            break
    kept = reduce(DataFrame.union, decided) if decided else reps.select("id", F.lit(True).alias("kept")).limit(0)
    return Rounds(kept, open_, lone, compared)


def greedy_keep_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept) - lexicographically first maximal independent set.

    ``nodes``: id, ord; ``edges``: a, b (undirected).  Each round keeps
    every undecided node without an undecided neighbour earlier in order and
    drops the undecided neighbours of the newly kept ones.  Nodes without an
    edge are kept at once and take no part in the rounds."""
    o = nodes.select("id", "ord")
    e = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = (e.join(o.withColumnRenamed("id", "a").withColumnRenamed("ord", "oa"), "a")
          .join(o.withColumnRenamed("id", "b").withColumnRenamed("ord", "ob"), "b"))
    e = stored(e.select("a", "b", "oa", "ob"))
    ends = e.select(F.col("a").alias("id")).distinct()
    decided = [o.join(ends, "id", "left_anti").select("id", F.lit(True).alias("kept"))]
    und = stored(ends)
    while not und.isEmpty():  # every round decides at least the first undecided node
        ue = stored(e.join(und.withColumnRenamed("id", "a"), "a", "left_semi").join(und.withColumnRenamed("id", "b"), "b", "left_semi"))
        blocked = ue.where(F.col("ob") < F.col("oa")).select(F.col("a").alias("id")).distinct()
        new = stored(und.join(blocked, "id", "left_anti"))
        gone = ue.join(new.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id")).distinct()
        done = stored(new.select("id", F.lit(True).alias("kept")).union(gone.select("id", F.lit(False).alias("kept"))))
        decided.append(done)
        und, e = stored(und.join(done, "id", "left_anti")), ue
    return reduce(DataFrame.unionByName, decided)


class Dedup(NamedTuple):
    kept: DataFrame        # id, kept (one row per input row)
    copies: DataFrame      # id, copy_of
    candidates: int        # pairs compared with leaders


def dedup_sets(sets: DataFrame, id_col: str, order_col: str, tokens_col: str,
               threshold: float = 0.9) -> Dedup:
    """I7 with exact Jaccard: copies collapsed, then leader rounds, then the
    verified pairs of what they leave open.  Sets that meet no other are kept;
    those that do are written once."""
    c = collapse_copies(sets, id_col, order_col, tokens_col, threshold if threshold >= MARKED else None)
    prefix = shared_marks(c.rows) if threshold >= MARKED else prefix_tokens(c.reps, threshold)
    met = stored(prefix.select("id").distinct())
    some = _sets_of(c.reps, met)
    r = leader_rounds(some, prefix, threshold)
    alone = c.rows.select("id").join(met, "id", "left_anti")
    kept = r.decided.unionByName(r.lone.union(alone).select("id", F.lit(True).alias("kept")))
    if not r.open.isEmpty():
        pairs = stored(_verified(_candidates(r.open, threshold), some, threshold))
        kept = kept.unionByName(greedy_keep_first(r.open.select("id", "ord").distinct(), pairs))
    return Dedup(kept.unionByName(c.copies.select("id", F.lit(False).alias("kept"))), c.copies, r.candidates)


# ------------------------------------------------------------------- LSH --

def portable_base(text) -> Column:
    """A whole number under ``PRIME`` from the first 32 bits of the md5 of a
    text: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(col(text).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(PRIME))


def portable_shingles(df: DataFrame, id_col: str, text_col: str, k: int = 3, keep: tuple = ()) -> DataFrame:
    """(id, keep..., tokens): distinct k-word shingles as polynomials of the
    words' portable bases; a shorter text is one shingle of its words."""
    x = df.select(id_col, *keep, F.lower(text_col).alias("_text"))
    schema = x.select(id_col, *keep, F.array(F.lit(0).cast("long")).alias("tokens")).schema

    def run(batches):
        get = _Bases().__getitem__
        for batch in batches:
            texts, n = batch.column("_text"), batch.num_rows
            for i in range(0, n, TEXTS):
                words = [(t or "").encode().split() for t in texts.slice(i, TEXTS).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, TEXTS) for c in (id_col, *keep)] + [_shingles(words, get, k)], schema.names)

    # lower case is Spark's, words end at its \s, which are the blanks of bytes.split
    return x.mapInArrow(run, schema).withColumn("tokens", F.array_distinct("tokens"))


class _Bases(dict):
    """Word -> ``portable_base``; a task keeps at most ``KNOWN_WORDS`` of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        base = self[word] = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4]) % PRIME
        return base


def _shingles(words: list[list[bytes]], base, k: int) -> pa.ListArray:
    """The polynomials of each row's shingles, repeats included."""
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    h = np.fromiter((base(w) for own in words for w in own), np.int64, int(end[-1]))
    value = h.copy()
    for i in range(1, k):  # of the window from each word on, as far as there are words
        value[:-i] = (value[:-i] * SHINGLE_BASE + h[i:]) % PRIME
    first = np.arange(len(h)) + k <= np.repeat(end, size)
    for r in np.flatnonzero((size > 0) & (size < k)):
        at = end[r] - size[r]
        value[at] = reduce(lambda acc, x: (acc * SHINGLE_BASE + int(x)) % PRIME, h[at:end[r]], 0)
        first[at] = True
    many = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(value[first]))


def embedding_tokens(c) -> Column:
    """The float16 elements of an embedding as portable bases (of the element
    in steps of 2**-24, a whole number)."""
    step = lambda x: (float16(x) * (1 << 24)).cast("long").cast("string")
    return F.array_distinct(F.transform(col(c), lambda x: portable_base(step(x))))


def lane_constants(num_perm: int = NUM_PERM) -> list[tuple[int, int]]:
    """(a, b) of each hash ``(a x + b) mod PRIME``, from md5 of its number."""
    def number(name: str) -> int:
        return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % (PRIME - 1)
    return [(1 + number(f"a{s}"), number(f"b{s}")) for s in range(num_perm)]


def minhash_signatures(sets: DataFrame, id_col: str, tokens_col: str, num_perm: int = NUM_PERM) -> DataFrame:
    """(id, sig) - per hash the minimum over the set's elements (whole
    numbers under ``PRIME``).

    A row's minima are taken inside its task (``signature_rows``), so that a set
    is one row before the shuffle; rows of one id count together.  An empty set
    has ``PRIME`` in every place."""
    return _by_id(signature_rows(sets, tokens_col, num_perm, (id_col,)), id_col, num_perm)


def _by_id(rows: DataFrame, id_col: str, num_perm: int) -> DataFrame:
    agg = rows.groupBy(id_col).agg(*[F.min(F.col("sig")[s]).alias(f"_h{s}") for s in range(num_perm)])
    return agg.select(id_col, F.array(*[F.col(f"_h{s}") for s in range(num_perm)]).alias("sig"))


def signature_rows(sets: DataFrame, tokens_col: str, num_perm: int, keep: tuple) -> DataFrame:
    """(keep..., sig): the MinHash values of each row's set."""
    x = sets.select(*keep, F.col(tokens_col).alias("_tokens"))
    schema = x.select(*keep, F.array(F.lit(0).cast("long")).alias("sig")).schema
    lanes = [(np.uint64(a), np.uint64(b + 1)) for a, b in lane_constants(num_perm)]

    def run(batches):
        for batch in batches:
            tokens = batch.column("_tokens")
            size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
            flat = tokens.flatten()
            if flat.null_count:  # a null element is none
                good = np.asarray(flat.is_valid())
                size = np.bincount(np.repeat(np.arange(len(size)), size)[good], minlength=len(size))
                flat = flat.drop_null()
            end, flat = np.cumsum(size), np.asarray(flat).astype(np.uint64)
            i, n = 0, len(size)
            while i < n:  # rows with about CHUNK elements
                start = end[i] - size[i]
                j = max(i + 1, int(np.searchsorted(end, start + CHUNK, "right")))
                j = min(j, i + CHUNK // num_perm)
                sig = _minima(flat[start:end[j - 1]], size[i:j], lanes)
                cut = pa.array(np.arange(j - i + 1, dtype=np.int32) * num_perm)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in keep]
                                                 + [pa.ListArray.from_arrays(cut, pa.array(sig.ravel()))], schema.names)
                i = j

    return x.mapInArrow(run, schema)


def _minima(tokens: np.ndarray, size: np.ndarray, lanes: list) -> np.ndarray:
    """rows x hashes: the least ``(a x + b) mod PRIME`` of each row.  ``PRIME`` is
    2**31 - 1, so the remainder of v is found by adding the digits of v + 1 to
    the base 2**31 twice, less one."""
    out = np.full((len(size), len(lanes)), PRIME, np.int64)
    used = np.flatnonzero(size)
    if not len(used):
        return out
    start = (np.cumsum(size) - size)[used]
    v, high, p, digit = np.empty_like(tokens), np.empty_like(tokens), np.uint64(PRIME), np.uint64(31)
    for s, (a, b) in enumerate(lanes):
        np.multiply(tokens, a, out=v)
        v += b
        for _ in range(2):
            np.right_shift(v, digit, out=high)
            v &= p
            v += high
        out[used, s] = np.minimum.reduceat(v, start).astype(np.int64) - 1
    return out


def lsh_buckets(sig, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One bucket id per band (hash of the band's slice and its index)."""
    s = col(sig)
    return F.array(*[F.xxhash64(F.lit(b), F.slice(s, b * rows + 1, rows)) for b in range(bands)])


def lsh_keep_first(sets: DataFrame, id_col: str, order_col: str, tokens_col: str,
                   num_perm: int = NUM_PERM, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """I5-I7, reference semantics: (id, kept).  Tokens are whole numbers under
    ``PRIME`` (``portable_shingles``); empty sets collide with each other."""
    s = sets.select(F.col(id_col).alias("id"), F.col(order_col).alias("ord"), F.col(tokens_col).alias("t"))
    s = stored(signature_rows(s, "t", num_perm, ("id", "ord")))  # sets are read once and not written
    rb = s.select("id", "ord").join(_by_id(s, "id", num_perm), "id").select(
        "id", "ord", F.posexplode(lsh_buckets("sig", bands, rows)).alias("band", "h"))
    rb = stored(rb.select("id", "ord", F.struct("band", "h").alias("bucket")))
    decided: list[DataFrame] = []
    while not rb.isEmpty():  # every round decides at least the first undecided row
        first = rb.groupBy("bucket").agg(F.min(F.struct("ord", "id")).alias("f"), F.count(F.lit(1)).alias("m"))
        first = first.select("bucket", "m", F.col("f.id").alias("first"))
        led = stored(lookup_join(rb, first, "bucket", count_col="m").drop("m"))  # a bucket of copies is a hot key
        new = stored(led.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("k")).where("k").select("id"))
        claimed = (led.where(F.col("id") == F.col("first")).join(new, "id", "left_semi").select("bucket"))
        sizes = led.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
        gone = (lookup_join(led, sizes.join(claimed, "bucket", "left_semi"), "bucket", count_col="m")
                .where(F.col("id") != F.col("first")).select("id").distinct())
        done = stored(new.select("id", F.lit(True).alias("kept")).union(gone.select("id", F.lit(False).alias("kept"))))
        decided.append(done)
        rb = stored(rb.join(done, "id", "left_anti"))
    return reduce(DataFrame.union, decided) if decided else s.select("id", F.lit(True).alias("kept"))
