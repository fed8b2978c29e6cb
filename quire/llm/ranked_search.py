"""Ranked lexical search for many queries at once, with shared sub-queries.

Every item of a query table ranks all documents by a sum of term scores.  Items
share terms, so their sums share parts; each shared part is added up once per
document.

1. Items (distinct rows of item_id and text) become (term, repeats) lists, dealt
   into blocks of about ``BLOCK_ENTRIES`` entries.  What travels to the tasks
   belongs to one block and so has a fixed size, however many items there are.
2. One pass over the texts writes the postings of the block's terms: per document
   its length and the numbers and counts of the query terms that it holds.  The
   document frequencies and lengths are sums over that table.  Texts are read
   once a block; no posting is shuffled.
3. Shared term sets are mined: terms are numbered so that terms of the same items
   stand side by side (by the smallest hash of their items), and each item's
   numbers are cut in two again and again at aligned places.  Equal pieces of
   different items are one node: the nodes form a graph whose leaves are terms,
   whose inner nodes add two nodes, and whose roots are the items.
4. A scoring task holds one accumulator per node and document of a small group of
   documents.  It fills the leaves from the postings, adds up each inner node
   once, however many items share it, and reads the items' scores off the roots.
   It emits the ``top`` best documents of every item; two ranking steps (salted,
   then per item) join the tasks' lists.

All scores are 64-bit integers; only the logarithm of a term's weight is a
double.  A null or empty text has no terms: such documents are not counted and
match nothing, such items have no rows.  Equal scores are ranked by doc_id, a
null id last.  Repeated rows of documents are documents of their own, each with
a rank; equal rows of items are one item.  A very long text is one row of a task.
Other columns of either table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.arrays import LOWER, U64, blocks, byte_set, mix64, runs, segment_starts, span_hash
from quire.llm.frames import documents_of, stored

TOP = 20
BLOCK_ENTRIES = 1 << 20
CELLS = 1 << 22  # accumulators (64 bits each) of a task
SALTS = 16
IS_TERM = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _term_hashes(column: pa.Array):
    """(first row, number of rows, row and hash of each term) per block."""
    for first, data, offsets in blocks(column):
        low = LOWER[data]
        starts, ends, rows = runs(low, offsets, IS_TERM)
        yield first, len(offsets) - 1, rows, span_hash(low, starts, ends)


def _pair_counts(rows: np.ndarray, values: np.ndarray):
    """(row, value, count) of the distinct pairs, by row and value."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    at = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]) if len(rows) else np.empty(0, np.int64)
    return rows[at], values[at], np.diff(np.r_[at, len(rows)])


def item_entries(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id) and (item, term, q): the terms of each item and how
    often it repeats them.  ``item`` names a distinct row of the items."""
    named = stored(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))

    def run(batches):
        for batch in batches:
            names = batch.column("item")
            for first, _, rows, terms in _term_hashes(batch.column("text")):
                row, term, q = _pair_counts(rows, terms)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(first + row)), pa.array(term.view(np.int64)), pa.array(q.astype(np.int64))],
                                                 ["item", "term", "q"])

    entries = stored(named.select("item", "text").mapInArrow(run, "item long, term long, q long"))
    return named.drop("text"), entries


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term: its length and the
    places in ``terms`` (sorted hashes) of the query terms that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of one block
    source = documents_of(docs).where("text IS NOT NULL")

    def run(batches):
        known = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, n_rows, rows, found in _term_hashes(batch.column("text")):
                n = np.bincount(rows, minlength=n_rows)
                have = np.flatnonzero(n)
                if len(known):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hit = known[place] == found
                    row, term, tf = _pair_counts(rows[hit], place[hit])
                else:
                    row, term, tf = (np.empty(0, np.int64) for _ in range(3))
                cut = pa.array(np.searchsorted(row, np.r_[have, n_rows]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first + have)), pa.array(n[have].astype(np.int64)),
                     pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tfs"])

    none = F.array(F.lit(0))
    schema = source.select("doc_id", F.lit(0).cast("long").alias("n"), none.alias("terms"), none.alias("tfs")).schema
    return source.mapInArrow(run, schema)


@dataclass
class Sharing:
    """The graph of shared sums.  Nodes 0 to len(leaf_term)-1 are leaves; a
    step adds nodes ``left`` and ``right`` into the next nodes."""
    leaf_term: np.ndarray  # place of the leaf's term in the list of terms
    leaf_q: np.ndarray     # its repeats in the item
    steps: list[tuple[np.ndarray, np.ndarray]]
    roots: np.ndarray      # node of each item
    items: np.ndarray      # names of the items

    @property
    def size(self) -> int:
        return len(self.leaf_term) + sum(len(x) for x, _ in self.steps)

    def sums(self, by_term: np.ndarray) -> np.ndarray:
        """items x documents: sums from terms x documents."""
        acc = np.empty((self.size, by_term.shape[1]), np.int64)
        at = len(self.leaf_term)
        np.multiply(by_term[self.leaf_term], self.leaf_q[:, None], out=acc[:at])
        for left, right in self.steps:
            np.add(acc[left], acc[right], out=acc[at:at + len(left)])
            at += len(left)
        return acc[self.roots]


def shared_sets(item: np.ndarray, term: np.ndarray, q: np.ndarray) -> Sharing:
    """Mine the term sets that the items of one block share."""
    names, item = np.unique(item, return_inverse=True)
    leaf, own = np.unique(np.stack([term, q]), axis=1, return_inverse=True)
    own = own.reshape(-1)
    n = leaf.shape[1]
    # leaves with the same items get neighbouring numbers
    least = np.full((2, n), np.iinfo(np.uint64).max, np.uint64)
    for i in range(2):
        np.minimum.at(least[i], own, mix64(item.astype(np.uint64) * U64(2) + U64(i)))
    order = np.lexsort((np.arange(n), least[1], least[0]))
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    order_in = np.lexsort((number[own], item))
    item, number = item[order_in], number[own][order_in]
    # a piece is an item's leaves of one aligned range; its name is a sum of hashes
    name = mix64(number.astype(np.uint64) + U64(1))
    node = number.copy()  # leaves are nodes 0 to n-1 in the new order
    known = dict(zip(mix64(np.arange(n, dtype=np.uint64) + U64(1)).tolist(), range(n)))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    size = n
    while len(number) > len(names):
        number = number >> 1
        pair = np.flatnonzero((item[1:] == item[:-1]) & (number[1:] == number[:-1]))
        if len(pair) == 0:
            continue
        both = name[pair] + name[pair + 1]
        new, at = np.unique(both, return_index=True)
        fresh = [i for i, x in enumerate(new.tolist()) if x not in known]
        steps.append((node[pair][at[fresh]], node[pair + 1][at[fresh]]))
        known |= zip(new[fresh].tolist(), range(size, size + len(fresh)))
        size += len(fresh)
        name[pair] = both
        node[pair] = [known[x] for x in both.tolist()]
        keep = np.ones(len(item), bool)
        keep[pair + 1] = False
        item, number, name, node = item[keep], number[keep], name[keep], node[keep]
    return Sharing(leaf[0][order], leaf[1][order], steps, node, names)


def _best(scores: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item, first within salts, then over all."""
    by = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    salted = scores.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = (salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*by)))
           .where(F.col("r") <= top).drop("r", "salt"))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= top)


def scored(posted: DataFrame, weights: np.ndarray, graph: Sharing, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """item, score, doc_id: of each task the ``top`` best documents per item."""
    shared = posted.sparkSession.sparkContext.broadcast((weights, graph))  # of one block

    def keep(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
        item = np.asarray(table.column("item"))
        start = segment_starts(item)
        rank = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)]))
        return table.filter(pa.array(rank < top))

    def run(batches):
        w, g = shared.value
        width = max(1, CELLS // max(1, g.size))
        least = np.ones(len(g.items), np.int64)  # a lower score is in no list
        best = None
        for batch in batches:
            found = [] if best is None else [best]
            ids, lists = batch.column("doc_id"), batch.column("terms")
            cut = np.asarray(lists.offsets).astype(np.int64)
            terms = np.asarray(lists.values)
            tf = np.asarray(batch.column("tfs").values).astype(np.int64)
            m = 75 + (25 * np.asarray(batch.column("n")) * n_docs) // max(1, n_terms)
            for i in range(0, batch.num_rows, width):
                j = min(batch.num_rows, i + width)
                a, b = cut[i], cut[j]
                doc = np.repeat(np.arange(j - i), np.diff(cut[i:j + 1]))
                by_term = np.zeros((len(w), j - i), np.int64)
                by_term[terms[a:b], doc] = w[terms[a:b]] * ((1_000_000_000 * tf[a:b]) // (1000 * tf[a:b] + 12 * m[i + doc]))
                sums = g.sums(by_term)
                item, doc = np.nonzero(sums >= least[:, None])
                if len(item):
                    found.append(pa.table({"item": pa.array(item.astype(np.int64)), "score": pa.array(sums[item, doc]),
                                           "doc_id": ids.take(pa.array(i + doc))}))
            if found:
                best = keep(pa.concat_tables(found))
                item, score = np.asarray(best.column("item")), np.asarray(best.column("score"))
                n = np.bincount(item, minlength=len(least))
                last = np.flatnonzero(np.r_[item[1:] != item[:-1], True])
                full = n[item[last]] == top
                least[item[last][full]] = score[last][full]
        if best is not None:
            names = pa.array(g.items[np.asarray(best.column("item"))])
            yield from best.set_column(0, "item", names).to_batches()

    source = posted.select("doc_id", "n", "terms", "tfs")
    schema = source.select(F.lit(0).cast("long").alias("item"), F.lit(0).cast("long").alias("score"), "doc_id").schema
    return source.mapInArrow(run, schema)


def block_scores(docs: DataFrame, entries: DataFrame, top: int = TOP) -> DataFrame:
    """item, score, doc_id, rank for one block of items."""
    got = entries.toArrow()  # about BLOCK_ENTRIES rows
    item, term, q = (got.column(c).to_numpy() for c in ("item", "term", "q"))
    terms, place = np.unique(term.view(np.uint64), return_inverse=True)
    graph = shared_sets(item, place.astype(np.int64), q)
    posted = stored(postings(docs, terms))
    total = posted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total["docs"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    known = df.select("term", weight.alias("w")).toArrow()  # one row per term of the block
    weights = np.zeros(len(terms), np.int64)
    weights[known.column("term").to_numpy()] = known.column("w").to_numpy()
    return _best(scored(posted, weights, graph, total["docs"], total["terms"], top), top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The ``top`` documents of every item with a score above 0: item_id, rank
    (from 1), doc_id, score."""
    names, entries = item_entries(items)
    n_blocks = max(1, -(-entries.count() // block_entries))
    parts = []
    for i in range(n_blocks):
        part = entries if n_blocks == 1 else entries.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i)
        parts.append(stored(block_scores(docs, part, top)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same rows in SQL, written apart from the code above.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(ws) AS t FROM i) GROUP BY ALL),
c AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, nd),
x AS (SELECT k, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(ws)::BIGINT * nd) // l)))) AS s
      FROM p JOIN f USING (t) JOIN d USING (k), c),
s AS (SELECT i, item_id, k, sum(q * s)::BIGINT AS score FROM q JOIN x USING (t) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN d USING (k) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
