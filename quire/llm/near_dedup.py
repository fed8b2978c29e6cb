"""Near-duplicate removal by circulant MinHash with exact verification.

1. A document is the set of its distinct shingles of ``k`` words (a shorter
   text is one shingle), each a 64-bit hash.  Equal sets are collapsed first,
   by a 128-bit sum over the set, so a group of copies becomes one node.
2. Circulant MinHash: the first permutation sends a shingle to a place on a
   circle of 2**32; the second permutation, shifted by j steps, gives signature
   coordinate j = min over the set of perm2(place + j).  Two permutations make
   all ``bands * ROWS`` coordinates.
3. Banding: nodes that agree in all rows of a band share a bucket.  In each
   bucket the members are compared with its first node only, which is linear
   in the bucket.  Comparing is exact: intersection over union of the full
   sets, after a bound on the sizes.
4. The links' connected components join the members of a family, whatever its
   size.  Members that are not in the component of their bucket's first node
   (their pivot) are compared with all nodes of that pivot, block against
   block: blocks have a bounded size, a task holds two of them, and only links
   that join components leave it.  These merge components in turn.

No pair in a bucket that could be a link of two components is left out.  The
work of step 4 is the number of left-over members times the size of their
pivot's group, in bounded pieces; it is nothing for families that step 3 joins.  Two texts at the bound
(0.85) share no bucket with a probability of (1 - 0.85**4)**24, about 2e-8.
The pipeline's stage has shingles of five words and the bound 0.8, with 34 bands:
(1 - 0.8**4)**34, about 2e-8 too.

Full sets are only made for nodes that share a bucket: their documents are
found again by a bit table of their ids (fixed size, at most 16 MB).  A null or
empty text has no shingle, is linked with nothing and is its own component.  A
null id is in no component (null) and kept.  Rows equal in id and text are one
document; rows that share an id only are separate nodes under that id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import IS_NOT_SPACE, LOWER, U64, blocks, mix32, mix64, runs, shingle_hash, span_hash
from quire.llm.frames import documents_of, stored, text_key
from quire.operators.components import connected_components

SHINGLE = 3
BANDS, ROWS = 24, 4
PART, WHOLE = 85, 100  # linked if WHOLE * intersection >= PART * union
STAGE_SHINGLE, STAGE_PART, STAGE_BANDS = 5, 80, 34  # of the pipeline's stage
MOST_BITS = 27
BLOCK_SHINGLES, BLOCK_NODES = 500_000, 1000  # of a block of a pivot's nodes
FIRST_PERMUTATION, SECOND_PERMUTATION = U64(0x5DEECE66D1234567), np.uint32(0x7F4A7C15)


def _sets(column, k: int):
    """(first row, row cuts, shingles): the sorted distinct shingles of each
    row of a block, one after another."""
    for first, data, offsets in blocks(column):
        low = LOWER[data]
        starts, ends, rows = runs(low, offsets, IS_NOT_SPACE)
        words = span_hash(low, starts, ends)
        s = shingle_hash(words, k)
        n = len(offsets) - 1
        cut = np.searchsorted(rows, np.arange(n + 1))
        out = []
        for r in range(n):
            a, b = cut[r], cut[r + 1]
            if b - a >= k:
                out.append(np.unique(s[a:b - k + 1]))
            else:
                out.append(shingle_hash(words[a:b], int(b - a)) if b > a else np.empty(0, np.uint64))
        sizes = np.array([len(x) for x in out], np.int64)
        yield first, np.r_[0, np.cumsum(sizes)], np.concatenate(out)


def _signature(cuts: np.ndarray, shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """rows x (bands * ROWS) circulant MinHash coordinates (rows with shingles)."""
    place = (mix64(shingles ^ FIRST_PERMUTATION) >> U64(32)).astype(np.uint32)
    sig = np.empty((bands * ROWS, len(cuts)), np.uint32)
    for j in range(bands * ROWS):
        sig[j] = np.minimum.reduceat(mix32((place + np.uint32(j)) ^ SECOND_PERMUTATION), cuts)
    return sig.T


def _bands(sig: np.ndarray) -> np.ndarray:
    """rows x bands bucket keys."""
    bands = sig.shape[1] // ROWS
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << U64(32), (len(sig), bands))
    parts = sig.astype(np.uint64).reshape(len(sig), bands, ROWS)
    for i in range(ROWS):
        h = mix64(h + parts[:, :, i] * U64(0x9E3779B97F4A7C15))
    return h


def signatures(docs: DataFrame, k: int = SHINGLE, n_bands: int = BANDS) -> DataFrame:
    """doc_id, key (of the text), h1, h2 (name of the set), n_shingles and bands
    of every row."""
    source = documents_of(docs).withColumn("key", text_key())

    def run(batches):
        for batch in batches:
            for first, cuts, shingles in _sets(batch.column("text"), k):
                n = len(cuts) - 1
                sizes = np.diff(cuts)
                have = np.flatnonzero(sizes)
                h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                width = np.where(sizes > 0, n_bands, 0)
                bands = np.empty((0, n_bands), np.uint64)
                if len(have):
                    at = cuts[:-1][have]
                    h1[have] = np.add.reduceat(mix64(shingles + U64(1)), at)
                    h2[have] = np.add.reduceat(mix64(~shingles), at)
                    bands = _bands(_signature(at, shingles, n_bands))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("key").slice(first, n), pa.array(h1.view(np.int64)),
                     pa.array(h2.view(np.int64)), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)], pa.int32()), pa.array(bands.ravel().view(np.int64)))],
                    ["doc_id", "key", "h1", "h2", "n_shingles", "bands"])

    long = F.lit(0).cast("long")
    schema = source.select("doc_id", "key", long.alias("h1"), long.alias("h2"), long.alias("n_shingles"), F.array(long).alias("bands")).schema
    return source.mapInArrow(run, schema)


def _id_table(ids: DataFrame) -> np.ndarray:
    """A bit table of the hashes in column ``x``: 16 bits per id, at most
    2**27 bits; beyond that it lets more rows pass, which the join then drops."""
    n = ids.count()
    bits = min(MOST_BITS, max(16, int(n * 16).bit_length()))
    got = (ids.select(F.shiftrightunsigned("x", 64 - bits).alias("b")).groupBy(F.shiftright("b", 6).alias("at"))
           .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toArrow())
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[np.asarray(got.column("at"))] = np.asarray(got.column("bits")).view(np.uint64)
    return table


def full_sets(docs: DataFrame, ids: DataFrame, k: int = SHINGLE) -> DataFrame:
    """h1, h2, shingles of the documents whose id hash is in ``ids.x`` (and of
    a few more)."""
    shared = docs.sparkSession.sparkContext.broadcast(_id_table(ids))
    source = documents_of(docs).where(F.col("text").isNotNull()).withColumn("x", F.xxhash64("doc_id"))

    def run(batches):
        table = shared.value
        shift = U64(64 - (len(table) * 64).bit_length() + 1)
        for batch in batches:
            b = np.asarray(batch.column("x")).view(np.uint64) >> shift
            pick = np.flatnonzero((table[b >> U64(6)] >> (b & U64(63))) & U64(1) == 1)
            for first, cuts, shingles in _sets(batch.column("text").take(pa.array(pick)), k):
                have = np.flatnonzero(np.diff(cuts))
                if len(have) == 0:
                    continue
                at = cuts[:-1][have]
                h1 = np.add.reduceat(mix64(shingles + U64(1)), at)
                h2 = np.add.reduceat(mix64(~shingles), at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.r_[at, len(shingles)], pa.int32()), pa.array(shingles.view(np.int64)))],
                    ["h1", "h2", "shingles"])

    return source.select("text", "x").mapInArrow(run, "h1 long, h2 long, shingles array<long>")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with inter and total, from the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    inter = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (pairs.join(right, "b").join(left, "a")
            .select("a", "b", inter.alias("inter"), (F.size("set_a") + F.size("set_b") - inter).alias("total")))


def _left_over(stars: DataFrame, comps: DataFrame, nodes: DataFrame, sets: DataFrame, part: int = PART) -> DataFrame:
    """a, b: links between components among the nodes that share a first node
    (a pivot).  A pivot's nodes are dealt into blocks of bounded size, and each
    pair of blocks is one group: no group grows with the family, and only links
    leave it."""
    label = comps.select("node", "component")
    member = (stars.select(F.col("a").alias("pivot"), F.col("b").alias("node"))
              .join(label, "node", "left").join(label.select(F.col("node").alias("pivot"), F.col("component").alias("home")), "pivot", "left")
              .join(nodes.select("node", "n"), "node")
              .select("pivot", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("home", "pivot").alias("home"))
              .withColumn("out", F.col("component") != F.col("home")))
    member = stored(member)
    size = (member.groupBy("pivot").agg(F.max("out").alias("any"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("m"))
            .where("any AND m > 1")
            .select("pivot", F.ceil(F.greatest(F.col("all") / BLOCK_SHINGLES, F.col("m") / BLOCK_NODES)).alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (member.join(size, "pivot").withColumn("block", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "out"))
    return (dealt.join(sets, "node").groupBy("pivot", "i", "j").applyInArrow(lambda group: _block_links(group, part), "a long, b long").distinct())


def _block_links(group: pa.Table, part: int = PART) -> pa.Table:
    """Links that connect different components in one pair of blocks: those of
    a spanning forest, found from the exact intersections of the nodes that are
    out of their pivot's component with all nodes."""
    node, comp, out = (np.asarray(group.column(c).combine_chunks()) for c in ("node", "component", "out"))
    shingles = group.column("shingles").combine_chunks()
    cut = np.asarray(shingles.offsets) - shingles.offsets[0].as_py()
    size = np.diff(cut)
    _, token, often = np.unique(np.asarray(shingles.flatten()), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(node)), size)
    keep = often[token] > 1  # a shingle of one node only is in no intersection
    row, token = row[keep], token[keep]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    query = np.flatnonzero(out)
    place = np.full(len(node), -1)
    place[query] = np.arange(len(query))
    inter = np.zeros((len(query), len(node)), np.float32)
    at, width = 0, 2048
    new = np.r_[0, np.cumsum(token[1:] != token[:-1])] if len(token) else token
    while at < len(token):  # 2048 shingles at a time
        end = int(np.searchsorted(new, new[at] + width))
        dense = np.zeros((len(node), width), np.float32)
        dense[row[at:end], new[at:end] - new[at]] = 1
        inter += dense[query] @ dense.T
        at = end
    total = size[query][:, None] + size[None, :] - inter
    linked = (WHOLE * inter.astype(np.float64) >= part * total) & (comp[query][:, None] != comp[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for x, y in zip(*np.nonzero(linked)):
        a, b = root(int(comp[query[x]])), root(int(comp[y]))
        if a != b:
            parent[a] = b
            found.append((int(node[query[x]]), int(node[y])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def links_and_nodes(docs: DataFrame, k: int = SHINGLE, part: int = PART, bands: int = BANDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, components): rows carry doc_id, key, h1, h2, n_shingles; nodes
    are the distinct sets with their smallest doc_id; components are
    (node, component) of the linked nodes."""
    rows = stored(signatures(docs, k, bands))
    nodes = stored(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2")
                   .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    firsts = stored(members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("f"), F.count(F.lit(1)).alias("m"))
                    .where("m > 1").select("bucket", F.col("f.node").alias("first"), F.col("f.n").alias("n_first")))
    shared = stored(members.join(firsts, "bucket"))  # only buckets with two or more nodes
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("h1", "h2", "doc_id", "node")
    # repeated rows give a set more than once
    each = full_sets(docs, wanted.select(F.xxhash64("doc_id").alias("x")), k).groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))
    sets = stored(each.join(wanted.drop("doc_id"), ["h1", "h2"]).select("node", "shingles"))

    stars = shared.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    measured = stored(_verify(stars, sets))
    linked = WHOLE * F.col("inter") >= part * F.col("total")
    links = measured.where(linked).select("a", "b")
    comps = connected_components(links)

    more = stored(_left_over(stars, comps, nodes, sets, part))
    if not more.isEmpty():
        comps = connected_components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    return rows.drop("bands"), nodes.drop("bands"), comps


def near_dedup(docs: DataFrame, k: int = SHINGLE, part: int = PART, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.  Linked are
    sets that share ``part`` hundredths of their union."""
    rows, nodes, comps = links_and_nodes(docs, k, part, bands)
    named = nodes.join(comps, "node")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_set = named.join(smallest, "component").select("h1", "h2", "least")
    # a set without links still has the smallest id of its copies
    of_set = (nodes.select("h1", "h2", "doc_id").join(of_set, ["h1", "h2"], "left")
              .select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.coalesce("least", "doc_id").alias("least")))
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return (rows.join(of_set, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    (component.isNull() | (component == F.col("doc_id"))).alias("kept")))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of the five-word
    shingles): the one with the smallest id, of those with that id the one with
    the smallest hash of the text.  Rows equal in id and text are one document, of
    which one row stays.  Documents without a word, or without an id, all stay."""
    rows, nodes, comps = links_and_nodes(docs, STAGE_SHINGLE, STAGE_PART, STAGE_BANDS)
    group = (nodes.join(comps, "node", "left")
             .select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.coalesce("component", "node").alias("group")))
    each = (rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "key", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
            .join(group, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))))
    name = F.struct("doc_id", "key")
    best = each.groupBy("group").agg(F.min(name).alias("best"))
    marks = stored(each.join(best, "group").select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), (name != F.col("best")).alias("gone"),
                                                   (F.col("copies") > 1).alias("repeated")).where("gone OR repeated"))
    same = (F.col("own_id") == F.col("m_id")) & (F.col("own_key") == F.col("m_key"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), text_key().alias("own_key"))
    kept = whole.join(marks.where("gone"), same, "left_anti")
    repeated = marks.where("NOT gone")
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["own_id", "own_key"])
        kept = kept.join(repeated, same, "left_anti").union(once)
    return kept.select("row.*")


#: The same rows in SQL, written apart from the code above.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 2], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
