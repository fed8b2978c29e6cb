"""Line dedup over content-defined chunks.

Lines are the text's lines, wrapped after sentence ends; a blank line belongs to
the line before it.  A rolling hash runs over the line hashes: its window at a
line is that line and the fewest before it that make two lines and ``least``
words.  Of each two windows side by side the one with the lower hash wins, and
a window that wins against a neighbour is a chunk.  The choice depends on the
lines of the two windows only, so it shifts with them, and two windows side by
side always hold a chunk.  A window of ``passage`` words or more, a line of
``anchor`` words or more and a window that is a whole physical line of that size
are chunks without winning.

1. Tasks emit the hash of each chunk; Spark counts them and picks the first
   place (smallest doc_id, then place in the text) of each hash that occurs
   twice or more.
2. Tasks emit the places of the chunks whose hash repeats (found by a bit table
   of fixed size, at most 16 MB), which meet their first places.  Chunks that
   lie side by side here and there make one part, with the lines beside it.
3. Each part gets the bytes at its first place, and is compared with them line
   by line, byte by byte, where the document is rewritten: a chunk grows to both
   sides as long as the lines are equal.  Equal lines go, the first ones stay;
   everything else stays as it was, to the byte.

So a run of whole lines that stands elsewhere is removed to its last line if it
has ``passage`` words on two lines, or three lines and ``least`` words in its
first two and last two; a line goes alone from ``anchor`` words on.  Each removed
line has an equal one at an earlier place, so one copy of every line stays.
The part of a line in which a passage begins or ends stays.  White space at
either end of a line does not count in the comparison, but goes with the chunk.
Shuffled are chunk hashes and places, repeated parts once, and each text twice:
to be read at first places, and to be rewritten.  A null text stays null and has no chunk.  Rows
equal in id and text are one document: all are rewritten alike.  A very long
text is one block of work, its chunks stay small.  A document of which all
chunks stand elsewhere keeps its row with an empty text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrays import IS_NOT_SPACE, U64, blocks, byte_set, mix64, power_pair, rows_of, span_hash
from quire.llm.frames import documents_of, stored, text_key

ANCHOR = 30
LEAST = 12
PASSAGE = 50
MOST_BITS = 27
MARGIN = 4  # bytes beside a part that tell whether its lines end there
ENDS = byte_set(b".!?")


class Lines(NamedTuple):
    """The wrapped lines of a block that hold a word."""
    rows: np.ndarray
    starts: np.ndarray   # bytes, white space included
    ends: np.ndarray
    x: np.ndarray        # bytes from the first to the last that is no white space
    y: np.ndarray
    words: np.ndarray    # words before the line, and in all lines at the end
    first: np.ndarray    # first line of the same row
    stop: np.ndarray     # line behind the last one of the same row
    line_first: np.ndarray  # first line of the same physical line
    line_last: np.ndarray   # whether it ends its physical line


class Chunks(NamedTuple):
    """Chunks as line numbers, and whether the lines beside them are of use."""
    first: np.ndarray
    last: np.ndarray
    before: np.ndarray
    after: np.ndarray
    hash: np.ndarray


def _next_full(full: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place from each of ``at`` on that is no white space."""
    at = at.copy()
    todo = np.flatnonzero(~full[at])
    for _ in range(8):
        at[todo] += 1
        todo = todo[~full[at[todo]]]
    if len(todo):
        solid = np.flatnonzero(full)
        at[todo] = solid[np.searchsorted(solid, at[todo])]
    return at


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n = len(data)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    stop = row_start.copy()
    stop[np.flatnonzero(data == 10) + 1] = True
    sentence = np.flatnonzero(data[1:] == 32)
    stop[sentence[ENDS[data[sentence]] & ~row_start[sentence + 1]] + 2] = True
    full = IS_NOT_SPACE[data]
    seen = np.zeros(n + 1, np.int32)
    np.cumsum(full & (np.r_[True, ~full[:-1]] | row_start[:n]), out=seen[1:])
    ends = np.flatnonzero(stop[1:]) + 1
    # blank lines join the line before, those at the start of a text the first one
    words = np.diff(seen[np.r_[0, ends]])
    blank_so_far = seen[ends] == seen[offsets[rows_of(offsets, ends - 1)]]
    ends = ends[row_start[ends] | (np.r_[words[1:] > 0, True] & ~blank_so_far)]
    starts = np.r_[0, ends[:-1]]
    good = seen[ends] > seen[starts]
    starts, ends = starts[good], ends[good]
    rows = rows_of(offsets, starts)
    m = len(ends)
    index = np.arange(m)
    new_row = np.r_[True, rows[1:] != rows[:-1]] if m else np.zeros(0, bool)
    last = np.r_[new_row[1:], True] | (data[ends - 1] == 10) if m else new_row
    new_line = np.r_[True, last[:-1]] if m else new_row
    return Lines(rows, starts, ends, _next_full(full, starts), n - _next_full(full[::-1], n - ends),
                 np.r_[0, np.cumsum(seen[ends] - seen[starts], dtype=np.int64)], np.maximum.accumulate(np.where(new_row, index, 0)),
                 np.searchsorted(rows, rows, "right"), np.maximum.accumulate(np.where(new_line, index, 0)), last)


def chunks(data: np.ndarray, lines: Lines, anchor: int = ANCHOR, least: int = LEAST, passage: int = PASSAGE) -> Chunks:
    """The chunks of one or more lines: windows, then lines that are chunks alone."""
    m = len(lines.rows)
    index = np.arange(m)
    total = lines.words
    begin = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, index - 1)
    whole = begin >= lines.first
    begin = np.maximum(begin, lines.first)
    up, down = power_pair(m + 1)
    own = span_hash(data, lines.x, lines.y)
    sums = np.r_[U64(0), np.cumsum(own * up[:m])]
    rolled = mix64((sums[1:] - sums[begin]) * down[begin])
    beside = whole[1:] & whole[:-1] & (lines.rows[1:] == lines.rows[:-1])
    lower = rolled[:-1] < rolled[1:]
    beats_next = np.r_[beside & lower, False]
    beats_last = np.r_[False, beside & ~lower]
    no_last, no_next = ~np.r_[False, beside], ~np.r_[beside, False]
    size = total[1:] - total[begin]
    forced = (size >= passage) | ((begin == lines.line_first) & lines.line_last & (size >= anchor))
    w = np.flatnonzero(whole & (beats_next | beats_last | (no_last & no_next) | forced))
    # a neighbour that wins covers the line beside the window wherever both stand together
    # (one of three lines or more may not: it can begin with lines of its own)
    long_last = (index - begin > 1) | (total[:-1] - total[np.maximum(begin - 1, 0)] < least)
    before = (beats_last | no_last | long_last)[w]
    after = (beats_next | no_next)[w]
    s = np.flatnonzero(np.diff(total) >= anchor)
    no = np.zeros(len(s), bool)
    return Chunks(np.r_[begin[w], s], np.r_[w, s], np.r_[before, no], np.r_[after, no],
                  np.r_[rolled[w], own[s]])


def _keyed(docs: DataFrame) -> DataFrame:
    return documents_of(docs).withColumn("key", text_key())


def _blocks_of(batch):
    """(row offsets, lines, chunks, batch rows of the chunks) of each block."""
    for first, data, offsets in blocks(batch.column("text")):
        if len(data):
            lines = lines_of(data, offsets)
            if not len(lines.rows):
                continue
            c = chunks(data, lines)
            yield offsets, lines, c, first + lines.rows[c.first]


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """hash, doc_id, key, at: every chunk."""
    source = _keyed(docs)

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for offsets, lines, c, rows in _blocks_of(batch):
                pick = pa.array(rows)
                at = lines.x[c.first] - offsets[lines.rows[c.first]]
                yield pa.RecordBatch.from_arrays([pa.array(c.hash.view(np.int64)), ids.take(pick), keys.take(pick), pa.array(at)],
                                                 ["hash", "doc_id", "key", "at"])

    long = F.lit(0).cast("long")
    return source.mapInArrow(run, source.select(long.alias("hash"), "doc_id", "key", long.alias("at")).schema)


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """16 bits per hash, at most 2**27 bits; beyond that more chunks pass,
    which the join then drops."""
    bits = min(MOST_BITS, max(16, int(hashes.count() * 16).bit_length()))
    got = (hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("b")).groupBy(F.shiftright("b", 6).alias("at"))
           .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toArrow())
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[np.asarray(got.column("at"))] = np.asarray(got.column("bits")).view(np.uint64)
    return table


def _name(column: str = "doc_id") -> Column:
    """The id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    p = hashes >> U64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[p >> U64(6)] >> (p & U64(63))) & U64(1) == 1


def _first_texts(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, text, key of the documents whose key passes the table: those
    that hold the first place of a repeated chunk, and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    source = _keyed(docs)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_has(shared.value, np.asarray(batch.column("key")).view(np.uint64))))

    return source.mapInArrow(run, source.schema)


def chunk_places(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """hash, doc_id, key, at, end of the chunks that pass the table; low and
    high enclose the chunk and the lines beside it that hold ``LEAST`` words."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    source = _keyed(docs)

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for offsets, lines, c, rows in _blocks_of(batch):
                k = np.flatnonzero(_has(shared.value, c.hash))
                i, j, total = c.first[k], c.last[k], lines.words
                far = np.searchsorted(total, total[i] - LEAST, "right") - 1
                low = np.where(c.before[k], np.maximum(np.minimum(far, i - 1), lines.first[i]), i)
                far = np.searchsorted(total, total[j + 1] + LEAST) - 1
                high = np.where(c.after[k], np.minimum(np.maximum(far, j + 1), lines.stop[j] - 1), j)
                base, pick = offsets[lines.rows[i]], pa.array(rows[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.hash[k].view(np.int64)), ids.take(pick), keys.take(pick), *(
                        pa.array(v - base) for v in (lines.x[i], lines.y[j], lines.x[low], lines.y[high]))],
                    ["hash", "doc_id", "key", "at", "end", "low", "high"])

    long = F.lit(0).cast("long")
    return source.mapInArrow(run, source.select(long.alias("hash"), "doc_id", "key", *[
        long.alias(c) for c in ("at", "end", "low", "high")]).schema)


def repeated_parts(docs: DataFrame) -> DataFrame:
    """name, key, parts: per document the parts whose chunks stand elsewhere
    (low, high), with the bytes there and their place in this text (from)."""
    place = F.struct("doc_id", "key", "at")
    firsts = stored(chunk_hashes(docs).groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("hash", "first"))
    later = (chunk_places(docs, _bit_table(firsts.select("hash"))).join(firsts, "hash").where(~place.eqNullSafe(F.col("first")))
             .select("doc_id", "key", F.col("first.doc_id").alias("f_id"), F.col("first.key").alias("f_key"),
                     (F.col("at") - F.col("first.at")).alias("shift"), "low", "high"))
    # chunks whose first places lie side by side, too, make one part
    same = Window.partitionBy("doc_id", "key", "f_id", "f_key", "shift").orderBy("low", "high")
    gap = F.coalesce(F.col("low") > F.max("high").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    part = ["doc_id", "key", "f_id", "f_key", "shift", "part"]
    parts = (later.withColumn("gap", gap.cast("long")).withColumn("part", F.sum("gap").over(same))
             .groupBy(*part).agg(F.min("low").alias("low"), F.max("high").alias("high")))
    parts = parts.withColumn("name", _name()).withColumn("f_name", _name("f_id"))
    texts = (_first_texts(docs, _bit_table(firsts.select(F.col("first.key").alias("hash")).distinct()))
             .select(_name().alias("f_name"), F.col("key").alias("f_key"), F.col("text").cast("binary").alias("bytes")))
    start = F.greatest(F.col("low") - F.col("shift") - MARGIN, F.lit(0))
    length = F.col("high") - F.col("shift") + MARGIN - start
    return (parts.join(texts.dropDuplicates(["f_name", "f_key"]), ["f_name", "f_key"])
            .select("name", parts["key"], F.struct("low", "high", (start + F.col("shift")).alias("from"), (start == 0).alias("is_start"),
                                            (start + length >= F.length("bytes")).alias("is_end"),
                                            F.substring("bytes", (start + 1).cast("int"), length.cast("int")).alias("bytes")).alias("part"))
            .groupBy("name", "key").agg(F.collect_list("part").alias("parts")))


def _whole_line(there: bytes, a: int, b: int, is_start: bool, is_end: bool) -> bool:
    """Whether the bytes a to b are a line of ``there`` from end to end."""
    k, e = a, b
    while k and there[k - 1] in b" \t\r\v\f":
        k -= 1
    while e < len(there) and there[e] in b" \t\r\v\f":
        e += 1
    begins = there[k - 1] == 10 or (there[k - 1] in b".!?" and there[k] == 32 and k < a) if k else is_start
    ends = there[e] == 10 or (there[b - 1] in b".!?" and there[b] == 32) if e < len(there) else is_end
    return begins and ends


def removed_spans(raw: bytes, parts) -> list[tuple[int, int]]:
    """Byte spans of ``raw`` to remove: streaks of lines equal to the lines at
    the same places of a part, with ``LEAST`` words on two lines or ``ANCHOR``
    words; sorted, without overlap or touch."""
    lines = lines_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    starts, ends, x, y, words = lines.starts, lines.ends, lines.x, lines.y, lines.words
    gone = np.zeros(len(starts) + 1, bool)
    for p in parts:
        there, base = p["bytes"], p["from"]
        first, last = int(np.searchsorted(x, p["low"])), int(np.searchsorted(y, p["high"], "right"))
        # where all bytes are equal, only the outer lines can end elsewhere
        alike = first < last and x[first] >= base and there[x[first] - base:y[last - 1] - base] == raw[x[first]:y[last - 1]]
        begin = first
        for i in [first, last - 1, last] if alike and last - first > 1 else range(first, last + 1):
            a = int(x[i]) - base if i < last else -1
            b = int(y[i]) - base if i < last else -1
            if a >= 0 and there[a:b] == raw[x[i]:y[i]] and _whole_line(there, a, b, p["is_start"], p["is_end"]):
                continue
            size = words[i] - words[begin]
            if (size >= LEAST and i - begin > 1) or size >= ANCHOR:
                gone[begin:i] = True
            begin = i + 1
    edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8))).tolist()
    return [(int(starts[i]), int(ends[j - 1])) for i, j in zip(edges[::2], edges[1::2])]


def line_dedup(docs: DataFrame) -> DataFrame:
    """text without the repeated chunks, removed_chunks (removed spans),
    removed_bytes (long), and the other columns in a struct ``rest``."""
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*others) if others else F.struct(F.lit(1).alias("none"))
    whole = docs.select("text", _name().alias("name"), text_key().alias("key"), rest.alias("rest"))
    joined = whole.join(repeated_parts(docs), ["name", "key"], "left").select("text", "parts", "rest")

    def run(batches):
        for batch in batches:
            texts, parts = batch.column("text").to_pylist(), batch.column("parts")
            count, size = [0] * len(texts), [0] * len(texts)
            for i in np.flatnonzero(parts.is_valid()).tolist():
                raw, kept, at = (texts[i] or "").encode(), [], 0
                for start, end in removed_spans(raw, parts[i].as_py()):
                    kept.append(raw[at:start])
                    at = end
                    count[i] += 1
                    size[i] += end - start
                if at:
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(size, pa.int64()),
                                              batch.column("rest")], ["text", "removed_chunks", "removed_bytes", "rest"])

    long = F.lit(0).cast("long")
    return joined.mapInArrow(run, joined.select("text", long.alias("removed_chunks"), long.alias("removed_bytes"), "rest").schema)


def line_dedup_rows(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text, removed_chunks, removed_bytes."""
    return line_dedup(docs.select("doc_id", "text")).select("rest.doc_id", "text", "removed_chunks", "removed_bytes")


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks; n_chars follows the text."""
    done = line_dedup(docs)
    kind = dict(docs.dtypes)

    def column(c):
        if c == "text":
            return F.col("text")
        if c == "n_chars" and kind[c] in ("int", "bigint"):
            return F.when(F.col("removed_chunks") > 0, F.length("text").cast(kind[c])).otherwise(F.col("rest.n_chars")).alias(c)
        return F.col("rest").getField(c).alias(c)

    return done.select(*[column(c) for c in docs.columns])
