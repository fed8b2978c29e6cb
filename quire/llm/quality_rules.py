"""Quality rules with adaptive thresholds.

Four measures per document (all whole numbers, so that every engine gets the
same): code points per word, symbols per 1000 words, repeated lines per 1000
lines with a word, words in repeated 8-word windows per 1000 words.  Their
distribution per language and source is kept in a mergeable quantile sketch:
counts over buckets whose width grows with the value (the leading six binary
digits), so that any quantile is known to about 3 % and sketches of parts add
up.  At most about 1,000 buckets exist per group and measure, however many
documents it has.  The limits of a group are high quantiles of its own sketch
(``HIGH`` hundredths, and ``LOW`` for word length): they replace fixed cutoffs,
and no constant of a measure's unit is in them.  A document is out of the limits
if its bucket is beyond the quantile's.  Groups with fewer than ``least`` measured
documents use the sketch of their language, and that of the whole table if that
is small, too.  Documents are then joined with their group's limits.

Documents that fail the base rule (under 20 words, or more than 30 % of the
words in repeated windows) are not measured and are not kept.  A null text has
no words.  Null languages and sources are groups of their own.  Repeated rows
count as often as they stand in the table.  Equal values are in one bucket and
fare alike.  A very long text is one row of a task, measured word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.frames import documents_of, stored

WINDOW = 8
LEAST_WORDS = 20
LEAST = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = ("word_length", "symbol_rate", "line_rate", "repeat_rate")
LOW, HIGH = 1, 95  # hundredths of a group's measured documents
LOWER_LIMIT = ("word_length",)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Number of words inside windows of ``width`` words that occur twice or
    more in the list.  Windows get exact numbers by doubling: the number of a
    run of 2k words is that of the pair of its halves."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    span = 1
    while span < width:
        pairs = ids[:-span] * (ids.max() + 1) + ids[span:]
        _, ids = np.unique(pairs, return_inverse=True)
        span *= 2
    often = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), len(lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and the base counts of every row."""
    source = documents_of(docs, *more)
    keep = [i for i, c in enumerate(source.columns) if c != "text"]
    names = [source.columns[i] for i in keep]

    def run(batches):
        for batch in batches:
            got = [_measure(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*got)) if got else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(c, pa.int64()) for c in cols],
                                             [*names, *COUNTS])

    schema = source.drop("text").select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    return source.mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """Lower edge of the sketch bucket of a whole number: its six leading
    binary digits, the rest zero."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.expr("1L") * F.pow(F.lit(2), shift).cast("long")
    return value - F.pmod(value, step)


def sketch(measured: DataFrame, *keys: str) -> DataFrame:
    """Mergeable quantile sketch: keys, measure, bucket, n.  Sketches of parts
    are merged by adding n."""
    long = measured.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("s"))
    return long.groupBy(*keys, "s.measure", "s.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, *keys: str, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Low and high quantile (bucket edges) and size per key and measure."""
    w = Window.partitionBy(*keys, "measure")
    run = sketches.withColumn("total", F.sum("n").over(w)).withColumn(
        "up_to", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))

    def at(hundredths: int) -> Column:
        return F.min(F.when(100 * F.col("up_to") >= hundredths * F.col("total"), F.col("bucket")))

    return run.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(low).alias("low"), at(high).alias("high"))


def thresholds(measured: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per language and source: the limits of each measure."""
    per_group = stored(sketch(measured, "lang", "source"))
    merged = lambda *keys: (per_group.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n")))
    own = quantiles(per_group, "lang", "source")
    lang = quantiles(merged("lang"), "lang").select(
        F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("total").alias("l_total"),
        F.col("low").alias("l_low"), F.col("high").alias("l_high"))
    whole = quantiles(merged()).select(F.col("measure").alias("w_measure"), F.col("low").alias("w_low"), F.col("high").alias("w_high"))
    both = (own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
            .join(F.broadcast(whole), F.col("measure") == F.col("w_measure")))  # one row per measure

    def choose(q: str) -> Column:
        return (F.when(F.col("total") >= least, F.col(q)).when(F.col("l_total") >= least, F.col("l_" + q))
                .otherwise(F.col("w_" + q)))

    limits = both.select("lang", "source", "measure", choose("low").alias("low"), choose("high").alias("high"))
    picks = []
    for m in MEASURES:
        at = F.col("measure") == m
        picks.append(F.max(F.when(at, F.col("high"))).alias(f"max_{m}"))
        if m in LOWER_LIMIT:
            picks.append(F.max(F.when(at, F.col("low"))).alias(f"min_{m}"))
    return limits.groupBy("lang", "source").agg(*picks)


def quality_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rate = lambda a, b: F.expr(f"1000 * {a} div {b}")
    base = stored(counts(docs, "lang", "source").withColumn("base_failed", failed))
    measured = base.where(~F.col("base_failed")).select(
        "lang", "source", F.expr("word_chars div n_words").alias("word_length"), rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"))
    limits = thresholds(measured, least).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "min_word_length", *[f"max_{m}" for m in MEASURES])
    joined = base.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    words, lines = F.expr("greatest(n_words, 1L)"), F.expr("greatest(n_lines, 1L)")
    value = {"word_length": F.expr("word_chars div greatest(n_words, 1L)")}
    value |= {m: F.floor(1000 * F.col(c) / d) for m, c, d in
              (("symbol_rate", "n_symbols", words), ("line_rate", "n_dup_lines", lines), ("repeat_rate", "n_repeat_words", words))}
    good = bucket(value["word_length"]) >= F.col("min_word_length")
    for m in MEASURES:
        good = good & (bucket(value[m]) <= F.col(f"max_{m}"))
    return joined.select("doc_id", *COUNTS[:5], "base_failed",
                         F.coalesce(~F.col("base_failed") & good, F.lit(False)).alias("kept"))


#: The same rows in SQL, written apart from the code above.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls FROM d),
g AS (SELECT k, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 9),
h AS (SELECT k, i, ws[i:i + 7] AS gram FROM g),
o AS (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM h),
p AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM o WHERE c > 1) GROUP BY k),
c AS (SELECT w.k, doc_id, lang, source, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN p ON p.k = w.k),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
m AS (SELECT k, lang, source, unnest([
        {'m': 'len', 'v': word_chars // n_words}, {'m': 'sym', 'v': 1000 * n_symbols // n_words},
        {'m': 'line', 'v': 1000 * n_dup_lines // n_lines}, {'m': 'rep', 'v': 1000 * n_repeat_words // n_words}]) AS s
      FROM b WHERE NOT base_failed),
v AS (SELECT k, lang, source, s.m AS m, s.v AS v, length(bin(s.v)) - 6 AS sh FROM m),
e AS (SELECT k, lang, source, m, v, CASE WHEN sh > 0 THEN (v >> sh) << sh ELSE v END AS q FROM v),
g1 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY q) AS i FROM e WINDOW w AS (PARTITION BY lang, source, m)),
g2 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY q) AS i FROM e WINDOW w AS (PARTITION BY lang, m)),
g3 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY q) AS i FROM e WINDOW w AS (PARTITION BY m)),
q1 AS (SELECT lang, source, m, max(n) AS n, min(q) FILTER (i >= 0.01 * n) AS a, min(q) FILTER (i >= 0.95 * n) AS b FROM g1 GROUP BY ALL),
q2 AS (SELECT lang, m, max(n) AS n, min(q) FILTER (i >= 0.01 * n) AS a, min(q) FILTER (i >= 0.95 * n) AS b FROM g2 GROUP BY ALL),
q3 AS (SELECT m, min(q) FILTER (i >= 0.01 * n) AS a, min(q) FILTER (i >= 0.95 * n) AS b FROM g3 GROUP BY ALL),
f AS (SELECT q1.lang, q1.source, q1.m,
             CASE WHEN q1.n >= 50 THEN q1.a WHEN q2.n >= 50 THEN q2.a ELSE q3.a END AS a,
             CASE WHEN q1.n >= 50 THEN q1.b WHEN q2.n >= 50 THEN q2.b ELSE q3.b END AS b
      FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.m = q2.m JOIN q3 ON q3.m = q1.m),
bad AS (SELECT e.k, bool_or(e.q > f.b OR (e.m = 'len' AND e.q < f.a)) AS out
        FROM e JOIN f ON e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source AND e.m = f.m GROUP BY e.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(out, true) AS kept
FROM b LEFT JOIN bad ON bad.k = b.k
"""
