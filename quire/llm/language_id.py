"""Language identification by a multilingual mixture.

Each language has a distribution over hashed letter n-grams, learnt from all
documents that may be learnt from (counts are summed in Spark; every count
is raised by a constant).  A document is a bag of words drawn from a mixture of
languages: the likelihood of a word under a language is the product over its
n-grams, and expectation-maximisation estimates the document's language
proportions.  The language set is chosen by penalised likelihood (BIC) over the
nested sets of the most probable languages: a further language must raise the
log-likelihood by more than half the log of the number of words.  The
prediction is the language with the largest proportion in the chosen set
(ties: the first by name), the score is that proportion.

A text that is null or has no letter gives ``und`` with score 0.  If nothing
can be learnt from, every row is ``und``.  Rows without a language are not
learnt from; repeated rows count as often as they stand in the table.  A very
long text is one row of a task, whose memory follows it.  A set has at most
``MAX_SET`` languages, and a word's evidence between two languages is at most
``MOST_EVIDENCE`` nats, so that one odd word cannot outweigh a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import LOWER, blocks, byte_set, ngrams, rows_of, runs, segment_starts
from quire.llm.frames import documents_of, remainder

BITS = 15
SIZES = (2, 3, 4)
RAISE = 0.5
STEPS = 12
MOST_EVIDENCE = 8.0
MAX_SET = 4
FOLDS, HELD_OUT = 5, 0
LETTER_BYTES = byte_set([*range(97, 123), *range(128, 256)])
WORD_SIGN = re.compile(r"[^\W\d_]")  # letters, and numerals such as a half or a superscript two


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORD_SIGN.finditer(text))


@dataclass
class LanguageModel:
    names: list[str]
    logs: np.ndarray  # buckets x languages


def _grams(data: np.ndarray, offsets: np.ndarray):
    """(buckets, positions) of the n-grams of a block's words; a word is a run
    of letter bytes, seen between two blanks."""
    low = np.where(LETTER_BYTES[LOWER[data]], LOWER[data], np.uint8(32))
    found = [ngrams(low, offsets, n) for n in SIZES]
    at = np.concatenate([f[1] for f in found])
    size = np.concatenate([np.full(len(f[1]), n) for f, n in zip(found, SIZES)])
    bucket = np.concatenate([f[0] for f in found]) >> np.uint32(32 - BITS)
    return low, bucket.astype(np.int64), at, size


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, data, offsets in blocks(batch.column("text")):
            _, bucket, at, _ = _grams(data, offsets)
            row = rows_of(offsets, at)
            own = np.array(langs[first:first + len(offsets) - 1], object)
            for lang in set(own):
                have = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                have += np.bincount(bucket[(own == lang)[row]], minlength=1 << BITS)
    for lang, c in counts.items():
        used = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(c[used])],
                                         ["lang", "bucket", "n"])


def fit(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> LanguageModel:
    """Counts over every row that may be learnt from.  The result holds
    2**15 numbers per language, however many documents there are."""
    part = (docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & (remainder("doc_id", folds) != held_out)).select("text", "lang"))
    got = (part.mapInArrow(_count, "lang string, bucket long, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(got.lang.unique().tolist())
    counts = np.full((1 << BITS, len(names)), RAISE)
    if names:
        counts[got.bucket.to_numpy(), np.searchsorted(names, got.lang.to_numpy().astype(str))] += got.n.to_numpy()
    return LanguageModel(names, np.log(counts / counts.sum(0)).astype(np.float32))


def _mixture(p: np.ndarray, start: np.ndarray, rows: np.ndarray, n_rows: int, allowed: np.ndarray):
    """Expectation-maximisation of all rows' proportions at once.  ``p``:
    words x languages likelihoods; ``allowed``: rows x languages.  Returns
    proportions and log-likelihoods per row with words (in row order)."""
    have = rows[start]
    words = np.diff(np.r_[start, len(rows)])[:, None]
    pi = allowed[have] / allowed[have].sum(1, keepdims=True)
    for step in range(STEPS + 1):
        total = np.einsum("ij,ij->i", p, np.repeat(pi, words[:, 0], axis=0))
        if step == STEPS:
            break
        pi = pi * np.add.reduceat(p / total[:, None], start) / words
    return pi, np.add.reduceat(np.log(total), start)


def _predict(data, offsets, logs):
    """(language index, score) of each row of a block; -1 without letter bytes."""
    n, k = len(offsets) - 1, logs.shape[1]
    best, score = np.full(n, -1), np.zeros(n)
    low, bucket, at, size = _grams(data, offsets)
    w_start, _, w_row = runs(low, offsets, LETTER_BYTES)
    if len(w_start) == 0:
        return best, score
    # the word in which an n-gram ends or, if it ends on a blank, the one before
    word = np.searchsorted(w_start, at + size - 1, "right") - 1
    good = (word >= 0)
    good[good] &= w_row[word[good]] == rows_of(offsets, at[good])
    word, bucket = word[good], bucket[good]
    ll, columns = np.empty((len(w_start), k)), np.ascontiguousarray(logs.T)
    for j in range(k):
        ll[:, j] = np.bincount(word, columns[j].take(bucket), len(w_start))
    # one odd word (a name, a foreign term) cannot outweigh a text
    ll = np.maximum(ll - ll.max(1, keepdims=True), -MOST_EVIDENCE)
    p = np.exp(ll)
    start = segment_starts(w_row)
    have = w_row[start]
    words = np.diff(np.r_[start, len(w_row)])
    single = np.add.reduceat(ll, start)
    everything = np.ones((n, k), bool)
    pi, full = _mixture(p, start, w_row, n, everything)
    penalty = 0.5 * np.log(words + 1.0)
    first = single.argmax(1)
    chosen, share, value = first.copy(), np.ones(len(have)), single.max(1)
    order = np.argsort(-pi, axis=1, kind="stable")
    for size_ in range(2, min(k, MAX_SET) + 1):
        # the mixture of all languages bounds what any set can reach
        open_ = np.flatnonzero(full - (size_ - 1) * penalty > value)
        if len(open_) == 0:
            break
        allowed = np.zeros((n, k), bool)
        sets = np.zeros((len(open_), k), bool)
        np.put_along_axis(sets, order[open_, :size_], True, axis=1)
        allowed[have[open_]] = sets
        inside = np.isin(w_row, have[open_])
        rows = w_row[inside]
        pi_s, reached = _mixture(p[inside], segment_starts(rows), rows, n, allowed)
        better = reached - (size_ - 1) * penalty[open_] > value[open_]
        at_ = open_[better]
        value[at_] = (reached - (size_ - 1) * penalty[open_])[better]
        chosen[at_], share[at_] = pi_s[better].argmax(1), pi_s[better].max(1)
    best[have], score[have] = chosen, share
    return best, score


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    logs = docs.sparkSession.sparkContext.broadcast(model.logs)  # 2**15 floats per language
    names = np.array([*model.names, "und"], object)

    def run(batches):
        table = logs.value
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            texts = batch.column("text")
            if table.shape[1]:
                for first, data, offsets in blocks(texts):
                    n = len(offsets) - 1
                    best[first:first + n], score[first:first + n] = _predict(data, offsets, table)
            none = np.array([t is None or not has_letter(t) for t in texts.to_pylist()], bool)
            best[none], score[none] = -1, 0.0
            if table.shape[1]:
                # letters, but no letter byte run: the prior's first language
                best[~none & (best < 0)] = 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    source = documents_of(docs)
    schema = source.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return source.mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
