"""Ranked search: shared sums against plain sums, and against a plain ranking."""

import collections
import math
import re

import numpy as np
import pytest

from quire.llm.ranked_search import ranked_search, shared_sets

DOCS = [(1, "The cat sat on the mat"), (2, "the CAT the cat, café"), (3, None), (4, ""), (5, " .;- \n"), (6, "dog dog dog 42"),
        (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (None, "cat and dog 42"), (8, "word " * 60_000 + "cat"), (9, "Ünder café")]
ITEMS = [(1, "the cat the"), (2, "dog 42"), (3, None), (4, "absent term"), (5, "the cat café sat"), (5, "the cat café sat"), (None, "dog cat"), (6, "the cat sat mat")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(docs, items, top):
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("top,block", [(20, 1 << 20), (3, 4)])
def test_hostile_rows_equal_a_plain_ranking(spark, top, block):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 0.5) for r in DOCS], "doc_id long, text string, item string, n long, rank int, score double").repartition(3)
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, item int, term int")
    got = ranked_search(docs, items, top, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(map(tuple, got.collect())) == key(plain(DOCS, ITEMS, top))


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs, items.where("item_id = 3")).count() == 0


def test_shared_sets_are_added_once():
    rng = np.random.default_rng(5)
    base = [rng.choice(400, 30, replace=False) for _ in range(6)]
    item, term, q = [], [], []
    for i in range(60):  # items made of a common set and a few own terms
        own = np.unique(np.r_[base[i % 6], rng.integers(0, 400, 4)])
        item += [i * 7] * len(own)
        term += own.tolist()
        q += (own % 3 // 2 + 1).tolist()
    item, term, q = map(np.array, (item, term, q))
    graph = shared_sets(item, term, q)
    by_term = rng.integers(0, 1 << 40, (400, 9))
    want = np.zeros((60, 9), np.int64)
    for i, t, k in zip(item, term, q):
        want[i // 7] += k * by_term[t]
    assert (graph.items == np.arange(60) * 7).all() and (graph.sums(by_term) == want).all()
    assert sum(len(x) for x, _ in graph.steps) < 0.75 * (len(item) - 60)  # additions without sharing
