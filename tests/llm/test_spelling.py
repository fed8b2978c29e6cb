"""Spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest

from quire.llm import spelling
from quire.llm.spelling import dictionary, near_pairs, spelling_variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, length=6, least=5):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_near(words):
    """Through the words with one code point left out."""
    lists = collections.defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            lists[w[:i] + w[i + 1:]].add(w)
    near = collections.defaultdict(set)
    for group in lists.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    return near


def plain(rows):
    n = plain_words(rows)
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def table(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def test_hostile_rows_equal_brute_force(spark):
    long = "abcdefghij" * 300
    rows = [(1, "Letters letters LETTERS " * 40 + "lettres " * 5 + "leters " * 6), (2, None), (3, ""), (4, "1234 -- \n"),
            (5, "ÉTUDES études Études " * 30 + "etudes " * 6), (5, "ÉTUDES études Études " * 30 + "etudes " * 6), (None, "lettars " * 9 + "lettar " * 6),
            (7, ("x" + long + " ") * 5 + (long + " ") * 30 + (long[:1500] + "z" + long[1500:] + " ") * 5 + (long[:-1] + "q ") * 6),
            (8, "tied" + "aa " * 6 + " tiedab " * 6 + " tiedac " * 30 + " tiedad " * 30), (9, "naïve×÷ß " * 7 + "naïve×÷ " * 40),
            (10, "chaina " * 5 + "chainab " * 25 + "chainabc " * 125 + "chainabcd " * 625)]
    docs = spark.createDataFrame([(*r, 1, "w", 0) for r in rows], "doc_id long, text string, n long, word string, key int").repartition(3)
    assert table(spelling_variants(docs)) == plain(rows)
    assert spelling_variants(docs.limit(0)).count() == 0 and spelling_variants(docs.where("doc_id in (2, 3, 4)")).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = table(spelling_variants(docs))
    assert got == plain(rows) and sum(r[1] is not None for r in got) > 50


@pytest.mark.parametrize("size,list_size,prune", [(2, 4096, 32), (2, 8, 2), (4, 64, 0)])
def test_dense_words_lose_no_pair(spark, size, list_size, prune):
    rng = np.random.default_rng(size)
    words = sorted({"".join("abéz"[j] for j in rng.integers(0, size, n)) for n in rng.integers(6, 13, 1500)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long").repartition(3)
    got = near_pairs(frame, list_size=list_size, prune=prune).collect()
    near = plain_near(words)
    assert len(got) == len(set(got)) and {(r.a, r.b) for r in got} == {(a, b) for a in near for b in near[a]}
    known = dictionary(frame, prune)
    assert all(known.counts > known.prune) and (np.diff(known.grams.astype(object)) > 0).all()


def test_chosen_grams_never_overlap():
    words = ["abcdef", "abcdefg", "a" * 6, "ab" * 40, "é" * 90, "zyxwvutsrq"]
    known = spelling.Dictionary(np.sort(np.array([k for _, _, _, keys in spelling._grams(words) for g in (2, 3, 4, 5, 6, 7) for k in np.unique(keys[g]) if k], np.uint64)),
                                np.zeros(0), 1)
    known.counts = np.arange(1, len(known.grams) + 1)
    for n, rows, places, keys in spelling._grams(words):
        short, gram = spelling._class_grams(keys, known.lengths(n, places, keys), spelling._limit(n))
        a, b = spelling._chosen(places, short, known.often(gram) + 1)
        r = np.arange(len(rows))
        assert (places[a] + short[r, a] <= places[b]).all()
