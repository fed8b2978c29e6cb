"""Document fingerprints against a plain version."""

import hashlib
import math

import numpy as np

from quire.llm import fingerprint as fp
from quire.llm.fingerprint import decoded, digests, edited_fingerprints, encoded, fingerprints, likeness

DOCS = [(5, "The quick brown fox jumps over the lazy dog."), (4, None), (3, ""), (2, "é" * 7), (1, "abc"), (None, "no id at all"),
        (9, "twice"), (9, "twice"), (8, "same id, one text"), (8, "same id, another text"), (20, "word and word " * 20_000), (21, "x" * 10)]


def plain_counts(text):
    raw, out = text.encode(), [0] * fp.BUCKETS
    for i in range(len(raw)):
        for t, (a, b) in enumerate(fp.TRIPLETS):
            if i >= b:
                out[(int(fp._MIX[t, 0][raw[i]]) + int(fp._MIX[t, 1][raw[i - a]]) + int(fp._MIX[t, 2][raw[i - b]])) % 256] += 1
    return out


def plain_digest(text):
    counts = plain_counts(text)
    edges = [sorted(counts)[fp.BUCKETS * i // 4 - 1] for i in (1, 2, 3)]
    q = [sum(c > e for e in edges) for c in counts]
    return [min(255, int(fp.LENGTH_STEPS * math.log2(1 + len(text)))), *q]


def plain_likeness(a, b):
    total = 2 * min(32, max(0, abs(a[0] - b[0]) - 2))
    for x, y in zip(a[1:], b[1:]):
        total += {0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)]
    return 1 - min(total, fp.UNRELATED) / fp.UNRELATED


def test_digests_equal_a_plain_version():
    texts = ["", "a", "abcd", "abcde", "Ünïcode text, with ½ and 漢字", "same text " * 50, "z" * 3000, "b"]
    assert digests(texts).tolist() == [plain_digest(t) for t in texts]
    assert (decoded(encoded(digests(texts))) == digests(texts)).all()
    assert digests([]).shape == (0, 257)


def test_query_equals_a_plain_version(spark):
    docs = spark.createDataFrame([(*r, 1, 2, "k") for r in DOCS], "doc_id long, text string, part int, role int, row string").repartition(4)
    got = {}
    for parts in ("1", "5"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got[parts] = sorted(map(tuple, edited_fingerprints(docs).collect()), key=repr)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["1"] == got["5"]
    # rows with one id are ordered by a hash: take either order of the two
    fits = 0
    for two in ((8, 9), (9, 8)):
        rows = [(i, t or "") for i, t in (DOCS[k] for k in (11, 10, 6, 7, *two, 0, 1, 2, 3, 4, 5))]
        want = []
        for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
            k = len(a) // 3
            e = a[:len(a) - k] + b[:k]
            da, db, de = map(plain_digest, (a, b, e))
            want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), encoded(np.array([da]))[0], encoded(np.array([de]))[0],
                         plain_likeness(da, de), plain_likeness(da, db)))
        fits += sorted(want, key=repr) == got["1"]
    assert fits == 1


def test_empty_and_single_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert edited_fingerprints(docs.limit(0)).count() == 0
    one = edited_fingerprints(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()} == {r.doc_id: r.fingerprint for r in edited_fingerprints(docs).collect()}


def test_edits_stay_closer_than_other_documents(spark):
    rows = edited_fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len(rows) == 1000 and sum(r.near_edited > r.near_next for r in rows) >= 980
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert likeness(digests(["abc" * 9]), digests(["abc" * 9]))[0] == 1.0
