"""MinHash shingles and signatures inside tasks, against plain Python."""

import hashlib
import random

from quire.operators import dedup as DD


def plain_shingles(text, k):
    words = (text or "").lower().encode().split()  # blanks of ASCII only
    h = [int(hashlib.md5(w).hexdigest()[:8], 16) % DD.PRIME for w in words]
    out = []
    for i in range(max(len(h) - k + 1, min(len(h), 1))):
        acc = 0
        for x in h[i:i + k]:
            acc = (acc * DD.SHINGLE_BASE + x) % DD.PRIME
        out.append(acc)
    return list(dict.fromkeys(out))


def test_shingles_of_every_length_and_forgotten_words(spark, monkeypatch):
    rnd = random.Random(11)
    texts = [None, "", " \t\n\x0b", "ÉA one\u00a0two", *(" ".join(rnd.choice("abcdefghij") + "ñ" * rnd.randint(0, 2) for _ in range(n))
                                                     for n in (1, 2, 3, 4, 700))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for k in (1, 2, 3, 5):
        got = {r.id: r.tokens for r in DD.portable_shingles(df, "id", "text", k).collect()}
        assert got == {i: plain_shingles(t, k) for i, t in enumerate(texts)}
    monkeypatch.setattr(DD, "KNOWN_WORDS", 2)
    few = DD._Bases()
    assert [few[w] for w in (b"a", b"b", b"c", b"a")] == [plain_shingles(w, 1)[0] for w in "abca"] and len(few) <= 2


def test_signatures_are_taken_in_the_row(spark):
    rnd = random.Random(12)
    edge = [0, 1, DD.PRIME - 1, DD.PRIME - 2]
    sets = [edge, [], None, [5, None], [None], [rnd.randrange(DD.PRIME) for _ in range(DD.CHUNK + 7)], [0], [3]]
    sets += [[rnd.randrange(DD.PRIME) for _ in range(rnd.randint(1, 40))] for _ in range(1500)]
    rows = [(min(i, 1400), s) for i, s in enumerate(sets)]  # an id of many rows
    out = DD.minhash_signatures(spark.createDataFrame(rows, "id long, tokens array<bigint>").coalesce(1), "id", "tokens")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # no row per element
    whole = {}
    for i, s in rows:
        whole.setdefault(i, []).extend(x for x in s or [] if x is not None)
    want = {i: [min(((a * x + b) % DD.PRIME for x in s), default=DD.PRIME) for a, b in DD.lane_constants()] for i, s in whole.items()}
    assert {r.id: r.sig for r in out.collect()} == want
