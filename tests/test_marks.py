"""Sets meet in the lists of their marks: nothing similar is missed, and the
sets themselves are not written."""

import itertools
import random

import numpy as np

from quire.operators import dedup as DD


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _family_sets(rng, families, alone):
    sets = []
    for _ in range(families):  # sizes on both sides of a class's end, too
        base = {rng.getrandbits(62) for _ in range(rng.choice([10, 12, 31, 32, 33, 63, 64, 66, 130, 250, 300]))}
        for _ in range(4):
            s = set(base)
            for _ in range(rng.randint(0, len(base) // 8)):
                if rng.random() < 0.5:
                    s.discard(min(s))
                else:
                    s.add(rng.getrandbits(62))
            sets.append(s)
    return sets + [{rng.getrandbits(62) for _ in range(200)} for _ in range(alone)]


def test_similar_sets_share_a_mark():
    rng = random.Random(2)
    few = []  # tokens that one bucket takes, so that the others stay empty
    while len(few) < 44:
        x = rng.getrandbits(62)
        if int(DD._mixed(np.array([x], np.uint64))[0]) >> 32 < (1 << 32) // 50:
            few.append(x)
    sets = [*_family_sets(rng, 60, 0), set(few[:40]), set(few[2:42]), set(range(9)), set()]
    flat = np.array([x for s in sets for x in sorted(s)], np.uint64)
    size = np.array([len(s) for s in sets])
    for t in (0.8, 0.9, 0.95):
        marks = [set(m) for m in DD._marks(flat, size, t).to_pylist()]
        near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] != sets[b] and sets[a] and _jaccard(sets[a], sets[b]) >= t]
        assert len(near) > 20 and all(marks[a] & marks[b] for a, b in near)
        assert sum(map(len, marks)) < 2 * len(flat) * (1 - t) / t  # far fewer than tokens


def test_only_sets_that_meet_another_are_written(spark, monkeypatch):
    rng = random.Random(4)
    sets = _family_sets(rng, 12, 300)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, tokens array<long>")
    written = []
    for name in ("stored", "stored_counted"):
        def spy(x, keep=getattr(DD, name)):
            out = keep(x)
            if "tokens" in x.columns:
                written.append((out[0] if isinstance(out, tuple) else out).count())
            return out
        monkeypatch.setattr(DD, name, spy)
    got = {r.id: r.kept for r in DD.dedup_sets(df, "id", "id", "tokens", 0.9).kept.collect()}
    kept = []
    for i, s in enumerate(sets):
        if not any(_jaccard(s, sets[k]) >= 0.9 for k in kept):
            kept.append(i)
    assert {i for i, k in got.items() if k} == set(kept) and len(got) == len(sets)
    assert sum(written) <= 48  # all 348 before


def test_a_set_travels_once_for_the_pairs_of_its_family(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(62) for _ in range(300)]
    sets = [set(base[:k] + base[k + 5:]) | {rng.getrandbits(62)} for k in range(0, 150, 5)]
    df = spark.createDataFrame([(i, i, sorted(s), len(s)) for i, s in enumerate(sets)], "id long, ord long, tokens array<long>, n int")
    sent = []
    def spy(x, keep=DD.stored_counted):  # noqa: E306
        out = keep(x)
        if "_g" in x.columns:
            sent.append(out[1])
        return out
    monkeypatch.setattr(DD, "stored_counted", spy)
    near = {(a, b): _jaccard(sets[a], sets[b]) for a, b in itertools.combinations(range(30), 2)}
    assert all(j >= 0.9 for j in near.values())
    assert {(r.a, r.b): r.jaccard for r in DD.jaccard_pairs(df, 0.9).collect()} == near
    assert sent == [30]  # 435 sets before, one a pair
    cand = DD.stored(spark.createDataFrame([(a, b, len(sets[a]), len(sets[b])) for a, b in near], "a long, b long, na int, nb int"))
    for block, most in ((1000, 50_000), (1 << 21, 20)):  # dealt into blocks
        got = DD._verified(cand, df, 0.9, block, most)
        assert sorted((r.a, r.b, r.jaccard) for r in got.collect()) == sorted((a, b, j) for (a, b), j in near.items())
        assert 30 < sent[-1] < 435


def test_ids_and_lists_beyond_the_limit_give_the_same_pairs(spark, monkeypatch):
    sets = _family_sets(random.Random(8), 8, 20)
    df = spark.createDataFrame([(i, i, sorted(s), len(s)) for i, s in enumerate(sets)], "id long, ord long, tokens array<long>, n int")
    monkeypatch.setattr(DD, "FEW_IDS", 9)  # ids go in parts, lists are joined by a shuffle
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if _jaccard(sets[a], sets[b]) >= 0.9}
    assert want and {(r.a, r.b) for r in DD.jaccard_pairs(df, 0.9).collect()} == want
