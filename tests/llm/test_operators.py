"""Training-data operators on small tables: hostile rows and brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import arrays, line_dedup, queries
from quire.llm import lm_score as lm
from quire.llm.decontaminate import decontaminate
from quire.llm.frames import labelled_part
from quire.llm.language_id import language_id
from quire.llm.line_dedup import line_dedup_rows, line_dedup_stage
from quire.llm.lm_score import lm_score
from quire.llm.mixing import mixing
from quire.llm.near_dedup import links_and_nodes, near_dedup, near_dedup_stage
from quire.llm.pii import pii, redact
from quire.llm.quality_classifier import quality_classifier
from quire.llm.quality_rules import quality_rules, repeated_words
from quire.llm.toxicity import toxicity

SMOKE = "/root/testdata/sf0.001"
PASSAGE = "\n".join(f"Line {i} of the shared passage says something long enough. And a little more of it here." for i in range(6))
LONG = " ".join(f"word{i % 977} stays" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.\n" + PASSAGE, "en", "a"),
    (2, PASSAGE + "\nAnother ending follows the shared part of this text.", "en", "a"),
    (3, None, None, None), (4, "", "en", None), (5, "   \n\t ", None, "a"), (6, "one", "en", "a"), (7, "ONE", "en", "a"),
    (None, "A text without an id, with mail x.y@site.example.org and +1 (555) 123-4567 in it.", "en", "b"),
    (8, LONG, "en", "a"), (9, "Same text twice in the table.", "fr", "b"), (9, "Same text twice in the table.", "fr", "b"),
    (10, "idiot " * 50, "en", "a"), (11, "1234 5678", "en", "a"),
    (12, "card 4111 1111 1111 1111 ip 10.0.0.1 and 300.1.1.1 mail a@b.c_d@e.f é" + "1" * 3000, "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "k") for r in ROWS],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, key string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (10, 0, 1), (10, 0, 1), (None, 1, 1), (4, None, None), (8, 1, 0), (12, 0, 0), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")


def tables(spark):
    return [spark.read.parquet(f"{SMOKE}/{t}.parquet") for t in ("documents", "labels", "benchmark")]


def words(text, pattern="[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_word_and_span_hashes_do_not_depend_on_place():
    column = pa.array(["b a  b", None, "", "a b"])
    got = {}
    for _, data, offsets in arrays.blocks(column, 1):
        s, e, _ = arrays.runs(data, offsets, arrays.IS_NOT_SPACE)
        for x, y, h in zip(s, e, arrays.span_hash(data, s, e)):
            got.setdefault(data[x:y].tobytes(), set()).add(int(h))
    assert all(len(h) == 1 for h in got.values()) and len(set.union(*got.values())) == 2


def test_repeated_words_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 7, 8, 9, 40, 200):
        w = [b"%d" % x for x in rng.integers(0, 2, n)]
        grams = [tuple(w[i:i + 8]) for i in range(max(0, n - 7))]
        c = collections.Counter(grams)
        hit = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 8)}
        assert repeated_words(w) == len(hit)


def test_scores_on_hostile_rows(docs, labels):
    for df, folds, out in ((toxicity(docs, labels), 4, 2), (quality_classifier(docs, labels), 5, 0)):
        rows = df.collect()
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    langs = {r.doc_id: r for r in language_id(docs).collect()}
    assert langs[3].lang_pred == langs[4].lang_pred == langs[11].lang_pred == "und" and langs[8].lang_pred in ("en", "fr")
    rates = mixing(docs, labels).collect()
    assert len(rates) == len(ROWS) and all(r.rate >= 0 for r in rates) and {r.n_tokens for r in rates if r.doc_id in (3, 4, 5)} == {0}


def test_sample_of_labels_bounds_the_joined_rows(spark):
    docs = spark.createDataFrame([(1, "same")] * 200 + [(2, f"text {i}") for i in range(200)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    whole = labelled_part(docs, labels, "toxic", 4, -2, 1000).collect()
    assert len(whole) == len(set(whole)) == 202
    few = labelled_part(docs, labels, "toxic", 4, -2, 50).collect()
    assert len(few) == 50 and set(few) <= set(whole)


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (toxicity(none, no_labels), quality_classifier(none, no_labels), language_id(none), mixing(none, no_labels), lm_score(none),
               pii(none), quality_rules(none), near_dedup(none), decontaminate(none, items), line_dedup_rows(none)):
        assert df.count() == 0
    assert {r.rate for r in mixing(docs, no_labels).collect()} == {1.0}
    assert {r.n_hit for r in decontaminate(docs, items).collect()} == {0}


def test_line_dedup_removes_the_second_copy_only(spark, docs):
    got = {r.doc_id: r for r in line_dedup_rows(docs).collect()}
    assert got[1].text == ROWS[0][1] and got[1].removed_chunks == 0
    assert got[2].text == "Another ending follows the shared part of this text." and got[2].removed_chunks == 1
    assert got[3].text is None and got[4].text == "" and got[9].text == ROWS[9][1]
    staged = line_dedup_stage(spark, docs, SMOKE)
    assert staged.columns == docs.columns and staged.count() == len(ROWS)
    assert all(r.n_chars == len(r.text or "") for r in staged.collect())


def plain_lines(text):
    """Lines wrapped after sentence ends, without white space; blank ones are none."""
    pieces = [x for line in (text or "").split("\n") for x in re.split("(?<=[.!?]) ", line)]
    return [x for x in (p.strip(" \t\n\v\f\r") for p in pieces) if x]


def test_line_dedup_keeps_one_copy_of_every_line(spark):
    documents = tables(spark)[0]
    source = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in line_dedup_rows(documents).collect()}
    assert got.keys() == source.keys()
    before, after = collections.Counter(), collections.Counter()
    removed = collections.defaultdict(collections.Counter)
    for i in sorted(source):
        old, new = collections.Counter(plain_lines(source[i])), collections.Counter(plain_lines(got[i].text))
        assert not new - old and len((source[i] or "").encode()) - len((got[i].text or "").encode()) == got[i].removed_bytes
        removed[i] = old - new
        before += old
        after += new
    assert before.keys() == after.keys() and sum(map(len, removed.values())) > 0
    # whatever goes stands in a document before, or twice in its own
    seen = collections.Counter()
    for i in sorted(source):
        old = collections.Counter(plain_lines(source[i]))
        assert all(seen[x] or old[x] > 1 for x in removed[i])
        seen += old


def test_line_dedup_finds_planted_passages_to_the_last_line(spark):
    rng = np.random.default_rng(7)

    def line(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n))

    passages, rows, marks = [], [], []
    for size, per_line in ((60, 20), (100, 20), (160, 20), (600, 20), (60, 4), (200, 7), (52, 26), (55, 55), (60, 12)):
        for _ in range(15):
            passages.append([line(per_line) for _ in range(size // per_line)])
    place = [(k, c) for k in range(len(passages)) for c in range(3)]
    for n, at in enumerate(rng.permutation(len(place))):
        k, copy = place[at]
        around = [[line(int(w)) for w in rng.integers(2, 25, int(rng.integers(1, 6)))] for _ in range(2)]
        gap = ("\n", " \n", "\r\n")[copy] if len(passages[k]) == 1 else "\n"
        rows.append((n, gap.join([*around[0], *passages[k], *around[1]])))
        marks.append((n, k, around))
    got = {r.doc_id: r.text for r in line_dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    first = {}
    for n, k, around in marks:
        left = plain_lines(got[n])
        assert [x for x in left if x not in passages[k]] == [*around[0], *around[1]]
        here = [x for x in left if x in passages[k]]
        assert here == (passages[k] if first.setdefault(k, n) == n else [])


def test_line_dedup_chunks_do_not_depend_on_their_surroundings():
    rng = np.random.default_rng(3)
    core = [" ".join(f"w{x}" for x in rng.integers(0, 50, int(n))) for n in rng.integers(1, 30, 40)]

    def inside(texts):
        raw = "\n".join(texts).encode()
        lines = line_dedup.lines_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        c = line_dedup.chunks(np.frombuffer(raw, np.uint8), lines)
        return {raw[lines.x[i]:lines.y[j]].decode() for i, j in zip(c.first, c.last)}

    alone, shifted = inside(core), inside(["other words come first", *core, "and others last"])
    middle = "\n".join(core[8:-8])
    assert {x for x in alone if x in middle} == {x for x in shifted if x in middle} and len(alone) > 10


def test_line_dedup_defined_cases(spark):
    long_line = " ".join(f"n{i}" for i in range(40))
    rows = [(1, f"x\n{long_line}", 0), (1, f"x\n{long_line}", 0), (2, f"{long_line}\n\n\n", 1), (3, None, 2), (3, "", 2), (4, " \n\t\n", 3),
            (None, f"  {long_line}  ", 4), (5, f"{long_line}\n{long_line}\nend", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long")
    for name in ("key", "row", "own_id", "hash", "spans", "rest", "r_id", "content", "before", "end"):
        docs = docs.withColumn(name, F.lit(name))
    staged = line_dedup_stage(spark, docs, SMOKE)
    assert staged.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in staged.collect())
    # a null id sorts first and keeps its copy; repeated rows are rewritten alike
    assert got == collections.Counter({(1, "x\n"): 2, (2, ""): 1, (3, None): 1, (3, ""): 1, (4, " \n\t\n"): 1, (None, f"  {long_line}  "): 1, (5, "end"): 1})


def test_quality_rules_on_hostile_rows(spark, docs):
    got = quality_rules(docs.withColumn("max_symbol_rate", F.lit(1)).withColumn("bucket", F.lit(2))).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and all(by[i].base_failed and not by[i].kept for i in (3, 4, 5, 6, 7, 10, 11))
    assert by[12].n_words == 12 and by[8].n_words == 60_000
    assert len({(r.n_words, r.kept) for r in got if r.doc_id == 9}) == 1


def test_limits_are_quantiles_of_each_group(spark):
    rows = []
    for source, step in (("clean", 100), ("messy", 4)):
        for i in range(400):  # one or twenty-five in a hundred documents have symbols, i of them
            body = " ".join(f"word{j}{source}{i}" for j in range(200))
            rows.append((len(rows), body + (" " + "# " * (i // 4) if i % step == 0 else ""), "en", source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    out = {s: [i for i, (k, _, _, source) in enumerate(rows) if source == s and not kept[k]] for s in ("clean", "messy")}
    assert 4 <= len(out["messy"]) <= 40 and len(out["clean"]) <= 40
    # the limit of the clean group is far under what the messy one allows
    worst = lambda s: max(rows[i][1].count("#") for i, r in enumerate(rows) if r[3] == s and kept[r[0]])
    assert worst("clean") < 10 < 60 < worst("messy")


def test_near_dedup_brute_force(spark, docs):
    documents = tables(spark)[0].select("doc_id", "text")
    extra = [(10_000 + i, " ".join(f"w{j}" if j % 60 != i % 60 else f"x{i}" for j in range(300))) for i in range(60)]
    got = {r.doc_id: r for r in near_dedup(documents.union(spark.createDataFrame(extra, documents.schema))).collect()}
    sets = {}
    for i, t in [*[(r.doc_id, r.text) for r in documents.collect()], *extra]:
        w = words(t)
        sets[i] = {tuple(w[j:j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), root(i)) for i in ids}
    own = {r.doc_id: r for r in near_dedup(docs).collect()}
    assert own[7].component_id == 6 and own[3].kept and own[4].kept and own[None].component_id is None and own[None].kept


def test_near_dedup_stage_links_five_word_shingles_at_080(spark):
    body = [f"w{i}" for i in range(400)]
    # a block of 22 % more: 396 of 484 shingles are shared (0.818); one of 28 %: 396 of 508 (0.780)
    rows = [(1, " ".join(body)), (2, " ".join(body + [f"x{i}" for i in range(88)])), (3, " ".join(body[::-1])),
            (4, " ".join(body[::-1] + [f"y{i}" for i in range(112)])), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup_stage(spark, docs, SMOKE).collect()) == [1, 3, 4, 5, 6]
    assert all(r.kept for r in near_dedup(docs).collect())  # op5: 398 of 486 is under 0.85


def test_near_dedup_stage_keeps_each_text_once(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, c), (9, c), (9, c.upper()), (7, b + " more"), (5, b + " tail"), (None, a), (None, a), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "row", 1, 0.5) for r in rows], "doc_id long, text string, row string, own_id int, score double")
    got = sorted(((r.doc_id, r.text) for r in near_dedup_stage(spark, docs, SMOKE).collect()), key=repr)
    pick = [r for r in got if r[0] in (5, 9)]
    assert len(pick) == 2 and {r[0] for r in pick} == {5, 9} and pick[0][1].startswith(b)
    assert sorted([r for r in got if r not in pick], key=repr) == sorted([(1, a), (None, a), (None, a), (3, None), (3, None), (4, "")], key=repr)
    assert near_dedup_stage(spark, docs, SMOKE).columns == docs.columns


def test_repeated_rows_are_compared_once(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a)] * 30 + [(2, a + " b")] * 30, "doc_id long, text string").repartition(4)
    rows, nodes, comps = links_and_nodes(docs)
    assert rows.count() == 60 and nodes.count() == 2 and comps.count() == 2
    assert {(r.doc_id, r.component_id) for r in near_dedup(docs).collect()} == {(1, 1), (2, 1)}


def test_decontamination_on_hostile_rows(spark, docs):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (2, None), (3, ""), (None, "lazy dog"), (5, PASSAGE)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert got[6].contaminated and got[7].n_hit == 1 and got[6].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[2].n_items == 1 and got[2].n_hit == len(words(PASSAGE, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    assert got[3].n_words == 0 and not got[3].contaminated


def test_lm_base_score_brute_force(docs):
    got = lm_score(docs).collect()
    learnt = [words(r[1]) for r in ROWS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = collections.Counter(w for x in learnt for w in x)
    total, size = sum(c.values()) + len(learnt), len(c) + 1
    texts = {r[0]: words(r[1]) for r in ROWS}
    for r in got:
        w = texts[r.doc_id]
        base = sum(math.log10((c[x] + 1) / (total + size + 1)) for x in w) + math.log10((len(learnt) + 1) / (total + size + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and math.isfinite(r.score) and r.score < 0


def test_lm_score_predicts_words_beyond_the_most_frequent(spark):
    rng = np.random.default_rng(3)
    # 2500 pairs of equally frequent words; the second follows the first only
    rows = [(i, " ".join(f"a{x} b{x}" for x in rng.integers(0, 2500, 100))) for i in range(2000)]
    got = lm_score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score + 0.2 * r.n_tokens for r in got)
    # words outside the table of frequent words are told apart by their buckets
    docs = spark.createDataFrame([(r[0] * 7, r[1]) for r in rows], "doc_id long, text string")
    rows, few, shape, weights = lm.fitted(docs, 100)
    assert len(few.hot) <= 100 and len(few.spelled) > 500
    by = lm.score(rows, few, shape, weights).collect()
    assert len(by) == len(docs.collect()) and sum(r.score for r in by) > sum(r.base_score + 0.2 * r.n_tokens for r in by)


def test_lm_probabilities_are_whole():
    """Over all symbols, the model's probabilities add up to one in any context,
    and the digits' decisions are those of a plain walk."""
    rng = np.random.default_rng(6)
    counts = np.r_[40.0, np.sort(rng.integers(1, 500, 150))[::-1], 7.0]
    shape = lm.classes(counts, rng.integers(0, lm.CLUSTERS, len(counts)))
    model = lm._Model(shape, 14)
    model.flat[:] = rng.normal(0, 0.7, len(model.flat))
    every = np.arange(len(counts))
    for two, one in ((0, 0), (3, 9), (9, 151)):
        before = np.full(len(every), one)
        total = model.clusters(np.full(len(every), two), before)[0][every, shape.cluster]
        total = total * model.bands(before, every)[0][every, shape.band]
        which, digit, odds, place = model.digits(before, every)
        plain = np.ones(len(every))
        for w, d, o in zip(which, digit, odds):
            plain[w] *= 1 / (1 + math.exp(-o if d else o))
        total *= plain
        assert abs(total.sum() - 1) < 1e-4
        seen = np.array([two, one, 5, 0], np.int64) if two else np.array([5, 0], np.int64)
        at = lm._log10_each(model, seen)
        if two:
            assert abs(10 ** at[2] - total[5]) < 1e-5


def test_lm_clusters_tell_languages_apart():
    rng = np.random.default_rng(2)
    near = np.zeros((40, 40))
    group = np.arange(40) % 3
    for a in range(40):
        for b in range(40):
            near[a, b] = rng.integers(50, 90) if group[a] == group[b] else rng.integers(0, 4)
    label = lm._seed_clusters(near + near.T, 3)
    assert len({(g, x) for g, x in zip(group, label)}) == 3


def pii_base(t):
    found = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = [int(x) for x in m.group() if x.isdigit()]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if good:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_pii_base_spans(spark, docs):
    source = docs.select("doc_id", "text").union(tables(spark)[0].selectExpr("doc_id + 1000", "text"))
    texts = {r.doc_id: r.text for r in source.collect()}
    for r in pii(source).collect():
        base = pii_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone"))
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert "x.y@site" not in clean[None] and "[email]" in clean[None] and clean[3] is None and clean[1] == ROWS[0][1]


def test_pii_adds_other_forms_and_leaves_alike_numbers(spark):
    rng = np.random.default_rng(8)
    n = lambda a, b: int(rng.integers(a, b))
    word = lambda: "".join(rng.choice(list("abcdefghklmnoprst"), n(3, 8)))
    hints = {"email": ("mail", "write to", "contact"), "ip": ("server", "host"), "phone": ("call", "phone", "tel")}
    base = {"email": lambda: (f"{word()}.{word()}", word())[n(0, 2)] + f"@{word()}." + ("org", "net")[n(0, 2)], "ip": lambda: ".".join(str(n(1, 255)) for _ in range(4)),
            "phone": lambda: (f"+{n(1, 99)} ({n(100, 999)}) {n(100, 999)}-{n(1000, 9999)}", f"+{n(10, 99)} {n(10, 9999)} {n(10000, 9999999)}")[n(0, 2)]}
    more = {"email": lambda: f"{word()} (at) {word()} (dot) org", "ip": lambda: ":".join(f"{n(1, 65535):x}" for _ in range(8)),
            "phone": lambda: (f"({n(100, 999)}) {n(100, 999)}-{n(1000, 9999)}", f"0{n(100, 999)} {n(10000, 99999)} {n(1000, 9999)}")[n(0, 2)]}
    alike = [lambda: f"version {n(1, 9)}.{n(0, 20)}.{n(0, 9)}.{n(0, 9)}.{n(0, 9)}", lambda: f"{n(1900, 2030)}-{n(10, 13)}-{n(10, 28)} {n(10, 24)}:{n(10, 60)}",
             lambda: f"from {n(100, 999)} {n(100, 999)} to {n(1000, 9999)}", lambda: f"pages {n(10, 99)}-{n(100, 999)} {n(1000, 9999)}",
             lambda: f"stayed at {word()}", lambda: f"ratio {n(1, 9)}:{n(1, 9)}:{n(1, 9)}:{n(1, 9)}", lambda: f"{n(1, 99999)} items",
             lambda: f"{n(10, 24)}:{n(10, 60)} and {n(1, 99)}.{n(1, 99)} km"]
    rows, planted, wrong = [], {}, set()
    for i in range(900):
        kind = ("email", "ip", "phone")[i % 3]
        hint = hints[kind][n(0, len(hints[kind]))]
        lead = " ".join(word() for _ in range(n(4, 9)))
        if i < 300:
            rows.append((i, f"{lead} {hint} {base[kind]()} {word()} {word()}"))
        elif i < 600:
            rows.append((i, f"{lead} {word()} {alike[n(0, len(alike))]()} {word()}"))
            wrong.add(i)
        else:
            form = more[kind]()
            text = f"{lead} {hint} {form} {word()}"
            planted[i] = f"{kind}:{text.index(form)}:{text.index(form) + len(form)}"
            rows.append((i, text))
    got = {r.doc_id: r for r in pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i, s in planted.items() if s in got[i].spans.split(",")]
    false = sum(got[i].spans != ",".join(pii_base(rows[i][1])) for i in wrong)
    by = {k: sum(planted[i].startswith(k) for i in found) for k in base}
    assert min(by.values()) >= 80 and len(found) >= 0.9 * (len(found) + false), (by, false)
    for i in planted:  # base columns know nothing of them
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len(pii_base(rows[i][1]))


def test_mixing_meets_its_targets(spark):
    documents, labels, _ = tables(spark)
    rows = mixing(documents, labels, {"1,0": 0.7, "0,0": 0.3}).collect()
    p = np.array([r.posteriors for r in rows])
    total = (p * np.array([r.n_tokens * r.rate for r in rows])[:, None]).sum(0)
    assert np.allclose(p.sum(1), 1) and abs(total.sum() / sum(r.n_tokens for r in rows) - 1) < 0.1


def test_stages_keep_the_columns_of_documents(spark):
    documents = tables(spark)[0]
    kept = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SMOKE)
        assert kept.columns == documents.columns and 0.5 * before < kept.count() <= before, name
    assert len(queries.QUERIES) == 13


def test_numerals_are_no_letters(spark):
    texts = [(1, "²"), (2, "½ ½"), (3, "①"), (4, "Ⅷ"), (5, "٣ 3"), (6, "_"), (11, "ª"), (12, "½ the"), (13, "漢")]
    train = [(20 + i, "the words of a language and the rest " * 3, "en") for i in range(20)]
    docs = spark.createDataFrame([(i, t, None) for i, t in texts] + train, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(1, 7)) and all(got[i][0] == "en" for i in (11, 12, 13))


def test_language_id_on_held_out_documents(spark):
    docs = tables(spark)[0]
    got = language_id(docs).where("held_out").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
