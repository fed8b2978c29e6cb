"""Remaining functions, hooks and sinks."""

import json
import os
import re
import tempfile

from pyspark.sql import functions as F

from quire.functions import degrees as D
from quire.functions.fuzzy import description_or_default, first_name_in_key, page_url
from quire.functions.html import unescape_stored
from quire.operators.arguments import direct_conclusions, direct_phase1_requests, run_completions
from quire.operators.matching import attach_pages, match_status
from quire.sources import readers as R
from quire.sources import writers as W


def test_notebook_pattern_needs_jvm_lookaround(spark):
    samples = ["Bachelor of Arts in 1990", "earned a B.F.A. degree", "M.Ed program", "x.BA y", "Juris Doctor", "an MBA."]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = {r.t: r.m for r in df.select("t", D.mentions("t", "notebook").alias("m")).collect()}
    py = re.compile(D.NOTEBOOK[4:], re.IGNORECASE)
    assert got == {s: bool(py.search(s)) for s in samples}


def test_unescape_stored_and_page_helpers(spark):
    df = spark.createDataFrame([("a\\nb\\t\\\"c\\\"", None, "Joe Biden", "joe_biden")], "s string, d string, n string, k string")
    r = df.select(unescape_stored("s").alias("u"), description_or_default("d").alias("d"),
                  page_url("k").alias("url"), first_name_in_key("n", "k").alias("f")).first()
    assert r.u == 'a\nb\t"c"' and r.d == "a Wikipedia article" and r.url.endswith("/joe_biden") and r.f is True


def test_attach_pages_only_for_matches(spark):
    names = spark.createDataFrame([("ann lee",), ("bo kim",)], "name string")
    cands = spark.createDataFrame([("ann lee", 1, "Ann_Lee", "a page")], "name string, rnk int, candidate_key string, description string")
    pages = spark.createDataFrame([("Ann_Lee", "<p>x</p>")], "key string, source string")
    got = {r.name: (r.status, r.source) for r in attach_pages(match_status(names, cands), pages).collect()}
    assert got == {"ann lee": ("MATCHED", "<p>x</p>"), "bo kim": ("NO_RESULTS", None)}


def test_completion_hook_feeds_phase_parser(spark):
    arts = spark.createDataFrame([(0, "a0", "first text"), (1, "a1", "second")], "i long, article_id string, text string")
    req = direct_phase1_requests(arts)
    fake = lambda prompts: ["1. claim for " + p.rsplit("\n", 1)[-1] for p in prompts]
    resp = run_completions(req, fake)
    got = sorted((r.i, r.conclusion) for r in direct_conclusions(resp).collect())
    assert got == [(0, "claim for first text"), (1, "claim for second")]


def test_csv_lists_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="quire-test-")
    with open(os.path.join(d, "authors.csv"), "w") as f:
        f.write("id,author_name\n1,Ann Lee\n2,Bo Kim\n")
    with open(os.path.join(d, "gold.csv"), "w") as f:
        f.write("author_name,urls\nAnn Lee,https://x/wiki/Ann_Lee\n")
    assert R.read_author_list(spark, os.path.join(d, "authors.csv")).count() == 2
    assert R.read_gold(spark, os.path.join(d, "gold.csv")).first().urls.endswith("Ann_Lee")
    pages = spark.createDataFrame([(1, "Ann Lee", "Ann_Lee", "<p>x</p>")], R.PAGE_SCHEMA)
    W.write_star({"pages": pages}, os.path.join(d, "star"), fmt="csv")
    assert R.read_pages(spark, os.path.join(d, "star", "pages")).count() == 1
    parsed = spark.createDataFrame([(1, "Ann Lee", "## Degree Mentions", "extra")], "id long, author_name string, sentences string, x string")
    W.write_parsed(parsed, os.path.join(d, "parsed"))
    assert spark.read.parquet(os.path.join(d, "parsed")).columns == ["id", "author_name", "sentences"]
    prof = spark.createDataFrame([(1, "Ann Lee", [("BA", ["Law"])])],
                                 "id long, author_name string, degrees array<struct<degree_type:string,degree_field:array<string>>>")
    W.write_degrees(prof, os.path.join(d, "deg"))
    line = json.loads(spark.read.text(os.path.join(d, "deg")).first().value)
    assert line == {"id": 1, "author_name": "Ann Lee", "degrees": [{"degree_type": "BA", "degree_field": ["Law"]}]}


def test_embedding_hook_then_dedup(spark):
    from quire.operators.dedup import dedup_sets, embed_texts, embedding_set
    docs = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "c d e")], "id long, text string")
    fake = lambda texts: [[float(len(t)), float(t.count(" ")), 0.5] for t in texts]
    emb = embed_texts(docs, "text", fake)
    sets = emb.select("id", embedding_set("embedding").alias("tokens"))
    kept = {r.id for r in dedup_sets(sets, "id", "id", "tokens").kept.where("kept").collect()}
    assert kept == {0, 2}


def test_rank_in_group_and_blacklist_table(spark):
    import random
    from quire.operators.ids import rank_in_group
    from quire.operators.sections import html_sections
    rnd = random.Random(9)
    data = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(20)}", i) for i in rnd.sample(range(5000), 600)]
    df = spark.createDataFrame(data, "k string, p long")
    got = sorted(tuple(r) for r in rank_in_group(df, "k", "p", num_partitions=8).select("k", "p", "rank").collect())
    want, seen = [], {}
    for k, p in sorted(data, key=lambda x: (x[0], x[1])):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, p, seen[k]))
    assert got == sorted(want)
    pages = spark.createDataFrame([(1, "<h2>Keep</h2><p>x</p><h2>Drop me</h2><p>y</p>")], "page_id long, source string")
    terms = spark.createDataFrame([("Drop me",)], "term string")
    assert [r.title for r in html_sections(pages, blacklist=terms).collect()] == ["Keep"]
