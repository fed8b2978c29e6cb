"""Readers, writers and the streaming intake on scratch folders."""

import datetime
import json
import os
import subprocess
import tempfile
import time

from pyspark.sql import functions as F

from quire.operators.arguments import build_requests, latest_content, parse_responses, request_json
from quire.sources import readers as R
from quire.sources import writers as W
from quire.streaming.intake import read_sink, sink_high_water_mark, start_intake, write_batch


def scratch():
    return tempfile.mkdtemp(prefix="quire-test-")


def test_read_articles_csv_multiline(spark):
    d = scratch()
    path = os.path.join(d, "a.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(R.ARTICLE_COLUMNS) + "\n")
        body = ['"T1"', '"A, B"', '"line one\nline two"'] + ['""'] * (len(R.ARTICLE_COLUMNS) - 3)
        f.write(",".join(body) + "\n")
        f.write(",".join(['"T2"', '"C D"', '"x"'] + ['""'] * (len(R.ARTICLE_COLUMNS) - 3)) + "\n")
    df = R.read_articles(spark, path)
    got = df.orderBy("pos").select("titulo", "autor", "texto_completo").collect()
    assert [tuple(r) for r in got] == [("T1", "A, B", "line one\nline two"), ("T2", "C D", "x")]


def test_read_corpus_dispatch(spark):
    import pytest
    with pytest.raises(ValueError, match="Unsupported"):
        R.read_corpus(spark, "/x/data.xlsx")


def test_read_terms_keeps_order_and_trims(spark):
    d = scratch()
    p = os.path.join(d, "terms.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write(" See also\r\n References\r\n\r\n Notes")
    got = [(r.rank, r.term) for r in R.read_terms(spark, p).orderBy("rank").collect()]
    assert got == [(0, "See also"), (1, "References"), (3, "Notes")]


def test_requests_and_responses_round_trip(spark):
    d = scratch()
    arts = spark.createDataFrame([(0, "texto ñ")], "i long, text string")
    req = build_requests(arts, F.lit("c_0"), F.col("text"))
    W.write_requests(req, os.path.join(d, "req"))
    line = json.loads(spark.read.text(os.path.join(d, "req")).first().value)
    assert line == {"custom_id": "c_0", "method": "POST", "url": "/v1/chat/completions",
                    "body": {"model": "gpt-4o-mini", "messages": [{"role": "user", "content": "texto ñ"}],
                             "temperature": 0.1}}
    assert request_json(req).first().value.startswith('{"custom_id":"c_0"')
    resp = os.path.join(d, "resp.jsonl")
    with open(resp, "w", encoding="utf-8") as f:
        f.write(json.dumps({"custom_id": "c_0", "response": {"body": {"choices": [{"message": {"content": "1. a"}}]}}}) + "\n")
        f.write("\n   \n")
        f.write("{broken\n")
        f.write(json.dumps({"custom_id": "c_0", "response": {"body": {"choices": [{"message": {"content": " 2. b "}}]}}}) + "\n")
    r = R.read_responses(spark, resp)
    assert r.count() == 3
    parsed = r.select("line", "custom_id", F.col("response")).withColumn(
        "content", F.coalesce(F.get(F.col("response.body.choices"), 0)["message"]["content"], F.lit("")))
    last = latest_content(parsed.withColumn("content", F.trim("content")))
    assert [(x.custom_id, x.content) for x in last.collect()] == [("c_0", "2. b")]
    lines = spark.createDataFrame([(1, '{"custom_id": "x"}'), (2, None)], "line long, value string")
    assert [(x.custom_id, x.content) for x in parse_responses(lines).orderBy("line").collect()] == [("x", ""), (None, "")]


def test_results_writers(spark):
    d = scratch()
    empty = spark.createDataFrame([], "article_id string, claim string")
    assert W.write_results_csv(empty, os.path.join(d, "none")) == 0 and not os.path.exists(os.path.join(d, "none"))
    assert not os.path.exists(os.path.join(d, "none"))
    one = spark.createDataFrame([("a", "c")], "article_id string, claim string")
    assert W.write_results_csv(one, os.path.join(d, "csv")) >= 1
    W.write_results_json(one, os.path.join(d, "json"))
    assert spark.read.json(os.path.join(d, "json")).first().claim == "c"


def test_write_star_observes_row_counts(spark):
    d = scratch()
    got = W.write_star({"a": spark.range(5), "b": spark.range(0)}, d)
    assert got == {"a": 5, "b": 0} and spark.read.parquet(os.path.join(d, "a")).count() == 5


def test_save_and_reuse_duplicates(spark):
    d = scratch()
    arts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, t string")
    W.save_duplicates(arts.where("id IN (1, 3)"), "id", os.path.join(d, "dups"))
    kept = W.reuse_duplicates(arts, "id", os.path.join(d, "dups"))
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4]


def test_export_files_and_streaming_intake(spark):
    d = scratch()
    src = os.path.join(d, "exports")
    os.makedirs(src)
    docs = {"e1.txt": "Title\nFecha de publicación: Mar 3, 2021\nbody", "e2.txt": "Fecha de publicación: Apr 10, 2021\nx",
            "e3.txt": "no date here"}
    for i, (name, text) in enumerate(docs.items()):
        p = os.path.join(src, name)
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)
        os.utime(p, (1_600_000_000 + i, 1_600_000_000 + i))
    batch = R.read_export_files(spark, os.path.join(src, "*.txt"))
    assert batch.count() == 3
    sink, ckpt = os.path.join(d, "sink"), os.path.join(d, "ckpt")
    start_intake(spark, src, sink, ckpt).awaitTermination()
    got = {os.path.basename(r.id): r.pub_date for r in read_sink(spark, sink).collect()}
    assert {k: (v.isoformat() if v else None) for k, v in got.items()} == \
        {"e1.txt": "2021-03-03", "e2.txt": "2021-04-10", "e3.txt": None}
    # a second run reads only new files (the checkpoint remembers the rest)
    with open(os.path.join(src, "e4.txt"), "w", encoding="utf-8") as f:
        f.write("Fecha de publicación: May 1, 2021")
    # an export older than all others and one without a date are not lost
    for name, text in (("e5.txt", "Fecha de publicación: Jan 5, 2020"), ("e6.txt", "nothing dated")):
        with open(os.path.join(src, name), "w", encoding="utf-8") as f:
            f.write(text)
    start_intake(spark, src, sink, ckpt).awaitTermination()
    assert read_sink(spark, sink).count() == 6
    assert sink_high_water_mark(spark, sink).first().start_date.isoformat() == "2021-05-01"


def test_intake_takes_files_of_any_age(spark):
    d = scratch()
    src, sink, ckpt = (os.path.join(d, x) for x in ("exports", "sink", "ckpt"))
    os.makedirs(src)
    now = time.time()
    for run, files in enumerate(([("today", 0)], [("month", 30), ("decade", 3650)], [("late", 9), ("new", 0)])):
        for name, days in files:
            p = os.path.join(src, f"{name}.txt")
            with open(p, "w", encoding="utf-8") as f:
                f.write(f"{name}\nFecha de publicación: Mar 3, 2021")
            os.utime(p, (now - days * 86400,) * 2)
        start_intake(spark, src, sink, ckpt).awaitTermination()
    got = [os.path.basename(r.id) for r in read_sink(spark, sink).collect()]
    assert sorted(got) == ["decade.txt", "late.txt", "month.txt", "new.txt", "today.txt"]


def test_intake_sink_is_idempotent(spark):
    sink = os.path.join(scratch(), "sink")
    t = [datetime.datetime(2021, 1, i) for i in (1, 2, 3)]
    schema = "id string, mtime timestamp, value string, pub_date date"
    batches = [[("a", t[0], "old", None), ("a", t[1], "newer", None), ("b", t[0], "b", None), (None, t[0], "x", None), (None, t[0], "x", None)],
               [("a", t[2], "again", None), ("c", t[0], None, None)], []]
    assert read_sink(spark, sink).count() == 0 and sink_high_water_mark(spark, sink).first().start_date is None
    for n in (0, 1, 1, 0, 2):  # batches are run again, one of them after a later one
        write_batch(spark.createDataFrame(batches[n], schema), "r1", n, sink)
    want = [("a", "newer"), ("b", "b"), ("c", None), (None, "x"), (None, "x")]
    assert sorted(((r.id, r.value) for r in read_sink(spark, sink).collect()), key=repr) == sorted(want, key=repr)
    # a new checkpoint over the old sink overwrites nothing
    write_batch(spark.createDataFrame([("c", t[0], "c", None), ("d", t[0], "d", None)], schema), "r2", 0, sink)
    assert sorted(((r.id, r.value) for r in read_sink(spark, sink).collect()), key=repr) == sorted(want + [("d", "d")], key=repr)


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run(["python", os.path.join(repo, "bench.py"), "tag_links", "token_cost"], env=env,
                         capture_output=True, text=True, timeout=300)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"tag_links", "token_cost"} and rec["sf"] == 0.001


def test_results_csv_does_not_grow_with_the_copies_of_a_text(spark):
    import random
    d, rng = scratch(), random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnop \n\",") for _ in range(8000))
    flat = spark.createDataFrame([(i, text, f"c{i}") for i in range(100)], "article_id long, text string, claim string").coalesce(1)
    assert W.write_results_csv(flat, os.path.join(d, "csv")) == 100
    size = sum(os.path.getsize(os.path.join(d, "csv", f)) for f in os.listdir(os.path.join(d, "csv")))
    assert size < 5 * len(text)  # plain, it is a hundred times the text
    back = (spark.read.schema(flat.schema).option("header", True).option("multiLine", True).option("escape", '"')
            .csv(os.path.join(d, "csv")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))
