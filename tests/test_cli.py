"""The command line runs the jobs on files."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quire.__main__ import main
from quire.sources.fixtures import fixture
from quire.sources.readers import ARTICLE_COLUMNS
from tests.conftest import SMOKE


def test_cli_articles_and_arguments(spark):
    d = tempfile.mkdtemp(prefix="quire-cli-")
    raw = fixture(spark, SMOKE, "job_raw_articles")
    cols = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ARTICLE_COLUMNS]
    raw.orderBy("pos").select(*cols).coalesce(1).write.option("header", True).option("escape", '"').csv(f"{d}/raw")
    csv = [f for f in os.listdir(f"{d}/raw") if f.endswith(".csv")][0]
    assert main(["articles", "--input", f"{d}/raw/{csv}", "--output", f"{d}/star"]) == 0
    assert spark.read.parquet(f"{d}/star/articles").count() > 0
    assert not os.path.exists(f"{d}/star/counts")

    corpus = f"{d}/corpus.csv"
    with open(corpus, "w", encoding="utf-8") as f:
        f.write("id,texto\n" + "".join(f'{i},"text number {i}"\n' for i in range(6)))
    common = ["--input", corpus, "--columns", "id,texto", "--text-column", "texto", "--id-column", "id"]
    assert main(["requests", *common, "--start", "2", "--num-rows", "3", "--output", f"{d}/p1"]) == 0
    req = [json.loads(r.value) for r in spark.read.text(f"{d}/p1").collect()]
    assert sorted(x["custom_id"] for x in req) == ["c_0", "c_1", "c_2"]
    assert all("text number" in x["body"]["messages"][0]["content"] for x in req)
    with open(f"{d}/r1.jsonl", "w") as f:
        for i in range(3):
            f.write(json.dumps({"custom_id": f"c_{i}", "response": {"body": {"choices": [{"message": {"content": f"1. c{i}\n2. d{i}"}}]}}}) + "\n")
    assert main(["fanout", *common, "--start", "2", "--num-rows", "3", "--responses", f"{d}/r1.jsonl", "--phase", "2",
                 "--output", f"{d}/p2"]) == 0
    assert spark.read.text(f"{d}/p2").count() == 6
    with open(f"{d}/r2.jsonl", "w") as f:
        f.write(json.dumps({"custom_id": "p_0_0", "response": {"body": {"choices": [{"message": {"content": "- a\n- b"}}]}}}) + "\n")
    assert main(["combine", *common, "--start", "2", "--num-rows", "3", "--responses", f"{d}/r1.jsonl", f"{d}/r2.jsonl",
                 "--output", f"{d}/res"]) == 0
    res = {r.article_id: r for r in spark.read.json(f"{d}/res/results_json").collect()}
    assert sorted(res) == ["2", "3", "4"] and res["2"].arguments[0].premises == ["a", "b"]
    assert spark.read.option("header", True).csv(f"{d}/res/results_csv").count() == 6


def test_cli_degrees_and_match(spark):
    d = tempfile.mkdtemp(prefix="quire-cli-")
    pages = fixture(spark, SMOKE, "wiki_pages").select(F.col("page_id").alias("id"), F.lit("A B").alias("author_name"),
                                                        F.lit("k").alias("key"), "source")
    pages.write.parquet(f"{d}/pages.parquet")
    assert main(["degrees", "--input", f"{d}/pages.parquet", "--output", f"{d}/parsed"]) == 0
    assert spark.read.parquet(f"{d}/parsed").count() == pages.count()
    with open(f"{d}/names.csv", "w") as f:
        f.write("id,author_name\n1,ann lee\n2,bo kim\n")
    with open(f"{d}/cands.csv", "w") as f:
        f.write("name,rnk,candidate_key,description\nann lee,1,Ann_Lee,a page\n")
    with open(f"{d}/gold.csv", "w") as f:
        f.write("author_name,urls\nann lee,https://x/wiki/Ann_Lee\nbo kim,https://x/wiki/Bo_Kim\n")
    assert main(["match", "--names", f"{d}/names.csv", "--candidates", f"{d}/cands.csv", "--gold", f"{d}/gold.csv",
                 "--output", f"{d}/m"]) == 0
    st = {r.name: r.status for r in spark.read.parquet(f"{d}/m/status").collect()}
    assert st == {"ann lee": "MATCHED", "bo kim": "NO_RESULTS"}
    assert spark.read.option("header", True).csv(f"{d}/m/sweep").count() == 19


def test_cli_profiles_and_intake(spark):
    d = tempfile.mkdtemp(prefix="quire-cli-")
    with open(f"{d}/replies.jsonl", "w") as f:
        f.write(json.dumps({"id": 1, "author_name": "Ann", "degrees_json": json.dumps(
            {"studies": [{"degree_type": "BA", "degree_field": ["Law"]}]})}) + "\n")
        f.write(json.dumps({"id": 2, "author_name": "Bo", "degrees_json": "not json"}) + "\n")
    assert main(["profiles", "--input", f"{d}/replies.jsonl", "--output", f"{d}/prof"]) == 0
    prof = [json.loads(r.value) for r in spark.read.text(f"{d}/prof/profiles").collect()]
    assert prof == [{"id": 1, "author_name": "Ann", "degrees": [{"degree_type": "BA", "degree_field": ["Law"]}]}]
    assert [r.id for r in spark.read.json(f"{d}/prof/quarantine").collect()] == [2]
    os.makedirs(f"{d}/exports")
    with open(f"{d}/exports/a.txt", "w", encoding="utf-8") as f:
        f.write("Fecha de publicación: Jan 9, 2022\nbody")
    assert main(["intake", "--source", f"{d}/exports", "--sink", f"{d}/sink", "--checkpoint", f"{d}/ck"]) == 0
    assert spark.read.parquet(f"{d}/sink").first().pub_date.isoformat() == "2022-01-09"
