"""Command line: run the jobs on files.

    python -m quire articles  --input raw.csv --output out/ [--format csv]
    python -m quire requests  --input corpus.csv --text-column texto --id-column id
                              --pipeline direct|socratic --output phase1/ [--start N --end M | --num-rows K]
    python -m quire fanout    --input corpus.csv ... --responses phase1.jsonl --phase 2 --output phase2/
    python -m quire combine   --input corpus.csv ... --responses p1.jsonl p2.jsonl [p3.jsonl] --output results/
    python -m quire degrees   --input pages.csv --output parsed/
    python -m quire profiles  --input replies.jsonl --output profiles/
    python -m quire match     --names names.csv --candidates candidates.csv [--gold gold.csv] --output match/
    python -m quire intake    --source exports/ --sink table/ --checkpoint ckpt/

Sessions come from ``SparkSession.builder.getOrCreate()`` (spark-submit
decides the master and ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _corpus(spark, a):
    from quire.operators.clean import select_corpus
    from quire.operators.ids import dense_ids, row_slice
    from quire.sources.readers import read_corpus
    schema = None
    if a.input.lower().endswith(".csv"):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in a.columns.split(",")]) if a.columns else None
    df = select_corpus(read_corpus(spark, a.input, schema), a.text_column, a.id_column)
    if a.start or a.end is not None or a.num_rows is not None:
        df = row_slice(df, "pos", a.start, a.end, a.num_rows, "i")
        return dense_ids(df.drop("i"), "pos", "i")
    return dense_ids(df, "pos", "i")


def _responses(spark, path):
    from quire.functions.lists import response_content
    from quire.sources.readers import read_responses
    r = read_responses(spark, path)
    return r.select("line", "custom_id", response_content(F.col("response")).alias("content"))


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("articles")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    s.add_argument("--method", default="shingles", choices=["shingles", "lsh"], help="relation of near duplicates")
    s.add_argument("--known-duplicates", help="saved duplicate ids (Parquet) to drop instead of a search")
    for name in ("requests", "fanout", "combine"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--columns", help="header names of a CSV corpus, comma separated")
        s.add_argument("--text-column", required=True)
        s.add_argument("--id-column")
        s.add_argument("--pipeline", default="direct", choices=["direct", "socratic"])
        s.add_argument("--start", type=int, default=0)
        s.add_argument("--end", type=int)
        s.add_argument("--num-rows", type=int)
        s.add_argument("--model", default="gpt-4o-mini")
        s.add_argument("--output", required=True)
        if name != "requests":
            s.add_argument("--responses", nargs="+", required=True)
            s.add_argument("--mode", default="reference", choices=["reference", "marker"],
                           help="list items as the reference cuts them, or after their marker")
        if name == "fanout":
            s.add_argument("--phase", type=int, required=True, choices=[2, 3])
    for name in ("degrees", "profiles"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--output", required=True)
    s = sub.add_parser("match")
    s.add_argument("--names", required=True)
    s.add_argument("--candidates", required=True)
    s.add_argument("--gold")
    s.add_argument("--threshold", type=float, default=50)
    s.add_argument("--output", required=True)
    s = sub.add_parser("intake")
    s.add_argument("--source", required=True)
    s.add_argument("--sink", required=True)
    s.add_argument("--checkpoint", required=True)
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName(f"quire-{a.cmd}").getOrCreate()
    from quire.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    from quire.operators import arguments as A
    from quire.plans import jobs as J
    from quire.sources import readers as R
    from quire.sources import writers as W

    if a.cmd == "articles":
        known = W.read_duplicates(spark, a.known_duplicates) if a.known_duplicates else None
        star = J.article_job(R.read_articles(spark, a.input), method=a.method, known_duplicates=known)
        counts = W.write_star({"articles": star.articles, "authors": star.authors, "rel_authors": star.rel_authors,
                               "tags": star.tags, "rel_tags": star.rel_tags}, a.output, a.format)
        print(json.dumps(counts))  # D10 stage counters, observed during the writes
    elif a.cmd == "requests":
        arts = _corpus(spark, a)
        req = (A.direct_phase1_requests(arts, model=a.model) if a.pipeline == "direct"
               else A.socratic_phase1_requests(arts, model=a.model))
        W.write_requests(req, a.output)
    elif a.cmd == "fanout":
        arts = _corpus(spark, a)
        r = [_responses(spark, x) for x in a.responses]
        if a.pipeline == "direct":
            req = A.direct_phase2_requests(arts, A.direct_conclusions(r[0], a.mode), model=a.model)
        elif a.phase == 2:
            req = A.socratic_phase2_requests(arts, A.socratic_questions(r[0], a.mode), model=a.model)
        else:
            req = A.socratic_phase3_requests(A.socratic_questions(r[0], a.mode), A.socratic_answers(r[1]), model=a.model)
        W.write_requests(req, a.output)
    elif a.cmd == "combine":
        arts = _corpus(spark, a)
        r = [_responses(spark, x) for x in a.responses]
        out = J.direct_job(arts, *r[:2], mode=a.mode) if a.pipeline == "direct" else J.socratic_job(arts, *r[:3], mode=a.mode)
        W.write_results_json(out.results.drop("i"), f"{a.output}/results_json")
        W.write_results_csv(out.flat, f"{a.output}/results_csv")
        out.stats.show(truncate=False)
    elif a.cmd == "degrees":
        W.write_parsed(J.degree_text_job(R.read_pages(spark, a.input)), a.output)
    elif a.cmd == "profiles":
        replies = spark.read.schema("id long, author_name string, degrees_json string").json(a.input)
        valid, bad = J.degree_profile_job(replies)
        W.write_degrees(valid, f"{a.output}/profiles")
        bad.write.mode("overwrite").json(f"{a.output}/quarantine")
    elif a.cmd == "match":
        names = R.read_author_list(spark, a.names).select(F.col("author_name").alias("name"))
        cands = spark.read.schema("name string, rnk int, candidate_key string, description string") \
                     .option("header", True).csv(a.candidates)
        gold = R.read_gold(spark, a.gold).select(F.col("author_name").alias("name"), F.col("urls").alias("url")) \
            if a.gold else None
        m, sweep = J.matching_job(names, cands, gold, a.threshold)
        m.write.mode("overwrite").parquet(f"{a.output}/status")
        if sweep is not None:
            sweep.write.mode("overwrite").option("header", True).csv(f"{a.output}/sweep")
    elif a.cmd == "intake":
        from quire.streaming.intake import sink_high_water_mark, start_intake
        start_intake(spark, a.source, a.sink, a.checkpoint).awaitTermination()
        sink_high_water_mark(spark, a.sink).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
