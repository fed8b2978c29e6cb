"""The direct job moves texts as little as it can, with the same rows."""

import os
import random
import re
import tempfile

from pyspark.sql import functions as F

from quire.operators import arguments as A
from quire.operators.ids import dense_ids
from quire.operators.results import flatten_arguments
from quire.plans.q_arguments import _direct
from quire.sources import writers as W
from tests.conftest import SMOKE


def test_long_texts_of_an_article_take_next_to_nothing(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnop \n\",") for _ in range(200_000))  # longer than the window of lz4
    flat = spark.createDataFrame([(i, text, f"c{i}") for i in range(60)], "article_id long, text string, claim string").coalesce(1)
    path = os.path.join(tempfile.mkdtemp(), "csv")
    assert W.write_results_csv(flat, path) == 60
    assert sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)) < 2 * len(text)  # 40 times with lz4
    back = spark.read.schema(flat.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))


def test_texts_and_contents_are_shuffled_once(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables
    try:
        plan = flatten_arguments(_direct(spark, SMOKE))._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    wide = [x for x in moved if re.search(r"\b(text|content|conclusion|premises|buf|_a|_c|_p|valueWithExtremumOrdering)#", x)]
    assert moved and len(wide) == 3, moved  # a text, a content, an article's premises; 7 before


def test_direct_results_with_repeated_ids(spark):
    arts = spark.createDataFrame([(0, 10, "t0"), (1, 11, "t1"), (2, 12, "t2")], "i long, article_id long, text string")
    p1 = spark.createDataFrame([("c_0", "1. a\n2. b", 1), ("c_0", "1. x\n2. y\n3. z", 3), ("c_0", "", 9), ("c_1", "1. k", 1), ("c_01", "1. l\n2. m", 1),
                                (None, "1. n", 1), (None, "1. o", 2), ("q_2", "1. other", 1)], "custom_id string, content string, line int")
    p2 = spark.createDataFrame([("p_0_0", "1. p\n2. q", 1), ("p_0_0", "1. r", 2), ("p_0_2", "1. s", 1), ("p_1_0", "1. u", 1), ("p_01_0", "1. v", 1),
                                ("p_7_0", "1. w", 1)], "custom_id string, content string, line int")
    got = {r.i: [(a.conclusion, list(a.premises)) for a in r.arguments] for r in A.direct_results(arts, p1, p2).collect()}
    assert got == {0: [("x", ["r"]), ("y", []), ("z", ["s"])],
                   1: [("k", ["u"]), ("k", ["v"]), ("l", ["u"]), ("l", ["v"]), ("m", [])], 2: []}


def test_numbers_go_to_the_texts(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in (5, 3, 9, 1)], "k long, text string")
    for more in ([], [(None, "x")]):  # a null key has its number, too
        got = dense_ids(df.union(spark.createDataFrame(more, df.schema)), "k", "id")
        want = [t for _, t in sorted([(5, "text 5"), (3, "text 3"), (9, "text 9"), (1, "text 1"), *[(0, t) for _, t in more]])]
        assert [r.text for r in got.orderBy("id").collect()] == want
    assert got.columns == ["k", "text", "id"] and got.agg(F.max("id")).first()[0] == 4
