"""Connected components on long chains and hubs; reader formats."""

import random

from quire.functions.lists import list_items
from quire.operators.clean import coerce_timestamp
from quire.operators.components import connected_components
from quire.sources.readers import read_pages


def _components(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r.node: r.component for r in connected_components(df).collect()}


def test_long_shuffled_path_and_hub(spark):
    names = list(range(400))
    random.Random(3).shuffle(names)
    path = list(zip(names, names[1:]))
    hub = [(1000, i) for i in range(1001, 1200)]
    got = _components(spark, path + hub + [(5000, 5000), (6000, None)])
    assert {got[i] for i in range(400)} == {0} and {got[i] for i in range(1000, 1200)} == {1000}
    assert 5000 not in got and 6000 not in got


def test_no_edges(spark):
    assert _components(spark, []) == {}


def test_time_of_day_is_not_a_date_and_markers(spark):
    df = spark.createDataFrame([("12:30", "1. one\n2020 was bad\n- two\n1.5 million")], "d string, t string")
    r = df.select(coerce_timestamp("d").alias("d"), list_items("t", mode="marker").alias("l")).first()
    assert r.d is None and r.l[0] == "one" and "two" in r.l and "5 million" not in r.l and "was bad" not in r.l


def test_parquet_folder_without_suffix(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "x string, y string").write.parquet(f"{tmp_path}/plain")
    assert read_pages(spark, f"{tmp_path}/plain").columns == ["x", "y"]
