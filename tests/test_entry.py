"""Driver contract, oracle agreement on the smallest tables, plan checks."""

import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from quire.sources.tables import DRIVER_TABLES
from scripts.oracle_check import kinds_duck, kinds_spark, rows_of
from tests.conftest import SMOKE

SAMPLE = ["tag_links", "dense_ids", "author_final_dim", "canonical_names", "list_items", "argument_parse",
          "flat_arguments", "html_sections", "degree_markdown", "degree_spans", "match_status", "threshold_sweep",
          "token_cost", "corpus_selection", "near_dup_pairs", "dedup_greedy", "embedding_sets", "degree_records"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["id_articulo", "id_tags", "tags"]
    assert df.count() > 0


def test_registry_is_consistent():
    qs, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 50
    numbered = {k.split("_")[0] for k in [*qs] if k.startswith("op") and k[2].isdigit()}
    try:
        importlib.import_module("quire.llm.queries")
        there = True
    except ImportError:
        there = False
    assert numbered | ({"pipeline"} & set(qs)) == ({f"op{n}" for n in range(1, 14)} | {"pipeline"} if there else set())
    assert all(fn.__doc__ for fn in qs.values())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", SAMPLE)
def test_oracle_agreement_smoke(spark, con, key):
    sdf = entry.queries()[key](spark, SMOKE)
    rel = con.sql(entry.oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert kinds_spark(sdf.schema) == kinds_duck(rel)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(rel.columns, rel.fetchall())


PLAN_KEYS = ["tag_links", "author_final_links", "degree_markdown", "direct_results", "threshold_sweep",
             "corpus_selection", "flat_arguments", "fuzzy_scores"]


@pytest.mark.parametrize("key", PLAN_KEYS)
def test_plans_stay_on_the_jvm(spark, key):
    df = entry.queries()[key](spark, SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{key}: {bad}"


def test_scan_prunes_columns(spark):
    df = entry.queries()["corpus_projection"](spark, SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
