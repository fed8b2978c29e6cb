"""Registry of named queries: each is (spark, sf_dir) -> DataFrame, with an
optional equivalent SQL text for an independent engine (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every ``q_*`` module of this package so its registrations run."""
    import importlib
    import pkgutil

    import quire.plans as pkg
    for m in sorted(pkgutil.iter_modules(pkg.__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"quire.plans.{m.name}")
