"""How queries register: a function of the logical tables, and its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.sources.fixtures import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NS, SIG, NOW = "repo:en", "hash:64", 1700900000.0
QUESTION = "@u3 the TION heron the"
CODE_QUESTION = "retitioning blees heention F17 snake_case"


def query(sql: str | None = None, name: str | None = None):
    """Register f(tables) under its name, with an oracle if there is one."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return f

    return add


def first_vector(t: Tables) -> list[float]:
    """The query's vector: that of the embedding with the smallest id (one row)."""
    return t.embeddings.orderBy("vec_id").select("embedding").first()[0]
