"""Registry of named queries, each with an optional checking SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.plans.bench import CTES, Bench

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Tables of the checking SQL that are read several times, and those that read themselves.
MATERIALIZED: set[str] = set()
RECURSIVE: set[str] = set()


def _needed(sql: str) -> list[str]:
    """CTEs named in the text, with those they build on, in order of definition."""
    seen: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I):
                seen.add(name)
                todo.append(body)
    return [n for n in CTES if n in seen]


def with_tables(sql: str) -> str:
    """Prefix the run-table definitions that the text reads."""
    sql = sql.strip().rstrip(";")
    names = _needed(sql)
    defs = ", ".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({CTES[n]})" for n in names)
    if not defs:
        return sql
    with_ = "WITH RECURSIVE" if RECURSIVE.intersection(names) else "WITH"
    if re.match(r"with\b", sql, re.I):
        return f"{with_} {defs}, {sql[4:].lstrip()}"
    return f"{with_} {defs} {sql}"


def query(name: str, sql: str | None = None):
    """Register `fn(bench) -> DataFrame` under a key."""

    def register(fn: Callable[[Bench], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Bench(spark, folder))
        if sql is not None:
            ORACLE[name] = with_tables(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column."""
    return df.select(
        [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )
