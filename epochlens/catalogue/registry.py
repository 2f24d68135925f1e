"""Registry of named queries over the supplied tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from epochlens.session import tune


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[["Tables"], DataFrame]
    sql: str | None


class Tables:
    """The given parquet tables and the views derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = tune(spark)
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        from epochlens.catalogue import views

        return views.spark_view(self, name)


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may use the derived views by name."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return register


def expand_sql(sql: str, definitions: dict[str, str]) -> str:
    """Prefix `sql` with the definitions of the views it names, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in definitions:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(definitions[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    body = sql.strip()
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    head = ",\n".join(f"{name} AS ({definitions[name].strip()})" for name in order)
    if match:
        body = ", " + body[match.end():]
    return f"WITH RECURSIVE {head}\n{body}"
