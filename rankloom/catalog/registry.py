"""Registry of queries: a DataFrame builder and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.catalog.fixtures import ctes
from rankloom.sources.tables import kept

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``; ``oracle`` may use the named views and the driver tables."""

    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if oracle is not None:
            body = oracle.strip()
            prefix = ctes(*views) if views else ""
            if prefix and body[:5].upper() == "WITH ":
                recursive = body[5:14].upper() == "RECURSIVE"
                prefix = prefix.rstrip() + ",\n"
                body = body[15:] if recursive else body[5:]
                if recursive:
                    prefix = prefix.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLES[name] = prefix + body
        return build

    return add


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several queries read, built and written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = kept(build(), name)
    return _KEPT[key]


def union_rows(source: str, columns: str, rules: list[tuple[str, ...]], fields: tuple[str, ...]) -> str:
    """UNION ALL of one SELECT per rule: (condition, expression per field)."""
    selects = []
    for condition, *values in rules:
        exprs = ", ".join(f"{v} AS {f}" for v, f in zip(values, fields))
        selects.append(f"SELECT {columns}, {exprs} FROM {source} WHERE {condition}")
    return "\nUNION ALL\n".join(selects)
