"""The query registry: name -> (spark, folder) -> DataFrame, with a description and an optional SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    about: str
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; the first line of its docstring describes it."""

    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        about = (run.__doc__ or name).strip().splitlines()[0]
        ENTRIES[name] = Entry(name, run, about, sql)
        return run

    return add


def execute(name: str, spark: SparkSession, folder: str) -> DataFrame:
    if name not in ENTRIES:
        raise KeyError(f"unknown query {name!r}; available: {sorted(ENTRIES)}")
    return ENTRIES[name].run(spark, folder)
