"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql=None):
    """Registers `function(spark, sf_dir)` under its own name."""

    def register(function):
        QUERIES[function.__name__] = Query(function.__name__, function, sql)
        return function

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
