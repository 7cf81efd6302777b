"""The list of registered queries and their SQL twins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from thresher.plans.views import Tables


@dataclass(frozen=True)
class Query:
    name: str
    survey: str
    run: Callable
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(survey, sql=None):
    """Registers a function of :class:`Tables` under its own name."""

    def register(function):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark, sf_dir):
            return function(Tables(spark, sf_dir))

        QUERIES[name] = Query(name, survey, run, sql)
        return function

    return register
