"""All queries of the library by name, with the SQL twins that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "a1_area_lifetime_stats"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL twin where SQL can say it."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register
