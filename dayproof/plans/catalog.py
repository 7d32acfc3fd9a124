"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayproof.functions.common import portable
from dayproof.session import prepare_session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, parts: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, with its check: ``parts`` are the shared CTEs ``sql`` needs."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(build(prepare_session(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(p.strip() for p in parts)}\n" if parts else "") + sql.strip()
        return build

    return register
