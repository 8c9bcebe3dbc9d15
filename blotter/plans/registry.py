"""Registry of named queries and their SQL oracles.

Each query is ``(spark, sf_dir) -> DataFrame`` over the bound views of the
driver's tables; the oracle is DuckDB SQL over the same raw tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blotter.plans.present import present

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the result is normalised by ``present``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            # results must not depend on the caller's zone (event-time windows,
            # truncation of timestamp_ntz go through the session zone)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(_fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (each registers its queries on import)."""
    from blotter.plans import (q_clean, q_forecast, q_geo, q_history,  # noqa: F401
                               q_lookup, q_ml, q_profiles, q_time, q_trends)
