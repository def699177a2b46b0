"""All queries of the library outside the corpus operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "p13_ranking_metrics"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **casts: str):
    """Registers a function of (spark, sf_dir) under a name, with the SQL of its result; casts: types of some columns of that."""
    if sql and casts:
        sql = "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in casts.items()) + f") FROM ({sql})"

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def _load() -> None:
    from seriesmill.plans import candidate_queries, curve_queries, run_queries, scalar_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
