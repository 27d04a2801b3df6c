"""Registered queries: one Spark DataFrame builder per operator plus, where
SQL can say the same thing, the DuckDB oracle text.

Every query reads the input tables (or data Spark derives from them) in full.
Timestamps are returned as ISO strings and integers as BIGINT so both engines
produce the same schema and values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the query modules fills the registry.
    from tracefold.plans import q_logs  # noqa: F401
    from tracefold.plans import q_graph  # noqa: F401
    from tracefold.plans import q_bundle  # noqa: F401
    from tracefold.plans import q_decide  # noqa: F401
    from tracefold.plans import q_rules  # noqa: F401
    from tracefold.plans import q_similar  # noqa: F401
    from tracefold.plans import q_recommend  # noqa: F401
    from tracefold.plans import q_stream  # noqa: F401
    from tracefold.plans import q_extra  # noqa: F401
    from tracefold.plans import q_documents  # noqa: F401
    from tracefold.plans import q_payload  # noqa: F401


def _fresh(fn):
    """Each query builds its shared intermediates once, from scratch."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tracefold.plans.flows import reset_memo
        reset_memo()
        try:
            return fn(spark, sf_dir)
        finally:
            reset_memo()
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {name: _fresh(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
