"""Where queries and their check SQL are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fresh(fn):
    """Each run of a query starts without what earlier ones have built."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lamina.plans.inputs import forget

        forget()
        return fn(spark, sf_dir)

    return run


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fresh(fn)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def tup(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"
