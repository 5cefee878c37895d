"""Registering queries with their SQL: doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero; whole numbers as longs."""
    kinds = dict(df.dtypes)
    fix = {"double": lambda x: F.round(x, digits) + 0.0, "float": lambda x: F.round(x.cast("double"), digits) + 0.0, "int": lambda x: x.cast("long"), "decimal(20,0)": lambda x: x.cast("long")}
    return df.select(*(fix.get(kinds[n], lambda x: x)(F.col(n)).alias(n) for n in df.columns))


def query(sql: str | None = None, tidied: bool = False):
    """Registers a query under its function's name, with its oracle; `tidied` if its columns come tidy."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(lambda v: view(spark, sf_dir, v))
            return found if tidied else tidy(found)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return put


def r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0e0 as {name}"
