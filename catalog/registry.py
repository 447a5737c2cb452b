"""The registry the query modules fill."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked."""
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round to 9 places, so that the order of summation does not show; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in columns})


def r9(expression: str) -> str:
    """The same in SQL."""
    return f"(ROUND(CAST({expression} AS DOUBLE), 9) + CAST(0 AS DOUBLE))"
