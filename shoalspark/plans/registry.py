"""Registry of queries: a Spark function over views, and SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.plans.fixtures import closure, view, with_clause

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, and no negative zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, views: str, twin: str | None = None, doubles: str = ""):
    """Register ``fn(*views)``; ``twin`` is SQL over the same views, ``doubles`` its columns to round."""
    names = views.split()

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(*(view(spark, sf_dir, v) for v in names)))
        if twin:
            used = closure([v for v in names])
            star = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"{with_clause(used)} SELECT * REPLACE ({star}) FROM ({twin})" if star else f"{with_clause(used)} SELECT * FROM ({twin})"
        return fn

    return register
