"""Operators are functions from table expressions to a query's text. One text makes the Spark plan; the same operator, told another dialect, makes its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPARK, DUCK = "spark", "duck"


def each(lo: object, hi: object, name: str, dialect: str = SPARK) -> str:
    """A clause after FROM that repeats every row for name in lo..hi; none where lo is above hi."""
    if dialect == SPARK:
        return f"lateral view explode(case when {hi} >= {lo} then sequence(cast({lo} as bigint), cast({hi} as bigint)) end) _{name} as {name}"
    return f"cross join lateral unnest(generate_series(cast({lo} as bigint), cast({hi} as bigint))) as _{name}({name})"


def numbers(lo: object, hi: int, name: str) -> str:
    return f"(select {name} from range({lo}, {hi + 1}) as _r({name}))"


def rounded(x: str, digits: int = 6) -> str:
    """For comparing sums whose order differs; minus zero becomes zero."""
    return f"(round({x}, {digits}) + 0.0e0)"


def query(sql: str, /, **tables: DataFrame) -> DataFrame:
    """Runs text in which tables stand in braces by name."""
    return next(iter(tables.values())).sparkSession.sql(sql, **tables)
