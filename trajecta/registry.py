"""How queries over the driver's tables are declared: key columns, floating-point columns (rounded on both sides), how to make them, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.roles import Roles
from trajecta.sources.tables import EVENTS_SQL, event_trajectories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R = Roles()
U = ("user_id",)
W = "window w as (partition by user_id order by t, event_id)"
#: The rows of the events as trajectories, numbered by seq from 0, with their number n.
NUMBERED = f"f as ({EVENTS_SQL}), q as (select *, row_number() over w - 1 as seq, count(*) over (partition by user_id) as n from f {W})"


def rounded(value: Column, digits: int) -> Column:
    """value to so many digits as DuckDB rounds: the nearest whole number of value * 10 ** digits, halves away from zero.

    (Spark's round takes the shortest decimal of value instead, which differs where that ends in a 5.)
    """
    p = value * F.lit(10.0**digits)
    r = F.rint(p)  # halves to even: p - r is exact and tells the ones that went toward zero
    away = r + F.when((p > 0) & (p - r == 0.5), 1.0).when((p < 0) & (p - r == -0.5), -1.0).otherwise(0.0)
    return F.when(F.abs(p) < float("inf"), away / F.lit(10.0**digits)).otherwise(value)


def add(name: str, keys: Sequence[str], floats: Sequence[str], make: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 8) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir).select(*keys, *[(rounded(F.col(f"`{c}`").cast("double"), digits) + 0.0).alias(c) for c in floats])

    QUERIES[name] = run
    if sql:
        values = [f'round(cast("{c}" as double), {digits}) + 0.0 as "{c}"' for c in floats]
        SQL[name] = f"select {', '.join([*keys, *values])} from ({sql})"


def over_events(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(event_trajectories(spark, sf_dir))
