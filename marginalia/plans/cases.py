"""Queries that give every row of a table one of a list of cases; the oracle holds the outcome that the rule's text says."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.domain import table
from marginalia.plans.register import query


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int | float):
        return repr(x) + ("e0" if isinstance(x, float) else "")
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: Sequence[Sequence[object]]) -> str:
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def spread(spark: SparkSession, sf_dir: str, rows: Sequence[tuple], schema: str) -> DataFrame:
    """(id, …): the parts' keys, each with the case of its key's remainder."""
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_k int, {schema}")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return parts.join(F.broadcast(cases), F.col("id") % len(rows) == F.col("_k")).drop("_k")  # a list of some cases


def outcome_sql(columns: str, outcomes: Sequence[tuple]) -> str:
    return f"SELECT p_partkey AS id, {columns} FROM part JOIN (VALUES {values([(i, *o) for i, o in enumerate(outcomes)])}) v(k, {columns}) ON p_partkey % {len(outcomes)} = k"


def case_query(name: str, schema: str, rows: Sequence[tuple], columns: str, outcomes: Sequence[tuple]):
    """Registers fn(cases) -> (id, columns), with the outcomes as its oracle."""
    assert len(rows) == len(outcomes), name

    def add(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spread(spark, sf_dir, rows, schema))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return query(name, outcome_sql(columns, outcomes))(run)

    return add
