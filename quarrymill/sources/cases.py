"""Rows of literal cases over a driver's table: row k takes case k modulo their number, so every branch occurs at each size.

The same cases as SQL values give what is expected of each, so a query over them is compared with stated results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .model import table
from .staging import spread


def literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*map(literal, value)) if value else F.array().cast("array<string>")
    return F.lit(value)


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(sql_literal, value)) + "]::VARCHAR[]"
    if isinstance(value, str):
        return " || ".join(["'" + part.replace("'", "''") + "'" for part in value.split("\n")]).replace(" || ", " || chr(10) || ")
    return str(value)


def cases(spark: SparkSession, sf_dir: str, columns: dict[str, list], source: str = "customer", key: str = "c_custkey") -> DataFrame:
    """id and, by row, each column's value of its case."""
    n = len(next(iter(columns.values())))
    assert all(len(v) == n for v in columns.values())
    at = (F.col(key) % n + 1).cast("int")
    return spread(table(spark, sf_dir, source).select(key), key).select(F.col(key).alias("id"), *[F.element_at(F.array(*map(literal, values)), at).alias(name) for name, values in columns.items()])


def case_query(name: str, inputs: dict[str, list], run: Callable[[DataFrame], dict[str, Column]], expected: dict[str, list]) -> None:
    """Registers name: the outputs that run gives for the rows of cases, against those that are expected."""
    n = len(next(iter(inputs.values())))
    assert all(len(v) == n for v in expected.values()), name
    rows = ", ".join("(" + ", ".join([str(k), *[sql_literal(expected[c][k]) for c in expected]]) + ")" for k in range(n))
    sql = f"SELECT c_custkey AS id, {', '.join('e.' + c for c in expected)} FROM customer JOIN (VALUES {rows}) e(k, {', '.join(expected)}) ON c_custkey % {n} = e.k"

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = cases(spark, sf_dir, inputs)
        out = run(df)
        staged = out.pop("_df", df)
        return staged.select("id", *[c.alias(n) for n, c in out.items()])

    fn.__name__ = name
    query(name, sql)(fn)
