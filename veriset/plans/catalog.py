"""Registered queries over the supplied tables, each next to its equivalent SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(function(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Result types that compare across engines: bigint, double rounded to six digits, joined arrays."""
    columns = []
    for field in df.schema:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif kind.startswith("array"):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)
