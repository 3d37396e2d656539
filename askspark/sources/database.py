"""Database tables over JDBC."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Bounds(NamedTuple):
    """How to split a table read: ranges of a numeric, date or time column, read by ``parts`` tasks."""

    column: str
    low: str
    high: str
    parts: int


def jdbc_options(url: str, table: str, bounds: Bounds | None = None, fetch_rows: int = 10_000, **more: str) -> dict[str, str]:
    """Reader options. The bounds only split the work: rows outside them still arrive, in the first and last part."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **more}
    if bounds:
        options |= {
            "partitionColumn": bounds.column,
            "lowerBound": bounds.low,
            "upperBound": bounds.high,
            "numPartitions": str(bounds.parts),
        }
    return options


def read_database_table(
    spark: SparkSession, url: str, table: str, bounds: Bounds | None = None, **options: str
) -> DataFrame:
    """A table read through JDBC. Filters, columns and limits run at the source; give ``bounds`` for a parallel read."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, bounds, **options)).load()
