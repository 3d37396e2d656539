"""Catalog, profile and preview of tables."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Databases that hold no user data, and the name that stands for a failed listing.
SYSTEM_DATABASES = ["information_schema", "mysql", "performance_schema", "sys"]
NOT_LISTED = "(unable to list tables)"


def catalog_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(db, tbl, db_pos, tbl_pos) rows as a local table, whose size the optimizer knows when it plans joins."""
    kinds = [("db", pa.string()), ("tbl", pa.string()), ("db_pos", pa.int32()), ("tbl_pos", pa.int32())]
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
    return spark.createDataFrame(pa.table(columns, schema=pa.schema(kinds)))


def list_catalog(spark: SparkSession) -> DataFrame:
    """(db, tbl, db_pos, tbl_pos) of the session catalog; a database that cannot be listed keeps a marker row."""
    rows = []
    for db_pos, db in enumerate(spark.catalog.listDatabases()):
        try:
            names = [t.name for t in spark.catalog.listTables(db.name)]
        except Exception:
            names = [NOT_LISTED]
        rows += [(db.name, name, db_pos, tbl_pos) for tbl_pos, name in enumerate(names)] or [(db.name, None, db_pos, None)]
    return catalog_table(spark, rows)


def table_sizes(tables: dict[str, DataFrame], db: str) -> DataFrame:
    """(db, tbl, db_pos, tbl_pos, n_rows) of named tables; row counts come from the file footers."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(db).alias("db"),
            F.lit(name).alias("tbl"),
            F.lit(0).alias("db_pos"),
            F.lit(pos).alias("tbl_pos"),
            "n_rows",
        )
        for pos, (name, df) in enumerate(tables.items())
    ]
    return reduce(DataFrame.unionByName, counted)


def catalog_summary(catalog: DataFrame, exclude_system: bool = True) -> DataFrame:
    """Per database: number and sorted names of its tables, and whether they could be listed."""
    kept = catalog.where(~F.col("db").isin(SYSTEM_DATABASES)) if exclude_system else catalog
    real = F.col("tbl").isNotNull() & (F.col("tbl") != NOT_LISTED)
    sizes = [F.sum(F.when(real, F.col("n_rows"))).alias("n_rows")] if "n_rows" in catalog.columns else []
    # One name per table of a database: the list is as long as the catalog, never as long as the data.
    return kept.groupBy("db").agg(
        F.count_if(real).alias("n_tables"),
        F.array_join(F.sort_array(F.collect_set(F.when(real, F.col("tbl")))), ", ").alias("tables"),
        (F.count_if(F.col("tbl") == NOT_LISTED) == 0).alias("accessible"),
        *sizes,
    )


def dataset_profile(df: DataFrame, key: str, n_sample: int = 3) -> DataFrame:
    """One row per column: position, name, type, size of the table, and the values of the first rows by ``key``."""
    # The sample is n rows by definition; its order is kept by the position within the n.
    head = df.orderBy(key).limit(n_sample)
    shown = head.agg(
        *[
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(c).cast("string").alias("v")))),
                            lambda s: F.coalesce(s["v"], F.lit("NULL"))),
                ", ",
            ).alias(c)
            for c in df.columns
        ]
    )
    described = [
        F.struct(
            F.lit(pos).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).alias("sample"),
        )
        for pos, f in enumerate(df.schema)
    ]
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return shown.select(F.explode(F.array(*described)).alias("d")).select(
        "d.*", total.alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")
    )


def table_preview(df: DataFrame, order_by: str, n: int = 50) -> DataFrame:
    """First ``n`` rows by key, each with the size of the whole table and whether rows are left out."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(order_by).limit(n).withColumns({"n_total": total, "truncated": total > n})
