"""One question about database tables or a spreadsheet, from its class to a table of rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askspark.functions import text as T
from askspark.operators.catalog import catalog_table, table_preview
from askspark.operators.routing import resolve_tables, unknown_table_refs
from askspark.plans.guard import RefusedQuery, Source, guarded_sql

SHOWN_ROWS = 50
MAX_ROWS = 100

ATTEMPTS = 3

#: (question, schema as text) to a reply that holds SQL, fenced or not. After a refused reply the question is followed by
#: the refused query and what was wrong with it.
WriteSql = Callable[[str, str], str]


class TableAnswer(NamedTuple):
    """The class of the question, the rows to show (None for a question about something else), how many there are in all
    (one row ``n``), and the query that gave them, if any."""

    kind: str
    rows: DataFrame | None
    total: DataFrame | None
    sql: str | None


def _open(spark: SparkSession, source: Source) -> DataFrame:
    return spark.read.parquet(source) if isinstance(source, str) else source(spark)


def schema_rows(spark: SparkSession, tables: dict[str, Source]) -> DataFrame:
    """(db, tbl, position, column, type, n_rows, n_missing) of the named tables, one row per column; the numbers come from one
    pass over each table."""
    parts = []
    for name, source in tables.items():
        db, _, tbl = name.rpartition(".")
        whole = _open(spark, source)
        present = whole.toDF(*(f"c{i}" for i in range(len(whole.columns))))
        counted = present.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in present.columns))
        rows = [
            F.struct(
                F.lit(db).alias("db"), F.lit(tbl).alias("tbl"), F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
            )
            for i, f in enumerate(whole.schema)
        ]
        parts.append(counted.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.union, parts)


def schema_text(spark: SparkSession, tables: dict[str, Source]) -> str:
    """What a model is told: each table with its columns and types."""
    parts = []
    for name, source in tables.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _open(spark, source).schema)
        parts.append(f"{name}({columns})")
    return "\n".join(parts)


def _first(spark: SparkSession, *columns):
    return spark.range(1).select(*columns).first()


def _meant(spark: SparkSession, question: str, tables: dict[str, Source]) -> str | None:
    """The table that the question names."""
    databases = list(dict.fromkeys(n.rpartition(".")[0] for n in tables))
    catalog = [(n.rpartition(".")[0], n.rpartition(".")[2], databases.index(n.rpartition(".")[0]), i) for i, n in enumerate(tables)]
    asked = spark.createDataFrame([(0, question)], "qid int, question string")
    hit = resolve_tables(asked, "qid", "question", catalog_table(spark, catalog)).first()
    return f"{hit['db']}.{hit['tbl']}".lstrip(".") if hit["tbl"] is not None else None


def run_reply(spark: SparkSession, reply: str, tables: dict[str, Source]) -> tuple[str, DataFrame, DataFrame]:
    """(query, rows to show, total) of a reply: the SQL is unfenced, limited, its tables looked up, guarded and planned."""
    sql = _first(spark, T.with_limit(T.fenced_block(F.lit(reply), "sql"), MAX_ROWS))[0]
    listed = catalog_table(spark, [(*(n.rpartition(".")[::2]), 0, 0) for n in tables])
    refs = unknown_table_refs(spark.createDataFrame([(0, sql)], "qid int, sql string"), "qid", "sql", listed, "tokens", match_case=False)
    unknown = refs.orderBy("ref_no").first()
    if unknown is not None:
        raise RefusedQuery(f"unknown table {unknown['db']}.{unknown['tbl']}")
    result = guarded_sql(spark, sql, tables, MAX_ROWS, SHOWN_ROWS)
    return sql, result.preview, result.total


def ask_tables(
    spark: SparkSession, question: str, tables: dict[str, Source], write_sql: WriteSql | None = None, attempts: int = ATTEMPTS,
    order_by: str | None = None,
) -> TableAnswer:
    """Answer one question over ``tables`` (``db.table``, or one bare name for a spreadsheet).

    A question to see a table gives its first rows by ``order_by`` (its first column unless given), with the size of the
    table and whether rows are left out; one about columns gives the schema of the table it names, or of all; one that is
    about neither tables nor numbers gives None; and any other is put to ``write_sql``, up to ``attempts`` times while its
    replies are refused. Without ``write_sql`` the rows of the table that the question means are counted. Only the question
    and schemas are handled on the driver.
    """
    kind = _first(spark, T.question_class(F.lit(question)))[0]
    if kind == "general":
        return TableAnswer(kind, None, None, None)
    named = _meant(spark, question, tables)
    if kind == "schema":
        rows = schema_rows(spark, {named: tables[named]} if named else tables)
        return TableAnswer(kind, rows, rows.agg(F.count(F.lit(1)).alias("n")), None)
    name = named or next(iter(tables))
    if kind == "display":
        whole = _open(spark, tables[name])
        shown = table_preview(whole, order_by or whole.columns[0], SHOWN_ROWS)
        return TableAnswer(kind, shown, whole.agg(F.count(F.lit(1)).alias("n")), None)
    quoted = ".".join(f"`{part}`" for part in name.split("."))
    if not write_sql:
        sql, rows, total = run_reply(spark, f"SELECT COUNT(*) AS n FROM {quoted}", tables)
        return TableAnswer(kind, rows, total, sql)
    schema, asked = schema_text(spark, tables), question
    for attempt in range(1, attempts + 1):
        reply = write_sql(asked, schema)
        try:
            sql, rows, total = run_reply(spark, reply, tables)
            return TableAnswer(kind, rows, total, sql)
        except RefusedQuery as error:
            if attempt == attempts:
                raise
            asked = f"{question}\n\nThis reply was refused:\n{reply}\nReason: {error}\nWrite a corrected query."
