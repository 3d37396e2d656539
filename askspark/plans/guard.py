"""Read-only SQL over an allowed set of tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askspark.functions.text import AGGREGATE_MARKS

# Functions that reach outside the tables: they call arbitrary JVM code.
REFUSED_FUNCTIONS = ("java_method", "reflect", "try_reflect")
# Settings of the caller's session that change what a query means or how it is planned.
INHERITED_SETTINGS = (
    "spark.sql.session.timeZone",
    "spark.sql.ansi.enabled",
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
)


#: Where a table comes from.
Source = str | Callable[[SparkSession], DataFrame]


class RefusedQuery(ValueError):
    """The text is not one read-only query over the allowed tables."""


class GuardedResult(NamedTuple):
    """Capped rows, their number (one row ``n``), and the first rows for display."""

    rows: DataFrame
    total: DataFrame
    preview: DataFrame


def is_aggregate(sql: str) -> bool:
    """Substring test on the text; decides only whether the row cap applies."""
    upper = sql.upper()
    return any(mark in upper for mark in AGGREGATE_MARKS)


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


def _plans_in(expression) -> list:
    """Plans of the subqueries inside an expression."""
    own = [expression.plan()] if _kind(expression) in SUBQUERIES else []
    return own + [p for child in _seq(expression.children()) for p in _plans_in(child)]


#: Leaves of a plan that hold no stored rows.
HARMLESS_LEAVES = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef")


def foreign_relations(plan, allowed: dict[str, str]) -> list[str]:
    """Names of what an analysed plan reads besides the allowed views, subqueries and common table expressions included.

    ``allowed`` has the lower-cased name of each view and the text of its plan; another view of that name has another plan.
    """
    kind = _kind(plan)
    if kind == "View" and plan.isTempView():
        name = plan.desc().identifier()
        if name.database().isEmpty() and allowed.get(name.table().lower()) == plan.child().canonicalized().toString():
            return []
        return [name.unquotedString()]
    inner = _seq(plan.children()) + [p for e in _seq(plan.expressions()) for p in _plans_in(e)]
    if kind == "WithCTE":
        inner += _seq(plan.cteDefs())
    if not inner and kind not in HARMLESS_LEAVES:
        return [kind]
    return [name for p in inner for name in foreign_relations(p, allowed)]


def _relation_names(plan) -> list[tuple[list[str], int]]:
    """(parts of the name, position in the text) of the tables that a parsed query names."""
    own = []
    if _kind(plan) == "UnresolvedRelation":
        start = plan.origin().startIndex()
        own = [(_seq(plan.multipartIdentifier()), start.get())] if start.isDefined() else []
    inner = _seq(plan.children()) + _seq(plan.innerChildren()) + [p for e in _seq(plan.expressions()) for p in _plans_in(e)]
    return own + [x for p in inner if hasattr(p, "expressions") for x in _relation_names(p)]


def _column_names(plan) -> list[tuple[list[str], int]]:
    """(parts of the name, position in the text) of the columns that a parsed query names."""

    def inside(expression) -> list:
        own = []
        if _kind(expression) == "UnresolvedAttribute" and expression.origin().startIndex().isDefined():
            own = [(_seq(expression.nameParts()), expression.origin().startIndex().get())]
        below = [x for child in _seq(expression.children()) for x in inside(child)]
        return own + below + ([x for p in _plans_in(expression) for x in _column_names(p)] if _kind(expression) in SUBQUERIES else [])

    own = [x for e in _seq(plan.expressions()) for x in inside(e)]
    inner = _seq(plan.children()) + _seq(plan.innerChildren())
    return own + [x for p in inner if hasattr(p, "expressions") for x in _column_names(p)]


def _short_names(spark: SparkSession, sql: str, tables: dict) -> str:
    """``sql`` with each allowed name of several parts, where it names a table or stands before a column, as one quoted name."""
    known = {n.lower(): n for n in tables if "." in n}
    if not known:
        return sql
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise RefusedQuery(str(error).splitlines()[0]) from error
    named = {(tuple(p), s) for p, s in _relation_names(parsed)}
    named |= {(tuple(p[:-1]), s) for p, s in _column_names(parsed) if len(p) > 2}
    for parts, start in sorted(named, key=lambda x: -x[1]):
        name = known.get(".".join(parts).lower())
        if name and (m := re.compile(r"\s*\.\s*".join(f"(?:`{re.escape(x)}`|{re.escape(x)})" for x in parts), re.IGNORECASE).match(sql, start)):
            sql = f"{sql[:start]}`{name}`{sql[m.end():]}"
    return sql


def guarded_session(spark: SparkSession, tables: dict[str, Source], sql: str) -> SparkSession:
    """Session that knows the given tables as views, and reads no files named in SQL.

    Only tables whose name occurs in the text are opened, as opening one reads its schema.
    """
    session = spark.newSession()
    for name in INHERITED_SETTINGS:
        value = spark.conf.get(name, None)
        if value is not None:
            session.conf.set(name, value)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, source in tables.items():
        if name.lower() not in sql.lower():
            continue
        rows = session.read.parquet(source) if isinstance(source, str) else source(session)
        rows.createOrReplaceTempView(f"`{name}`")
    return session


def check_query(session: SparkSession, sql: str) -> DataFrame:
    """Analyse ``sql`` as a subquery, which only one SELECT can be; raises ``RefusedQuery`` before anything runs.

    The analysed plan may read the session's own views and nothing else.
    """
    if re.search(rf"\b({'|'.join(REFUSED_FUNCTIONS)})\b", sql, re.IGNORECASE):
        raise RefusedQuery("the query names a function that is not allowed")
    try:
        checked = session.sql(f"SELECT * FROM (\n{sql}\n)")
        query = session.sql(sql)
    except (ParseException, AnalysisException) as error:
        raise RefusedQuery(str(error).splitlines()[0]) from error
    views = {t.name.lower(): session.table(f"`{t.name}`") for t in session.catalog.listTables() if t.isTemporary and not t.namespace}
    allowed = {}
    for name, view in views.items():
        plan = view._jdf.queryExecution().analyzed()
        while _kind(plan) == "SubqueryAlias":
            plan = plan.child()
        if _kind(plan) == "View":
            allowed[name] = plan.child().canonicalized().toString()
    if foreign_relations(checked._jdf.queryExecution().analyzed(), allowed):
        raise RefusedQuery("the query names a table that is not in the allowed set")
    return query


def guarded_sql(
    spark: SparkSession, sql: str, tables: dict[str, Source], max_rows: int | None = 100, preview: int = 50
) -> GuardedResult:
    """Check and plan one query over ``tables``: name to Parquet path, or to a function from a session to a DataFrame, so CSV
    and JDBC sources work as well. A name may be ``db.table``; queries write it with or without backquotes. Unless it looks like an aggregate, at most ``max_rows`` rows come back.

    Nothing runs here. Catalyst plans the query itself, so an ORDER BY under the cap becomes a top-n and filters reach
    the files.
    """
    bare = sql.strip().rstrip(";").strip()
    plain = bare.replace("`", "")
    rows = check_query(guarded_session(spark, {n: t for n, t in tables.items() if n.lower() in plain.lower()}, plain), _short_names(spark, bare, tables))
    if max_rows is not None and not is_aggregate(bare):
        rows = rows.limit(max_rows)
    return GuardedResult(rows, rows.agg(F.count(F.lit(1)).alias("n")), rows.limit(preview))
