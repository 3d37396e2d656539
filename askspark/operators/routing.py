"""Rule operators over tables of questions, requests and generated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askspark.functions import text as T
from askspark.functions.sql_text import sql_table_refs

# Names never taken for a table.
STOP_NAMES = ["the", "all", "a", "an", "my", "this", "that", "some"]


def classify_questions(df: DataFrame, col: str, match: str = "substring", out: str = "question_class") -> DataFrame:
    """Add the class of each question."""
    return df.withColumn(out, T.question_class(F.col(col), match))


def extract_fenced_block(df: DataFrame, col: str, lang: str, out: str) -> DataFrame:
    """Add the code block of each reply."""
    return df.withColumn(out, T.fenced_block(F.col(col), lang))


def extract_table_refs(df: DataFrame, col: str, read: str = "pattern") -> DataFrame:
    """One row per table reference in each query text, numbered from 0 in order of discovery.

    ``read="pattern"`` takes quoted pairs anywhere and pairs after a table word, whatever they are part of; ``"tokens"``
    reads the text token by token and takes only what stands where a table is named.
    """
    if read not in ("pattern", "tokens"):
        raise ValueError("read must be 'pattern' or 'tokens'")
    others = [c for c in df.columns if c != col]
    refs = T.table_refs(F.col(col)) if read == "pattern" else sql_table_refs(F.col(col))
    return df.select(*others, F.posexplode(refs).alias("ref_no", "ref")).select(
        *others, "ref_no", F.col("ref.db").alias("db"), F.col("ref.tbl").alias("tbl")
    )


def unknown_table_refs(df: DataFrame, id_col: str, sql_col: str, catalog: DataFrame, read: str = "pattern", match_case: bool = True) -> DataFrame:
    """References to a table that the catalog does not list, also when the database itself is unknown (``db_known`` tells).

    ``read`` as for ``extract_table_refs``; without ``match_case`` names are compared in lower case, as Spark does.
    """
    key = (lambda c: F.col(c)) if match_case else (lambda c: F.lower(c))
    refs = extract_table_refs(df.select(id_col, sql_col), sql_col, read).withColumns({"__db": key("db"), "__tbl": key("tbl")})
    known = catalog.select(key("db").alias("__db"), key("tbl").alias("__tbl")).distinct()
    databases = known.select("__db", F.lit(True).alias("db_known")).distinct()
    return (
        refs.join(known, ["__db", "__tbl"], "left_anti")
        .join(databases, "__db", "left")
        .select(id_col, "ref_no", "db", "tbl", F.coalesce("db_known", F.lit(False)).alias("db_known"))
    )


def plan_limits(df: DataFrame, col: str, n: int = 100) -> DataFrame:
    """Add the aggregate flag and the text with a row limit."""
    sql = F.col(col)
    return df.withColumns({"is_aggregate": T.looks_aggregate(sql), "limited_sql": T.with_limit(sql, n)})


def resolve_tables(questions: DataFrame, id_col: str, col: str, catalog: DataFrame) -> DataFrame:
    """The table each question means: first in catalog order whose name is a word of the question.

    If a database name is a word of the question, only its tables count (the first such database). ``catalog`` has
    (db, tbl, db_pos, tbl_pos). Questions are joined to names on the first word of the name, so no question is compared
    with the whole catalog; the full name is tested only on those candidates.
    """
    text = F.lower(T.strip(F.col(col)))
    first_word = r"(?U)\w+"
    asked = questions.select(id_col, text.alias("__q"))
    tokens = asked.select(
        id_col, "__q", F.explode(F.array_distinct(F.regexp_extract_all("__q", F.lit(first_word), F.lit(0)))).alias("__word")
    )

    def named(name: str):
        pattern = F.concat(F.lit(r"(?U)(^|\b)\Q"), F.lower(name), F.lit(r"\E($|\b)"))
        return F.rlike(F.col("__q"), pattern)

    def key(name: str):
        return F.regexp_extract(F.lower(F.col(name)), first_word, 0).alias("__word")

    dbs = catalog.groupBy("db").agg(F.min("db_pos").alias("db_pos")).select("db", "db_pos", key("db"))
    chosen = (
        tokens.join(dbs, "__word").where(named("db")).groupBy(id_col).agg(F.min_by("db", "db_pos").alias("__db"))
    )
    tables = catalog.where(~F.lower("tbl").isin(STOP_NAMES)).select("db", "tbl", "db_pos", "tbl_pos", key("tbl"))
    found = (
        tokens.join(tables, "__word")
        .where(named("tbl"))
        .join(chosen, id_col, "left")
        .where(F.col("__db").isNull() | (F.col("db") == F.col("__db")))
        .groupBy(id_col)
        .agg(F.min(F.struct("db_pos", "tbl_pos", "db", "tbl")).alias("hit"))
    )
    return questions.join(found, id_col, "left").select(
        *questions.columns, F.col("hit.db").alias("db"), F.col("hit.tbl").alias("tbl")
    )


def route_requests(df: DataFrame, asset_col: str, question_col: str, asked_col: str | None = None) -> DataFrame:
    """The operator family for each request and, when another family was asked for, why it is refused.

    Off-topic questions to a database go on to the web search; with no usable asset everything does.
    """
    family = T.asset_family(F.col(asset_col))
    off_topic = (family == "database") & (T.question_class(F.col(question_col)) == "general")
    routed = df.withColumn("family", family).withColumn(
        "handler", F.when(off_topic | (family == "unsupported"), "web_search").otherwise(family)
    )
    if asked_col is None:
        return routed
    asked = F.col(asked_col)
    wrong = asked.isin("document", "dataset", "database", "image") & (asked != F.col("family"))
    return routed.withColumn(
        "refusal", F.when(wrong, F.concat(F.lit("no active "), asked))
    )
