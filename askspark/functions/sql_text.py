"""Reading SQL text with column functions: its tokens, and the tables it names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a comment, a text in single or double quotes, a name in backquotes, a word, a number, or one other character.
#: Repeats never give back what they took, so a text that is never closed takes no longer than one that is.
TOKEN = r"""(?s)--[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|'(?:[^'\\]|\\.|'')*+'?|"(?:[^"\\]|\\.|"")*+"?|`(?:[^`]|``)*+`?|[\p{L}_][\p{L}\p{N}_$]*+(?:-[\p{L}_][\p{L}\p{N}_$]*+)*+|[0-9][\p{L}\p{N}_.]*+|[^\s]"""
WORD = r"^[\p{L}_`]"
#: Words after which a table is named, words that may stand between, and words that end a list of tables.
TABLE_WORDS = ["FROM", "JOIN", "STRAIGHT_JOIN", "UPDATE", "INTO", "TABLE", "DESCRIBE", "DESC", "TRUNCATE"]
BETWEEN_WORDS = ["LATERAL", "ONLY", "IF", "NOT", "EXISTS", "IGNORE", "OVERWRITE", "EXTENDED"]
END_WORDS = ["SELECT", "WITH", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "MINUS", "WINDOW", "SET", "VALUES", "QUALIFY", "RETURNING"]


def sql_tokens(sql: Column) -> Column:
    """The tokens of a query text without its comments; null for null."""
    found = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~(t.startswith("--") | t.startswith("/*")))


def _bare(name: Column) -> Column:
    inner = F.regexp_replace(name, "^`|`$", "")
    return F.when(name.startswith("`"), F.replace(inner, F.lit("``"), F.lit("`"))).otherwise(name)


def table_names(sql: Column) -> Column:
    """Array of arrays: the parts of each name of two or more parts that stands where a table is named, in order.

    A table is named after FROM, JOIN and their like, and after the commas of such a list, also inside subqueries and joins
    in parentheses. Texts, comments, columns (``alias.col``, ``db.tbl.col``), the FROM of ``extract(... FROM x)`` and of IS
    DISTINCT FROM name no table. One walk over the tokens keeps, for each open parenthesis, whether a table may come
    (``table``), a list of tables goes on (``list``), or neither (``query``; ``call`` inside parentheses that are no query).
    """
    texts = "array<string>"
    start = F.struct(
        F.array(F.lit("query")).alias("frames"), F.array().cast(texts).alias("parts"), F.lit(False).alias("dot"),
        F.lit("").alias("before"), F.array().cast(f"array<{texts}>").alias("names"),
    )

    def step(s: Column, x: Column) -> Column:
        u, top = F.upper(x), F.element_at(s["frames"], -1)
        word, reading = x.rlike(WORD), F.size(s["parts"]) > 0
        goes_on = reading & ((s["dot"] & word) | (~s["dot"] & (x == ".")))
        outer = F.slice(s["frames"], 1, F.size(s["frames"]) - 1)
        put = lambda v: F.concat(outer, F.array(F.lit(v)))
        keyword = u.isin(TABLE_WORDS) & (top != "call") & ~s["before"].isin("DISTINCT", "KEY", "FOR", ".")
        named = word & (top == "table") & ~u.isin(BETWEEN_WORDS)
        frames = (
            F.when(goes_on, s["frames"])
            .when(u.isin("SELECT", "WITH"), put("query"))
            .when(keyword, put("table"))
            .when(u.isin(END_WORDS) & (top != "call"), put("query"))
            .when((x == "(") & (top == "table"), F.concat(put("list"), F.array(F.lit("table"))))
            .when(x == "(", F.concat(s["frames"], F.array(F.lit("call"))))
            .when((x == ")") & (F.size(s["frames"]) > 1), outer)
            .when((x == ",") & (top == "list"), put("table"))
            .when(named, put("list"))
            .otherwise(s["frames"])
        )
        begins = named & ~keyword & ~u.isin(END_WORDS)
        more = F.when(s["dot"] | ~reading, F.array(_bare(x)))
        parts = (
            F.when(goes_on & (x == "."), s["parts"]).when(goes_on, F.concat(s["parts"], more))
            .when(begins, F.array(_bare(x))).otherwise(F.array().cast(texts))
        )
        names = F.when(reading & ~goes_on & (F.size(s["parts"]) > 1), F.concat(s["names"], F.array(s["parts"]))).otherwise(s["names"])
        return F.struct(frames.alias("frames"), parts.alias("parts"), (goes_on & (x == ".")).alias("dot"), u.alias("before"), names.alias("names"))

    return F.aggregate(F.concat(sql_tokens(sql), F.array(F.lit(";"))), start, step, lambda s: s["names"])


def sql_table_refs(sql: Column) -> Column:
    """Array of (db, tbl) of the tables that a query names with their database; of three parts the last two count."""
    return F.transform(table_names(sql), lambda p: F.struct(F.element_at(p, -2).alias("db"), F.element_at(p, -1).alias("tbl")))
