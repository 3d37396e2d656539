"""Column functions on text. All of them are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities decoded in page text, in the order they are replaced (the ampersand comes last).
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]

LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


# Fixed value: the white space of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Text without white space at either end (not only blanks, unlike ``trim``); its time grows with the text, whatever
    blanks are inside."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def words(c: Column) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def whitespace_words(c: Column) -> Column:
    """Words between white space, case kept."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines of a text, whatever the line break."""
    return F.split(c, LINE_BREAK)


def page_text(html: Column) -> Column:
    """Readable text of a web page: comments, scripts, styles and tags become blanks, entities are decoded."""
    text = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", " ")
    text = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?(?:</script\s*>|$)", " ")
    text = F.regexp_replace(text, r"(?is)<style\b[^>]*>.*?(?:</style\s*>|$)", " ")
    text = F.regexp_replace(text, r"<[^>]*(?:>|$)", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fenced_block(c: Column, lang: str) -> Column:
    """First block fenced as ``lang``, else the first fence of any kind, else the whole text; stripped."""

    def after(mark: str) -> Column:
        rest = F.substring(c, F.instr(c, mark) + len(mark), F.length(c))
        return strip(F.substring_index(rest, "```", 1))

    tagged = "```" + lang
    return F.when(F.contains(c, F.lit(tagged)), after(tagged)).when(F.contains(c, F.lit("```")), after("```")).otherwise(
        strip(c)
    )


def reply_lines(c: Column) -> Column:
    """Non-blank lines of a model reply without their bullets or numbers."""
    kept = F.filter(lines(c), lambda line: strip(line) != "")
    # Fixed value: what a bullet or number looks like.
    return F.transform(kept, lambda line: strip(F.regexp_replace(line, r"(?U)^\s*[\d.\-*]+\s*", "")))


def query_variations(query: Column, reply: Column, n: int = 3) -> Column:
    """Up to n + 1 rewritten queries; the query itself comes first when the reply does not contain it."""
    found = F.coalesce(reply_lines(reply), F.array().cast("array<string>"))
    return F.slice(F.when(F.array_contains(found, query), found).otherwise(F.concat(F.array(query), found)), 1, n + 1)


def overlap_extract(text: Column, question: Column) -> Column:
    """The sentence of ``text`` that shares most different words with the question, the first of equals; null if none does."""
    asked = F.array_distinct(words(question))
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: strip(s) != "")
    scored = F.transform(
        sentences, lambda s, i: F.struct(F.size(F.array_intersect(words(s), asked)).alias("n"), (-i).alias("place"), strip(s).alias("sentence"))
    )
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["sentence"])


def sub_questions(query: Column, reply: Column) -> Column:
    """Non-empty reply lines, or the question itself if there are none."""
    found = F.filter(reply_lines(reply), lambda line: line != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(query))


def retrieval_strategy(reply: Column) -> Column:
    """One of four labels read from a noisy one-word reply; anything else means hyde."""
    label = F.regexp_replace(F.upper(reply), "[^A-Z]", "")
    return F.when(label.isin("NONE", "EXPANSION", "DECOMPOSITION", "HYDE"), F.lower(label)).otherwise("hyde")


def message_text(content: Column) -> Column:
    """Plain text of a message stored as text, as a JSON list of blocks, or as a JSON object.

    Text blocks of a list are joined by newlines. An object without text is kept as its JSON. The content counts as a list
    of blocks only if all of it is one JSON list of strings and objects, and as an object only if all of it is one; anything
    else, such as ``[1] see below``, is already plain.
    """
    # Inside one more pair of brackets, text after the first value makes the list invalid or longer than one.
    outer = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), content, F.lit("]"))), "$", "array<variant>")
    value = F.when(F.size(outer) == 1, F.element_at(outer, 1))
    kind = F.schema_of_variant(value)
    blocks = F.try_variant_get(value, "$", "array<variant>")

    def block_kind(block: Column) -> Column:
        return F.schema_of_variant(block)

    def block_text(block: Column) -> Column:
        plain = block_kind(block) == "STRING"
        inner = F.when(F.try_variant_get(block, "$.text", "string") != "", F.try_variant_get(block, "$.text", "string"))
        return F.when(plain, F.try_variant_get(block, "$", "string")).otherwise(inner)

    listed = F.array_join(F.filter(F.transform(blocks, block_text), lambda t: t.isNotNull()), "\n")
    of_blocks = F.forall(blocks, lambda b: (block_kind(b) == "STRING") | block_kind(b).startswith("OBJECT"))
    single = F.try_variant_get(value, "$.text", "string")
    return (
        F.when(content.isNull(), F.lit(""))
        .when(kind.startswith("ARRAY") & of_blocks, listed)
        .when(kind.startswith("OBJECT"), F.when(F.length(single) > 0, single).otherwise(content))
        .otherwise(content)
    )


# Error categories in the order they are tried.
ERROR_PATTERNS = [
    ("invalid_api_key", r"\bapi[ _-]?key[ _-]?invalid\b"),
    ("permission_denied", r"\bpermission[ _-]?denied\b"),
    ("quota_exceeded", r"\bquota[ _-]?exceeded\b"),
    ("rate_limit", r"\b429\b|\brate[ _-]?limit\b"),
    ("file_too_large", r"\bfile[ _-]?too[ _-]?large\b"),
    ("unsupported_format", r"\bunsupported[ _-]?format\b"),
    ("out_of_memory", r"\bmemory\b|\boom\b|out[ _-]?of[ _-]?memory"),
    ("timeout", r"\btimeout\b"),
    ("connection", r"\bconnection\b"),
    ("mysql", r"\bmysql\b|py.?mysql"),
    ("not_found", r"\b404\b|\bnot[ _-]?found\b"),
    ("sandbox", r"\bsandbox\b"),
]


def error_category(error: Column) -> Column:
    """First matching category of an error text; NULL if none matches."""
    text = F.lower(error)
    chain = F
    for name, pattern in ERROR_PATTERNS:
        chain = chain.when(F.rlike(text, F.lit(pattern)), F.lit(name))
    return chain


# Patterns and keywords of the question classes.
DISPLAY_PATTERNS = [
    r"\bshow\s+(me\s+)?(the\s+)?(all\s+)?(\w+\s+)?tables?\b",
    r"\bdisplay\s+(the\s+)?(\w+\s+)?tables?\b",
    r"\blist\s+(all\s+)?(\w+\s+)?(tables?|columns?|databases|records?)\b",
    r"\bview\s+(the\s+)?(\w+\s+)?tables?\b",
    r"\bget\s+(the\s+)?(\w+\s+)?tables?\b",
    r"\bshow\s+(\w+\s+)?(data|records|rows)\b",
]
SCHEMA_PATTERNS = [
    r"\bwhat\s+(tables|columns|fields)\b",
    r"\bshow\s+(schema|structure|columns)\b",
    r"\bdescribe\s+\w+",
    r"\bhow\s+many\s+(tables|columns)\b",
]
CALCULATION_WORDS = [
    "count", "sum", "average", "avg", "max", "min", "total",
    "calculate", "compute", "how many", "how much", "revenue",
    "profit", "sales", "group by", "join", "highest", "lowest",
    "top", "bottom", "most", "least", "best", "worst",
    "compare", "trend", "monthly", "yearly", "weekly", "daily",
    "quarterly", "growth", "increase", "decrease", "rank",
    "percentage", "ratio", "statistic", "stat", "metric",
    "metrics",
]
GENERAL_PATTERNS = [
    r"\bweather\b", r"\bforecast\b",
    r"\bjoke\b", r"\brecipe\b", r"\briddle\b",
    r"\b(movie|song|album)\s+name\b",
    r"\bstock\s+price\b", r"\bcryptocurrency\b", r"\bbitcoin\b",
]


def any_of(patterns: list[str], flags: str = "") -> str:
    """One pattern that matches where any of the given ones does."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def question_class(question: Column, match: str = "substring") -> Column:
    """display, schema, calculation or general, tried in this order; calculation if none applies.

    ``match="word"`` asks for keywords as whole words, so that "country" no longer counts as "count".
    """
    if match not in ("substring", "word"):
        raise ValueError("match must be 'substring' or 'word'")
    text = F.lower(strip(question))
    keywords = any_of(CALCULATION_WORDS)
    if match == "word":
        keywords = rf"(?U)\b(?:{keywords})\b"
    return (
        F.when(F.rlike(text, F.lit(any_of(DISPLAY_PATTERNS, "(?U)"))), "display")
        .when(F.rlike(text, F.lit(any_of(SCHEMA_PATTERNS, "(?U)"))), "schema")
        .when(F.rlike(text, F.lit(keywords)), "calculation")
        .when(F.rlike(text, F.lit(any_of(GENERAL_PATTERNS, "(?U)"))), "general")
        .otherwise("calculation")
    )


# Text that marks a query as an aggregate.
AGGREGATE_MARKS = ["COUNT(", "SUM(", "AVG(", "MIN(", "MAX(", "GROUP BY", "HAVING"]


def looks_aggregate(sql: Column) -> Column:
    """Whether the text holds an aggregate mark; a plain substring test, so a window MAX(...) counts too."""
    text = F.upper(sql)
    test = F.lit(False)
    for mark in AGGREGATE_MARKS:
        test = test | F.contains(text, F.lit(mark))
    return test


def with_limit(sql: Column, n: int = 100) -> Column:
    """SQL text with ``LIMIT n`` appended unless it names a limit already or looks like an aggregate."""
    bare = strip(F.regexp_replace(sql, ";+$", ""))
    open_ended = ~F.contains(F.upper(sql), F.lit("LIMIT")) & ~looks_aggregate(sql)
    return F.when(open_ended, F.concat(bare, F.lit(f" LIMIT {n};"))).otherwise(sql)


# How a table reference looks in SQL text.
QUOTED_REF = r"`([^`]+)`\.`([^`]+)`"
KEYWORD_REF = r"(?i)(?:FROM|JOIN|UPDATE|INTO|TABLE)\s+`?([A-Za-z_][\w-]*)`?\.`?([A-Za-z_][\w-]*)`?"


def table_refs(sql: Column) -> Column:
    """Array of (db, tbl) named in SQL text: quoted pairs anywhere first, then pairs after a table keyword."""

    def pairs(pattern: str) -> Column:
        dbs = F.regexp_extract_all(sql, F.lit(pattern), F.lit(1))
        tbls = F.regexp_extract_all(sql, F.lit(pattern), F.lit(2))
        return F.zip_with(dbs, tbls, lambda d, t: F.struct(d.alias("db"), t.alias("tbl")))

    return F.concat(pairs(QUOTED_REF), pairs(KEYWORD_REF))


def asset_family(asset: Column) -> Column:
    """document, dataset, image, database or unsupported, from a file extension or an asset type name."""
    kind = F.lower(asset)
    return (
        # The types of each family.
        F.when(kind.isin(".pdf", ".docx", ".doc", ".txt", "url"), "document")
        .when(kind.isin(".csv", ".xlsx", ".xls"), "dataset")
        .when(kind.isin(".png", ".jpg", ".jpeg", ".webp", ".gif", "image"), "image")
        .when(kind == "mysql", "database")
        .otherwise("unsupported")
    )


def image_mime(extension: Column) -> Column:
    """MIME type of an image extension, image/jpeg if it is not a known one."""
    ext = F.lower(extension)
    return (
        # The type of each extension.
        F.when(ext == ".png", "image/png")
        .when(ext.isin(".jpg", ".jpeg"), "image/jpeg")
        .when(ext == ".webp", "image/webp")
        .when(ext == ".gif", "image/gif")
        .otherwise("image/jpeg")
    )


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if the file name has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))
