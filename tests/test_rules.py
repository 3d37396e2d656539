"""Rule operators on small tables, one row per branch."""

import pytest
from pyspark.sql import functions as F

from askspark.functions import text as T
from askspark.operators import routing as G


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("c"))).collect()]


@pytest.mark.parametrize("match,expected", [
    ("substring", ["display", "display", "schema", "schema", "calculation", "calculation", "general", "general", "calculation",
                   "calculation", "display", "display", "calculation", "calculation", "calculation"]),
    ("word", ["display", "display", "schema", "schema", "calculation", "calculation", "general", "general", "calculation",
              "calculation", "display", "display", "calculation", "calculation", "calculation"]),
])
def test_question_classes(spark, match, expected):
    asked = ["Show me the customer tables", "list columns", "How many tables are there?", "describe orders", "total revenue",
             "which country", "weather in Oslo", "tell a joke", "Who is Ada Lovelace", "", "show sales rows", "  LIST records",
             "state of things", "stop it", None]
    assert apply(spark, asked[:-1], lambda c: T.question_class(c, match)) == expected[:-1]


def test_keywords_inside_words(spark):
    # "forecast" is general, but the substring "count" in "country" is met first.
    asked = ["forecast for my country", "forecast for my town"]
    assert apply(spark, asked, T.question_class) == ["calculation", "general"]
    assert apply(spark, asked, lambda c: T.question_class(c, "word")) == ["general", "general"]
    with pytest.raises(ValueError):
        T.question_class(F.col("c"), "fuzzy")


def test_table_refs(spark):
    queries = ["SELECT * FROM `a`.`b` JOIN c.d ON 1", "update x.y-z set a=1", "select 1", "FROM `db`.tbl", "insert into\n a.b select * from `q q`.`r`"]
    found = apply(spark, queries, T.table_refs)
    pairs = [[(r["db"], r["tbl"]) for r in refs] for refs in found]
    assert pairs == [[("a", "b"), ("a", "b"), ("c", "d")], [("x", "y-z")], [], [("db", "tbl")], [("q q", "r"), ("a", "b")]]


def test_unknown_refs_include_unknown_databases(spark):
    log = spark.createDataFrame([(1, "select * from shop.orders"), (2, "select * from shop.nope"), (3, "select * from hr.staff")], "id int, sql string")
    catalog = spark.createDataFrame([("shop", "orders")], "db string, tbl string")
    rows = G.unknown_table_refs(log, "id", "sql", catalog).orderBy("id").collect()
    assert [(r["id"], r["tbl"], r["db_known"]) for r in rows] == [(2, "nope", True), (3, "staff", False)]


def test_limits(spark):
    queries = ["select a from t;;", "select credit_limit from t", "select count (*) from t", "select max(a) over () from t", "select a from t limit 3"]
    assert apply(spark, queries, T.with_limit) == [
        "select a from t LIMIT 100;", "select credit_limit from t", "select count (*) from t LIMIT 100;", "select max(a) over () from t", "select a from t limit 3"]


def test_fenced_blocks(spark):
    replies = ["x ```sql\nSELECT 1\n``` y ```z```", "``` a ```", " bare \n", "```sql SELECT 2"]
    assert apply(spark, replies, lambda c: T.fenced_block(c, "sql")) == ["SELECT 1", "a", "bare", "SELECT 2"]
    assert apply(spark, ["```sql\na```"], lambda c: T.fenced_block(c, "python")) == ["sql\na"]


def test_strategies(spark):
    assert apply(spark, ["hyde.", "**Expansion**", "unsure", " none ", "Decomposition", ""], T.retrieval_strategy) == [
        "hyde", "expansion", "hyde", "none", "decomposition", "hyde"]


def test_reply_lines(spark):
    rows = spark.createDataFrame([("q", "1. a\n\n - b\r\n3) c"), ("q", "q\nx\ny\nz\nw"), ("q", ""), ("q", "1.\n2."), ("q", None)], "q string, r string")
    out = rows.select(T.query_variations(F.col("q"), F.col("r")).alias("v"), T.sub_questions(F.col("q"), F.col("r")).alias("s")).collect()
    assert [r["v"] for r in out] == [["q", "a", "b", ") c"], ["q", "x", "y", "z"], ["q"], ["q", "", ""], ["q"]]
    assert [r["s"] for r in out] == [["a", "b", ") c"], ["q", "x", "y", "z", "w"], ["q"], ["q"], ["q"]]


def test_message_text(spark):
    contents = ["plain", None, '["a", {"type": "text", "text": "b"}, {"type": "image"}, {"text": ""}]', '{"type": "text", "text": "c"}', '{"x": 1}', "[]", "12", "[broken", "[1, 2, 3]", "[1] see note", '["a"] see ["b"]', '["a", 3]', '[["a"]]', '{"text": "t"} and', ' ["a"] ']
    kept = ["12", "[broken", "[1, 2, 3]", "[1] see note", '["a"] see ["b"]', '["a", 3]', '[["a"]]', '{"text": "t"} and', "a"]
    assert apply(spark, contents, T.message_text) == ["plain", "", "a\nb", "c", '{"x": 1}', "", *kept]


def test_error_categories(spark):
    errors = ["API-key invalid", "permission denied", "quota_exceeded", "got 429", "rate limit", "file too large", "unsupported-format", "out of memory", "request timeout",
              "connection lost", "pymysql", "404", "not found", "sandbox", "odd", "memoryless"]
    assert apply(spark, errors, T.error_category) == [
        "invalid_api_key", "permission_denied", "quota_exceeded", "rate_limit", "rate_limit", "file_too_large", "unsupported_format", "out_of_memory", "timeout",
        "connection", "mysql", "not_found", "not_found", "sandbox", None, None]


def test_resolve_tables(spark):
    catalog = spark.createDataFrame(
        [("shop", "orders", 0, 0), ("shop", "order items", 0, 1), ("logs", "orders", 1, 0), ("logs", "the", 1, 1), ("logs", "a.b", 1, 2)],
        "db string, tbl string, db_pos int, tbl_pos int")
    asked = ["show ORDERS", "orders in logs", "show the order items", "the thing", "reorders", "logs a.b please", "axb in logs"]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, q string")
    out = {r["id"]: (r["db"], r["tbl"]) for r in G.resolve_tables(rows, "id", "q", catalog).collect()}
    assert out == {0: ("shop", "orders"), 1: ("logs", "orders"), 2: ("shop", "order items"), 3: (None, None), 4: (None, None),
                   5: ("logs", "a.b"), 6: (None, None)}


def test_routes(spark):
    rows = spark.createDataFrame([(".PDF", "q", "document"), ("mysql", "tell a joke", None), ("mysql", "total", "image"), (".zip", "q", "dataset"), (None, "q", None)],
                                 "asset string, q string, asked string")
    out = [(r["handler"], r["refusal"]) for r in G.route_requests(rows, "asset", "q", "asked").collect()]
    assert out == [("document", None), ("web_search", None), ("database", "no active image"), ("web_search", "no active dataset"), ("web_search", None)]


def test_page_text(spark):
    html = ["<p>a&amp;lt;<br>b</p><script>x<y</script><!-- c --> d &quot;e&quot;", "<style>p{}</style>", "cut <div clas", "<SCRIPT src=1>never closed"]
    assert apply(spark, html, T.page_text) == ['a&lt; b d "e"', "", "cut", ""]


def test_extensions(spark):
    assert apply(spark, ["/a/b.TXT", "/a.b/c", "/x/.bashrc", "c.tar.gz", "/a/.x.png"], T.file_extension) == [".txt", "", "", ".gz", ".png"]
