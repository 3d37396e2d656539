"""Tables named in query texts, and text rules on long runs of blanks."""

import time

import pytest
from pyspark.sql import functions as F

from askspark.functions.sql_text import sql_table_refs, sql_tokens, table_names
from askspark.functions.text import strip
from askspark.operators.chunking import drop_empty_documents
from askspark.plans.guard import RefusedQuery
from askspark.plans.tables import ask_tables
from workload.text_logs import SHAPES


def refs(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string").select("i", sql_table_refs(F.col("q")).alias("r")).collect()
    return [[tuple(x) for x in r["r"]] if r["r"] is not None else None for r in sorted(rows, key=lambda r: r["i"])]


def test_every_shape_of_the_query_log(spark):
    texts = [s.replace("{t}", "t").replace("{n}", "\n").replace("{q}", "'") for s, _ in SHAPES]
    want = [[(r.partition(".")[0], r.partition(".")[2] or "t") for r in named] for _, named in SHAPES]
    assert len(SHAPES) == 20 and refs(spark, texts) == want


def test_other_texts(spark):
    assert refs(spark, [
        None, "", "from", "SELECT 'never closed from a.b", "/* never closed from a.b", "SELECT * FROM a.`b``c` x", "FROM a.b.c.d",
        "SELECT * FROM unnest(o.items) u, s.t", "CREATE TABLE IF NOT EXISTS s.t AS SELECT 1", "SELECT ((o.x)) FROM s.t", "DELETE FROM s.t WHERE a.b = 1",
        "SELECT * FROM s.t FOR UPDATE", "SELECT trim(BOTH 'x' FROM o.name) FROM s.t o", "SELECT * FROM s.from",
    ]) == [None, [], [], [], [], [("a", "b`c")], [("c", "d")], [("s", "t")], [("s", "t")], [("s", "t")], [("s", "t")], [("s", "t")], [("s", "t")], [("s", "from")]]


def test_tokens_and_names(spark):
    row = spark.createDataFrame([("SELECT a.b+1 -- c\n FROM `x y`.z /*d*/ WHERE t = 'it''s'",)], "q string").select(sql_tokens(F.col("q")).alias("t"), table_names(F.col("q")).alias("n")).first()
    assert row["t"] == ["SELECT", "a", ".", "b", "+", "1", "FROM", "`x y`", ".", "z", "WHERE", "t", "=", "'it''s'"]
    assert row["n"] == [["x y", "z"]]


def test_long_runs_of_blanks_take_seconds(spark):
    blanks = "a" + " " * 1_000_000 + "b"
    start = time.perf_counter()
    df = spark.createDataFrame([(1, blanks), (2, " " * 1_000_000), (3, " \x85 x 　\t")], "doc_id int, text string")
    assert [len(r[0]) for r in df.select(strip(F.col("text"))).collect()] == [1_000_002, 0, 1]
    assert sorted(r[0] for r in drop_empty_documents(df).select("doc_id").collect()) == [1, 3]
    assert time.perf_counter() - start < 15


@pytest.fixture(scope="module")
def shop(spark):
    return {f"shop.{n}": f"/root/testdata/sf0.001/{n}.parquet" for n in ("orders", "customer", "nation")}


def test_ordinary_sql_of_a_model_runs(spark, shop):
    for sql in (
        "SELECT `o`.`o_custkey` FROM `shop`.`orders` `o`", "SELECT o_custkey FROM Shop.Orders", "SELECT o_custkey FROM shop.orders -- join no.table",
        "SELECT shop.orders.o_custkey FROM shop.orders WHERE shop.orders.o_custkey > 0", "SELECT `shop`.`orders`.`o_custkey` FROM `shop`.`orders`",
        "SELECT (SELECT first(shop.customer.c_custkey) FROM shop.customer) AS o_custkey FROM shop.orders",
    ):
        answer = ask_tables(spark, "Total keys", shop, lambda question, schema: sql)
        assert answer.rows.columns == ["o_custkey"] and answer.rows.count() == 50 and answer.total.first()["n"] == 100


def test_refused_replies_are_corrected_or_raised(spark, shop):
    asked = []

    def write(question, schema):
        asked.append(question)
        return ["SELECT * FROM shop.nowhere", "DROP TABLE shop.orders", "SELECT count(*) AS n FROM shop.orders"][len(asked) - 1]

    assert ask_tables(spark, "How many orders", shop, write).rows.first()["n"] == 1500
    assert len(asked) == 3 and "shop.nowhere" in asked[1] and "unknown table" in asked[1] and "DROP TABLE" in asked[2]
    asked.clear()
    with pytest.raises(RefusedQuery, match="unknown table shop.nowhere"):
        ask_tables(spark, "How many orders", shop, write, attempts=1)


def test_display_has_an_order_and_schema_the_named_table(spark, shop):
    shown = ask_tables(spark, "Show me the customer table", shop)
    rows = shown.rows.collect()
    assert [r["c_custkey"] for r in rows] == list(range(rows[0]["c_custkey"], rows[0]["c_custkey"] + 50)) and rows[0]["n_total"] == 150 and rows[0]["truncated"]
    assert {r["tbl"] for r in ask_tables(spark, "What columns does nation have", shop).rows.collect()} == {"nation"}
    assert {r["tbl"] for r in ask_tables(spark, "What columns are there", shop).rows.collect()} == {"orders", "customer", "nation"}
