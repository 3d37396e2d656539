"""What the SQL guard lets through and what it refuses."""

import pytest

from askspark.plans.guard import RefusedQuery, guarded_sql

SF_DIR = "/root/testdata/sf0.001"
TABLES = {n: f"{SF_DIR}/{n}.parquet" for n in ("orders", "customer", "events")}

REFUSED = [
    "INSERT INTO orders SELECT * FROM orders",
    "DROP VIEW orders",
    "CREATE TABLE x AS SELECT 1",
    "SET spark.sql.runSQLOnFiles=true",
    "FROM orders INSERT INTO customer SELECT *",
    "SELECT 1) ; DROP TABLE orders; SELECT (1",
    "SELECT 1; SELECT 2",
    "SELECT * FROM nation",
    "SELECT * FROM other.orders",
    f"SELECT * FROM parquet.`{SF_DIR}/nation.parquet`",
    f"SELECT * FROM text.`{SF_DIR}/../../etc/passwd`",
    "SELECT java_method('java.lang.System', 'getenv')",
    "SELECT /* x */ reflect ('java.lang.System', 'getenv')",
    "SELECT `try_reflect`('java.lang.System', 'getenv')",
    "SHOW TABLES",
    "DESCRIBE orders",
    "",
    "SELEC 1",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(RefusedQuery):
        guarded_sql(spark, sql, TABLES)


def test_shared_tables_stay_hidden(spark, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS hidden_table (a INT) USING parquet LOCATION '{tmp_path}/hidden'")
    try:
        with pytest.raises(RefusedQuery):
            guarded_sql(spark, "SELECT * FROM hidden_table", TABLES)
        with pytest.raises(RefusedQuery):
            guarded_sql(spark, "SELECT * FROM spark_catalog.default.hidden_table", TABLES)
    finally:
        spark.sql("DROP TABLE hidden_table")


def test_caps(spark):
    plain = guarded_sql(spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey; ", TABLES)
    assert plain.total.first()["n"] == 100 and plain.preview.count() == 50
    assert [r[0] for r in plain.rows.take(3)] == [0, 1, 2]
    assert guarded_sql(spark, "SELECT o_custkey, count(*) FROM orders GROUP BY 1 -- note", TABLES).total.first()["n"] > 100
    assert guarded_sql(spark, "SELECT o_orderkey FROM orders LIMIT 7", TABLES).rows.count() == 7
    assert guarded_sql(spark, "WITH t AS (SELECT 1 AS a) SELECT a FROM t", TABLES).rows.first()["a"] == 1


def test_capped_sort_is_a_top_n(spark):
    rows = guarded_sql(spark, "SELECT o_orderkey FROM orders WHERE o_custkey > 5 ORDER BY o_totalprice", TABLES).rows
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "TakeOrderedAndProject" in plan and "GreaterThan(o_custkey,5)" in plan
    assert "o_orderpriority" not in plan


def test_only_the_given_views_are_read(spark, tmp_path):
    spark.range(3).createOrReplaceGlobalTempView("hid")
    spark.range(3).createOrReplaceGlobalTempView("orders")
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    for name in ("orders", "elsewhere.secret", "note"):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (a INT) USING parquet LOCATION '{tmp_path}/{name}'")
    try:
        for sql in (
            "SELECT * FROM global_temp.hid", "SELECT * FROM global_temp.orders", "SELECT * FROM elsewhere.secret", "SELECT * FROM note",
            "SELECT * FROM default.orders", "SELECT * FROM spark_catalog.default.orders", "SELECT * FROM spark_catalog.elsewhere.secret",
            "SELECT * FROM orders WHERE o_orderkey IN (SELECT a FROM elsewhere.secret)", "SELECT (SELECT max(id) FROM global_temp.hid) AS m FROM orders",
            "SELECT 1 WHERE EXISTS (SELECT 1 FROM note)", "WITH t AS (SELECT * FROM note) SELECT * FROM t", "SELECT * FROM orders, LATERAL (SELECT * FROM note)",
        ):
            with pytest.raises(RefusedQuery):
                guarded_sql(spark, sql, TABLES)
        for sql in (
            "SELECT o_orderkey AS note FROM orders", "SELECT 'spark_catalog.default.note' AS x, o.* FROM orders o", "WITH note AS (SELECT 1 AS a) SELECT * FROM note",
            "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", "SELECT * FROM VALUES (1), (2)", "SELECT * FROM range(3)",
        ):
            assert guarded_sql(spark, sql, TABLES).rows.count() > 0
    finally:
        for name in ("orders", "elsewhere.secret", "note"):
            spark.sql(f"DROP TABLE {name}")
        spark.sql("DROP DATABASE elsewhere")
        spark.catalog.dropGlobalTempView("hid")
        spark.catalog.dropGlobalTempView("orders")


def test_qualified_names_and_loaders(spark, tmp_path):
    (tmp_path / "staff.csv").write_text("name,pay\nAda,3\nBob,4\n")
    tables = {"shop.orders": TABLES["orders"], "hr.staff-list": lambda s: s.read.option("header", True).csv(str(tmp_path / "staff.csv"))}
    rows = guarded_sql(spark, "SELECT `o`.o_orderkey, 'shop.orders' AS t FROM `shop`.`orders` AS `o` ORDER BY 1", tables).rows
    assert rows.count() == 100 and rows.first()["t"] == "shop.orders"
    assert guarded_sql(spark, "SELECT count(*) AS n FROM shop.orders", tables).rows.first()["n"] == 1500
    assert guarded_sql(spark, "SELECT sum(pay) AS s FROM `hr`.`staff-list` WHERE name IN (SELECT name FROM `hr`.`staff-list`)", tables).rows.first()["s"] == 7
    with pytest.raises(RefusedQuery):
        guarded_sql(spark, "SELECT * FROM `shop`.`customer`", tables)
