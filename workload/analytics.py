"""Relational analytics, guarded SQL, catalog."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from askspark.operators import catalog as K
from askspark.operators import relational as R
from askspark.operators import sketches
from askspark.operators.skew import interval_join, skew_join
from askspark.plans.guard import guarded_sql
from askspark.plans.tables import ask_tables
from askspark.session import cut_lineage
from workload.tables import NAMES, paths, table

QUERIES, ORACLES = {}, {}
AS_OF = dt.datetime(1998, 3, 15)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("r01_filter_project", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net_price
    FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24""")
def _(spark, d):
    return R.filter_project(
        table(spark, d, "lineitem"), "l_discount >= 0.05D AND l_quantity < 24",
        ["l_orderkey", "l_linenumber", "round(l_extendedprice * (1 - l_discount), 4) AS net_price"])


@query("r02_count_rows", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def _(spark, d):
    return R.count_rows(table(spark, d, "orders"), "o_orderstatus = 'O' AND o_totalprice > 100000")


@query("r03_totals", """
    SELECT count(*) AS n, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_avg,
           min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
           round(sum(l_extendedprice), 2) AS l_extendedprice_sum, round(avg(l_extendedprice), 4) AS l_extendedprice_avg,
           min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem""")
def _(spark, d):
    out = R.totals(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumns({
        "l_quantity_sum": F.round("l_quantity_sum", 2), "l_quantity_avg": F.round("l_quantity_avg", 6),
        "l_extendedprice_sum": F.round("l_extendedprice_sum", 2), "l_extendedprice_avg": F.round("l_extendedprice_avg", 4)})


@query("r04_group_totals", """
    SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 4) AS avg_revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(spark, d):
    # Orders shrink to one row per customer before the join, so a customer with most orders is no hot key.
    spend = R.group_totals(table(spark, d, "orders"), ["o_custkey"], {"n": "count(1)", "spend": "sum(o_totalprice)"})
    customer = table(spark, d, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey AS n_nationkey")
    nation = table(spark, d, "nation").selectExpr("n_nationkey", "n_regionkey AS r_regionkey")
    by_customer = R.join_tables(spend, customer, ["o_custkey"])
    by_nation = R.group_totals(by_customer, ["n_nationkey"], {"n": "sum(n)", "spend": "sum(spend)"})
    joined = R.join_tables(R.join_tables(by_nation, nation, ["n_nationkey"]), table(spark, d, "region"), ["r_regionkey"])
    return R.group_totals(joined, ["r_name"], {
        "n_orders": "sum(n)", "revenue": "round(sum(spend), 2)", "avg_revenue": "round(sum(spend) / sum(n), 4)"})


@query("r05_group_having", """
    SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend FROM orders
    GROUP BY o_custkey HAVING count(*) >= 12 AND avg(o_totalprice) > 200000""")
def _(spark, d):
    return R.group_having(
        table(spark, d, "orders"), ["o_custkey"],
        {"n_orders": "count(1)", "spend": "round(sum(o_totalprice), 2)", "mean": "avg(o_totalprice)"},
        "n_orders >= 12 AND mean > 200000").drop("mean")


JOIN_SQL = """
    SELECT o_orderkey, l_linenumber, l_extendedprice, o_custkey, o_orderpriority
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _join(spark, d, salt=None):
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_linenumber", "l_extendedprice")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return R.join_tables(lines, orders, ["o_orderkey"], salt=salt)


QUERIES["r06_join_tables"] = _join
ORACLES["r06_join_tables"] = JOIN_SQL
QUERIES["r06_join_tables_salted"] = lambda spark, d: _join(spark, d, salt=4)
ORACLES["r06_join_tables_salted"] = JOIN_SQL


@query("r06_skew_join", """
    WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 1 ELSE user_id END AS c_custkey, value FROM events)
    SELECT c_custkey, c_name, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN customer USING (c_custkey) GROUP BY 1, 2""")
def _(spark, d):
    # One key has half of the rows; what it meets is repeated for the tasks that share it.
    e = table(spark, d, "events").selectExpr("CASE WHEN event_id % 2 = 0 THEN 1 ELSE user_id END AS c_custkey", "value")
    met = skew_join(e, table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    return R.group_totals(met, ["c_custkey", "c_name"], {"n": "count(1)", "total": "round(sum(value), 4)"})


@query("r06_interval_join", """
    WITH span AS (SELECT n_nationkey, step, TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS low,
            TIMESTAMP '2024-01-01' + to_days(n_nationkey) + to_seconds(step) AS high
        FROM nation, (SELECT unnest([60, 3600, 86400, 2592000, 315360000]) AS step))
    SELECT n_nationkey, step::BIGINT AS step, count(*) AS n, sum(event_id)::BIGINT AS ids FROM span JOIN events ON ts >= low AND ts < high GROUP BY 1, 2""")
def _(spark, d):
    """Intervals from one minute to ten years in one table."""
    steps = "explode(array(60L, 3600L, 86400L, 2592000L, 315360000L)) AS step"
    spans = table(spark, d, "nation").selectExpr("n_nationkey", "TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, n_nationkey) AS low", steps)
    spans = spans.selectExpr("n_nationkey", "step", "low", "low + make_interval(0, 0, 0, 0, 0, 0, step) AS high")
    met = interval_join(table(spark, d, "events").select("event_id", "ts"), spans, "ts", "low", "high")
    return R.group_totals(met, ["n_nationkey", "step"], {"n": "count(1)", "ids": "sum(event_id)"})


def top_customers(spark, d):
    spend = R.group_totals(table(spark, d, "orders"), ["o_custkey"], {"total_spend": "round(sum(o_totalprice), 2)", "n_orders": "count(1)"})
    # Only customers that exist compete, and names are looked up for the ten winners alone.
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    spend = R.join_tables(spend.withColumnRenamed("o_custkey", "c_custkey"), customer.select("c_custkey"), ["c_custkey"], "left_semi")
    best = R.top_k(spend, "total_spend", 10, ["c_custkey"])
    named = R.join_tables(best, customer, ["c_custkey"])
    return named.orderBy(F.desc("total_spend"), "c_custkey")


QUERIES["r07_top_k"] = top_customers
ORACLES["r07_top_k"] = """
    SELECT c_custkey, round(sum(o_totalprice), 2) AS total_spend, count(*) AS n_orders, c_name
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name
    ORDER BY total_spend DESC, c_custkey LIMIT 10"""


def _ranked(cut: str) -> str:
    return f"""
    SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS row_number,
        rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS rank,
        dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS dense_rank FROM orders) {cut}"""


@query("r08_rank_in_group", _ranked(""))
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.rank_in_group(orders, ["o_orderpriority"], "o_totalprice", "o_orderkey")


@query("r08_rank_hot_values", """
    WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, event_type, k, row_number() OVER (PARTITION BY event_type ORDER BY k, event_id) AS row_number,
        rank() OVER (PARTITION BY event_type ORDER BY k) AS rank, dense_rank() OVER (PARTITION BY event_type ORDER BY k) AS dense_rank FROM e""")
def _(spark, d):
    # A hundred values only: each holds many rows, and the tie column orders them.
    events = table(spark, d, "events").selectExpr("event_id", "event_type", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    return R.rank_in_group(events, ["event_type"], "k", "event_id", ascending=True)


def ranked_sql(source: str, value: str, tie: str, down: str) -> str:
    return f"""
    WITH t AS ({source})
    SELECT * REPLACE (CAST(v AS VARCHAR) AS v), row_number() OVER (PARTITION BY g ORDER BY v {down} NULLS LAST, tie) AS row_number, rank() OVER (PARTITION BY g ORDER BY v {down} NULLS LAST) AS rank,
        dense_rank() OVER (PARTITION BY g ORDER BY v {down} NULLS LAST) AS dense_rank FROM (SELECT g, {value} AS v, {tie} AS tie FROM t)"""


RANKED = {
    # times; numbers a double cannot tell apart; cents of large amounts; a text that breaks ties
    "r08_rank_dates": ("SELECT o_orderpriority AS g, o_orderdate AS v, o_orderkey AS tie FROM orders", True),
    "r08_rank_large_keys": ("SELECT o_orderpriority AS g, 9007199254740992 + o_orderkey % 3 AS v, o_orderkey AS tie FROM orders", False),
    "r08_rank_cents": ("SELECT o_orderstatus AS g, CAST(90000000000000000 + o_orderkey % 5 AS DECIMAL(20, 0)) AS v, o_orderkey AS tie FROM orders", True),
    "r08_rank_text_tie": ("SELECT c_mktsegment AS g, c_custkey % 4 AS v, c_name AS tie FROM customer", False),
}


def _rank_query(sql: str, down: bool):
    def run(spark, d):
        source = sql.rsplit(" FROM ", 1)
        rows = table(spark, d, source[1]).selectExpr(*_split_columns(source[0].removeprefix("SELECT ")))
        return R.rank_in_group(rows, ["g"], "v", "tie", ascending=not down).withColumn("v", F.col("v").cast("string"))

    return run


def _split_columns(text: str) -> list[str]:
    return re.split(r", (?![^(]*\))", text)


for _name, (_sql, _down) in RANKED.items():
    QUERIES[_name] = _rank_query(_sql, _down)
    ORACLES[_name] = ranked_sql(_sql, "v", "tie", "DESC" if _down else "ASC")


@query("r08_top_k_in_group", _ranked("WHERE row_number <= 5"))
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.rank_in_group(orders, ["o_orderpriority"], "o_totalprice", "o_orderkey", k=5)


@query("r09_share_of_total", """
    SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total,
           round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 6) AS share
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(spark, d):
    out = R.share_of_total(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.withColumns({"total": F.round("total", 2), "share": F.round("share", 6)})


@query("r10_compare_groups", """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
           count(*) FILTER (o_orderstatus = 'P') AS P,
           count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'F') AS O_minus_F,
           count(*) FILTER (o_orderstatus = 'P') - count(*) FILTER (o_orderstatus = 'F') AS P_minus_F
    FROM orders GROUP BY o_orderpriority""")
def _(spark, d):
    return R.compare_groups(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "count(1)")


@query("r10_compare_absent", """
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus = 'none') AS "none",
           count(*) FILTER (o_orderstatus = 'none') - count(*) FILTER (o_orderstatus = 'P') AS none_minus_P FROM orders GROUP BY o_custkey""")
def _(spark, d):
    return R.compare_groups(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["P", "none"], "count(1)")


@query("r07_top_k_orphans", """
    SELECT c_custkey, round(sum(o_totalprice), 2) AS total_spend, c_name FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_custkey % 2 = 0 GROUP BY c_custkey, c_name ORDER BY total_spend DESC, c_custkey LIMIT 10""")
def _(spark, d):
    """Orders of customers that the second table lacks take no place among the ten."""
    spend = R.group_totals(table(spark, d, "orders"), ["o_custkey"], {"total_spend": "round(sum(o_totalprice), 2)"})
    some = table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    known = R.join_tables(spend.withColumnRenamed("o_custkey", "c_custkey"), some.select("c_custkey"), ["c_custkey"], "left_semi")
    return R.join_tables(R.top_k(known, "total_spend", 10, ["c_custkey"]), some, ["c_custkey"])


@query("r11_trend_monthly", """
    SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders GROUP BY 1""")
def _(spark, d):
    return R.trend(table(spark, d, "orders"), "o_orderdate", "month", {"n_orders": "count(1)", "revenue": "round(sum(o_totalprice), 2)"})


@query("r11_trend_daily", """
    SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY 1, 2""")
def _(spark, d):
    return R.trend(table(spark, d, "events"), "ts", "day", {"n": "count(1)", "total": "round(sum(value), 2)"}, ["event_type"])


@query("r12_growth", """
    WITH s AS (SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS t FROM orders GROUP BY 1),
         p AS (SELECT period, t, lag(t) OVER (ORDER BY period) AS b FROM s)
    SELECT period, round(t, 2) AS total, round(b, 2) AS previous, round(t - b, 2) AS change,
           round((t - b) / b, 6) AS growth_rate FROM p""")
def _(spark, d):
    out = R.growth(table(spark, d, "orders"), "o_orderdate", "quarter", "o_totalprice")
    return out.withColumns({
        "total": F.round("total", 2), "previous": F.round("previous", 2), "change": F.round("change", 2),
        "growth_rate": F.round("growth_rate", 6)})


@query("r12_growth_gaps", """
    WITH o AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS t FROM orders
               WHERE month(o_orderdate) NOT IN (2, 7, 8) GROUP BY ALL),
    cal AS (SELECT o_orderpriority, unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS period FROM o GROUP BY o_orderpriority),
    s AS (SELECT o_orderpriority, period, coalesce(t, 0) AS t FROM cal LEFT JOIN o USING (o_orderpriority, period)),
    p AS (SELECT *, lag(t) OVER (PARTITION BY o_orderpriority ORDER BY period) AS b FROM s)
    SELECT o_orderpriority, period, round(t, 2) AS total, round(b, 2) AS previous, round(t - b, 2) AS change,
           round((t - b) / nullif(b, 0), 6) AS growth_rate FROM p""")
def _(spark, d):
    out = R.growth(table(spark, d, "orders").where("month(o_orderdate) NOT IN (2, 7, 8)"), "o_orderdate", "month", "o_totalprice", ["o_orderpriority"])
    return out.withColumns({
        "total": F.round("total", 2), "previous": F.round("previous", 2), "change": F.round("change", 2),
        "growth_rate": F.round("growth_rate", 6)})


@query("r13_describe_sparse", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev, min(x) AS "min", max(x) AS "max",
           round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75
    FROM (SELECT {e} AS x FROM lineitem)""" for c, e in (("l_tax", "l_tax"), ("nothing", "CAST(NULL AS DOUBLE)"))))
def _(spark, d):
    """A column without any value has a row as well."""
    lines = table(spark, d, "lineitem").selectExpr("l_tax", "CAST(NULL AS DOUBLE) AS nothing")
    out = R.describe_numeric(lines, ["l_tax", "nothing"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "q25", "q50", "q75")})


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]


@query("r13_describe_numeric", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
           min({c}) AS "min", max({c}) AS "max", round(quantile_cont({c}, 0.25), 6) AS q25,
           round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem""" for c in DESCRIBED))
def _(spark, d):
    out = R.describe_numeric(table(spark, d, "lineitem"), DESCRIBED)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "q25", "q50", "q75")})


@query("r13_correlation", """
    SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr_l_quantity_l_extendedprice,
           round(corr(l_discount, l_tax), 6) AS corr_l_discount_l_tax FROM lineitem""")
def _(spark, d):
    out = R.correlation(table(spark, d, "lineitem"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("r14_distinct_values", """
    SELECT count(DISTINCT o_custkey) AS o_custkey_distinct, count(DISTINCT o_orderstatus) AS o_orderstatus_distinct,
           count(DISTINCT o_orderpriority) AS o_orderpriority_distinct FROM orders""")
def _(spark, d):
    return R.distinct_values(table(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("r14_distinct_by_sketches", """
    SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, true AS users_near, true AS median_near FROM events GROUP BY event_type""")
def _(spark, d):
    """Users and median value per type from merged daily sketches: within 4 standard errors (6.5 %) and 2 % of the ranks."""
    events = table(spark, d, "events")
    days = cut_lineage(sketches.sketch_periods(events, "ts", "day", ["event_type"], ["user_id"], ["value"]), "daily-sketches")
    month = sketches.read_sketches(sketches.merge_sketches(days, ["event_type"]), {"median": 0.5})
    exact = events.join(month.select("event_type", "value_median"), "event_type")
    exact = exact.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("n_users"),
        (F.abs(F.avg((F.col("value") <= F.col("value_median")).cast("double")) - 0.5) <= 0.02).alias("median_near"),
    )
    near = (F.abs(F.col("user_id_distinct") - F.col("n_users")) <= 0.065 * F.col("n_users")).alias("users_near")
    return month.join(exact, "event_type").select("event_type", "n_rows", "n_users", near, "median_near")


@query("r14_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return R.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("r15_in_last_period", """
    SELECT count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-02-01' AND o_orderdate < TIMESTAMP '1998-03-01'""")
def _(spark, d):
    rows = R.in_last_period(table(spark, d, "orders"), "o_orderdate", "month", AS_OF)
    return rows.agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


SPANS_SQL = """
    WITH spans AS (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS span_start FROM orders)
    SELECT span_start, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend FROM spans
    JOIN orders ON o_orderdate >= span_start AND o_orderdate < span_start + INTERVAL 45 DAYS GROUP BY span_start"""


@query("r06_range_join", SPANS_SQL)
def _(spark, d):
    # Orders shrink to one row per date before the join.
    days = R.group_totals(table(spark, d, "orders"), ["o_orderdate"], {"n": "count(1)", "spend": "sum(o_totalprice)"})
    starts = R.trend(days, "o_orderdate", "month", {"n": "count(1)"}).select(F.col("period").alias("span_start"))
    spans = starts.withColumn("span_end", F.col("span_start") + F.expr("INTERVAL 45 DAYS"))
    pairs = R.range_join(days, spans, "o_orderdate", "span_start", "span_end")
    return R.group_totals(pairs, ["span_start"], {"n_orders": "sum(n)", "spend": "round(sum(spend), 2)"})


@query("r06_range_join_reversed", """
    SELECT e.event_id, r.event_id AS range_id FROM events e JOIN events r ON r.event_id % 50 = 0
    AND e.ts >= r.ts AND e.ts < CASE WHEN r.event_id % 100 = 0 THEN r.ts + INTERVAL 30 MINUTES ELSE r.ts - INTERVAL 3 DAYS END""")
def _(spark, d):
    """Ranges that end before they start hold nothing."""
    events = table(spark, d, "events")
    end = F.when(F.col("event_id") % 100 == 0, F.col("ts") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("ts") - F.expr("INTERVAL 3 DAYS"))
    ranges = events.where("event_id % 50 = 0").select(F.col("event_id").alias("range_id"), F.col("ts").alias("low"), end.alias("high"))
    return R.range_join(events.select("event_id", "ts"), ranges, "ts", "low", "high", "day").select("event_id", "range_id")


def guarded(name: str, sql: str, oracle: str | None = None, max_rows: int | None = 100):
    QUERIES[name] = lambda spark, d: guarded_sql(spark, sql, paths(d), max_rows).rows
    ORACLES[name] = oracle or sql


QUALIFIED = "SELECT o_orderkey, c_name FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 90"


@query("g05_guarded_sql_qualified", QUALIFIED.format(orders="orders", customer="customer"))
def _(spark, d):
    """Generated SQL names its tables by database and backquotes; one table comes through a loader."""
    tables = {f"shop.{n}": p for n, p in paths(d).items()} | {"shop.customer": lambda s: s.read.parquet(paths(d)["customer"])}
    return guarded_sql(spark, QUALIFIED.format(orders="`shop`.`orders`", customer="shop.`customer`"), tables).rows


guarded("g05_guarded_sql", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_totalprice DESC, o_orderkey""", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
# The subqueries are reduced to one row per customer first: a customer with most orders is then no hot join key.
guarded("p1_semi_anti_join", """
    WITH big AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000),
         urgent AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT c_mktsegment, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer c
    WHERE EXISTS (SELECT 1 FROM big WHERE big.o_custkey = c.c_custkey)
      AND NOT EXISTS (SELECT 1 FROM urgent WHERE urgent.o_custkey = c.c_custkey)
    GROUP BY c_mktsegment""", """
    SELECT c_mktsegment, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)
      AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
    GROUP BY c_mktsegment""")
guarded("p2_left_outer_join", """
    WITH late AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spend FROM orders
                  WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY o_custkey)
    SELECT c_mktsegment, count(*) AS n_customers, count(late.n) AS n_active, round(coalesce(sum(spend), 0), 2) AS spend
    FROM customer LEFT JOIN late ON c_custkey = o_custkey GROUP BY c_mktsegment""")
guarded("p3_range_join", """
    WITH days AS (SELECT o_orderdate AS d, count(*) AS n, sum(o_totalprice) AS spend FROM orders GROUP BY o_orderdate),
         spans AS (SELECT DISTINCT CAST(date_trunc('month', d) AS TIMESTAMP_NTZ) AS span_start FROM days),
         buckets AS (SELECT span_start, span_start + INTERVAL 45 DAYS AS span_end,
                     explode(sequence(span_start, span_start + INTERVAL 45 DAYS, INTERVAL 1 MONTH)) AS bucket FROM spans)
    SELECT span_start, sum(n) AS n_orders, round(sum(spend), 2) AS spend FROM buckets
    JOIN days ON CAST(date_trunc('month', d) AS TIMESTAMP_NTZ) = bucket AND d >= span_start AND d < span_end
    GROUP BY span_start""", SPANS_SQL)
guarded("p4_set_operations", """
    WITH returned AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT
                      SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45),
         wanted AS (SELECT l_partkey FROM returned EXCEPT SELECT p_partkey FROM part WHERE p_size > 40),
         all_keys AS (SELECT 'wanted' AS kind, l_partkey AS k FROM wanted UNION ALL
                      SELECT 'either', k FROM (SELECT l_partkey AS k FROM wanted UNION SELECT p_partkey FROM part WHERE p_size < 5))
    SELECT kind, count(*) AS n, sum(k) AS key_sum FROM all_keys GROUP BY kind""", """
    WITH returned AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT
                      SELECT l_partkey FROM lineitem WHERE l_quantity > 45),
         wanted AS (SELECT l_partkey FROM returned EXCEPT SELECT p_partkey FROM part WHERE p_size > 40),
         all_keys AS (SELECT 'wanted' AS kind, l_partkey AS k FROM wanted UNION ALL
                      SELECT 'either', k FROM (SELECT l_partkey AS k FROM wanted UNION SELECT p_partkey FROM part WHERE p_size < 5))
    SELECT kind, count(*) AS n, sum(k)::BIGINT AS key_sum FROM all_keys GROUP BY kind""")
guarded("p5_rollup", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)""")
guarded("p6_window_frame", """
    WITH m AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS period,
                      sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, period, round(sum(revenue) OVER (PARTITION BY o_orderstatus ORDER BY period
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
           round(avg(revenue) OVER (PARTITION BY o_orderstatus ORDER BY period
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM m""", """
    WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate)::TIMESTAMP AS period,
                      sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, period, round(sum(revenue) OVER (PARTITION BY o_orderstatus ORDER BY period
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
           round(avg(revenue) OVER (PARTITION BY o_orderstatus ORDER BY period
               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM m""")
guarded("p7_scalar_functions", """
    SELECT upper(substr(event_type, 1, 3)) AS kind, year(ts) AS y, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS half,
           count(*) AS n, sum(coalesce(CAST(get_json_object(props, '$.k') AS BIGINT), 0)) AS k_sum,
           round(sum(abs(value - 10)), 2) AS spread, min(replace(trim(event_type), 'e', '3')) AS coded
    FROM events WHERE length(props) > 3 GROUP BY 1, 2, 3""", """
    SELECT upper(substr(event_type, 1, 3)) AS kind, year(ts)::INTEGER AS y, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS half,
           count(*) AS n, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS k_sum,
           round(sum(abs(value - 10)), 2) AS spread, min(replace(trim(event_type), 'e', '3')) AS coded
    FROM events WHERE length(props) > 3 GROUP BY 1, 2, 3""")
guarded("p8_cte_scalar_subquery", """
    WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
    SELECT c_nationkey, count(*) AS n_above, round(sum(total), 2) AS total FROM spend JOIN customer c ON o_custkey = c_custkey
    WHERE total > (SELECT avg(total) FROM spend)
      AND c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
    GROUP BY c_nationkey""")


@query("k01_catalog_summary", f"""
    SELECT 'shop' AS db, {len(NAMES)}::BIGINT AS n_tables, '{", ".join(sorted(NAMES))}' AS tables, true AS accessible,
           ({" + ".join(f"(SELECT count(*) FROM {n})" for n in NAMES)})::BIGINT AS n_rows""")
def _(spark, d):
    return K.catalog_summary(K.table_sizes({n: table(spark, d, n) for n in NAMES}, "shop"))


PROFILED = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("k02_dataset_profile", " UNION ALL ".join(f"""
    SELECT {i}::INTEGER AS position, '{c}' AS "column", '{t}' AS type,
           (SELECT string_agg({c}::VARCHAR, ', ' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)) AS sample,
           (SELECT count(*) FROM customer) AS n_rows, {len(PROFILED)}::INTEGER AS n_columns""" for i, (c, t) in enumerate(PROFILED)))
def _(spark, d):
    return K.dataset_profile(table(spark, d, "customer"), "c_custkey")


@query("k03_table_preview", """
    SELECT *, (SELECT count(*) FROM orders) AS n_total, (SELECT count(*) > 50 FROM orders) AS truncated
    FROM orders ORDER BY o_orderkey LIMIT 50""")
def _(spark, d):
    return K.table_preview(table(spark, d, "orders"), "o_orderkey")


# One question over tables, for each class


def shop(d):
    return {f"shop.{n}": p for n, p in paths(d).items()}


def written(question: str, schema: str) -> str:
    """Stands for a model: the reply names tables by database, fenced among other words."""
    return "Sure:\n```sql\nSELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM `shop`.`orders` GROUP BY o_orderpriority;\n```\nDone."


@query("ask_tables_display", """
    SELECT *, (SELECT count(*) FROM orders) AS n_total, (SELECT count(*) > 50 FROM orders) AS truncated
    FROM orders ORDER BY o_orderkey LIMIT 50""")
def _(spark, d):
    return ask_tables(spark, "Show me the orders table", shop(d)).rows


@query("ask_tables_schema", f"""
    SELECT 'shop' AS db, 'customer' AS tbl, position::INTEGER AS position, c AS "column", t AS type,
           (SELECT count(*) FROM customer) AS n_rows, n_missing
    FROM ({" UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS c, '{t}' AS t, (SELECT count(*) - count({c}) FROM customer) AS n_missing" for i, (c, t) in enumerate(PROFILED))})""")
def _(spark, d):
    return ask_tables(spark, "What columns does customer have", shop(d)).rows


@query("ask_tables_calculation", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return ask_tables(spark, "Total order value per priority", shop(d), written).rows


ALIASED = """SELECT `o`.`o_orderstatus`, count(*) AS n, max(`c`.`c_name`) AS last -- not from shop.nowhere
    FROM `shop`.`orders` `o` JOIN Shop.Customer AS c ON `o`.`o_custkey` = c.c_custkey WHERE 'see join no.table' <> '' GROUP BY `o`.`o_orderstatus`"""


@query("ask_tables_aliases", "SELECT o_orderstatus, count(*) AS n, max(c_name) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    """Columns behind quoted aliases, names in another case, dotted words in comments and texts."""
    return ask_tables(spark, "How many orders per status", shop(d), lambda question, schema: f"```sql\n{ALIASED}\n```").rows


@query("ask_tables_long_names", "SELECT o_orderpriority, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1")
def _(spark, d):
    """Columns named with their database and table."""
    sql = "SELECT shop.orders.o_orderpriority, CAST(SUM(shop.orders.o_custkey) AS BIGINT) AS keys FROM shop.orders GROUP BY shop.orders.o_orderpriority"
    return ask_tables(spark, "Sum of keys per priority", shop(d), lambda question, schema: sql).rows


def corrects(question: str, schema: str) -> str:
    """A model that names a table that is not there, then a column, and mends what it is told."""
    if "no_such_table" not in question:
        return "SELECT count(*) AS n FROM shop.no_such_table"
    return "SELECT count(*) AS n, max(o_totalprice) AS top FROM shop.orders" if "`no_such_column`" in question else "SELECT no_such_column FROM shop.orders -- no_such_table"


@query("ask_tables_corrected", "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")
def _(spark, d):
    return ask_tables(spark, "How many orders are there", shop(d), corrects).rows


@query("ask_sheet", "SELECT count(*) AS n FROM part")
def _(spark, d):
    """A spreadsheet is one table behind a loader; without a model its rows are counted."""
    return ask_tables(spark, "How many rows are there", {"parts": lambda s: table(s, d, "part")}).rows
