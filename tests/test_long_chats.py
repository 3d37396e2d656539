"""Chats of most of a table: no task gathers one."""

from workload import text_logs

SF_DIR = "/root/testdata/sf0.001"


def test_long_chats_are_numbered_without_gathering_them(spark):
    rows = text_logs.glued(spark, SF_DIR)
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple").replace("L", "")
    for line in plan.split("\n"):
        if "Window" in line and "text" in line:
            assert "windowspecdefinition(conv_id#" in line, line
    assert rows.groupBy("conv_id").agg({"turn": "max", "*": "count"}).where("`max(turn)` <> `count(1)` - 1").count() == 0
