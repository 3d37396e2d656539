"""What a Python worker holds is bounded by the operator that uses it and by the rows that it takes at a time."""

import pyarrow as pa

from askspark.llm import common


def test_a_worker_keeps_the_objects_of_one_operator():
    made = []
    make = lambda: made.append(1) or [1]
    first = common.per_worker("one", "x", make)
    common.per_worker("one", "y", make)
    assert common.per_worker("one", "x", make) is first and len(made) == 2
    common.per_worker("two", "x", make)
    assert list(common.only_for("two")) == ["x"]
    assert common.only_for("quality") == {}


def test_appended_columns_are_made_a_few_rows_at_a_time(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 50) AS text")

    def begin():
        return lambda batch: [pa.array([batch.num_rows] * batch.num_rows, pa.int64())]

    got = common.append_arrow(rows, begin, {"n": "long"}, instead_of=1)
    assert got.columns == ["id", "n"]
    assert sorted(r["id"] for r in got.collect()) == list(range(3000))
    assert got.agg({"n": "max"}).first()[0] <= common.ROWS_AT_ONCE
