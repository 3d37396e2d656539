"""Text functions that are asked again, and late rows of a stream."""

import datetime as dt
import os
import tempfile
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from askspark.functions.prompts import apply_text_fn, apply_text_fn_once
from askspark.session import scratch_path
from askspark.streaming import jobs


def noted(folder, text):
    with open(os.path.join(folder, str(os.getpid())), "a") as f:
        f.write(text + "\n")


def notes(folder):
    return Counter(line for n in os.listdir(folder) for line in open(os.path.join(folder, n)).read().splitlines())


def test_passing_errors_are_tried_again_others_are_not(spark):
    folder = tempfile.mkdtemp()

    def flaky(batch: pd.Series) -> pd.Series:
        for p in batch:
            noted(folder, p)
        tries = notes(folder)
        if any(p == "busy" and tries[p] < 3 for p in batch):
            raise RuntimeError("HTTP 429: rate limit")
        if any(p == "bad" for p in batch):
            raise ValueError("no such thing")
        return batch.str.upper()

    df = spark.createDataFrame([("busy",), ("bad",), ("fine",)], "q string").repartition(3, "q")
    got = {r["q"]: (r["answer"], r["answer_error"]) for r in apply_text_fn(df, "{q}", flaky, wait=0.01).collect()}
    assert got["busy"] == ("BUSY", None) and got["fine"] == ("FINE", None)
    assert got["bad"][0] is None and "no such thing" in got["bad"][1]
    assert notes(folder)["busy"] >= 3


def test_one_attempt_gives_up(spark):
    def never(batch):
        raise RuntimeError("connection lost")

    df = spark.createDataFrame([("a", "x")], "q string, other string")
    row = apply_text_fn(df, "{q}", never, attempts=1, fallback="other").first()
    assert row["answer"] == "x" and "connection lost" in row["answer_error"]


def test_equal_prompts_are_asked_once(spark):
    folder = tempfile.mkdtemp()

    def ask(batch: pd.Series) -> pd.Series:
        for p in batch:
            noted(folder, p)
        if any("crash" in p for p in batch):
            raise ValueError("crash")
        return batch + "!"

    rows = [(i, "same") for i in range(500)] + [(500 + i, f"p{i}") for i in range(20)] + [(900, "crash"), (901, None)]
    df = spark.createDataFrame(rows, "i int, q string").repartition(8)
    got = {r["i"]: (r["answer"], r["answer_error"]) for r in apply_text_fn_once(df, "ask {q}", ask, fallback="q").collect()}
    assert len(got) == len(rows) and all(got[i] == ("ask same!", None) for i in range(500)) and got[505] == ("ask p5!", None) and got[901] == ("ask !", None)
    assert got[900][0] == "crash" and "crash" in got[900][1]
    asked = notes(folder)
    assert set(asked) == {"ask same", "ask crash", "ask ", *(f"ask p{i}" for i in range(20))}
    assert all(n == 1 or p == "ask crash" or n == 2 for p, n in asked.items())  # twice at most, where a batch held the bad one


def test_late_rows_are_counted_and_repeats_change_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    batches = [[("a", day), ("a", day), ("b", day + dt.timedelta(days=10)), (None, None)], [("a", day), ("b", day + dt.timedelta(days=9)), ("c", day + dt.timedelta(days=20))], [("b", day + dt.timedelta(days=10)), (None, day)]]
    source, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, "session_id string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
        jobs.stream_activity_parts(jobs.file_stream(spark, f"{source}/*.parquet", spark.read.parquet(source).schema), out, progress).awaitTermination()
    at = lambda n: day + dt.timedelta(days=n)
    want = {("a", at(0)): (2, 1, True), ("b", at(10)): (1, 1, True), ("b", at(9)): (1, 0, True), ("c", at(20)): (1, 0, False), (None, at(0)): (0, 1, True)}
    read = lambda: {(r["session_id"], r["day"]): (r["n_turns"], r["n_late"], r["closed"]) for r in jobs.read_activity(spark, out).collect()}
    assert read() == want
    # all batches once more from the start, as after a lost checkpoint
    jobs.stream_activity_parts(jobs.file_stream(spark, f"{source}/*.parquet", spark.read.parquet(source).schema, 1), out, scratch_path(spark, "progress")).awaitTermination()
    assert read() == want
    assert jobs.read_activity(spark, out).agg(F.sum(F.col("n_turns") + F.col("n_late"))).first()[0] == 8
