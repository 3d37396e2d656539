"""Chat jobs, with chats longer than one part and with every branch of the rules."""

import pytest
from pyspark.sql import functions as F

from askspark.operators import conversations as V

LONG = 2500


@pytest.fixture(scope="module")
def messages(spark):
    long = spark.range(LONG).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat(' m', id, ' ') AS text")
    short = spark.createDataFrame([(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(14)], "conv_id bigint, turn bigint, role string, text string")
    tiny = spark.createDataFrame([(3, 0, "user", "x" * 900), (3, 1, "assistant", "  ")], "conv_id bigint, turn bigint, role string, text string")
    return long.unionByName(short).unionByName(tiny)


def test_split(spark, messages):
    old = {r["conv_id"]: r["n"] for r in V.split_for_summary(messages).where("is_old").groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert old == {1: LONG - 6, 2: 8}
    everything = V.split_for_summary(messages, 10, 0)
    assert everything.where("is_old").count() == LONG + 14 and everything.count() == LONG + 16


def test_transcript_parts(spark, messages):
    parts = V.format_transcript(messages.where("conv_id = 1")).orderBy("part").collect()
    assert [r["part"] for r in parts] == [0, 1, 2]
    whole = "\n".join(r["transcript"] for r in parts).split("\n")
    assert whole == [f"[{'USER' if i % 2 == 0 else 'ASSISTANT'}]: m{i}" for i in range(LONG)]
    tiny = V.format_transcript(messages.where("conv_id = 3")).first()["transcript"]
    assert tiny == "[USER]: " + "x" * 800 + "...\n[ASSISTANT]: "


def test_compact(spark, messages):
    previous = spark.createDataFrame([(1, "before"), (2, None), (3, "kept")], "conv_id bigint, summary string")
    out = {r["conv_id"]: r["summary"] for r in V.compact_history(messages, previous).collect()}
    assert out[3] == "kept" and out[2] == "\n".join(f"[{'USER' if i % 2 == 0 else 'ASSISTANT'}]: t{i}" for i in range(8))
    assert out[1].startswith("before\n") and out[1].endswith(f"m{LONG - 7}") and len(out[1]) == V.SUMMARY_CHARS
    full = spark.createDataFrame([(1, "s" * V.SUMMARY_CHARS)], "conv_id bigint, summary string")
    again = V.compact_history(messages, full).first()["summary"]
    assert again.endswith(f"m{LONG - 7}") and len(again) == V.SUMMARY_CHARS and again.startswith("sss")


def test_a_model_sees_every_old_turn_once_and_leaves_one_summary(spark, messages):
    previous = spark.createDataFrame([(1, "before"), (2, None), (3, "kept")], "conv_id bigint, summary string")
    squeeze = lambda before, text: F.concat(before, F.lit("<"), F.regexp_replace(text, r"\[[A-Z]+\]: |\n", ""), F.lit(">"))
    rows = V.compact_history(messages, previous, squeeze, part_turns=100, fan=4).collect()
    out = {r["conv_id"]: r["summary"] for r in rows}
    assert len(rows) == 3 and out[3] == "kept" and out[2] == "<" + "".join(f"t{i}" for i in range(8)) + ">"
    assert out[1].startswith("before<") and out[1].replace("<", "").replace(">", "") == "before" + "".join(f"m{i}" for i in range(LONG - 6))


def test_final_answer(spark):
    rows = [(1, 0, "assistant", "a", False), (1, 1, "assistant", "b", True), (2, 0, "assistant", "c", True), (2, 1, "assistant", " ", False),
            (3, 0, "user", "d", False), (4, 0, "assistant", " e\n", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, has_tool_calls boolean")
    assert {r[0]: r[1] for r in V.final_answer(df).collect()} == {1: "a", 2: "c", 3: V.NO_ANSWER, 4: "e"}


def test_titles(spark):
    messages = spark.createDataFrame([(1, 1, "user", "second"), (1, 0, "user", "a first question, long"), (2, 0, "assistant", "hi")], "conv_id int, turn int, role string, text string")
    sessions = spark.createDataFrame([(1, "New Session", None), (2, "New Session", None), (3, "New Session", "report_of_the_year.pdf"), (4, "Mine", "f.pdf")], "conv_id int, title string, file_metadata string")
    assert {r["conv_id"]: r["title"] for r in V.derive_titles(messages, sessions).collect()} == {1: "a first question, ", 2: "New Session", 3: "report_of_the_year", 4: "Mine"}


def test_upsert(spark):
    schema = "session_id int, title string, file_metadata string, created_at string, updated_at string, summary string"
    current = spark.createDataFrame([(1, "old", None, "2024-01-01", "2024-01-30", "s"), (2, "stale", None, "2023-01-01", "2023-01-02", "s"), (3, "odd", None, "x", "unreadable", None)], schema)
    updates = spark.createDataFrame([(1, "v1", None, "2024-02-01", "2024-02-01", None, 1), (1, "v2", None, "2024-02-02", "2024-02-02", None, 2), (2, "again", None, "2024-02-03", "2024-02-03", "t", 1)], schema + ", version bigint")
    out = V.upsert_sessions(current, updates, "2024-01-31", 7)
    rows = {r["session_id"]: r for r in out.collect()}
    assert (rows[1]["title"], rows[1]["created_at"], rows[1]["summary"]) == ("v2", "2024-01-01", "")
    assert rows[2]["created_at"] == "2024-02-03" and rows[3]["title"] == "odd"
    again = V.upsert_sessions(out, updates)
    assert sorted(map(tuple, again.select(out.columns).collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_export(spark, messages):
    sessions = spark.createDataFrame([(1, "Long", "sum"), (3, "Tiny", "")], "conv_id bigint, title string, summary string")
    parts = V.export_markdown(messages.where("conv_id IN (1, 3)"), sessions, "2024-01-31 00:00:00").orderBy("conv_id", "part").collect()
    assert [(r["conv_id"], r["part"]) for r in parts] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    text = "".join(r["markdown"] for r in parts[:3])
    assert text.startswith("# 💬 Long\n\n**Exported**: 2024-01-31 00:00:00\n\n## 📝 Conversation Summary\n\nsum\n\n---\n\n## Full Conversation\n\n### 👤 USER\n\nm0\n\n---\n\n### 🤖 ASSISTANT\n\nm1")
    assert text.count("### ") == LONG and "Summary" not in parts[3]["markdown"]


def test_prepare(spark):
    df = spark.createDataFrame([("system", "s"), ("user", "u" * 200_001), ("assistant", "a" * 300_000)], "role string, text string")
    assert [(r["role"], r["too_long"], len(r["preview"])) for r in V.prepare_turns(df).collect()] == [("user", True, 120), ("assistant", False, 120)]
