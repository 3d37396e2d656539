import base64
import json
import random

import pytest

from askspark.functions.prompts import apply_text_fn
from askspark.operators import catalog as K
from askspark.sources import database, files, sessions
from workload import registry


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("première ligne\nfin".encode() + b"\xff\xfe!")
    (tmp_path / "blank.txt").write_text(" \n\t ")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("b")
    rows = {r["source"].rsplit("/", 1)[1]: r for r in files.read_text_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "première ligne\nfin!" and rows["b.txt"]["page"] == 1 and len(rows) == 2


def test_images_and_manifest(spark, tmp_path):
    for name in ("a.PNG", "b.jpg", "c.webp", "d.bin", "e.gif", "f.pdf", "g.csv", "noext"):
        (tmp_path / name).write_bytes(name.encode())
    images = {r["path"].rsplit("/", 1)[1]: r for r in files.load_images(spark, str(tmp_path)).collect()}
    assert images["a.PNG"]["mime"] == "image/png" and images["c.webp"]["mime"] == "image/webp" and images["d.bin"]["mime"] == "image/jpeg"
    assert base64.b64decode(images["b.jpg"]["payload"]) == b"b.jpg"
    manifest = {r["path"].rsplit("/", 1)[1]: r for r in files.attachment_manifest(spark, str(tmp_path), max_mb=5 / 1024 / 1024).collect()}
    assert manifest["f.pdf"]["handler"] == "document" and manifest["g.csv"]["handler"] == "dataset" and manifest["a.PNG"]["handler"] == "image"
    assert manifest["d.bin"]["reason"] == "Extension '.bin' not supported." and manifest["noext"]["handler"] == "unsupported"
    assert not manifest["a.PNG"]["over_limit"] and manifest["c.webp"]["over_limit"] and manifest["c.webp"]["reason"].startswith("File too large")


def test_manifest_reads_no_bytes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    df = files.attachment_manifest(spark, str(tmp_path))
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_history_file(spark, tmp_path):
    (tmp_path / "h.json").write_text('{\n "s1": {"title": "T", "created_at": "2024-01-01T00:00:00", "messages": [{"role": "user", "content": "hé"}, {"role": "assistant", "content": "yo"}]},\n "s2": {"title": "U", "messages": []}\n}')
    read = sessions.read_sessions(spark, str(tmp_path / "h.json"))
    assert {r["session_id"]: r["title"] for r in read.collect()} == {"s1": "T", "s2": "U"}
    assert [(r["turn"], r["content"]) for r in sessions.session_messages(read).orderBy("turn").collect()] == [(0, "hé"), (1, "yo")]
    (tmp_path / "bad.json").write_text('{"s1": {"title"')
    assert sessions.read_sessions(spark, str(tmp_path / "bad.json")).count() == 0


def test_long_session_is_written_in_parts(spark, tmp_path):
    heads = spark.createDataFrame([(7, "T", None, "c", "u", "")], "session_id int, title string, file_metadata string, created_at string, updated_at string, summary string")
    turns = spark.range(2100).selectExpr("7 AS session_id", "id AS turn", "'user' AS role", "concat('m', id) AS content")
    sessions.write_sessions(heads, turns, str(tmp_path / "out"))
    read = sessions.read_sessions(spark, str(tmp_path / "out"), whole_files=False)
    assert read.count() == 3
    assert [(r["turn"], r["content"]) for r in sessions.session_messages(read).orderBy("turn").collect()] == [(i, f"m{i}") for i in range(2100)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,day\n1,x,2024-01-01\n2,,2024-01-02\n")
    assert dict(files.read_delimited(spark, str(tmp_path / "a.csv")).dtypes) == {"id": "int", "name": "string", "day": "date"}
    assert files.read_delimited(spark, str(tmp_path / "a.csv"), "id bigint, name string, day string").dtypes[2] == ("day", "string")


def test_jdbc_options():
    assert database.jdbc_options("jdbc:x", "t") == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000"}
    split = database.jdbc_options("jdbc:x", "t", database.Bounds("id", "0", "100", 8), user="u")
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8" and split["user"] == "u"


def test_catalog(spark):
    spark.range(3).createOrReplaceTempView("some_view")
    listed = K.list_catalog(spark)
    row = K.catalog_summary(listed).where("db = 'default'").first()
    assert row["accessible"] and "some_view" in row["tables"]
    broken = spark.createDataFrame([("a", K.NOT_LISTED), ("sys", "t"), ("b", None), ("c", "t2"), ("c", "t1")], "db string, tbl string")
    out = {r["db"]: (r["n_tables"], r["tables"], r["accessible"]) for r in K.catalog_summary(broken).collect()}
    assert out == {"a": (0, "", False), "b": (0, "", True), "c": (2, "t1, t2", True)}
    spark.catalog.dropTempView("some_view")


def test_text_function(spark):
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, "boom"), (3, None)], "id int, q string").coalesce(1)

    def fn(batch):
        if batch.str.contains("boom").any():
            raise RuntimeError("model failed")
        return batch.str.upper()

    rows = {r["id"]: r for r in apply_text_fn(df, "Q: {q}!", fn, fallback="q").collect()}
    assert rows[1]["answer"] == "Q: ONE. TWO. THREE.!" and rows[1]["answer_error"] is None
    assert rows[2]["answer"] == "boom" and "model failed" in rows[2]["answer_error"] and rows[3]["answer"] == "Q: !"
    silent = apply_text_fn(df, "{q}").orderBy("id").first()
    assert silent["answer"] is None and silent["answer_error"] is None
    with pytest.raises(ValueError):
        apply_text_fn(df, "{nope}")


def tricky(rng, n):
    text = lambda: "".join(rng.choice(['{', '}', '"', '\\', ',', 'é', '\n', 'a', ' ']) for _ in range(rng.randint(0, 12)))
    return {f"{i}{text()}": {"title": text(), "summary": text(), "messages": [{"role": "user", "content": text()} for _ in range(rng.randint(0, 4))]} for i in range(n)}


def test_history_files_are_read_in_blocks(spark, tmp_path):
    rng = random.Random(4)
    files_of = {"one.json": (tricky(rng, 40), None), "two.json": (tricky(rng, 60), 2), "none.json": ({}, None)}
    for name, (history, indent) in files_of.items():
        (tmp_path / name).write_text(json.dumps(history, indent=indent, ensure_ascii=False))
    (tmp_path / "blank.json").write_text(" \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = sessions.read_history(spark, str(tmp_path))
        got = {r["session_id"]: (r["title"], r["summary"], [m["content"] for m in r["messages"]]) for r in read.sessions.collect()}
        blocks = spark.read.option("lineSep", "}").text(str(tmp_path / "two.json")).select("_metadata.file_block_start").distinct().count()
        assert read.broken.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = {k: (v["title"], v["summary"], [m["content"] for m in v["messages"]]) for h, _ in files_of.values() for k, v in h.items()}
    assert got == expected and blocks > 10


def test_broken_history_is_counted(spark, tmp_path):
    whole = {"a": {"title": "x", "messages": []}, "b": {"title": "y", "messages": []}}
    cases = {
        "cut": (json.dumps(whole)[:-12], ["a"], 2),  # b is cut off, and the object never ends
        "open": (json.dumps(whole)[:-1], ["a", "b"], 1),
        "number": ('{"a": {"title": "x"}, "n": 5, "b": {"title": "y"}}', ["a"], 1),
        "text": ("no json at all", [], 2),
        "colon": ('{"a": {"title" "x"}, "b": {"title": "y"}}', ["b"], 1),
    }
    for name, (text, ids, broken) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "h.json").write_text(text)
        read = sessions.read_history(spark, str(tmp_path / name))
        assert (sorted(r["session_id"] for r in read.sessions.collect()), read.broken.count()) == (ids, broken), name


def test_attachments_stay_below_the_limit_at_any_size(spark, tmp_path):
    """70 MB of texts in one partition and a text of 20 MB are written as files that may be attached."""
    texts = spark.range(0, 70_000, 1, 1).selectExpr("id AS doc_id", "repeat('x', IF(id = 7, 20000000, 1000)) AS text")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("SELECT 1L AS doc_id, 2 AS quality, true AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [r for r in registry.QUERIES["s06_attachment_manifest"](spark, str(tmp_path)).collect() if r["extension"] == ".txt"]
    assert [(r["reason"], r["n_bytes"]) for r in rows] == [(None, 69_999 * 1001 + 20_000_001)]
