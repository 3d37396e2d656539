"""Incremental jobs: many batches give what one batch job gives, also when a batch is repeated."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from askspark.operators.chunking import chunk_documents, drop_empty_documents
from askspark.operators.conversations import upsert_sessions
from askspark.operators.lexical import term_stats
from askspark.streaming import jobs
from askspark.streaming.session_table import read_session_table, stale_folders, stream_session_table

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def split(df, path, key, parts=3):
    for i in range(parts):
        df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i).coalesce(1).write.parquet(f"{path}/part{i}")
    return f"{path}/*"


def test_chunks(spark, tmp_path):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    source = split(documents, str(tmp_path / "in"), "doc_id")

    def run():
        stream = jobs.file_stream(spark, source, documents.schema, files_per_batch=1)
        jobs.stream_chunks(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()

    run()
    expected = chunk_documents(drop_empty_documents(documents), 500, 50)
    got = jobs.read_batches(spark, str(tmp_path / "out/chunks"))
    assert got.select("batch_id").distinct().count() == 3
    assert rows(got.drop("batch_id")) == rows(expected)
    run()  # nothing new arrived
    # The last batch is lost after its output was written: it runs again and replaces its own output.
    for name in ("2", ".2.crc"):
        (tmp_path / "progress" / "commits" / name).unlink()
    run()
    assert rows(jobs.read_batches(spark, str(tmp_path / "out/chunks")).drop("batch_id")) == rows(expected)
    keyed = expected.withColumn("key", F.concat_ws("#", "doc_id", "chunk_no"))
    assert rows(jobs.read_batches(spark, str(tmp_path / "out/postings")).drop("batch_id")) == rows(term_stats(keyed, "key").postings)


def test_sessions(spark, tmp_path):
    versions = spark.range(60).selectExpr(
        "id % 7 AS session_id", "concat('t', id) AS title", "CAST(NULL AS STRING) AS file_metadata", "concat('c', id) AS created_at",
        "concat('u', id) AS updated_at", "CAST(NULL AS STRING) AS summary", "id AS version")
    # Batches hold early and late versions of the same sessions, in no order.
    source = split(versions, str(tmp_path / "in"), "version")
    stream = jobs.file_stream(spark, source, versions.schema, files_per_batch=1)
    jobs.stream_sessions(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = jobs.current_sessions(spark, str(tmp_path / "out"))
    assert rows(got) == rows(upsert_sessions(versions.drop("version").limit(0), versions))
    assert got.where("session_id = 0").first()["created_at"] == "c0"


def test_activity_drops_late_rows(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    batches = [[(1, day), (1, day), (2, day)], [(1, day + dt.timedelta(days=20))], [(1, day), (2, day + dt.timedelta(days=19))]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "session_id int, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        stream = jobs.file_stream(spark, str(tmp_path / "in/*"), spark.read.parquet(str(tmp_path / "in/p0")).schema)
        jobs.stream_activity(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["session_id"], r["n_turns"]) for r in out.collect()) == [(1, 2), (2, 1)]


def test_compacted_sessions_are_the_recent_ones(spark, tmp_path):
    schema = "session_id int, title string, file_metadata string, created_at string, updated_at string, summary string, version bigint"
    batches = [[(1, "a", None, "2024-01-01", "2024-01-01", "", 1), (2, "b", None, "2024-01-01", "2024-01-29", "", 1)], [(1, "c", None, "x", "2024-01-30", "s", 2), (3, "d", None, "2023-01-01", "2023-01-01", "", 1)], [(1, "e", None, "y", "2024-01-31", "t", 3)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).write.parquet(f"{tmp_path}/out/batch_id={i}")
    jobs.compact_sessions(spark, f"{tmp_path}/out", f"{tmp_path}/into", "2024-01-31", 7)
    whole = jobs.current_sessions(spark, f"{tmp_path}/out").where("session_id <> 3")
    assert rows(jobs.current_sessions(spark, f"{tmp_path}/into")) == rows(whole)
    assert spark.read.parquet(f"{tmp_path}/into").count() == 3


SESSION_VERSIONS = "session_id int, title string, created_at string, version bigint, deleted boolean"


def replayed(batches):
    """Plain form of the session table: batches in turn, each by version."""
    state = {}
    for batch in batches:
        cuts = {}
        for s, _, _, v, gone in batch:
            if gone:
                cuts[s] = max(cuts.get(s, -1), v)
        for s in cuts:
            state.pop(s, None)
        for s, title, created, v, gone in batch:
            if not gone and v > cuts.get(s, -1):
                first, last = state.get(s, ((v, created), (v, title)))
                state[s] = (min(first, (v, created)), max(last, (v, title)))
    return sorted((first[1], s, last[1], last[0]) for s, (first, last) in state.items())


def test_session_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    versions = [(int(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9])), f"t{v}", f"c{v:03d}", int(v), bool(rng.random() < 0.15)) for v in rng.permutation(120)]
    # Each batch knows late and early versions; the last one only deletes, and empties the table of one session.
    batches = [versions[:50], versions[50:60], versions[60:], [(3, None, None, 999, True), (77, None, None, 1, True)]]

    def run(i):
        stream = jobs.file_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/p0").schema)
        stream_session_table(stream, f"{tmp_path}/out", f"{tmp_path}/progress", buckets=4).awaitTermination()
        assert rows(read_session_table(spark, f"{tmp_path}/out")) == replayed(batches[: i + 1])

    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SESSION_VERSIONS).write.parquet(f"{tmp_path}/in/p{i}")
        run(i)
        for name in (str(i), f".{i}.crc"):  # lost after its output was written: the batch runs again
            (tmp_path / "progress" / "commits" / name).unlink()
        run(i)
    table = read_session_table(spark, f"{tmp_path}/out")
    folders = {f.rsplit("/", 2)[0] + "/" + f.rsplit("/", 2)[1] for f in table.inputFiles()}
    assert sum(spark.read.parquet(f).count() for f in folders) == table.count()  # one stored row per session is read
    assert len(folders) <= 4 and stale_folders(spark, f"{tmp_path}/out").count() >= 4


def test_session_table_of_deletions_only(spark, tmp_path):
    spark.createDataFrame([(1, "a", "c", 1, True), (None, "b", "d", None, True)], SESSION_VERSIONS).write.parquet(f"{tmp_path}/in/p0")
    for batch in ([(None, "x", "y", None, None)], [(None, "z", "w", 4, False)]):
        stream = jobs.file_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/p0").schema)
        stream_session_table(stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
        spark.createDataFrame(batch, SESSION_VERSIONS).write.mode("append").parquet(f"{tmp_path}/in/p1")
    assert read_session_table(spark, f"{tmp_path}/out").select("session_id", "title", "created_at").collect() == [(None, "x", "y")]
    stream = jobs.file_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/p0").schema)
    stream_session_table(stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    assert read_session_table(spark, f"{tmp_path}/out").select("session_id", "title", "created_at").collect() == [(None, "z", "y")]
