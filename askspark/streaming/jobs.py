"""Incremental forms of ingest, session upkeep and activity counts.

All jobs read new files once (``availableNow``), keep their progress in a checkpoint, and write so that a batch that is
repeated after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from askspark.operators.chunking import chunk_documents, drop_empty_documents
from askspark.operators.conversations import retain_recent, upsert_sessions
from askspark.operators.lexical import TermIndex, index_of_tokens, split_words
from askspark.operators.segments import add_batch, open_index


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files at ``path`` (a folder or a pattern)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def stream_chunks(
    source: DataFrame, out: str, checkpoint: str, size: int = 500, overlap: int = 50, tasks: int | None = None
) -> StreamingQuery:
    """New documents (doc_id, text) to chunks, their tokens and postings, appended under ``out``/chunks, /tokens and /postings.

    ``load_stream_index`` reads them for a search. A document arrives once, so its postings are complete within its batch.
    They lie in runs, each sorted by term: one run for each Arrow batch of chunks, so no task sorts or spills all it has. Give
    ``tasks`` when batches come in fewer files than there are cores.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        path = _batch_folder(f"{out}/chunks", batch_id)
        documents = drop_empty_documents(batch.select("doc_id", "text"))
        documents = documents.repartition(tasks, "doc_id") if tasks else documents
        chunk_documents(documents, size, overlap).write.mode("overwrite").parquet(path)
        chunks = batch.sparkSession.read.parquet(path)
        keyed = chunks.withColumn("key", F.concat_ws("#", "doc_id", "chunk_no"))
        tokens = _batch_folder(f"{out}/tokens", batch_id)
        split_words(keyed, "key").write.mode("overwrite").parquet(tokens)
        index = index_of_tokens(batch.sparkSession.read.parquet(tokens))
        index.postings.write.mode("overwrite").parquet(_batch_folder(f"{out}/postings", batch_id))

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_stream_index(spark: SparkSession, out: str) -> TermIndex:
    """Keyword index over all batches that ``stream_chunks`` wrote. Counts per term and the mean length are sums over the
    postings and the chunks, so a new batch changes nothing that is stored."""
    chunks, postings = (spark.read.parquet(f"{out}/{name}").drop("batch_id") for name in ("tokens", "postings"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return index_of_tokens(chunks)._replace(postings=postings, terms=terms, stored=True)


def stream_segments(source: DataFrame, path: str, checkpoint: str, size: int = 500, overlap: int = 50) -> StreamingQuery:
    """Documents (doc_id, text) to a segment index at ``path``, one segment a batch.

    A document that arrives again replaces what was there; one whose text is null or blank is deleted. Within a batch a
    document comes once. A repeated batch changes nothing. ``segments.block_max_top_k`` searches the index.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        documents = batch.select("doc_id", "text")
        chunks = chunk_documents(drop_empty_documents(documents), size, overlap)
        keyed = chunks.select(F.col("doc_id").alias("document"), F.concat_ws("#", "doc_id", "chunk_no").alias("key"), "text")
        add_batch(open_index(batch.sparkSession, path), keyed, documents.select(F.col("doc_id").alias("document")), batch_id)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_sessions(spark: SparkSession, out: str, into: str, as_of: str, days: int) -> None:
    """Write the versions under ``out`` that still matter to ``into``, where later batches may go on: per session the first
    and the last, and only of sessions updated within ``days`` before ``as_of`` or without a readable time."""
    versions = spark.read.parquet(out).drop("batch_id")
    recent = retain_recent(current_sessions(spark, out), as_of, days).select("session_id")
    _ends(versions.join(recent, "session_id", "left_semi")).write.parquet(_batch_folder(into, -1))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What the batches under ``path`` wrote, with their ``batch_id``."""
    return spark.read.parquet(path)


def _ends(versions: DataFrame) -> DataFrame:
    """First and last version of each session."""
    row = F.struct(*[c for c in versions.columns if c != "session_id"])
    ends = versions.groupBy("session_id").agg(F.array(F.min_by(row, "version"), F.max_by(row, "version")).alias("ends"))
    return ends.select("session_id", F.explode(F.array_distinct("ends")).alias("s")).select("session_id", "s.*")


def stream_sessions(source: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Session versions (session_id, ..., version) to a session table; ``current_sessions`` reads it.

    Each batch is reduced to the first and the last version per session and written under its own id. Versions are merged when read, so no batch
    rewrites the table and a repeated batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _ends(batch).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_sessions(spark: SparkSession, out: str) -> DataFrame:
    """Newest version of every session written by ``stream_sessions``."""
    versions = spark.read.parquet(out).drop("batch_id")
    none = versions.drop("version").limit(0)
    return upsert_sessions(none, versions)


def stream_activity(source: DataFrame, out: str, checkpoint: str, ts: str = "ts", key: str = "session_id", days: int = 7) -> StreamingQuery:
    """Turns per key and day of event time, to Parquet at ``out``.

    A day is written once it ended more than ``days`` before the newest event; later rows for it are dropped.
    """
    stamped = source.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", f"{int(days)} days")
    counted = stamped.groupBy(F.window("__ts", "1 day"), key).agg(F.count(F.lit(1)).alias("n_turns"))
    rows = counted.select(key, F.col("window.start").cast("timestamp_ntz").alias("day"), "n_turns")
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(availableNow=True).start()
    )


def stream_activity_parts(source: DataFrame, out: str, checkpoint: str, ts: str = "ts", key: str = "session_id", days: int = 7) -> StreamingQuery:
    """Turns per key and day of event time, on time and late ones apart.

    A row is late where its day ended more than ``days`` before the newest event of the batches before its own. Every batch
    writes its counts and its newest event under its own id, so a repeated batch replaces itself; ``read_activity`` adds
    them up. Rows without a time belong to no day and are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = batch.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at")).where("at IS NOT NULL")
        newest = None
        if batch_id:
            earlier = spark.read.schema("newest timestamp, batch_id long").parquet(f"{out}/newest").where(F.col("batch_id") < batch_id)
            newest = earlier.agg(F.max("newest")).first()[0]
        day = F.date_trunc("day", "at")
        closed = F.lit(False) if newest is None else day + F.expr("INTERVAL 1 DAY") <= F.lit(newest) - F.make_interval(days=F.lit(int(days)))
        counts = stamped.groupBy("key", day.cast("timestamp_ntz").alias("day"), closed.alias("late")).agg(F.count(F.lit(1)).alias("n_turns"))
        counts.write.mode("overwrite").parquet(_batch_folder(f"{out}/counts", batch_id))
        stamped.agg(F.max("at").alias("newest")).write.mode("overwrite").parquet(_batch_folder(f"{out}/newest", batch_id))

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_activity(spark: SparkSession, out: str, key: str = "session_id", days: int = 7) -> DataFrame:
    """(``key``, day, n_turns, n_late, closed) over all batches of ``stream_activity_parts``: the turns of a day that came on
    time and late, and whether later ones would be late. ``n_turns`` of a closed day does not change any more."""
    newest = spark.read.parquet(f"{out}/newest").agg(F.max("newest")).scalar()
    counts = spark.read.parquet(f"{out}/counts").groupBy("key", "day")
    sums = counts.agg(*(F.coalesce(F.sum(F.when(F.col("late") == late, F.col("n_turns"))), F.lit(0)).alias(n) for n, late in (("n_turns", False), ("n_late", True))))
    closed = F.col("day").cast("timestamp") + F.expr("INTERVAL 1 DAY") <= newest - F.make_interval(days=F.lit(int(days)))
    return sums.select(F.col("key").alias(key), "day", "n_turns", "n_late", closed.alias("closed"))
