"""A session table fed by batches of versions: a read costs one row per session, whatever the number of batches.

Sessions lie in hash buckets. A batch rewrites the buckets it touches, under its own id, and leaves the others alone; a list
of buckets per batch tells which folder is the newest of its bucket. Nothing is changed in place, so a batch that is repeated
after a failure replaces its own output, and a reader sees whole batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
OLDEST = -(2**63)
LIST = "bucket int, n bigint, batch_id bigint"


def stream_session_table(source: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Versions (session_id, created_at, ..., version, deleted) to a session table at ``out``; ``read_session_table`` reads it.

    The newest version of a session wins and its first ``created_at`` is kept. A version with ``deleted`` removes what came in
    earlier batches and what its own batch has up to that version; later versions start anew. Equal versions: the later batch
    wins, inside a batch the greater row. Rows without a version are the oldest, rows without a session id are one session.
    A bucket is rewritten by one task: choose ``buckets`` so that one holds what a task can write, and keep it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, out, buckets)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_session_table(spark: SparkSession, out: str) -> DataFrame:
    """Sessions that are not deleted, with the ``version`` they have."""
    state = _read(spark, out, [(r["batch_id"], r["bucket"]) for r in _newest(spark, out).where("n > 0").collect()])
    return state.drop("first_version", "batch_id", "bucket")


def stale_folders(spark: SparkSession, out: str) -> DataFrame:
    """Folders (batch_id, bucket) that no read needs any more; delete them when no reader is older than the newest batch."""
    newest = _newest(spark, out).select("bucket", "batch_id")
    return _lists(spark, out).where("n > 0").select("bucket", "batch_id").join(newest, ["bucket", "batch_id"], "left_anti")


def _lists(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LIST).parquet(f"{out}/lists")


def _newest(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """One row per bucket: the batch that wrote it last and the number of its sessions."""
    lists = _lists(spark, out) if before is None else _lists(spark, out).where(F.col("batch_id") < before)
    return lists.groupBy("bucket").agg(F.max_by("n", "batch_id").alias("n"), F.max("batch_id").alias("batch_id"))


def _read(spark: SparkSession, out: str, folders: list[tuple[int, int]]) -> DataFrame:
    """The given folders, at most one per bucket; no other folder is listed or read."""
    empty = spark.read.parquet(f"{out}/empty")
    paths = [f"{out}/rows/batch_id={batch_id}/bucket={bucket}" for batch_id, bucket in folders]
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def _write_batch(batch: DataFrame, batch_id: int, out: str, buckets: int) -> None:
    spark = batch.sparkSession
    body = [c for c in batch.columns if c not in ("session_id", "created_at", "version", "deleted")]
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    versions = batch.withColumns({
        "version": F.coalesce(F.col("version").cast("bigint"), F.lit(OLDEST)),
        "deleted": F.coalesce("deleted", F.lit(False)),
    })
    # Deletions are few rows; what they cut is joined to them, so that a session with most of the batch is no window.
    cuts = versions.where("deleted").groupBy(F.col("session_id").alias("__id")).agg(F.max("version").alias("__cut"))
    same = F.col("session_id").eqNullSafe(F.col("__id"))
    live = versions.where("NOT deleted").join(cuts, same, "left").where("__cut IS NULL OR version > __cut")
    row = F.struct(*body)
    new = live.groupBy("session_id").agg(
        F.max_by(row, F.struct("version", row)).alias("last"),
        F.max("version").alias("version"),
        F.min_by("created_at", F.struct("version", "created_at")).alias("created_at"),
        F.min("version").alias("first_version"),
    ).select("session_id", "created_at", *[f"last.{c}" for c in body], "version", "first_version")
    if not batch_id:
        new.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{out}/empty")

    touched = versions.select(bucket.alias("bucket")).distinct()
    known = {r["bucket"] for r in touched.collect()}  # at most one row per bucket
    older = _newest(spark, out, batch_id).where("n > 0").collect() if batch_id else []
    state = _read(spark, out, [(r["batch_id"], r["bucket"]) for r in older if r["bucket"] in known])
    kept = state.select(*new.columns).join(cuts, same, "left_anti").withColumn("__new", F.lit(0))
    both = kept.unionByName(new.withColumn("__new", F.lit(1))).withColumn("bucket", bucket)
    merged = both.repartition("bucket").groupBy("bucket", "session_id").agg(
        F.max_by(row, F.struct("version", "__new")).alias("last"),
        F.max("version").alias("version"),
        F.min_by("created_at", F.struct("first_version", "__new")).alias("created_at"),
        F.min("first_version").alias("first_version"),
    )
    rows = f"{out}/rows/batch_id={batch_id}"
    columns = ["session_id", "created_at", *[f"last.{c}" for c in body], "version", "first_version"]
    merged.select(*columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(rows)
    # The list comes last: a batch counts when its rows are all there. Buckets that deletions emptied are listed with none.
    sizes = spark.read.schema("bucket int").parquet(rows).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    listed = spark.createDataFrame([(b,) for b in sorted(known)], "bucket int")
    listed.join(sizes, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{out}/lists/batch_id={batch_id}")
