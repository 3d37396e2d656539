"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "askspark") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """New path under the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode, where everything runs on one machine, a
    temporary folder is made if nothing is set; it goes when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="askspark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, "askspark", f"{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that several branches see one and the same table."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Rows over ``tasks`` tasks by ``key``, for work that is heavy per row on a table in few files; by default as they are."""
    return df.repartition(tasks, key) if tasks else df
