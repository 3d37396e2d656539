"""Small helpers that the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Made = TypeVar("Made")
#: Rows that a task takes from a batch at a time and gives back together.
ROWS_AT_ONCE = 256
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The word patterns of the contracts.
WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_SPACE = r"[^\x20\x09-\x0D]+"


def only_for(operator: str) -> dict:
    """What this Python worker keeps for ``operator``. What it kept for another one goes, as workers live through the jobs
    of all operators."""
    store = sys.modules.setdefault("askspark_worker_store", types.ModuleType("askspark_worker_store"))
    if getattr(store, "operator", None) != operator:
        store.operator, store.kept = operator, {}
    return store.kept


def per_worker(operator: str, name: str, make: Callable[[], Made]) -> Made:
    """An object built once in each Python worker process and kept for its later tasks of the same operator."""
    kept = only_for(operator)
    if name not in kept:
        kept[name] = make()
    return kept[name]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def md5_number(text: Column, modulus: int) -> Column:
    """A number below ``modulus`` that SQL engines agree on."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulus).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def append_arrow(
    df: DataFrame, begin: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], made: dict[str, str], instead_of: int = 0
) -> DataFrame:
    """``df`` with the columns ``made`` (name: type) at its end, in place of its last ``instead_of`` columns. ``begin`` runs
    once per task and gives the function from a batch to the new arrays. Column names of any kind pass. A batch is worked on
    ``ROWS_AT_ONCE`` rows at a time, so that neither side holds the engine's whole batch a second time."""
    names, at_once = df.columns, ROWS_AT_ONCE
    kept = len(names) - instead_of
    inner = [f"c{i}" for i in range(kept + len(made))]
    kinds = [*(f.dataType for f in df.schema.fields[:kept]), *map(T.DataType.fromDDL, made.values())]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(inner, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = begin()
        for batch in (b.slice(start, at_once) for b in batches for start in range(0, b.num_rows, at_once)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *function(batch)], names=inner)

    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(run, schema).toDF(*names[:kept], *made)
