"""Exact top k of every query over a whole corpus, without pairing all rows in a shuffle.

Each task scores its part of the corpus against a block of queries and keeps the best k per query, as an aggregate does
before its shuffle. At most k rows per query and task are shuffled, whatever share of the corpus a term or a copied text
holds, and nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SHARED_BYTES = 64 << 20  # queries sent to every task; above it queries are shuffled in blocks of this size
SLICE_BYTES = 256 << 20  # corpus per group when queries are shuffled
SCORES_AT_ONCE = 500_000
ROWS_AT_ONCE = 1024
SCORE_DIGITS = 9  # scores closer than this tie, and ties go to the smaller key


def _best(prepare: Callable, k: int, largest: bool) -> Callable:
    """Task body: (queries, batches of corpus) to one table with the best k rows per query."""
    at_once, most_rows, digits = SCORES_AT_ONCE, ROWS_AT_ONCE, SCORE_DIGITS
    sign = 1.0 if largest else -1.0

    def run(queries: pa.Table, batches: Iterator) -> pa.Table:
        ids, score = prepare(queries)
        step = max(1, min(most_rows, at_once // max(1, len(ids))))  # bounds scores and the rows' own tokens or numbers
        floor = np.full(len(ids), -np.inf)  # score of the k-th best so far
        held: tuple | None = None
        for batch in batches:
            for offset in range(0, batch.num_rows, step):
                part = batch.slice(offset, step)
                # query x row; -inf where nothing matches
                found = np.round(sign * score(part), digits)
                found[np.isnan(found)] = -np.inf
                if found.shape[1] > k:
                    bar = np.maximum(floor, np.partition(found, -k, axis=1)[:, -k])
                else:
                    bar = floor
                q, row = np.nonzero((found >= bar[:, None]) & np.isfinite(found))
                if not len(q):
                    continue
                keys = part.column("key").take(pa.array(row)).to_numpy(zero_copy_only=False)
                if keys.dtype == object:
                    keys = keys.astype(str)
                new = (q, found[q, row], keys)
                q, s, keys = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
                order = np.lexsort((keys, -s, q))
                q, s, keys = q[order], s[order], keys[order]
                first = np.searchsorted(q, q, "left")
                top = np.arange(len(q)) - first < k
                held = (q[top], s[top], keys[top])
                size = np.bincount(held[0], minlength=len(ids))
                last = np.cumsum(size) - 1
                full = size == k
                floor[full] = held[1][last[full]]
        if held is None:
            held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        return ids, held

    def table(queries: pa.Table, batches: Iterator, schema: pa.Schema) -> pa.Table:
        if not queries.num_rows:
            return schema.empty_table()
        ids, (q, s, keys) = run(queries, batches)
        return pa.table(
            [ids.take(pa.array(q)), pa.array(keys).cast(schema.field(1).type), pa.array(sign * s, pa.float64())],
            schema=schema,
        )

    return table


def table_bytes(df: DataFrame) -> int:
    """About what the rows take in memory: bytes of text, eight for each number."""

    def size(name: str, kind: T.DataType):
        c = F.col(name)
        if isinstance(kind, T.ArrayType):
            text = isinstance(kind.elementType, T.StringType)
            return F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16) if text else F.size(c) * 8
        return F.octet_length(c) + 16 if isinstance(kind, T.StringType | T.BinaryType) else F.lit(8)

    row = sum((F.greatest(F.coalesce(size(f.name, f.dataType), F.lit(0)), F.lit(0)) for f in df.schema), F.lit(16))
    return int(df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0])


def top_k_join(
    corpus: DataFrame,
    queries: DataFrame,
    prepare: Callable,
    k: int,
    largest: bool,
    max_shared_bytes: int | None = None,
    slice_bytes: int | None = None,
) -> DataFrame:
    """(qid, key, score, rank) of the best ``k`` corpus rows per query.

    ``corpus`` has a column ``key``, ``queries`` a column ``qid`` and one or more rows per query. ``prepare(queries)``
    runs in tasks and gives the query ids and a function that scores a batch of the corpus. Query tables of up to
    ``max_shared_bytes`` are sent to every task and the corpus is not shuffled. Larger ones are cut into blocks of about that
    size that meet every slice of the corpus, of about ``slice_bytes``, in bounded groups. The rows are the same either way.
    """
    limit = max_shared_bytes or MAX_SHARED_BYTES
    spark = corpus.sparkSession
    qid, key = queries.schema["qid"].dataType.simpleString(), corpus.schema["key"].dataType.simpleString()
    out = f"qid {qid}, key {key}, score double"
    arrow = pa.schema([("qid", _arrow_type(qid)), ("key", _arrow_type(key)), ("score", pa.float64())])
    best = _best(prepare, k, largest)
    size = table_bytes(queries)
    if size <= limit:
        shared = spark.sparkContext.broadcast(queries.toArrow())

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from best(shared.value, batches, arrow).to_batches()

        local = corpus.mapInArrow(task, out)
    else:
        blocks = math.ceil(size / limit)
        slices = max(1, math.ceil(table_bytes(corpus) / (slice_bytes or SLICE_BYTES)))
        q = queries.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn(
            "__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))
        )
        c = corpus.withColumn("__slice", F.pmod(F.xxhash64("key"), F.lit(slices))).withColumn(
            "__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
        )

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            return best(left, right.to_batches(), arrow)

        local = q.groupBy("__block", "__slice").cogroup(c.groupBy("__block", "__slice")).applyInArrow(meet, out)
    by_score = F.col("score").desc() if largest else F.col("score").asc()
    place = Window.partitionBy("qid").orderBy(by_score, "key")
    return local.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _arrow_type(name: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if name not in kinds:
        raise TypeError(f"ids and keys must be int, bigint or string, not {name}")
    return kinds[name]
