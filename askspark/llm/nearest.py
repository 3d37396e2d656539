"""Nearest neighbours by cosine: neighbours on several shifted Hilbert curves, then an exact check.

Unit vectors are projected to a few dimensions, turned and shifted anew for each curve, and range-partitioned by their
place on the curve. Vectors near each other on a curve are near in space, so a window around a query on each curve gives
candidates, which are merged and ranked by their true cosine. The worst of them bounds what the exact check has to look
at: blocks of vectors, in the order of the first curve, whose cone of directions cannot reach a query's bound are passed
over for that query, and the rest is compared. On vectors with little structure the windows alone find few of the true
neighbours; the check makes the result exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askspark.llm.common import shuffle_parts
from askspark.session import cut_lineage

#: Vectors and (about) queries that one group of the exact check holds.
SLICE_ROWS = 32_768
QUERY_BLOCK = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2 ** ``bits``; columns times bits at most 63."""
    x = [c.astype(np.int64) for c in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Key of each unit vector on one curve: a random orthonormal projection of its own and a random shift of the grid."""
    rng = np.random.default_rng([seed, curve])
    width = min(dims, unit.shape[1])
    basis, _ = np.linalg.qr(rng.normal(size=(unit.shape[1], width)))
    shifted = (unit @ basis + 1 + rng.random(width)) / 3
    return hilbert_keys(np.clip((shifted * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision, summed from the first component to the last; scaling by powers of two changes no digit."""
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))
    total = lambda x: float(np.cumsum(x)[-1])
    return max(-1.0, min(1.0, total(a * b) / float(np.sqrt(total(a * a) * total(b * b)))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: ``first`` (smallest id), ``ids`` (its k + 1 smallest) and ``asks`` (any of its rows is a
    query). Ids are cut to k + 1 in each batch, then per salted part, then per vector, so copies never gather."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = batch.column("id").to_pylist(), batch.column("asks").to_pylist()
            found: dict[bytes, list] = {}
            for i, q, v in zip(ids, asks, batch.column("v").to_pylist()):
                own = found.setdefault((np.array(v, np.float64) + 0.0).tobytes(), [[], False])
                own[0].append(i)
                own[1] |= q
            lists = [sorted(set(x[0]))[: k + 1] for x in found.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array([x[1] for x in found.values()], pa.bool_())],
                names=["vec", "ids", "asks"],
            )

    packed = rows.select("id", "asks", "v").mapInArrow(pack, "vec binary, ids array<long>, asks boolean")
    least = lambda: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    for keys in ([F.col("vec"), F.pmod(F.element_at("ids", 1), F.lit(64)).alias("part")], [F.col("vec")]):
        packed = packed.groupBy(*keys).agg(least(), F.max("asks").alias("asks"))
    return packed.select(F.element_at("ids", 1).alias("first"), "ids", "asks", "vec")


HIT = "q long, first long, ids array<long>, score double"


def hits(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["q", "first", "ids", "score"])


def window_hits(vectors: DataFrame, k: int, curves: int, dims: int, bits: int, window: int, seed: int) -> DataFrame:
    """For each query and curve the k + 1 best of the ``window`` vectors on either side in the same range partition."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(matrix(batch.column("vec")))
            for c in range(curves):
                keys = pa.array(curve_keys(unit, c, dims, bits, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), keys, *batch.columns], names=["curve", "key", *batch.schema.names])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(rows: list[tuple], start: int, end: int) -> pa.RecordBatch:
            raw = np.array([np.frombuffer(r[4], np.float64) for r in rows])
            unit, out = unit_rows(raw), []
            for p in range(start, end):
                if rows[p][3]:
                    low = max(0, p - window)
                    score = unit[low : p + window + 1] @ unit[p]
                    for j in np.argsort(-score, kind="stable")[: k + 4] + low:
                        out.append((rows[p][1], rows[j][1], rows[j][2], exact_cosine(raw[p], raw[j])))
            return hits(out)

        kept: list[tuple] = []
        done = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("curve", "first", "ids", "asks", "vec"))):
                if kept and kept[-1][0] != row[0]:
                    yield search(kept, done, len(kept))
                    kept, done = [], 0
                kept.append(row)
                if len(kept) >= 4096 + 2 * window:
                    yield search(kept, done, len(kept) - window)
                    kept, done = kept[-2 * window :], window
        if kept:
            yield search(kept, done, len(kept))

    placed = vectors.select("first", "ids", "asks", "vec").mapInArrow(place, "curve int, key long, first long, ids array<long>, asks boolean, vec binary")
    ordered = placed.repartitionByRange(shuffle_parts(vectors), "curve", "key", "first").sortWithinPartitions("curve", "key", "first")
    return ordered.mapInArrow(look, HIT)


def check_hits(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of all vectors, those that reach a query's bound, at most the best k + 4 per query and slice.

    ``queries`` has q, vec and bound; ``vectors`` a column ``slice`` that deals near ones to slices of bounded size. Blocks of
    about ``QUERY_BLOCK`` queries, in no order, meet every slice in groups bounded on both sides; none passes the driver.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    met = vectors.select(F.col("slice").alias("of")).distinct().select("of", every_block)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    left = asked.join(met, "block").select("block", "of", "q", "vec", "bound")
    right = vectors.select("slice", every_block, "key", "first", "ids", "vec")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([hits([])])
        names, raw = left.column("q").to_numpy(), matrix(left.column("vec"))
        unit, bound = unit_rows(raw), left.column("bound").to_numpy() - 1e-9
        ids, lists = right.column("first").to_pylist(), right.column("ids").to_pylist()
        whole = matrix(right.column("vec"))
        by_place = np.lexsort((right.column("first").to_numpy(), right.column("key").to_numpy()))
        best: list[list] = [[] for _ in names]
        for start in range(0, len(by_place), 1024):
            part = by_place[start : start + 1024]
            own = whole[part]
            to = unit_rows(own)
            middle = to.mean(axis=0)
            middle /= max(np.linalg.norm(middle), 1e-12)
            widest = np.arccos(np.clip((to @ middle).min(), -1, 1))
            nearest = np.cos(np.maximum(np.arccos(np.clip(unit @ middle, -1, 1)) - widest, 0))
            able = np.flatnonzero(nearest >= bound - 1e-6)
            score = unit[able] @ to.T
            for x, y in zip(*np.nonzero(score >= bound[able, None])):
                best[able[x]].append((score[x, y], ids[part[y]], lists[part[y]], own[y]))
            for x in able:
                if len(best[x]) > 4 * (k + 4):
                    best[x] = sorted(best[x], key=lambda h: (-h[0], h[1]))[: k + 4]
                    bound[x] = max(bound[x], best[x][-1][0] - 1e-9)
        rows = []
        for x, found in enumerate(best):
            for _, i, own_ids, v in sorted(found, key=lambda h: (-h[0], h[1]))[: k + 4]:
                rows.append((int(names[x]), i, own_ids, exact_cosine(raw[x], v)))
        return pa.Table.from_batches([hits(rows)])

    return left.groupBy("block", "of").cogroup(right.groupBy("block", "slice")).applyInArrow(check, HIT)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = 4,
    dims: int = 8, bits: int = 7, window: int = 64, seed: int = 11, exact: bool = True,
) -> DataFrame:
    """(``query_id``, ``rank``, id, ``score``): the ``k`` nearest other rows of each row where ``is_query`` holds, by largest
    cosine in double precision, ties to the smaller id; all of them if there are fewer.

    Vectors that are null, empty, zero, hold a null or non-finite component, have no id, or are not of the most common
    length, take no part. Equal vectors are searched once and all count. An id on several rows with one vector counts
    once. An empty table, or one without queries, gives an empty result. With ``exact=False`` only the curves' windows are
    searched.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & sound)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else -1))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = curve_keys(unit_rows(matrix(batch.column("vec"))), 0, dims, bits, seed) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "key"])

    kept = distinct_vectors(rows, k).mapInArrow(order, "first long, ids array<long>, asks boolean, vec binary, key long")
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            slices = (task << 32) + np.arange(done, done + batch.num_rows) // SLICE_ROWS
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slices, pa.int64())], names=[*batch.schema.names, "slice"])

    along = kept.repartitionByRange(shuffle_parts(vectors), "key", "first").sortWithinPartitions("key", "first")
    kept = cut_lineage(along.mapInArrow(deal, "first long, ids array<long>, asks boolean, vec binary, key long, slice long"), "vectors")
    best_first = Window.partitionBy("q").orderBy(F.desc("score"), "first")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("q", "first").agg(F.max("score").alias("score"), F.max("ids").alias("ids"))
        return once.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= k + 1)

    found = cut_lineage(best(window_hits(kept, k, curves, dims, bits, window, seed)), "windows")
    if exact:
        bound = found.where(F.col("place") == k + 1).select("q", F.col("score").alias("bound"))
        asked = kept.where("asks").select(F.col("first").alias("q"), "vec").join(bound, "q", "left").select("q", "vec", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
        found = best(found.select("q", "first", "ids", "score").union(check_hits(kept, cut_lineage(asked, "queries"), k)))
    of_query = found.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    same = lambda v: F.sha2(v, 256)
    asking = rows.where("asks").select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(x, np.float64).tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "vec"])

    asking = asking.mapInArrow(to_bytes, "id long, vec binary").select("id", same(F.col("vec")).alias("same"))
    classes = kept.where("asks").select(same(F.col("vec")).alias("same"), F.col("first").alias("q"))
    each = asking.join(classes, "same").join(of_query, "q").select("id", F.explode("hits").alias("h"))
    each = each.select(F.col("id").alias("query_id"), F.explode("h.ids").alias(id_col), F.col("h.score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    each = each.where(F.col("query_id") != F.col(id_col)).withColumn("rank", F.row_number().over(ranked))
    return each.where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
