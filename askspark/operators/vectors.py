"""Vector search and local text vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askspark.functions.text import words
from askspark.operators.search import top_k_join
from askspark.session import cut_lineage


def _usable(df: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds numbers only; others have no distance."""
    return df.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))


def _settle():
    """Function that makes squared distances exact where they can matter: (queries, vectors, squares from products, k).

    A square from products is off by a small part of the norms, so each query keeps what is within that of its k-th best;
    those are summed from differences, and the rest cannot be among the k best.
    """

    def settle(q: np.ndarray, v: np.ndarray, square: np.ndarray, k: int) -> np.ndarray:
        if not square.size:
            return square
        error = 8 * np.finfo(np.float64).eps * q.shape[1] * ((q * q).sum(axis=1).max() + (v * v).sum(axis=1).max())
        bar = np.partition(square, k - 1, axis=1)[:, k - 1] if square.shape[1] > k else np.full(len(q), np.inf)
        i, j = np.nonzero((square <= bar[:, None] + 2 * error) & np.isfinite(square))
        out = np.full(square.shape, np.inf)
        for start in range(0, len(i), 50_000):
            a, b = i[start : start + 50_000], j[start : start + 50_000]
            out[a, b] = ((q[a] - v[b]) ** 2).sum(axis=1)
        return out

    return settle


def _distance(metric: str, k: int):
    """Scorer factory for ``top_k_join``; query rows are (qid, vector). The cosine with a zero vector is 0."""
    settle = _settle()

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1.0)

    def matrix(column) -> np.ndarray:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(lists), -1)

    def prepare(queries: pa.Table):
        q = matrix(queries.column("vector"))
        if metric == "cosine":
            q = unit(q)
        q_square = (q * q).sum(axis=1)[:, None]

        def score(batch) -> np.ndarray:
            v = matrix(batch.column("vector"))
            if metric == "cosine":
                return 1.0 - q @ unit(v).T
            return settle(q, v, np.maximum(q_square + (v * v).sum(axis=1)[None, :] - 2.0 * (q @ v.T), 0.0), k)

        return queries.column("qid").combine_chunks(), score

    return prepare


def dense_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 4, metric: str = "l2", max_shared_bytes: int | None = None
) -> DataFrame:
    """(qid, key, score, rank): exact nearest vectors for every query vector.

    ``queries`` is (qid, vector), one row per query; ``vectors`` is (key, vector). The score is the squared Euclidean
    distance, or one minus the cosine with ``metric="cosine"`` (1 for a zero vector); smaller is nearer. Vectors that are
    NULL or hold a NULL or NaN take no part.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be 'l2' or 'cosine'")
    return top_k_join(
        _usable(vectors).select("key", "vector"),
        _usable(queries).select("qid", "vector"),
        _distance(metric, k),
        k,
        largest=False,
        max_shared_bytes=max_shared_bytes,
    )


class Cells(NamedTuple):
    """Vectors grouped around pivots: rows (key, vector, cell, radius), pivot vectors, and each cell's largest radius."""

    rows: DataFrame
    pivots: np.ndarray
    radii: np.ndarray


def build_cells(vectors: DataFrame, n_cells: int = 256) -> Cells:
    """Assign every vector to its nearest pivot and store the result, sorted by cell within each file.

    The pivots are ``n_cells`` vectors of the corpus chosen by key hash. They only decide how much a search can skip; about
    the square root of the number of vectors balances finding cells and reading them.
    """
    given = _usable(vectors).select("key", "vector")
    chosen = given.orderBy(F.xxhash64("key"), "key").limit(n_cells).toArrow()
    pivots = np.array(chosen.column("vector").to_pylist(), dtype=np.float64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
            square = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (v @ pivots.T)
            cell = square.argmin(axis=1)
            radius = np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), lists, pa.array(cell, pa.int32()), pa.array(radius, pa.float64())],
                names=["key", "vector", "cell", "radius"],
            )

    schema = T.StructType([*given.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    rows = cut_lineage(given.mapInArrow(task, schema).sortWithinPartitions("cell"), "cells")
    radii = np.full(len(pivots), -np.inf)
    for r in rows.groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # one row per cell
        radii[r["cell"]] = r["radius"]
    return Cells(rows, pivots, radii)


def _reach(pivots: np.ndarray, k: int):
    """Function of query vectors: distances to every pivot, and a bound on the distance of the k-th neighbour.

    Pivots are vectors of the corpus, so the k nearest pivots give the bound. The margin covers rounding, which grows with
    the norms.
    """
    widest = float(np.sqrt((pivots * pivots).sum(axis=1).max())) if len(pivots) else 0.0

    def reach(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (q * q).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (q @ pivots.T)
        far = np.sqrt(np.maximum(square, 0.0))
        if far.shape[1] < k:
            return far, np.full(len(q), np.inf)
        margin = 1e-5 + 16 * np.sqrt(np.finfo(np.float64).eps * q.shape[1]) * (np.sqrt((q * q).sum(axis=1)) + widest)
        return far, np.partition(far, k - 1, axis=1)[:, k - 1] + margin

    return reach


def dense_top_k_in_cells(queries: DataFrame, cells: Cells, k: int = 4) -> DataFrame:
    """Same result as ``dense_top_k`` with squared Euclidean distance, skipping cells that cannot hold a neighbour.

    By the triangle inequality a vector at ``radius`` from its pivot is at least ``|distance to pivot - radius|`` away.
    Cells no query can reach are not read, and the others are compared only with the queries that reach them.
    """
    radii, reach, settle = cells.radii, _reach(cells.pivots, k), _settle()
    asked = _usable(queries).select("qid", "vector")

    def reached_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(radii), bool)
        for batch in batches:
            if batch.num_rows:
                far, bound = reach(np.array(batch.column("vector").to_pylist(), dtype=np.float64))
                found |= (far - radii[None, :] <= bound[:, None]).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32))], names=["cell"])

    # at most one row per cell comes back, however many queries there are
    reached = [r["cell"] for r in asked.select("vector").mapInArrow(reached_cells, "cell int").distinct().collect()]
    rows = cells.rows
    if len(reached) < len(radii):
        rows = rows.where(F.col("cell").isin(reached))

    def prepare(table: pa.Table):
        q = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        far, bound = reach(q)
        q_square = (q * q).sum(axis=1)[:, None]

        def score(batch) -> np.ndarray:
            lists = batch.column("vector")
            v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
            cell, radius = batch.column("cell").to_numpy(), batch.column("radius").to_numpy()
            found = np.full((len(q), len(v)), np.inf)
            for c in np.unique(cell):
                near = np.flatnonzero(far[:, c] - radii[c] <= bound)
                here = np.flatnonzero(cell == c)
                if not len(near):
                    continue
                part = v[here]
                square = np.maximum(q_square[near] + (part * part).sum(axis=1)[None, :] - 2.0 * (q[near] @ part.T), 0.0)
                out_of_reach = np.abs(far[near, c][:, None] - radius[here][None, :]) > bound[near][:, None]
                found[np.ix_(near, here)] = np.where(out_of_reach, np.inf, square)
            return settle(q, v, found, k)

        return table.column("qid").combine_chunks(), score

    return top_k_join(rows, asked, prepare, k, largest=False)


def _counter(dim: int):
    """Function from lists of words to a matrix with each row's words per bucket below ``dim``: the first 32 bits of the word's
    MD5 digest, so that other engines find the same. Each distinct word of a batch is hashed once."""

    def counts(lists: pa.Array) -> np.ndarray:
        from hashlib import md5

        coded = lists.flatten().dictionary_encode()
        bucket = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        place = row * dim + (bucket[coded.indices.to_numpy()] if len(row) else 0)
        return np.bincount(place, minlength=len(lists) * dim).reshape(len(lists), dim)

    return counts


def _token_lists(col: str) -> Column:
    return F.coalesce(words(F.col(col)), F.array().cast("array<string>"))


def rarity_weights(corpus: DataFrame, col: str = "text", dim: int = 256) -> list[float]:
    """Weights ln((n + 1) / (df + 1)) of the hashed terms of a corpus: every task counts its rows, ``dim`` numbers result."""
    counter, rows_at_once = _counter(dim), 2048

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)  # place ``dim`` counts the rows
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                lists = batch.column(0).slice(start, rows_at_once)
                total[:dim] += (counter(lists) > 0).sum(axis=0)
                total[dim] += len(lists)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(total)], names=["bucket", "n"])

    found = corpus.select(_token_lists(col).alias("w")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(dim + 1)
    for r in found.collect():
        counts[r["bucket"]] = r["n"]
    return np.log((counts[dim] + 1) / (counts[:dim] + 1)).tolist()


def embed_text(
    df: DataFrame, col: str = "text", dim: int = 256, weights: list[float] | None = None, element: str = "float",
    wordless: str = "zero",
) -> DataFrame:
    """Add ``vector``: a unit-length hashed term vector, weighted by the terms' rarity (by default in ``df`` itself).

    Deterministic and offline; stands where a model server would be asked. Pass the corpus weights when embedding queries,
    so that both sides share them. ``element`` is 'float' or 'double'. Texts without words that weigh anything get a zero
    vector, or NULL with ``wordless="null"``: a search should use that, as a zero vector has no direction, yet by Euclidean
    distance is nearer to any query than most texts that share words with it.
    """
    if wordless not in ("zero", "null"):
        raise ValueError("wordless must be 'zero' or 'null'")
    scale = np.array(weights if weights is not None else rarity_weights(df, col, dim))
    counter, kind, rows_at_once = _counter(len(scale)), pa.float32() if element == "float" else pa.float64(), 2048

    def unit(lists: pa.Array) -> pa.Array:
        made = []
        for start in range(0, max(len(lists), 1), rows_at_once):
            m = counter(lists.slice(start, rows_at_once)) * scale
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m /= np.where(norm > 0, norm, 1.0)
            ends = np.arange(len(m) + 1, dtype=np.int32) * len(scale)
            gone = pa.array(norm[:, 0] == 0) if wordless == "null" else None
            made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()).cast(kind), mask=gone))
        return pa.concat_arrays(made)

    # A filter on the vectors would be moved below and make them twice, had the function no mark against it.
    return df.withColumn("vector", F.arrow_udf(unit, f"array<{element}>").asNondeterministic()(_token_lists(col)))
