"""Documents to chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askspark.functions.text import strip

# Most pages of a tier, chunk size and overlap in characters.
TIERS = [(5, 500, 50), (15, 1000, 100), (None, 2000, 200)]
SEPARATORS = ("\n\n", "\n", " ", "")
ROWS_AT_ONCE = 64


def drop_empty_documents(df: DataFrame, col: str = "text", min_chars: int = 1) -> DataFrame:
    """Documents with at least ``min_chars`` characters of readable text."""
    return df.where(F.length(strip(F.col(col))) >= min_chars)


def chunk_tier(df: DataFrame, n_pages: str | Column = "n_pages") -> DataFrame:
    """Add chunk_size and chunk_overlap for the length of the document in pages."""
    pages = F.col(n_pages) if isinstance(n_pages, str) else n_pages

    def pick(i: int) -> Column:
        (small, *a), (medium, *b), (_, *c) = TIERS
        return F.when(pages <= small, a[i]).when(pages <= medium, b[i]).otherwise(c[i])

    return df.withColumns({"chunk_size": pick(0), "chunk_overlap": pick(1)})


def _splitter(separators: tuple[str, ...]) -> Callable[[str, int, int], list[tuple[int, int]]]:
    """Function giving the (start, end) spans of one text's chunks.

    The text is cut before each occurrence of the first separator it contains. Neighbouring pieces shorter than ``size``
    are packed greedily; a longer piece is cut again by the separators that follow. The next chunk starts with the last
    pieces of the previous one, up to ``overlap``. As pieces are contiguous, packing is a search in the sorted cut
    positions: one step per chunk, not per piece. The functions are nested so that tasks receive them by value.
    """

    def spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        marks: dict[str, np.ndarray] = {}

        def cuts(sep: str, start: int, end: int) -> np.ndarray:
            if sep == "":
                return np.arange(start + 1, end)
            if sep not in marks:
                if len(sep) == 1:
                    marks[sep] = np.flatnonzero(codes == ord(sep))
                else:
                    found, at = [], text.find(sep)
                    while at >= 0:
                        found.append(at)
                        at = text.find(sep, at + len(sep))
                    marks[sep] = np.asarray(found, dtype=np.int64)
            inside = marks[sep]
            lo, hi = np.searchsorted(inside, [start, end - len(sep) + 1])
            return inside[lo:hi]

        def pack(bounds: np.ndarray) -> list[tuple[int, int]]:
            b = bounds.tolist()
            out, i, last = [], 0, len(b) - 1
            while True:
                j = bisect_right(b, b[i] + size, i) - 1
                out.append((b[i], b[j]))
                if j == last:
                    return out
                i = bisect_left(b, max(b[j] - overlap, b[j + 1] - size), i)

        def split(start: int, end: int, level: int) -> list[tuple[int, int]]:
            at = np.empty(0, dtype=np.int64)
            while level < len(separators):
                at = cuts(separators[level], start, end)
                level += 1
                if len(at) or separators[level - 1] == "":
                    break
            bounds = np.unique(np.concatenate(([start], at, [end])))
            long = np.flatnonzero(np.diff(bounds) >= size)
            out, first = [], 0
            for piece in long:
                if piece > first:
                    out += pack(bounds[first : piece + 1])
                s, e = int(bounds[piece]), int(bounds[piece + 1])
                out += split(s, e, level) if level < len(separators) else [(s, e)]
                first = piece + 1
            if first < len(bounds) - 1:
                out += pack(bounds[first:])
            return out

        return split(0, len(text), 0) if text else []

    return spans


def chunk_documents(
    df: DataFrame,
    size: int | str = "chunk_size",
    overlap: int | str = "chunk_overlap",
    col: str = "text",
    separators: tuple[str, ...] = SEPARATORS,
) -> DataFrame:
    """One row per chunk: the other columns, chunk_no from 0, start offset and stripped text.

    ``size`` and ``overlap`` are numbers or column names. A row-wise map without a shuffle, for batches and streams alike.
    Greedy packing carries state from chunk to chunk, which column expressions can only do by copying a growing array, so
    this one step runs on Arrow batches.
    """
    keys = [c for c in df.columns if c not in (col, "chunk_size", "chunk_overlap")]
    given = [F.lit(v).cast("int") if isinstance(v, int) else F.col(v).cast("int") for v in (size, overlap)]
    source = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("__text"), given[0].alias("__size"), given[1].alias("__overlap"))
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("chunk_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]
    )
    spans, at_once = _splitter(separators), ROWS_AT_ONCE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few rows at a time: what a task holds is then bounded by their texts, not by the engine's batch
        for batch in (b.slice(start, at_once) for b in batches for start in range(0, b.num_rows, at_once)):
            rows, numbers, starts, chunks = [], [], [], []
            columns = [batch.column(n).to_pylist() for n in ("__text", "__size", "__overlap")]
            for row, (text, n, lap) in enumerate(zip(*columns)):
                number = 0
                for s, e in spans(text, n, lap):
                    piece = text[s:e]
                    body = piece.strip()
                    if body:
                        rows.append(row)
                        numbers.append(number)
                        starts.append(s + len(piece) - len(piece.lstrip()))
                        chunks.append(body)
                        number += 1
            kept = [batch.column(k).take(pa.array(rows, pa.int32())) for k in keys]
            made = [pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(chunks, pa.string())]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keys, "chunk_no", "start", "text"])

    return source.mapInArrow(task, schema)
