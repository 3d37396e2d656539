"""Ranked lexical search in which documents that are alike for the items are scored once.

Of a document only its counts of words that some item holds, and its length class m, decide its score. Documents are reduced
to these vectors where they are read; equal vectors with equal m (found by hash, verified byte by byte) are a class, of which
the k smallest ids are kept, as no more can be in a result. Classes are scored against all items of a block in numpy, with
whole numbers throughout, and each task keeps the k best documents of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askspark.session import cut_lineage

#: Text of items that tasks hold at a time, (class, item, word) triples and (class, item) scores worked on at a time.
ITEM_BYTES = 8 << 20
TRIPLES = 1 << 21
SCORES = 1 << 22
#: Up to so many different words of an item the sums stay below 2**53, where adding doubles is exact.
EXACT_WORDS = 200_000
#: Bytes to terms: letters of ASCII in lower case, digits and bytes of other characters as they are, the rest to blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per row: id, ``n`` (terms) and ``vector``, its (term number, count) pairs by ascending term number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, vectors = [], []
            for value in batch.column("text"):
                words = terms(value.as_py())
                pairs = sorted((i, tf) for w, tf in Counter(words).items() if (i := number(w)) is not None)
                sizes.append(len(words))
                vectors.append(np.array(pairs, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "n", "vector"])

    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("vector", T.BinaryType())])
    return docs.select("id", "text").mapInArrow(restrict, schema)


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is; summed in each task, then in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<u4").reshape(-1, 2)
            held += np.bincount(pairs[:, 0], minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for r in vectors.select("vector").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(m, vector, members): each class once, with its ``k`` smallest ids, null last. The cut runs before the shuffle, so that
    a class with most of the documents sends ``k`` rows a task."""
    key = ["digest", "m", "vector"]
    member = F.struct(F.col("id").isNull().alias("none"), "id").alias("member")
    rows = vectors.where(F.octet_length("vector") > 0).select(F.xxhash64("vector", "m").alias("digest"), "m", "vector", member)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("member"))
    kept = rows.withColumn("place", place).where(F.col("place") <= k)
    return kept.groupBy(*key).agg(F.array_sort(F.collect_list("member")).alias("members")).select("m", "vector", "members")


def _score(classes: DataFrame, items: list[list[int]], weights: np.ndarray, k: int) -> DataFrame:
    """(item, score, member): the ``k`` best documents of each item in each task."""
    order = sorted((t, i) for i, words in enumerate(items) for t in words)
    holders = np.array([i for _, i in order], np.int64)
    held = np.bincount([t for t, _ in order], minlength=len(weights)).astype(np.int64)
    exact = max(map(len, items), default=0) <= EXACT_WORDS
    shared = classes.sparkSession.sparkContext.broadcast((holders, held, np.cumsum(held) - held, weights))
    n_items = len(items)
    kind = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()), T.StructField("member", classes.schema["members"].dataType.elementType)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, held, first, weights = shared.value
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        floor = np.ones(n_items, np.int64)
        none_kind = None

        def portion(m: np.ndarray, vectors: list[bytes], members: list) -> None:
            n = len(vectors)
            pairs = np.frombuffer(b"".join(vectors), "<u4").reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(n), [len(v) // 8 for v in vectors])
            term, tf = pairs[:, 0], pairs[:, 1]
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            times = held[term]
            ends = np.cumsum(times)
            item = holders[np.repeat(first[term] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)]
            cell = item * n + np.repeat(row, times)
            if exact:
                total = np.bincount(cell, np.repeat(gain, times), n_items * n).astype(np.int64).reshape(n_items, n)
            else:
                total = np.zeros(n_items * n, np.int64)
                np.add.at(total, cell, np.repeat(gain, times))
                total = total.reshape(n_items, n)
            least = floor if n <= k else np.maximum(floor, np.partition(total, n - k, axis=1)[:, n - k])
            found = np.argwhere(total >= least[:, None])
            edges = np.searchsorted(found[:, 0], np.arange(n_items + 1))
            for i in np.unique(found[:, 0]).tolist():
                for c in found[edges[i] : edges[i + 1], 1].tolist():
                    best[i] += [(-int(total[i, c]), x["none"], x["id"] if not x["none"] else 0) for x in members[c]]
                best[i].sort()
                del best[i][k:]
                if len(best[i]) == k:
                    floor[i] = max(1, -best[i][-1][0])

        for batch in batches:
            none_kind = batch.schema.field("members").type.value_type
            m, vectors, members = batch.column("m").to_numpy(), batch.column("vector").to_pylist(), batch.column("members")
            work = np.array([held[np.frombuffer(v, "<u4")[::2]].sum() for v in vectors], np.int64)
            part = np.maximum(np.cumsum(work) // TRIPLES, np.arange(len(work)) * n_items // SCORES)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(work)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    portion(m[a:b], vectors[a:b], members.slice(a, b - a).to_pylist())
        rows = [(i, -s, {"none": none, "id": None if none else x}) for i, top in enumerate(best) for s, none, x in top]
        if rows:
            item, points, member = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(points, pa.int64()), pa.array(member, none_kind)], names=["item", "score", "member"])

    return classes.mapInArrow(score, kind)


def lexical_top_k(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item id, ``rank`` from 1, document id, ``score``): the ``k`` best documents of each item with a score above 0, equal
    scores by ascending document id.

    Terms are runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased. With N documents that have
    terms, L terms in all, n in a document, df documents with a term and tf of it in the document, a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), m = 10 + 90 n N div L, and the score sums, over the item's distinct terms,
    weight * (10**9 tf div (1000 tf + 8 m)).

    A null or empty text has no terms and is no hit; an item without terms has no rows. Repeated documents are several
    documents; a document without an id comes last among equals. Repeated items give repeated results. Other columns are
    ignored. Items are taken in blocks of about ``item_bytes`` of text, one after another: the driver and the tasks hold one
    block, and its results are written before the next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // item_bytes))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    schema = T.StructType([T.StructField("item_id", asked.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        some = numbered.where(F.col("block") == block).select("item_id", "text").collect()
        words = [sorted(set(terms(r["text"]))) for r in some]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))} if words else {}
        if not vocabulary:
            continue
        vectors = cut_lineage(term_vectors(rows, vocabulary), "term-vectors")
        sums = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not sums["docs"]:
            continue
        df = document_counts(vectors, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        length = F.expr(f"10 + (90 * n * {sums['docs']}L) div {sums['terms']}L")
        scored = _score(classes_of(vectors.withColumn("m", length), k), [[vocabulary[w] for w in ws] for ws in words], weights, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "member")
        top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], T.StructType([T.StructField("item", T.LongType()), schema["item_id"]]))
        found = top.join(names, "item").select("item_id", "rank", F.col("member.id").alias("id"), "score")
        out = out.union(cut_lineage(found, "ranked"))
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
