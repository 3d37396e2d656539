"""A stored keyword index of segments: blocks of postings with their largest gain, delete marks, and tiered merging.

A segment is one folder of Parquet tables that never changes:

- ``documents``: (document, chunks, tokens), what this segment says about each document it touches; no chunks means deleted
- ``chunks``: (document, key, text)
- ``blocks``: (term, slice, most_tf, least_tokens, n, rows, tfs), the postings of a term in one slice of the segment: places in
  the slice and counts. One more row of each slice has no term and holds its chunks: (documents, keys, lengths)
- ``terms``: (term, df)

A document of a newer segment replaces it in older ones. Counts of terms and lengths are sums over segments, less what is
replaced; so adding a segment reads the others' small tables alone. A search takes, for each query, the slices in order of
what they could score at most: first a few, then only those that could still beat the k-th score. A slice holds chunks of
similar length, and its bound for a term is the gain of its highest count in its shortest chunk. A slice is made and scored
as one group of a few hundred chunks, so only its best chunks are shuffled, never single postings.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askspark.operators.lexical import TOKENIZERS
from askspark.operators.search import MAX_SHARED_BYTES, table_bytes
from askspark.session import cut_lineage

#: Chunks of a slice, and query terms that are looked up by name in the files.
SLICE = 256
NAMED_TERMS = 200
SCORES_AT_ONCE = 2_000_000
#: Segments of one size class that are merged into one.
FAN_IN = 4
LIST = "segments"


class Segment(NamedTuple):
    """A folder below the index, its place in the order of arrival, and how many chunks it holds."""

    folder: str
    number: int
    n_chunks: int


class SegmentIndex(NamedTuple):
    spark: SparkSession
    path: str
    segments: list[Segment]

    def read(self, name: str) -> DataFrame:
        """A table of all segments with the ``segment`` number."""
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/{s.folder}/{name}").withColumn("segment", F.lit(s.number)) for s in self.segments))

    def current(self) -> DataFrame:
        """(document, segment, chunks, tokens): what holds about each document that is not deleted."""
        newest = self.read("documents").groupBy("document").agg(F.max_by(F.struct("segment", "chunks", "tokens"), "segment").alias("d"))
        return newest.select("document", "d.*").where("chunks > 0")

    def replaced(self) -> DataFrame:
        """(document, segment) of what a newer segment replaces; the newest segment cannot be in it."""
        seen = self.read("documents").where("chunks > 0").select("document", "segment")
        newest = self.read("documents").groupBy("document").agg(F.max("segment").alias("newest"), F.count("*").alias("n")).where("n > 1")
        return seen.join(newest, "document").where("segment < newest").select("document", "segment")

    def chunks(self) -> DataFrame:
        """(document, key, text) of all chunks that hold."""
        return self.read("chunks").join(self.replaced(), ["document", "segment"], "left_anti").drop("segment")


def _list_path(path: str, version: int) -> str:
    return f"{path}/{LIST}/version={version:08d}"


def open_index(spark: SparkSession, path: str) -> SegmentIndex:
    """The index as its last complete list of segments says."""
    try:
        rows = spark.read.json(f"{path}/{LIST}", schema="segments string, version int").orderBy(F.desc("version")).limit(1).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = []
    return SegmentIndex(spark, path, [Segment(*s) for s in json.loads(rows[0]["segments"])] if rows else [])


def _save(index: SegmentIndex, version: int) -> None:
    row = index.spark.createDataFrame([(json.dumps(index.segments),)], "segments string").coalesce(1)
    row.write.mode("overwrite").json(_list_path(index.path, version))


BLOCK = "slice long, most_tf int, least_tokens int, n int"


def _postings() -> Callable[[pa.Table], pa.Table]:
    """Group body: chunks (document, key, words, n_tokens) of one slice to its blocks and the row that names its chunks."""

    def blocks(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("document", "ascending")]).combine_chunks()
        n, slice_no = table.num_rows, table.column("slice")[0].as_py()
        lengths = table.column("n_tokens").to_numpy()
        lists = pc.split_pattern(table.column("words").combine_chunks(), " ")
        row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        found = lengths[row] > 0  # a text without words splits into one empty piece
        pair, tf = np.unique(coded.indices.to_numpy()[found].astype(np.int64) * n + row[found], return_counts=True)
        code, row = pair // n, (pair % n).astype(np.int32)
        code, starts = np.unique(code, return_index=True)
        ends = np.append(starts, len(row)).astype(np.int32)
        tf, more = tf.astype(np.int32), len(code) + 1
        reduced = lambda f, v: f.reduceat(v, starts) if len(starts) else np.empty(0, np.int32)
        numbers = [reduced(np.maximum, tf), reduced(np.minimum, lengths[row]), np.diff(ends)]
        gap = np.append(ends, ends[-1]).astype(np.int32)  # the last row has no postings
        named = []
        for name in ("document", "key", "n_tokens"):
            values = table.column(name).combine_chunks()
            at = pa.array(np.append(np.zeros(more, np.int32), n).astype(np.int32))
            named.append(pa.ListArray.from_arrays(at, values, mask=pa.array(np.arange(more) < more - 1)))
        return pa.table(
            [
                pa.concat_arrays([coded.dictionary.take(pa.array(code)), pa.nulls(1, coded.dictionary.type)]),
                pa.array(np.full(more, slice_no, np.int64)),
                *(pa.array(np.append(v, 0).astype(np.int32)) for v in numbers),
                pa.ListArray.from_arrays(pa.array(gap), pa.array(row)),
                pa.ListArray.from_arrays(pa.array(gap), pa.array(tf)),
                *named,
            ],
            names=["term", "slice", "most_tf", "least_tokens", "n", "rows", "tfs", "documents", "keys", "lengths"],
        )

    return blocks


def write_segment(chunks: DataFrame, touched: DataFrame, path: str, tokenizer: str = "words") -> int:
    """Write one segment: ``chunks`` (document, key, text) and the ids of all documents it speaks for (``touched``), deleted
    ones included. Returns the number of chunks. Only lengths pass the driver, one number per length class."""
    spark = chunks.sparkSession
    chunks.select("document", "key", "text").write.mode("overwrite").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    tokens = stored.select("document", "key", F.coalesce(TOKENIZERS[tokenizer](F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    tokens = tokens.withColumn("n_tokens", F.size("tokens"))
    counts = tokens.groupBy("document").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"))
    said = touched.select("document").distinct().join(counts, "document", "left")
    said.select("document", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{path}/documents")
    # slices: chunks of one length class, dealt by hash
    length = F.floor(F.log2(F.col("n_tokens") + 1) * 4).cast("int")
    sizes = {r["length"]: r["count"] for r in tokens.groupBy(length.alias("length")).count().collect()}
    parts = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, -(-n // SLICE)))) if sizes else F.create_map(F.lit(0), F.lit(1))
    slice_no = (length.cast("long") * (1 << 32) + F.pmod(F.xxhash64("key"), F.try_element_at(parts, length))).alias("slice")
    # tokens hold no blank, and one text is a fraction of their list's size in a shuffle
    rows = tokens.select("document", "key", F.array_join("tokens", " ").alias("words"), "n_tokens", slice_no)
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
    blocks = rows.groupBy("slice").applyInArrow(
        _postings(), f"term string, {BLOCK}, rows array<int>, tfs array<int>, documents array<{kinds['document']}>, keys array<{kinds['key']}>, lengths array<int>"
    )
    blocks.sortWithinPartitions("term", "slice").write.mode("overwrite").parquet(f"{path}/blocks")
    counts = spark.read.parquet(f"{path}/blocks").where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    counts.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    return sum(sizes.values())


def add_batch(index: SegmentIndex, chunks: DataFrame, touched: DataFrame, batch: int, fan_in: int = FAN_IN) -> SegmentIndex:
    """The index with one more segment, numbered by its batch; one that is there already is left as it is. Where the last
    ``fan_in`` or more are of no larger size class than the new one, they become one segment without what is replaced in it."""
    if any(s.number >= batch for s in index.segments):
        return index
    folder = f"batch-{batch:08d}"
    n = write_segment(chunks, touched, f"{index.path}/{folder}")
    segments = [*index.segments, Segment(folder, batch, n)]
    tier = lambda s: (s.n_chunks // SLICE).bit_length() // 2

    def trailing(found: list[Segment]) -> int:
        """How many segments at the end are of no larger class than the last."""
        return next((i for i, s in enumerate(reversed(found)) if tier(s) > tier(found[-1])), len(found))

    while (run := trailing(segments)) >= fan_in:
        some = SegmentIndex(index.spark, index.path, segments[-run:])
        folder = f"merged-{segments[-run].number:08d}-{batch:08d}"
        # a deleted document stays marked, unless nothing older is left
        touched = some.read("documents").select("document") if len(segments) > run else some.current().select("document")
        n = write_segment(some.chunks(), touched, f"{index.path}/{folder}")
        segments[-run:] = [Segment(folder, batch, n)]
        if len(segments) == 1:
            break
    index = index._replace(segments=segments)
    _save(index, batch)
    return index


def _gain(tf, n_tokens, mean: float, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_tokens / mean))


def _gone(index: SegmentIndex) -> DataFrame | None:
    """(segment, slice, gone): places of replaced documents' chunks in each slice that has any; None without such."""
    replaced = index.replaced()
    if replaced.isEmpty():
        return None
    places = index.read("blocks").where("term IS NULL").select("segment", "slice", F.posexplode("documents").alias("place", "document"))
    gone = places.join(replaced, ["document", "segment"]).groupBy("segment", "slice").agg(F.collect_list("place").alias("gone"))
    return cut_lineage(gone, "replaced-places")


def weighted_terms(queries: DataFrame, index: SegmentIndex, tokenizer: str = "words") -> tuple[DataFrame, float]:
    """(qid, term, weight) of the queries, and the mean length of a chunk. Document counts are sums over the segments' term
    tables, less the postings of replaced documents in blocks of query terms."""
    sums = index.current().agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).first()
    asked = queries.select("qid", F.explode(TOKENIZERS[tokenizer](F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    asked = cut_lineage(asked, "asked-terms")
    if not sums["chunks"] or not sums["tokens"]:
        return asked.limit(0).select("qid", "term", F.lit(0.0).alias("weight")), 1.0
    df = index.read("terms").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    gone = _gone(index)
    if gone is not None:
        old = touching(index.read("blocks"), asked).join(gone, ["segment", "slice"])
        old = old.groupBy("term").agg(F.sum(F.size(F.array_intersect("rows", "gone"))).alias("gone"))
        df = df.join(old, "term", "left").select("term", (F.col("df") - F.coalesce("gone", F.lit(0))).alias("df")).where("df > 0")
    n = sums["chunks"]
    weight = F.col("qtf") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return cut_lineage(asked.join(df, "term").select("qid", "term", weight.alias("weight")), "weighted-terms"), sums["tokens"] / n


def touching(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of the asked terms. A few terms are named to the file reader, which then skips row groups of others; many are
    joined."""
    terms = asked.select("term").distinct()
    few = [r["term"] for r in terms.limit(NAMED_TERMS + 1).collect()]
    if len(few) > NAMED_TERMS:
        return blocks.join(terms, "term", "left_semi")
    return blocks.where(reduce(lambda x, y: x | y, (F.col("term") == t for t in few), F.lit(False)))


class Search(NamedTuple):
    """Hits (qid, key, score, rank), and what was read: one row with the blocks of query terms, the (query, block) pairs they
    make, and how many of those pairs were opened."""

    hits: DataFrame
    read: DataFrame


def block_max_top_k(queries: DataFrame, index: SegmentIndex, k: int = 4, k1: float = 1.5, b: float = 0.75, tokenizer: str = "words") -> Search:
    """Best chunks by keywords for every query (qid, text), as ``bm25_top_k`` over the chunks that hold, ties by smaller key.

    A query first reads the k + 1 slices that could score most, as its best chunks may lie in as many; they give the floor
    for the others.
    """
    weighted, mean = weighted_terms(queries, index, tokenizer)
    parts = max(1, math.ceil(table_bytes(weighted) / MAX_SHARED_BYTES))
    found = [_search(weighted.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) if parts > 1 else weighted, mean, index, k, k1, b) for i in range(parts)]
    read = reduce(DataFrame.unionByName, (s.read for s in found)).agg(*(F.sum(c).alias(c) for c in ("pairs", "opened")))
    blocks = touching(index.read("blocks").where("term IS NOT NULL"), weighted).agg(F.count("*").alias("blocks"))
    return Search(reduce(DataFrame.unionByName, (s.hits for s in found)), blocks.crossJoin(read))  # one row each


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _search(weighted: DataFrame, mean: float, index: SegmentIndex, k: int, k1: float, b: float) -> Search:
    """Search for queries of which every task holds the weights. ``code`` numbers the terms, ``q`` the queries."""
    spark, place = weighted.sparkSession, ["segment", "slice"]
    held = weighted.toArrow()
    qids = pc.unique(held.column("qid").combine_chunks())
    terms = pc.unique(held.column("term").combine_chunks())
    query, code = (pc.index_in(held.column(c).combine_chunks(), value_set=v).to_numpy(zero_copy_only=False).astype(np.int64) for c, v in (("qid", qids), ("term", terms)))
    weight = held.column("weight").to_numpy()
    by_term, by_query = np.argsort(code, kind="stable"), np.argsort(query, kind="stable")
    term_edges, query_edges = np.searchsorted(code[by_term], np.arange(len(terms) + 1)), np.searchsorted(query[by_query], np.arange(len(qids) + 1))
    shared = spark.sparkContext.broadcast((qids, query, code, weight, by_term, by_query, term_edges, query_edges))
    codes = spark.createDataFrame(pa.table([terms, pa.array(np.arange(len(terms), dtype=np.int32))], schema=pa.schema([("term", pa.string()), ("code", pa.int32())])))
    blocks = touching(index.read("blocks").where("term IS NOT NULL"), weighted).join(F.broadcast(codes), "term")
    gain, ranges, at_once = _gain, _ranges, SCORES_AT_ONCE

    def bound(table: pa.Table) -> pa.Table:
        """What every query could score at most in this slice, and the blocks that it names there."""
        _, query, _, weight, by_term, _, edges, _ = shared.value
        present = table.column("code").to_numpy()
        most = gain(table.column("most_tf").to_numpy(), table.column("least_tokens").to_numpy(), mean, k1, b)
        entry = by_term[ranges(edges[present], edges[present + 1])]
        sums = np.bincount(query[entry], weights=weight[entry] * np.repeat(most, edges[present + 1] - edges[present]))
        pairs = np.bincount(query[entry])
        q = np.flatnonzero(pairs)
        same = [pa.array([table.column(c)[0].as_py()] * len(q), t) for c, t in (("segment", pa.int32()), ("slice", pa.int64()))]
        return pa.table([*same, pa.array(q, pa.int32()), pa.array(sums[q]), pa.array(pairs[q])], names=["segment", "slice", "q", "most", "pairs"])

    bounds = blocks.select(*place, "code", "most_tf", "least_tokens").groupBy(*place)
    slices = cut_lineage(bounds.applyInArrow(bound, "segment int, slice long, q int, most double, pairs long"), "slices")

    def score(table: pa.Table, asked: pa.Table) -> pa.Table:
        """The k best chunks of this slice for each query that wants it, none below the query's floor."""
        qids, _, code, weight, _, by_query, _, edges = shared.value
        none = pa.table([qids.slice(0, 0), keys_of(asked).slice(0, 0), pa.array([], pa.float64())], names=["qid", "key", "score"])
        if not table.num_rows or not asked.num_rows:
            return none
        keys, lengths = keys_of(asked), asked.column("lengths").combine_chunks().flatten().to_numpy()
        wanted, floors = (asked.column(c).combine_chunks().flatten().to_numpy() for c in ("q", "floor"))
        present, lists = table.column("code").to_numpy(), table.column("rows").combine_chunks()
        term, row = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
        gains = np.zeros((len(present), len(keys)))
        gains[term, row] = gain(table.column("tfs").combine_chunks().flatten().to_numpy(), lengths[row], mean, k1, b)
        gains[:, asked.column("gone").combine_chunks().flatten().to_numpy()] = 0.0
        place_of = np.full(len(edges_of_terms(shared.value)), -1)
        place_of[present] = np.arange(len(present))
        out = []
        for first in range(0, len(wanted), max(1, at_once // max(1, len(present)))):
            some, floor = (v[first : first + max(1, at_once // max(1, len(present)))] for v in (wanted, floors))
            entry = by_query[ranges(edges[some], edges[some + 1])]
            who = np.repeat(np.arange(len(some)), edges[some + 1] - edges[some])
            here = place_of[code[entry]]
            weights = np.zeros((len(some), len(present)))
            weights[who[here >= 0], here[here >= 0]] = weight[entry[here >= 0]]
            total = np.round(weights @ gains, 9)
            if total.shape[1] > k:
                floor = np.maximum(floor, np.partition(total, -k, axis=1)[:, -k])
            q, row = np.nonzero((total > 0) & (total >= floor[:, None]))
            names = keys.take(pa.array(row)).to_numpy(zero_copy_only=False)
            order = np.lexsort((names.astype(str) if names.dtype == object else names, -total[q, row], q))
            q, row = q[order], row[order]
            top = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
            out.append((some[q[top]], row[top], total[q[top], row[top]]))
        q, row, total = (np.concatenate(p) for p in zip(*out))
        return pa.table([qids.take(pa.array(q)), keys.take(pa.array(row)), pa.array(total)], names=["qid", "key", "score"])

    def keys_of(asked: pa.Table) -> pa.Array:
        return asked.column("keys").combine_chunks().flatten()

    def edges_of_terms(value: tuple) -> np.ndarray:
        return value[6][:-1]

    named = index.read("blocks").where("term IS NULL").select(*place, "keys", "lengths")
    gone = _gone(index)
    named = named.withColumn("gone", F.lit(None).cast("array<int>")) if gone is None else named.join(gone, place, "left")
    named = named.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    key = named.schema["keys"].dataType.elementType.simpleString()
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "key")

    def scored(wanted: DataFrame) -> DataFrame:
        """The k best chunks of each query in its wanted slices (segment, slice, q, floor)."""
        asked = wanted.groupBy(*place).agg(F.collect_list(F.struct("q", "floor")).alias("w")).select(*place, F.col("w.q").alias("q"), F.col("w.floor").alias("floor"))
        asked = cut_lineage(asked, "wanted-slices")
        need = blocks.select(*place, "code", "rows", "tfs").join(asked.select(*place), place, "left_semi")
        hits = need.groupBy(*place).cogroup(asked.join(named, place).groupBy(*place)).applyInArrow(score, f"qid {weighted.schema['qid'].dataType.simpleString()}, key {key}, score double")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best_first = Window.partitionBy("q").orderBy(F.desc("most"), *place)
    start = slices.withColumn("turn", F.row_number().over(best_first)).where(F.col("turn") <= k + 1).drop("turn")
    start = cut_lineage(start.withColumn("floor", F.lit(0.0)), "first-slices")
    first = cut_lineage(scored(start), "first-hits")
    numbers = spark.createDataFrame(pa.table([qids, pa.array(np.arange(len(qids), dtype=np.int32))], schema=pa.schema([("qid", qids.type), ("q", pa.int32())])))
    floor = first.where(F.col("rank") == k).join(F.broadcast(numbers), "qid").select("q", F.col("score").alias("floor"))
    rest = slices.join(start.select(*place, "q"), [*place, "q"], "left_anti").join(F.broadcast(floor), "q", "left")
    rest = rest.withColumn("floor", F.coalesce("floor", F.lit(0.0))).where(F.col("most") >= F.col("floor") - 1e-6)
    rest = cut_lineage(rest.select(*place, "q", "most", "pairs", "floor"), "open-slices")
    both = first.unionByName(cut_lineage(scored(rest), "more-hits")).drop("rank")
    hits = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "key", "score", "rank")
    opened = start.select("pairs").unionByName(rest.select("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("opened"))
    return Search(hits, slices.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).crossJoin(opened))
