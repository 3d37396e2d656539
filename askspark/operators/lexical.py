"""Keyword index as tables, and keyword search."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askspark.functions.text import whitespace_words, words
from askspark.operators.search import MAX_SHARED_BYTES, table_bytes, top_k_join
from askspark.session import cut_lineage

TOKENIZERS = {"words": words, "whitespace": whitespace_words}


class TermIndex(NamedTuple):
    """Keyword index: chunks (key, tokens, n_tokens), postings (key, term, tf), terms (term, df), one-row stats.

    ``stored`` tells that the tables are files, so that reading one does not tokenize the corpus again.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    tokenizer: str
    stored: bool = False


def term_stats(chunks: DataFrame, key: str, col: str = "text", tokenizer: str = "words") -> TermIndex:
    """Index tables of a chunk table with unique keys; each is lazy, and can be written as Parquet and read back."""
    tokens = chunks.select(F.col(key).alias("key"), F.coalesce(TOKENIZERS[tokenizer](F.col(col)), F.array().cast("array<string>")).alias("tokens"))
    return index_of_tokens(tokens.withColumn("n_tokens", F.size("tokens")), tokenizer)


def split_words(chunks: DataFrame, key: str, col: str = "text") -> DataFrame:
    """(key, tokens, n_tokens) by the tokenizer ``words``, as ``term_stats`` has it, without a pattern search for each word:
    a task marks the bytes of words in a whole batch of lower-cased texts and cuts them out together."""
    in_word = np.zeros(256, bool)
    in_word[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            if not batch.num_rows:
                continue
            kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            edges = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + batch.num_rows + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
            held = in_word[data]
            first = held.copy()
            first[1:] &= ~held[:-1]
            inner = edges[:-1][edges[:-1] < len(data)]
            first[inner] = held[inner]  # a word ends with its text
            starts = np.flatnonzero(first)
            before = np.concatenate(([0], np.cumsum(held)))  # bytes of words up to a place
            words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(before[starts], before[-1]).astype(np.int32)), pa.py_buffer(data[held]))
            ends = np.searchsorted(starts, edges).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), words)
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists, pa.array(np.diff(ends))], names=["key", "tokens", "n_tokens"])

    rows = chunks.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(col), F.lit(""))).alias("text"))
    kind = T.StructType([rows.schema["key"], T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("n_tokens", T.IntegerType())])
    return rows.mapInArrow(task, kind)


def _term_counter():
    """Task body: batches of (key, tokens) to (key, term, tf), those of a batch in the order of their terms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            coded = lists.flatten().dictionary_encode()
            row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            order = pc.sort_indices(coded.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            terms, height = coded.dictionary.take(order), max(1, batch.num_rows)
            pair, tf = np.unique(place[coded.indices.to_numpy()] * height + row, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(pair % height)), terms.take(pa.array(pair // height)), pa.array(tf, pa.int64())],
                names=["key", "term", "tf"],
            )

    return task


def index_of_tokens(tokens: DataFrame, tokenizer: str = "words") -> TermIndex:
    """Index tables of a table of (key, tokens, n_tokens)."""
    # A chunk is one row, so its terms are counted where it was read; grouping by (key, term) would shuffle the corpus.
    kind = T.StructType([tokens.schema["key"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    postings = tokens.select("key", "tokens").mapInArrow(_term_counter(), kind)
    terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("n_tokens").alias("mean_tokens"))
    return TermIndex(tokens, postings, terms, stats, tokenizer)


def store_index(index: TermIndex, path: str) -> None:
    """Write the index tables; postings and terms are sorted by term, so that a search reads few of their blocks."""
    index.chunks.write.parquet(f"{path}/chunks")
    chunks = index.chunks.sparkSession.read.parquet(f"{path}/chunks")
    again = index_of_tokens(chunks, index.tokenizer)
    again.postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    again.terms.sortWithinPartitions("term").write.parquet(f"{path}/terms")
    again.stats.write.parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str, tokenizer: str = "words") -> TermIndex:
    """Index written by ``store_index``."""
    return TermIndex(*[spark.read.parquet(f"{path}/{name}") for name in TermIndex._fields[:4]], tokenizer, True)


DENSE_SHARE = 50  # a term is common where it touches more than 1 in 50 of all (query, chunk) pairs


def _bm25(k1: float, b: float, mean_tokens: float):
    """Scorer factory for ``top_k_join``; query rows are (qid, term, weight)."""
    dense_share = DENSE_SHARE

    def prepare(queries: pa.Table):
        coded = pc.dictionary_encode(queries.column("qid").combine_chunks())
        vocabulary = pc.unique(queries.column("term").combine_chunks())
        term = pc.index_in(queries.column("term").combine_chunks(), value_set=vocabulary).to_numpy()
        query, weight = coded.indices.to_numpy(), queries.column("weight").to_numpy()
        order = np.argsort(term, kind="stable")
        query, weight = query[order], weight[order]
        edges = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))

        def score(batch) -> np.ndarray:
            tokens = batch.column("tokens")
            tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
            code = pc.index_in(tokens.flatten(), value_set=vocabulary)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(tokens).to_numpy()[known].astype(np.int64)
            code = code.drop_null().to_numpy().astype(np.int64)
            n = batch.num_rows
            pair, tf = np.unique(code * n + row, return_counts=True)
            code, row = pair // n, pair % n
            length = batch.column("n_tokens").to_numpy()[row]
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_tokens))
            total = np.zeros((len(coded.dictionary), n))
            hit = np.zeros(total.shape, dtype=bool)
            present, starts = np.unique(code, return_index=True)
            ends = np.append(starts[1:], len(code))
            # Terms in many queries and chunks at once go through one matrix product, the others one by one.
            pairs = (ends - starts) * (edges[present + 1] - edges[present])
            common = np.flatnonzero(pairs > total.size // dense_share)
            if len(common):
                asked, held = np.zeros((len(total), len(common))), np.zeros((len(common), n))
                named, found = np.zeros(asked.shape, np.float32), np.zeros(held.shape, np.float32)
                for i, at in enumerate(common):
                    c, lo, hi = present[at], starts[at], ends[at]
                    asked[query[edges[c] : edges[c + 1]], i] = weight[edges[c] : edges[c + 1]]
                    held[i, row[lo:hi]] = gain[lo:hi]
                    named[query[edges[c] : edges[c + 1]], i] = found[i, row[lo:hi]] = 1
                total += asked @ held
                hit |= named @ found > 0
            for at in np.setdiff1d(np.arange(len(present)), common):
                c, lo, hi = present[at], starts[at], ends[at]
                cells = np.ix_(query[edges[c] : edges[c + 1]], row[lo:hi])
                total[cells] += np.outer(weight[edges[c] : edges[c + 1]], gain[lo:hi])
                hit[cells] = True
            return np.where(hit, total, -np.inf)

        return coded.dictionary, score

    return prepare


CORPUS = ""  # stands for the whole corpus among the terms: no token is empty


def _term_counts(index: TermIndex, wanted: DataFrame, whole: bool) -> DataFrame:
    """(term, df, n_tokens) of the wanted terms, or all, plus one row for the corpus: its chunks and their tokens.

    One pass over the chunks, whose small result is kept, or none if the index is stored. Up to ``MAX_SHARED_BYTES`` of
    wanted terms are sent to every task and other tokens are dropped before counting; more are picked out after counting, when
    each term is one row.
    """
    spark = index.chunks.sparkSession
    kept = cut_lineage(wanted.unionByName(spark.range(1).select(F.lit(CORPUS).alias("term"))).distinct(), "query-terms")
    few = not whole and table_bytes(kept) <= MAX_SHARED_BYTES
    if index.stored:
        total = F.round(F.col("n_chunks") * F.col("mean_tokens")).cast("bigint")
        corpus = index.stats.select(F.lit(CORPUS).alias("term"), F.col("n_chunks").alias("df"), total.alias("n_tokens"))
        counts = index.terms.withColumn("n_tokens", F.lit(0).cast("bigint")).unionByName(corpus)
    else:
        tokens = index.chunks.select(
            "n_tokens", F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(CORPUS)))).alias("term")
        )
        tokens = tokens.join(F.broadcast(kept), "term", "left_semi") if few else tokens
        counts = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n_tokens").alias("n_tokens"))
    if not whole and (index.stored or not few):
        counts = counts.join(kept, "term", "left_semi")
    return cut_lineage(counts, "term-counts")


def bm25_top_k(
    queries: DataFrame,
    index: TermIndex,
    k: int = 4,
    k1: float = 1.5,
    b: float = 0.75,
    idf: str = "plus_one",
    epsilon: float = 0.25,
    max_shared_bytes: int | None = None,
) -> DataFrame:
    """(qid, key, score, rank): best chunks by keywords for every query of (qid, text).

    ``idf="plus_one"`` is ln(1 + (N - df + 0.5) / (df + 0.5)), never negative. ``"okapi"`` leaves out the 1 and puts
    ``epsilon`` times the mean idf of all terms where it would be negative. Chunks without a query term are no hits.
    """
    asked = (
        queries.select("qid", F.explode(TOKENIZERS[index.tokenizer](F.col("text"))).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    if idf not in ("plus_one", "okapi"):
        raise ValueError("idf must be 'plus_one' or 'okapi'")
    counted = _term_counts(index, asked.select("term"), whole=idf == "okapi")
    corpus = counted.where(F.col("term") == CORPUS).first()
    if corpus is None or not corpus["n_tokens"]:
        return top_k_join(index.chunks, asked.limit(0).withColumn("weight", F.lit(0.0)), _bm25(k1, b, 1.0), k, largest=True)
    odds = (F.lit(corpus["df"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    df = counted.where(F.col("term") != CORPUS)
    if idf == "plus_one":
        value = F.log1p(odds)
    else:
        mean = df.agg(F.avg(F.log(odds)).alias("m")).first()["m"]
        value = F.when(F.log(odds) < 0, epsilon * mean).otherwise(F.log(odds))
    mean_tokens = corpus["n_tokens"] / corpus["df"]
    weighted = asked.join(df, "term").select("qid", "term", (F.col("qtf") * value).alias("weight"))
    return top_k_join(index.chunks, weighted, _bm25(k1, b, mean_tokens), k, largest=True, max_shared_bytes=max_shared_bytes)
