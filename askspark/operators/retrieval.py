"""Hybrid retrieval for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askspark.functions import text as T
from askspark.operators.lexical import TermIndex, bm25_top_k
from askspark.operators.vectors import dense_top_k
from askspark.session import cut_lineage

# Weights of the keyword and the vector ranking, hits per retriever, hits kept per (sub-)query.
WEIGHTS = (0.3, 0.7)
RETRIEVER_K = 4
KEPT = {"expansion": 2, "decomposition": 2, "hyde": 4}
CONTEXT_SEPARATOR = "\n\n---\n\n"


def fuse_ranks(
    sparse: DataFrame, dense: DataFrame, weights: tuple[float, float] = WEIGHTS, c: int = 60, merge_on: DataFrame | None = None
) -> DataFrame:
    """(qid, key, score, rank): weighted reciprocal-rank fusion of two rankings of (qid, key, rank).

    Hits of the same chunk add up. With ``merge_on`` (key, text) chunks of equal text count as one and the smallest key
    stands for them.
    """
    parts = [
        ranking.select("qid", "key", "rank", (F.lit(float(w)) / (F.lit(c) + F.col("rank"))).alias("part"))
        for ranking, w in zip((sparse, dense), weights)
    ]
    both = parts[0].unionByName(parts[1])
    if merge_on is None:
        merged = both.groupBy("qid", "key").agg(F.sum("part").alias("score"))
    else:
        # The hits are few and stored, so that their keys filter the texts where they are read.
        both = cut_lineage(both, "rankings")
        texts = merge_on.select("key", "text").join(both.select("key").distinct(), "key", "left_semi")
        merged = (
            both.join(texts, "key")
            .groupBy("qid", "text")
            .agg(F.sum("part").alias("score"), F.min("key").alias("key"))
            .drop("text")
        )
    rounded = merged.withColumn("score", F.round("score", 12))
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    return rounded.withColumn("rank", F.row_number().over(place)).select("qid", "key", "score", "rank")


def parse_strategy(df: DataFrame, col: str, out: str = "strategy") -> DataFrame:
    """Add the retrieval strategy named by a model reply."""
    return df.withColumn(out, T.retrieval_strategy(F.col(col)))


def clean_variations(df: DataFrame, query: str, reply: str, n: int = 3) -> DataFrame:
    """One row per rewritten query: the other columns, sub_no from 0 and sub_query."""
    others = [c for c in df.columns if c != reply]
    return df.select(*others, F.posexplode(T.query_variations(F.col(query), F.col(reply), n)).alias("sub_no", "sub_query"))


def clean_subquestions(df: DataFrame, query: str, reply: str) -> DataFrame:
    """One row per sub-question: the other columns, sub_no from 0 and sub_query."""
    others = [c for c in df.columns if c != reply]
    return df.select(*others, F.posexplode(T.sub_questions(F.col(query), F.col(reply))).alias("sub_no", "sub_query"))


def sub_queries(df: DataFrame, query: str = "question", reply: str = "reply", strategy: str = "strategy") -> DataFrame:
    """Texts to search for each question, by strategy: itself, its variations, its parts, or the drafted answer."""
    q, r, s = F.col(query), F.col(reply), F.col(strategy)
    texts = (
        F.when(s == "expansion", T.query_variations(q, r))
        .when(s == "decomposition", T.sub_questions(q, r))
        .when(s == "hyde", F.array(F.coalesce(T.strip(r), q)))
        .otherwise(F.array(q))
    )
    return df.select("qid", s.alias("strategy"), F.posexplode(texts).alias("sub_no", "text"))


def retrieve(
    subs: DataFrame, index: TermIndex, vectors: DataFrame, k: int = RETRIEVER_K, dedupe: bool = False, merge_on: DataFrame | None = None
) -> DataFrame:
    """(qid, strategy, sub_no, key, score, rank): hits of every question in the order they are shown.

    ``subs`` is (qid, strategy, sub_no, text, vector), one row per text to search. All of them are searched in one keyword
    pass and one vector pass. Hits come by sub-query, then by fused rank, cut by strategy; direct lookups keep all. A
    chunk found by several sub-queries stays each time unless ``dedupe``. With ``merge_on`` (key, text) chunks of equal text
    count as one.
    """
    named = subs.withColumn("sid", F.concat_ws("#", "qid", "sub_no"))
    sparse = bm25_top_k(named.select(F.col("sid").alias("qid"), "text"), index, k)
    dense = dense_top_k(named.select(F.col("sid").alias("qid"), "vector"), vectors, k)
    fused = fuse_ranks(sparse, dense, merge_on=merge_on).withColumnRenamed("qid", "sid").withColumnRenamed("rank", "sub_rank")
    hits = fused.join(named.select("sid", "qid", "strategy", "sub_no"), "sid")
    allowed = F.lit(2**31 - 1)
    for name, n in KEPT.items():
        allowed = F.when(F.col("strategy") == name, n).otherwise(allowed)
    hits = hits.where(F.col("sub_rank") <= allowed)
    if dedupe:
        again = Window.partitionBy("qid", "key").orderBy("sub_no", "sub_rank")
        hits = hits.withColumn("rn", F.row_number().over(again)).where("rn = 1").drop("rn")
    shown = Window.partitionBy("qid").orderBy("sub_no", "sub_rank")
    return hits.withColumn("rank", F.row_number().over(shown)).select("qid", "strategy", "sub_no", "key", "score", "rank")


def assemble_context(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, context, found): texts of the hits (qid, key, rank) in rank order, one row per question.

    The hits of a question are few by construction, so joining them into one text is bounded. They are stored first: their
    size is then known, and while it is small the chunks are filtered where they are read instead of being shuffled.
    """
    shown = cut_lineage(hits.select("qid", "key", "rank"), "hits")
    texts = chunks.select("key", "text").join(shown, "key")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    context = F.array_join(F.transform(ordered, lambda h: h["text"]), CONTEXT_SEPARATOR)
    grouped = texts.groupBy("qid").agg(context.alias("context"))
    return questions.select("qid").join(grouped, "qid", "left").withColumn("found", F.col("context").isNotNull())
