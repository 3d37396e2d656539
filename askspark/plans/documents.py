"""From documents and a table of questions to answers: the whole retrieval flow as one set of Spark jobs."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askspark.functions.prompts import apply_text_fn
from askspark.functions.text import overlap_extract
from askspark.operators.chunking import chunk_documents, chunk_tier, drop_empty_documents
from askspark.operators.lexical import TermIndex, term_stats
from askspark.operators.retrieval import assemble_context, retrieve, sub_queries
from askspark.operators.vectors import embed_text, rarity_weights
from askspark.session import cut_lineage

PROMPT = "Context:\n{context}\n\nQuestion: {question}\n\nAnswer from the context only."


class Corpus(NamedTuple):
    """Chunks (key, doc_id, text), their keyword index and their vectors (key, vector)."""

    chunks: DataFrame
    index: TermIndex
    vectors: DataFrame
    weights: list[float]


def index_documents(documents: DataFrame, dim: int = 256) -> Corpus:
    """Chunk (doc_id, text, n_pages) by length and index the chunks. Chunks are stored once and read by every later pass."""
    readable = drop_empty_documents(documents.select("doc_id", "text", "n_pages"))
    chunks = chunk_documents(chunk_tier(readable).drop("n_pages"))
    stored = cut_lineage(chunks.select(F.concat_ws("#", "doc_id", "chunk_no").alias("key"), "doc_id", "text"), "chunks")
    weights = rarity_weights(stored, dim=dim)
    vectors = embed_text(stored, dim=dim, weights=weights, wordless="null").select("key", "vector")
    return Corpus(stored, term_stats(stored, "key"), vectors, weights)


def answer_questions(
    questions: DataFrame, corpus: Corpus, fn: Callable[[pd.Series], pd.Series] | None = None
) -> DataFrame:
    """(qid, strategy, found, context, answer, answer_error) for questions of (qid, question, strategy, reply).

    ``reply`` is what a model wrote for the strategy: variations, sub-questions or a drafted answer. Without ``fn`` the
    answer is the sentence of the context that shares most words with the question. Questions without any hit have no
    answer.
    """
    subs = embed_text(sub_queries(questions), weights=corpus.weights, wordless="null")
    hits = retrieve(subs, corpus.index, corpus.vectors)
    contexts = assemble_context(questions, hits, corpus.chunks)
    filled = contexts.join(questions.select("qid", "question", "strategy"), "qid")
    answered = apply_text_fn(filled, PROMPT, fn)
    if fn is None:
        answered = answered.withColumn("answer", overlap_extract(F.col("context"), F.col("question")))
    return answered.select(
        "qid", "strategy", "found", "context", F.when(F.col("found"), F.col("answer")).alias("answer"), "answer_error"
    )
