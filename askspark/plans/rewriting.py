"""Questions to searches: a text function picks a strategy for each question and rewrites it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askspark.functions.prompts import apply_text_fn
from askspark.functions.text import retrieval_strategy

STRATEGY_PROMPT = """Name the best way to search for an answer, in one word.
NONE for a direct lookup, EXPANSION if other wording may help, DECOMPOSITION for a question of several parts,
HYDE if a drafted answer is the best search text.
{question}"""
REWRITE_PROMPTS = {
    "expansion": "Write three other wordings of this question, one per line.\n",
    "decomposition": "Split this question into two or three simpler ones, one per line.\n",
    "hyde": "Draft an answer to this question in two sentences.\n",
}


def rewrite_questions(questions: DataFrame, fn: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(qid, question, strategy, reply) as ``sub_queries`` takes them.

    Two calls per question: the strategy, then, unless it is a direct lookup, the rewriting. A call that fails, or no ``fn``,
    leaves the strategy hyde and no reply, and the question itself is searched.
    """
    asked = apply_text_fn(questions.select("qid", "question"), STRATEGY_PROMPT, fn, "__said")
    named = asked.select("qid", "question", F.coalesce(retrieval_strategy(F.col("__said")), F.lit("hyde")).alias("strategy"))
    task = F.lit(None).cast("string")
    for strategy, prompt in REWRITE_PROMPTS.items():
        task = F.when(F.col("strategy") == strategy, F.lit(prompt)).otherwise(task)
    wanted = named.withColumn("__task", task)
    rewritten = apply_text_fn(wanted.where("__task IS NOT NULL"), "{__task}{question}", fn, "reply").drop("__task", "reply_error")
    return rewritten.unionByName(wanted.where("__task IS NULL").select("qid", "question", "strategy", F.lit(None).cast("string").alias("reply")))
