"""Documents to training text: drop poor and toxic ones, one of each near-duplicate group, benchmark leaks; then tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns; the last one adds the token
counts and digests. ``run`` writes every stage as Parquet below the shared folder and reads it again for the next.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from askspark.llm.bpe import bpe_round_trip  # noqa: E402
from askspark.llm.common import table  # noqa: E402
from askspark.llm.decontaminate import find_benchmark  # noqa: E402
from askspark.llm.jaccard_join import similar_components  # noqa: E402
from askspark.llm.quality import score_quality  # noqa: E402
from askspark.session import scratch_path  # noqa: E402

PLACE = "place among the rows of one id"


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return score_quality(docs, table(spark, sf_dir, "labels")).where("keep").select(columns(docs))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles, the one whose id names the group stays. Documents without words
    are copies of nothing and stay. Of rows with one id, the first stays, in the order of hashes and contents of their columns."""
    groups = similar_components(docs, 5, 80, 100)
    chosen = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    order = [F.xxhash64("text"), "text", *(F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c in docs.columns if c not in ("doc_id", "text"))]
    first = Window.partitionBy("doc_id").orderBy(*order)
    kept = docs.join(chosen.where("doc_id IS NOT NULL"), "doc_id", "left_semi").select(columns(docs))
    kept = kept.withColumn(PLACE, F.row_number().over(first)).where(F.col(PLACE) == 1).select(columns(docs))
    return kept.union(docs.where("doc_id IS NULL"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return find_benchmark(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, all of whose columns but the text stay."""
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_columns=True).drop("text")


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_similar),
    ("decontamination", keep_clean),
    ("tokens", encode),
]

#: The classifier and the tokenizer have no SQL form; the classifier is tested on held-out labels, the other stages against
#: plain Python and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
