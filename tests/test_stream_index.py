"""The tables of a streamed index: words cut in whole batches, postings that come sorted from their batch."""

import numpy as np

from askspark.operators.lexical import index_of_tokens, split_words, term_stats

TEXTS = ["ab", "cd ef", "", None, " x", "y ", "É1a-b2É", "Kelvin İx", "日本 a日b", "...", "Ab,aB\nab", "end", "\U0001F600z\U0001F600"]


def rows(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def test_words_are_those_of_the_pattern(spark):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("aZ09 é\n-😀"), rng.integers(0, 9))) for _ in range(400)]
    chunks = spark.createDataFrame(list(enumerate(TEXTS + made)), "key long, text string").coalesce(1)
    expected = term_stats(chunks, "key").chunks
    got = split_words(chunks, "key")
    assert got.dtypes == expected.dtypes
    assert rows(got) == rows(expected)
    assert split_words(chunks.limit(0), "key").count() == 0
    assert rows(split_words(chunks.where("key = 2"), "key")) == [(2, (), 0)]


def test_postings_of_a_batch_come_in_the_order_of_terms(spark):
    chunks = spark.createDataFrame([(1, "b a a"), (2, "c b"), (3, ""), (4, "a c c c")], "key long, text string").coalesce(1)
    got = [tuple(r) for r in index_of_tokens(split_words(chunks, "key")).postings.collect()]
    assert got == [(1, "a", 2), (4, "a", 1), (1, "b", 1), (2, "b", 1), (2, "c", 1), (4, "c", 3)]
