"""Inputs that once lost rows, failed or took too long."""

import math
import time
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from askspark.llm.bpe import bpe_round_trip
from askspark.llm.decontaminate import find_benchmark
from askspark.llm.lattice_lm import START, score_texts, vocabulary_scores
from askspark.llm.url_filter import alias_edges

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def test_scores_do_not_depend_on_how_the_table_is_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400)
    plain = {r["doc_id"]: r for r in score_texts(docs, held_out(), PIECES).collect()}
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "50KB"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        dealt = {r["doc_id"]: r for r in score_texts(docs.repartition("doc_id"), held_out(), PIECES).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(dealt) == len(plain) == 400
    for i, r in plain.items():
        assert dealt[i]["n_known"] == r["n_known"] and math.isclose(dealt[i]["score"], r["score"], rel_tol=1e-9)


def all_cuts(word, pieces, byte_scores):
    """Sum over all segmentations, one by one from the left."""
    sums = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            part = word[start:end]
            if part in pieces:
                sums[end] += sums[start] * math.exp(pieces[part])
        if word[end - 1] not in pieces:
            sums[end] += sums[end - 1] * math.exp(sum(byte_scores[b] for b in word[end - 1].encode()))
    return sums[-1]


def test_score_is_the_sum_over_segmentations(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The Cat", None, "", "naïve ßtraße 日本 the", "cat cat dog the", "unseen words here", "x" * 30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [1, 4, 5]
    held = ~F.col("doc_id").isin(train)
    pieces, byte_scores = vocabulary_scores(PIECES)
    tokens = {i: (t or "").lower().split() for i, t in rows}
    log = lambda w: math.log10(all_cuts(START + w, pieces, byte_scores))
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, held, PIECES, reestimate=False, whole_words=False).collect()}
    end = -math.log10(101)
    for i, words in tokens.items():
        assert math.isclose(got[i], sum(map(log, words)) + end, rel_tol=1e-9)

    # with arcs of training words: n / (n + v) of their frequency, the rest for the segmentations
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    own = n / (n + v)
    mix = lambda w: math.log10(own * counts[w] / n + (1 - own) * all_cuts(START + w, pieces, byte_scores))
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, held, PIECES, reestimate=False).collect()}
    end = math.log10(own * len(train) / n + (1 - own) / 101)
    for i, words in tokens.items():
        assert math.isclose(got[i], sum(map(mix, words)) + end, rel_tol=1e-9)

    # re-estimated: each piece by its expected uses over all segmentations of the training words
    uses, bytes_used = Counter(), Counter()
    for w, c in counts.items():
        w = START + w
        sums = [all_cuts(w[:k], pieces, byte_scores) if k else 1.0 for k in range(len(w) + 1)]
        after = [all_cuts(w[k:], pieces, byte_scores) if k < len(w) else 1.0 for k in range(len(w) + 1)]
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                if w[a:b] in pieces:
                    uses[w[a:b]] += c * sums[a] * math.exp(pieces[w[a:b]]) * after[b] / sums[-1]
            if w[a] not in pieces:
                p = c * sums[a] * math.exp(sum(byte_scores[x] for x in w[a].encode())) * after[a + 1] / sums[-1]
                for x in w[a].encode():
                    bytes_used[x] += p
    total = sum(uses.values()) + sum(bytes_used.values()) + len(train) + 0.1 * (len(pieces) + 257)
    again = {p: math.log((uses[p] + 0.1) / total) for p in pieces}
    again_bytes = [math.log((bytes_used[b] + 0.1) / total) for b in range(256)]
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, held, PIECES, whole_words=False).collect()}
    for i, words in tokens.items():
        want = sum(math.log10(all_cuts(START + w, again, again_bytes)) for w in words) + math.log10((len(train) + 0.1) / total)
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_a_benchmark_item_without_an_id_hits_words_but_is_not_counted(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "four one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (7, "one two three"), (None, "four")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in find_benchmark(docs, items).collect()}
    assert got == {1: (3, 1, ["7"]), 2: (1, 0, []), 3: (4, 1, ["7"])}


def test_columns_of_structs_with_blanks_in_their_names_pass(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("a b", F.struct(F.lit(1).alias("c d"), F.lit("x").alias("e")))
    items = spark.createDataFrame([(7, "some text")], "item_id long, text string")
    assert find_benchmark(docs, items).select("`a b`.`c d`").first()[0] == 1
    assert bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_columns=True).select("`a b`.`c d`").first()[0] == 1


def test_a_page_of_unclosed_links_takes_seconds(spark):
    html = "<link " * 170_000 + "<meta " * 10_000  # a megabyte
    pages = spark.createDataFrame([(1, "http://a.org/x", html), (2, "http://a.org/y", '<link href="/z" rel="canonical">')], "page_id long, url string, html string")
    start = time.perf_counter()
    assert ("http://a.org/y", "http://a.org/z") in {tuple(r) for r in alias_edges(pages).collect()}
    assert time.perf_counter() - start < 20
