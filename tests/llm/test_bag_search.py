"""Ranked search over classes against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from askspark.llm import bag_search as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w in set(words(text)) if b[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, m int, item_id string")
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in B.lexical_top_k(d, q, **more).collect()), key=str)


def sample(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "été", "Straße", "x1", "42", "naïve", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for i in range(n)]
    docs += [(1000 + i, "The w1-w2, OF w3!") for i in range(150)] + [(None, "the w1 w2 of w3"), (5, None), (6, ""), (7, "!? --"), (1000, "The w1-w2, OF w3!")]
    docs += [(2000, "w1 " * 20_000 + "the"), (-4, "w1 w2 w3 the of")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(20)] + [(100, None), (101, ""), (102, "unheard of"), (103, "nothing-known-at-all"), (3, "w1 w2"), (3, "w1 w2"), (None, "w3 été")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scoring_every_document(spark, seed):
    docs, items = sample(seed)
    assert found(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_and_small_portions(spark, monkeypatch):
    docs, items = sample(3, 120)
    monkeypatch.setattr(B, "TRIPLES", 50)
    monkeypatch.setattr(B, "SCORES", 60)
    assert found(spark, docs, items, item_bytes=300) == brute(docs, items)
    monkeypatch.setattr(B, "EXACT_WORDS", 0)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = sample(4, 20)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_equal_vectors_of_equal_length_are_scored_once(spark):
    docs = spark.createDataFrame([(i, "a b unheard" if i % 2 else "b a other") for i in range(50)] + [(99, "a b")], "id long, text string")
    vectors = B.term_vectors(docs, {b"a": 0, b"b": 1})
    from pyspark.sql import functions as F

    rows = B.classes_of(vectors.withColumn("m", F.col("n")), 10).collect()
    assert sorted((r["m"], [x["id"] for x in r["members"]]) for r in rows) == [(2, [99]), (3, list(range(10)))]
