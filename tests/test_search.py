"""Exact search against brute force, with copies that tie and queries beyond the shared size."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askspark.operators import lexical as L
from askspark.operators import retrieval as S
from askspark.operators import vectors as V

TEXTS = ["the cat sat", "the cat sat", "a dog ate the cat", "dogs and cats", "", "the the the the", "one cat, one dog", "Sat on the mat"] + ["the cat sat"] * 40
QUERIES = {1: "the cat", 2: "dog dog cat", 3: "zebra", 4: "", 5: "mat the"}


def brute_bm25(texts, query, k, tokenize, idf_kind):
    docs = [tokenize(t) for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    logs = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    if idf_kind == "okapi":
        idf = {t: v if v >= 0 else 0.25 * sum(logs.values()) / len(logs) for t, v in logs.items()}
    else:
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    hits = []
    for i, d in enumerate(docs):
        tf = Counter(d)
        if any(t in tf for t in tokenize(query)):
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in tokenize(query) if t in tf)
            hits.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(hits)[:k]]


def index(spark, tokenizer="words"):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").repartition(5)
    return L.term_stats(rows, "id", tokenizer=tokenizer)


@pytest.mark.parametrize("kind,tokenizer,shared", [("plus_one", "words", None), ("plus_one", "words", 64), ("okapi", "whitespace", None)])
def test_bm25(spark, kind, tokenizer, shared):
    tokenize = (lambda t: re.findall("[a-z0-9]+", t.lower())) if tokenizer == "words" else str.split
    queries = spark.createDataFrame(list(QUERIES.items()), "qid int, text string")
    rows = L.bm25_top_k(queries, index(spark, tokenizer), idf=kind, max_shared_bytes=shared).collect()
    for qid, text in QUERIES.items():
        got = [(r["key"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == qid]
        want = brute_bm25(TEXTS, text, 4, tokenize, kind)
        assert [k for k, _ in got] == [k for k, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    queries = spark.createDataFrame(list(QUERIES.items()), "qid int, text string")
    fresh = index(spark)
    L.store_index(fresh, str(tmp_path / "index"))
    stored = L.load_index(spark, str(tmp_path / "index"))
    assert sorted(L.bm25_top_k(queries, stored).collect()) == sorted(L.bm25_top_k(queries, fresh).collect())
    assert sorted(stored.postings.collect()) == sorted(fresh.postings.collect())


@pytest.mark.parametrize("metric,shared", [("l2", None), ("l2", 256), ("cosine", None)])
def test_dense(spark, metric, shared):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 8)).astype(np.float32)
    points[100:200] = points[0]  # a third of all vectors are copies
    asked = np.vstack([points[0], rng.normal(size=(9, 8))]).astype(np.float32)
    vectors = spark.createDataFrame([(f"k{i:03d}", p.tolist()) for i, p in enumerate(points)] + [("none", None)], "key string, vector array<float>")
    queries = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "qid int, vector array<float>")
    rows = V.dense_top_k(queries, vectors.repartition(6), k=5, metric=metric, max_shared_bytes=shared).collect()
    a, b = asked.astype(float), points.astype(float)
    if metric == "cosine":
        far = 1 - (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    else:
        far = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    for q in range(len(a)):
        want = sorted((round(d, 9), f"k{i:03d}") for i, d in enumerate(far[q]))[:5]
        got = sorted((r for r in rows if r["qid"] == q), key=lambda r: r["rank"])
        assert [r["key"] for r in got] == [k for _, k in want]
        assert [r["score"] for r in got] == pytest.approx([d for d, _ in want], abs=1e-6)


def test_cells_give_the_same_hits_and_skip(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 20
    points = np.vstack([c + rng.normal(size=(50, 8)) for c in centres])
    points[:100] = points[0]  # copies fill a third of the corpus
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "key bigint, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in (0, 120, 121, 299)], "qid bigint, vector array<double>")
    for n_cells in (40, 3):  # with fewer pivots than k there is no bound, and nothing is skipped
        cells = V.build_cells(vectors, n_cells)
        hits = V.dense_top_k_in_cells(queries, cells, k=4)
        assert sorted((r["qid"], r["rank"], r["key"]) for r in hits.collect()) == sorted(
            (r["qid"], r["rank"], r["key"]) for r in V.dense_top_k(queries, vectors, k=4).collect())
        plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
        assert ("In(cell" in plan) == (n_cells == 40)


def test_no_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "key bigint, vector array<float>")
    assert V.dense_top_k(vectors.limit(0).withColumnRenamed("key", "qid"), vectors).count() == 0


def test_fusion(spark):
    sparse = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "qid int, key int, rank int")
    dense = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "qid int, key int, rank int")
    rows = S.fuse_ranks(sparse, dense).orderBy("rank").collect()
    assert [r["key"] for r in rows] == [20, 30, 10]
    assert rows[0]["score"] == pytest.approx(0.3 / 62 + 0.7 / 61)
    texts = spark.createDataFrame([(10, "x"), (20, "y"), (30, "x")], "key int, text string")
    merged = S.fuse_ranks(sparse, dense, merge_on=texts).orderBy("rank").collect()
    assert [(r["key"], round(r["score"], 6)) for r in merged] == [(20, round(0.3 / 62 + 0.7 / 61, 6)), (10, round(0.3 / 61 + 0.7 / 62, 6))]


def test_retrieve_cuts_and_repeats(spark):
    texts = index(spark)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(len(TEXTS))], "key bigint, vector array<float>")
    subs = spark.createDataFrame(
        [(1, "none", 0, "the cat", [0.0, 1.0]), (2, "expansion", 0, "the cat", [0.0, 1.0]), (2, "expansion", 1, "cat", [0.0, 1.0]), (3, "hyde", 0, "dog", [5.0, 1.0])],
        "qid bigint, strategy string, sub_no int, text string, vector array<float>")
    rows = S.retrieve(subs, texts, vectors).collect()
    sizes = Counter(r["qid"] for r in rows)
    assert sizes[2] == 4 and sizes[3] == 4 and 4 <= sizes[1] <= 8
    once = S.retrieve(subs, texts, vectors, dedupe=True).where("qid = 2").collect()
    assert len(once) == len({r["key"] for r in once}) < 4
    context = S.assemble_context(
        spark.createDataFrame([(1,), (9,)], "qid bigint"), S.retrieve(subs, texts, vectors),
        spark.createDataFrame(list(enumerate(TEXTS)), "key bigint, text string")).orderBy("qid").collect()
    assert context[0]["found"] and context[0]["context"].startswith("the cat sat\n\n---\n\n")
    assert not context[1]["found"] and context[1]["context"] is None


def test_text_vectors_find_their_own_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["apples and pears", "cars and roads", "stars at night", ""])], "key bigint, text string")
    weights = V.rarity_weights(rows)
    vectors = V.embed_text(rows, weights=weights)
    asked = V.embed_text(rows.where("key < 3").withColumnRenamed("key", "qid"), weights=weights)
    hits = V.dense_top_k(asked, vectors, k=1).collect()
    assert all(h["qid"] == h["key"] and h["score"] == pytest.approx(0, abs=1e-5) for h in hits) and len(hits) == 3
    assert vectors.where("key = 3").select(F.array_max(F.transform("vector", F.abs))).first()[0] == 0


@pytest.mark.parametrize("shared", [None, 300])
def test_unusable_vectors_cost_no_hits(spark, shared):
    good = [(i, [float(i), 1.0]) for i in range(4)]
    bad = [(10, [None, 1.0]), (11, [float("nan"), 1.0]), (12, [0.0, 0.0]), (13, [0.0, 0.0])]
    vectors = spark.createDataFrame(good + bad, "key int, vector array<double>")
    queries = spark.createDataFrame([(1, [0.1, 1.0]), (2, [None, 1.0]), (3, [0.0, 0.0])], "qid int, vector array<double>")
    near = V.dense_top_k(queries, vectors, k=2, max_shared_bytes=shared).collect()
    assert {(r["qid"], r["key"]) for r in near} == {(1, 0), (1, 1), (3, 12), (3, 13)}
    around = V.dense_top_k(queries, vectors, k=5, metric="cosine", max_shared_bytes=shared).collect()
    assert [r["key"] for r in sorted(around, key=lambda r: (r["qid"], r["rank"]))] == [0, 1, 2, 3, 12, 0, 1, 2, 3, 12]


def test_large_norms_stay_exact(spark):
    rng = np.random.default_rng(9)
    points = 1e5 + rng.normal(size=(400, 8)) * 2e-3
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "key bigint, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 400, 40)], "qid bigint, vector array<double>")
    exact = ((points[::40, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    want = {(40 * q, k) for q in range(10) for _, k in sorted((round(s, 9), k) for k, s in enumerate(exact[q]))[:4]}
    for hits in (V.dense_top_k(queries, vectors), V.dense_top_k_in_cells(queries, V.build_cells(vectors, 20))):
        assert {(r["qid"], r["key"]) for r in hits.collect()} == want


def test_null_text_is_no_hit(spark):
    rows = spark.createDataFrame([(1, None), (2, "a cat")], "id bigint, text string")
    queries = spark.createDataFrame([(1, "cat"), (2, None)], "qid int, text string")
    assert [(r["qid"], r["key"]) for r in L.bm25_top_k(queries, L.term_stats(rows, "id")).collect()] == [(1, 2)]


def test_texts_without_words_are_near_to_nothing(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "\u4e2d\u6587 !!"), (3, None), (4, "omega psi"), (5, "")], "key long, text string")
    weights = V.rarity_weights(rows)
    made = {r["key"]: r["vector"] for r in V.embed_text(rows, weights=weights, wordless="null").collect()}
    assert [k for k, v in made.items() if v is None] == [2, 3, 5]
    asked = spark.createDataFrame([(1, "omega zeta eta theta iota kappa lambda mu"), (2, "?")], "qid long, text string")
    hits = V.dense_top_k(V.embed_text(asked, weights=weights, wordless="null"), V.embed_text(rows, weights=weights, wordless="null")).collect()
    assert [(r["qid"], r["key"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(1, 4), (1, 1)]


def test_a_scoring_step_takes_a_bounded_number_of_rows():
    import pyarrow as pa

    from askspark.operators.search import _best

    seen = []
    prepare = lambda queries: (pa.array([1]), lambda part: seen.append(part.num_rows) or np.arange(part.num_rows, dtype=float)[None, :])
    schema = pa.schema([("qid", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    batch = pa.RecordBatch.from_pydict({"key": list(range(10_000))})
    _best(prepare, 2, True)(pa.table({"qid": [1]}), iter([batch]), schema)
    assert sum(seen) == 10_000 and max(seen) <= 1024


def test_vectors_are_made_once_under_a_filter(spark):
    rows = spark.createDataFrame([(1, "alpha beta")], "key long, text string")
    made = V._usable(V.embed_text(rows, weights=[1.0] * 256))
    plan = made._sc._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
    assert plan.count("ArrowEvalPython") == 1
