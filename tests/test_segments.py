"""The segment index against the plain search over what holds."""

import random

import pytest
from askspark.operators import segments as S
from askspark.operators.lexical import bm25_top_k, term_stats
from askspark.session import scratch_path
from askspark.streaming import jobs


def chunk_rows(documents):
    return [(d, f"{d}#{i}", t) for d, texts in documents.items() for i, t in enumerate(texts)]


def frame(spark, documents):
    chunks = spark.createDataFrame(chunk_rows(documents), "document long, key string, text string")
    return chunks, spark.createDataFrame([(d,) for d in documents], "document long")


def queries(spark):
    return spark.createDataFrame([(1, "w1 w2 rare7"), (2, "w3 w3 w0"), (3, "unheard"), (4, None), (5, "rare2 rare9 w5")], "qid int, text string")


def found(hits):
    return sorted((r["qid"], r["rank"], r["key"], round(r["score"], 6)) for r in hits.collect())


def plain(spark, documents):
    chunks, _ = frame(spark, documents)
    return found(bm25_top_k(queries(spark), term_stats(chunks, "key")))


def some(rng, ids):
    word = lambda: f"w{min(int(rng.expovariate(0.4)), 30)}" if rng.random() < 0.98 else f"rare{rng.randrange(12)}"
    return {i: [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 4))] for i in ids}


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 16)


def test_batches_updates_and_deletes_equal_the_plain_search(spark):
    rng = random.Random(1)
    path = scratch_path(spark, "segments")
    index, held = S.open_index(spark, path), {}
    assert index.segments == []
    steps = [some(rng, range(0, 120)), some(rng, range(100, 160)), {5: [], 6: [], 150: []}, some(rng, [5, 900, 17]), some(rng, range(300, 340)), {900: []}]
    for batch, documents in enumerate(steps):
        index = S.add_batch(index, *frame(spark, documents), batch)
        held = {d: t for d, t in {**held, **documents}.items() if t}
        again = S.add_batch(S.open_index(spark, path), *frame(spark, documents), batch)
        assert again.segments == index.segments  # a repeated batch changes nothing
        if batch in (3, 5):
            assert found(S.block_max_top_k(queries(spark), index).hits) == plain(spark, held)
    assert len(index.segments) < len(steps)  # some were merged
    assert sorted((r["document"], r["key"]) for r in index.chunks().collect()) == sorted((d, k) for d, k, _ in chunk_rows(held))


def test_blocks_that_cannot_win_stay_closed(spark):
    """Blocks opened for a query grow far less than the index."""
    opened = {}
    for n in (400, 3200):
        rng = random.Random(2)
        documents = {i: [" ".join(f"w{rng.randrange(6)}" for _ in range(20)) + (f" key{i % 10}" if i < 30 else "")] for i in range(n)}
        index = S.add_batch(S.open_index(spark, scratch_path(spark, "segments")), *frame(spark, documents), 0)
        asked = spark.createDataFrame([(i, f"key{i} w1 w2") for i in range(10)], "qid int, text string")
        search = S.block_max_top_k(asked, index, k=3)
        assert search.hits.count() == 30
        opened[n] = search.read.first()
    assert opened[3200]["pairs"] > 6 * opened[400]["pairs"]
    assert opened[3200]["opened"] < 2 * opened[400]["opened"] and opened[3200]["opened"] < 0.2 * opened[3200]["pairs"]


def test_empty_index_and_empty_queries(spark):
    index = S.add_batch(S.open_index(spark, scratch_path(spark, "segments")), *frame(spark, {}), 0)
    assert S.block_max_top_k(queries(spark), index).hits.count() == 0
    index = S.add_batch(index, *frame(spark, {1: ["w1 w2"]}), 1)
    assert S.block_max_top_k(queries(spark).limit(0), index).hits.count() == 0
    assert found(S.block_max_top_k(queries(spark), index).hits) == plain(spark, {1: ["w1 w2"]})


def test_streamed_documents_replace_and_delete(spark):
    source, path, progress = (scratch_path(spark, n) for n in ("incoming", "segments", "segments-progress"))
    held = {}
    for batch in ({1: "w1 w2", 2: "w3 rare7"}, {2: "w1 w1 w5", 3: "rare2"}, {1: None, 4: " ", 5: "w2 rare9"}):
        spark.createDataFrame(list(batch.items()), "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        jobs.stream_segments(jobs.file_stream(spark, f"{source}/*.parquet", spark.read.parquet(source).schema), path, progress).awaitTermination()
        held = {d: t for d, t in {**held, **{d: [t] if t and t.strip() else [] for d, t in batch.items()}}.items() if t}
    index = S.open_index(spark, path)
    assert [s.number for s in index.segments] == [0, 1, 2]
    assert found(S.block_max_top_k(queries(spark), index).hits) == plain(spark, held)


def test_blocks_hold_places_and_large_query_tables_come_in_parts(spark, monkeypatch):
    """Postings are two numbers each, a slice names its chunks once, and queries beyond the shared size find the same."""
    held = some(random.Random(3), range(80))
    index = S.add_batch(S.open_index(spark, scratch_path(spark, "segments")), *frame(spark, held), 0)
    blocks = index.read("blocks")
    assert "entries" not in blocks.columns
    assert blocks.where("term IS NULL").count() == blocks.select("slice").distinct().count()
    whole = S.block_max_top_k(queries(spark), index)
    monkeypatch.setattr(S, "MAX_SHARED_BYTES", 100)
    parts = S.block_max_top_k(queries(spark), index)
    assert found(parts.hits) == found(whole.hits) == plain(spark, held)
    assert parts.read.first() == whole.read.first()
