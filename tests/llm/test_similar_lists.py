"""What the similarity join moves: n-grams are hashed in batches, texts stay where they are, decided pairs leave their lists."""

import random

import pyarrow as pa
import pytest

from askspark.llm import jaccard_join
from askspark.llm.jaccard_join import gram_sets, similar_components


def odd_texts(count: int) -> list[str | None]:
    rng = random.Random(1)
    words = ["a", "\u00c9", "\u00e9", "aB", "Ab", *("x" * k for k in (7, 8, 9, 15, 16, 17, 255, 256, 257, 3000)), "x" * 8 + "y", "x" * 300 + "y"]
    blanks = [" ", "\t\x0b", "\n", "\r \x0c", "\xa0", "\x1c ", " \u2003"]
    texts = ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.choice([0, 1, 2, 3, 5, 30]))) for _ in range(count)]
    return [None, "", " ", " \t", *(t.strip() if rng.random() < 0.5 else t for t in texts), None, ""]


@pytest.mark.parametrize("at_once", [10, 5000, 1 << 20])
def test_hashes_are_equal_just_where_ngrams_are(monkeypatch, at_once):
    monkeypatch.setattr(jaccard_join, "AT_ONCE", at_once)
    texts = odd_texts(800)
    column = pa.chunked_array([pa.array(texts[:300]), pa.array([], pa.string()), pa.array(["not this", *texts[300:]]).slice(1)])
    for n in (1, 4, 9):
        known: dict = {}
        got = list(gram_sets(column, n))
        assert len(got) == len(texts)
        for text, grams in zip(texts, got):
            w = (text or "").encode().lower().split()
            want = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
            assert len(grams) == len(want) and grams.tolist() == sorted(set(grams.tolist()))
            for g in want:
                known[g] = known.get(g, set(grams.tolist())) & set(grams.tolist())
        assert all(known.values())  # a gram has a hash that is in all sets with it
        assert len(set().union(*(g.tolist() for g in got))) == len(known)


def test_texts_are_not_written_and_lists_of_two_are_decided_by_their_hub(spark, monkeypatch):
    rng = random.Random(4)
    texts = {}
    for i in range(0, 60, 2):  # pairs that share their first half and nothing else; every third is a near copy
        base = [f"w{rng.randrange(10**9)}" for _ in range(80)]
        texts[i] = " ".join(base)
        texts[i + 1] = " ".join(base[:40] + ([f"w{rng.randrange(10**9)}" for _ in range(40)] if i % 3 else [*base[40:79], "new"]))
    written: dict = {}
    plain = jaccard_join.cut_lineage

    def cut(df, purpose):
        out = plain(df, purpose)
        written.setdefault(purpose, []).append(out)
        return out

    monkeypatch.setattr(jaccard_join, "cut_lineage", cut)
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == {i: i - 1 if i % 2 and (i - 1) % 3 == 0 else i for i in texts}
    assert not [p for p, tables in written.items() if any("text" in t.columns for t in tables)]
    assert [t.count() for t in written["known"]] == [0]
