"""The splitter against a plain piece-by-piece packer, and its promises on any text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from askspark.operators import chunking as C

spans = C._splitter(C.SEPARATORS)


def pieces_of(text, sep):
    return list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})" if len(sep) == 1 else f"(?={sep})", text) if p]


def plain(text, size, overlap, seps):
    """Pieces are queued one at a time; a full queue is written out and shortened from the front."""
    while seps and seps[0] and seps[0] not in text:
        seps = seps[1:]
    done, queue = [], []
    for piece in pieces_of(text, seps[0]):
        if len(piece) >= size:
            if queue:
                done.append("".join(queue))
            queue = []
            done += plain(piece, size, overlap, seps[1:]) if seps[1:] else [piece]
            continue
        if sum(map(len, queue)) + len(piece) > size:
            done.append("".join(queue))
            while queue and (sum(map(len, queue)) > overlap or sum(map(len, queue)) + len(piece) > size):
                queue.pop(0)
        queue.append(piece)
    if queue:
        done.append("".join(queue))
    return done


words = st.text(alphabet="ab é😀", max_size=40)
texts = st.lists(words, max_size=30).flatmap(lambda ws: st.sampled_from(["\n", " ", "\n\n", "x"]).map(lambda s: s.join(ws)))


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(3, 40), st.integers(0, 20))
def test_equals_plain_packer(text, size, overlap):
    overlap = min(overlap, size - 1)
    if "\n\n\n" in text:  # overlapping matches of a blank line; covered by the promises below
        return
    assert [text[s:e] for s, e in spans(text, size, overlap)] == (plain(text, size, overlap, list(C.SEPARATORS)) if text else [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40), st.integers(0, 20))
def test_promises(text, size, overlap):
    overlap = min(overlap, size - 1)
    found = spans(text, size, overlap)
    covered = 0
    for s, e in found:
        assert 0 < e - s <= size and s <= covered and covered - s <= overlap
        covered = e
    assert covered == len(text)


def test_paragraphs_before_lines(spark):
    text = "one two\nthree\n\nfour five\n\nsix"
    rows = C.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id int, text string"), 16, 0)
    assert [(r["doc_id"], r["chunk_no"], r["start"], r["text"]) for r in rows.orderBy("doc_id", "chunk_no").collect()] == [
        (1, 0, 0, "one two\nthree"), (1, 1, 15, "four five\n\nsix")]


def test_tiers(spark):
    rows = C.chunk_tier(spark.createDataFrame([(1,), (5,), (6,), (15,), (16,)], "n_pages int"))
    assert [(r[1], r[2]) for r in rows.collect()] == [(500, 50), (500, 50), (1000, 100), (1000, 100), (2000, 200)]


def test_whole_text_of_a_huge_document(spark):
    text = " ".join(f"word{i}" for i in range(200_000))
    rows = C.chunk_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"), 500, 0).collect()
    assert " ".join(r["text"] for r in sorted(rows, key=lambda r: r["start"])) == text
