"""Simple-8b words and token files, held against the ids themselves and the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from askspark.llm import simple8b
from askspark.llm.token_files import read_token_files, with_starts, write_token_files
from askspark.session import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def round_trip(ids):
    words, escapes, word_at, escape_at = simple8b.pack(np.array(ids, np.uint32))
    assert simple8b.unpack(words, escapes, word_at, len(ids)).tolist() == list(ids)
    blocks = [simple8b.unpack_block(words, escapes, word_at, escape_at, len(ids), k).tolist() for k in range(len(word_at))]
    assert [x for b in blocks for x in b] == list(ids)
    return words, escapes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=600))
def test_any_ids_round_trip(ids):
    round_trip(ids)


@pytest.mark.parametrize("n", [0, 1, 239, 240, 1023, 1024, 1025, 9000])
def test_blocks_and_runs(n):
    round_trip([0] * n)
    round_trip([2**k - 1 for k in range(33)] * 3 + [1] * n)
    words, escapes = round_trip([7] * n + [2**32 - 1])
    assert n < 500 or len(words) < n / 10


def test_one_large_id_is_an_escape_and_does_not_widen_its_neighbours():
    ids = [900] * 59 + [4_000_000_000] + [900] * 60
    words, escapes = round_trip(ids)
    assert escapes.tolist() == [4_000_000_000] and len(words) <= 21


TEXTS = [
    (7, "Hello, world's  end\tnow"), (3, None), (None, "no id"), (1, ""), (2, "   \n"), (-5, "x" * 5000 + " tail"), (12, "<|endoftext|> a<|startoftext|>b"),
    (8, "É é ß ́b ΣΑΣ 日本\x0b\x0c1234 don't"), (9, "same"), (9, "same"), (9, "other"), (10, "word " * 30_000),
    (11, "End. end, END! Été? ÉTÉ étÉ; Straße: ÿÿ. e\u0301te\u0301. İstanbul. it's I'LL a.b ... x., 12. ªº."),
]


def written(spark, rows, with_ids=True):
    path = scratch_path(spark, "token-files")
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, path)
    return with_starts(read_token_files(spark, path, with_ids=with_ids))


def test_files_hold_the_ids_of_the_tokenizer_in_order(spark):
    rows = TEXTS + [(100 + i, f"text number {i} " * (i % 7)) for i in range(300)]
    found = sorted((r for r in written(spark, rows).collect()), key=lambda r: r["start"])
    assert len(found) == len(rows)
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    tokenizer, place = Tokenizer.from_file(WORDS), 0
    expected = sorted((i is not None, i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert expected == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in found)
    for r in found:
        assert (r["start"], r["n_tokens"]) == (place, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        place += len(r["ids"])


def test_no_documents_no_records(spark):
    assert written(spark, []).count() == 0


def test_columns_of_other_names_and_types(spark):
    docs = spark.createDataFrame([("b", "two words", 1, "x"), ("a", None, 2, "y"), (None, "z", 3, "w")], "key string, body string, record int, `at` string")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, WORDS, path, id_col="key", text_col="body")
    found = with_starts(read_token_files(spark, path, "string")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in found] == [(None, 0), ("a", 2), ("b", 3)]


def test_query_holds_every_document(spark):
    from askspark.llm.queries import op11_write_token_files

    sf_dir = "/root/testdata/sf0.001"
    found = op11_write_token_files(spark, sf_dir).orderBy("doc_id").collect()
    tokenizer, place = Tokenizer.from_file(WORDS), 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(found) == len(docs)
    for r, d in zip(found, docs):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (d["doc_id"], place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)
