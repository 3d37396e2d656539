"""Queries with SQL equivalents against DuckDB, the others against plain Python, on the smallest tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from askspark.llm import queries
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), con, queries.ORACLES[name]) == []


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_token_counts_equal_the_tokenizer(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op3_token_counts(spark, SF_DIR).collect()}
    for i, t in texts.items():
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 2048)


def test_bpe_equals_the_tokenizer(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op10_bpe_round_trip(spark, SF_DIR).collect()}
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_base_score_is_the_smoothed_unigram(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall("[^\x20\x09-\x0d]+", t.translate(lower)) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    p = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    for r in queries.op5_score_texts(spark, SF_DIR).collect():
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own) + 1, n)
        assert r.n_known == sum(w in counts for w in own) + 1
        assert r.base_score == pytest.approx(sum(p(counts[w]) for w in own) + p(ends), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
