"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import itertools
import math
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from askspark.llm.bpe import bpe_round_trip
from askspark.llm.decontaminate import find_benchmark
from askspark.llm.jaccard_join import similar_components
from askspark.llm.lattice_lm import score_texts
from askspark.llm.license_scan import scan_licenses
from askspark.llm.nearest import nearest
from askspark.llm.quality import score_quality
from askspark.llm.revisits import resolve_revisits
from askspark.llm.token_counts import token_counts
from askspark.llm.url_filter import filter_urls, resolved
from tests.llm.test_methods import documents_of_shared_passages, similar_by_force

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "Under the MIT License. " + " ".join(f"word{i % 977}" for i in range(60_000)) + "x" * 30_000
ITEM = " ".join(f"bench{i}" for i in range(14))
ROWS = [
    (1, None, "en", "s"), (2, "", None, "s"), (3, LONG, "en", None), (4, "one two three four five six seven", "en", "s"),
    (4, "one two three four five six seven", "en", "s"), (5, f"Before {ITEM.upper()}, after.", "en", "s"), (6, " \n\t ", "en", "s"),
    (7, "one two three four five six seven", "de", "s"), (None, "a row without an id", "en", "s"), (8, "\x00\ufffd 𐍈𐍈 <|endoftext|>", "xx", "s"),
]
#: Columns that operators make or use themselves.
CLASHES = (
    "row id w n_words n_hit items hit_spans contaminated _n_words _spans _items keep p_poor _poor _host _path ids decoded n_tokens round_trip "
    "same prefix gram n_shingles component_id held_out score known base lattice labels spans n_bytes over_limit"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return table.withColumns({c: F.lit("clash") for c in CLASHES}).withColumn("a.b", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (3, 0, None), (None, 0, 1), (5, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(10, ITEM), (9, ITEM), (11, "five six"), (12, None), (13, "")], "item_id long, text string")


def both(run, docs):
    """Rows of the table, after the empty table gave none with the same columns."""
    out, none = run(docs), run(docs.where("false"))
    assert none.columns == out.columns and none.count() == 0
    return out.collect()


def test_token_counts(docs):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    got = both(lambda d: token_counts(d, WORD_BPE), docs)
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in ROWS]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)


def test_bpe(docs):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    got = both(lambda d: bpe_round_trip(d, BYTE_BPE, keep_columns=True, with_ids=True), docs)
    assert len(got) == len(ROWS)
    for r in got:
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.round_trip and r.decoded == (r.text or "") and r.n_tokens == len(r.ids)


def test_decontaminate(docs, benchmark):
    got = both(lambda d: find_benchmark(d, benchmark), docs)
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in got if r.contaminated) == [
        (4, 2, ["11"]), (4, 2, ["11"]), (5, 14, ["10", "9"]), (7, 2, ["11"]),
    ]
    assert len(got) == len(ROWS) and all(r.n_words == 0 for r in got if r.doc_id in (1, 2, 6))
    assert not any(r.contaminated for r in find_benchmark(docs, benchmark.where("false")).collect())


def test_many_windows_take_several_passes(docs, benchmark, monkeypatch):
    shown = ["doc_id", "n_words", "n_hit", "items", "hit_spans", "contaminated"]
    rows = lambda: sorted(map(str, find_benchmark(docs, benchmark).select(shown).collect()))
    once = rows()
    monkeypatch.setattr("askspark.llm.decontaminate.PASS_PATTERNS", 2)
    assert rows() == once


def test_quality(docs, labels):
    got = both(lambda d: score_quality(d, labels), docs)
    assert len(got) == len(ROWS) and all(0 <= r.p_poor <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert all(r.keep for r in score_quality(docs, labels.where("false")).collect())


def test_many_paths_are_joined(docs, labels, monkeypatch):
    once = score_quality(docs, labels).select("doc_id", "p_poor").orderBy("doc_id").collect()
    monkeypatch.setattr("askspark.llm.quality.SMALL_TABLE", 0)
    assert [r.p_poor for r in score_quality(docs, labels).orderBy("doc_id").collect()] == pytest.approx([r.p_poor for r in once])


def test_language_model(docs, monkeypatch):
    got = both(lambda d: score_texts(d, F.col("doc_id") == 7, PIECES), docs)
    assert len(got) == len(ROWS) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].held_out and by_id[7].held_out and not by_id[4].held_out
    assert by_id[7].score == pytest.approx(by_id[4].score) and by_id[1].n_tokens == by_id[6].n_tokens == 1
    monkeypatch.setattr("askspark.llm.lattice_lm.FREQUENT", 0)
    joined = {r.doc_id: r for r in score_texts(docs, F.col("doc_id") == 7, PIECES).collect()}
    for i, r in by_id.items():
        assert (joined[i].n_known, joined[i].base_score, joined[i].score) == (r.n_known, pytest.approx(r.base_score), pytest.approx(r.score))
    untrained = score_texts(docs, F.lit(True), PIECES).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)


def test_licenses(spark, docs):
    got = both(scan_licenses, docs)
    found = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and (found[3].n_base, found[3].first_word, found[3].labels) == (1, 0, "mit")
    assert found[1].labels == "" and found[1].first_word is None and found[1].score == 0
    changed = "note: Redistribution and use in source and also binary forms, with or without modification, are permitted provided that these following conditions are met"
    shown = scan_licenses(spark.createDataFrame([(1, changed), (2, "cc by nc cc by nc")], "doc_id long, text string")).collect()
    assert [(r.labels, r.n_base) for r in sorted(shown)] == [("", 0), ("cc-by-nc", 2)]  # 14 of the notice's 19 trigrams are left, less than 0.8


def test_words_left_out_are_neighbouring_diagonals(spark):
    text = "x Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction"
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "mit" and r.n_base == 0 and 0.8 <= r.score < 1 and r.spans[0].start == 1


def test_similar(docs):
    got = both(lambda d: similar_components(d, 4, 85, 100), docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id not in (3, None)) == [
        (1, 0, 1), (2, 0, 2), (4, 4, 4), (4, 4, 4), (5, 13, 5), (6, 0, 6), (7, 4, 4), (8, 1, 8),
    ]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_urls(spark):
    link = '<html><link href="https://x.example.com/de/1" rel="canonical"></html>'
    pages = spark.createDataFrame([
        (1, "https://a.net/1", link), (2, "HTTP://User@EXAMPLE.org/es/x?y#z", None), (3, None, link), (4, "no scheme", ""), (5, "http://x.example.com/de/1", None),
        (6, "http://b.net/q", '<meta http-equiv="refresh" content="0; url=http://a.net/1/">'), (6, "http://b.net/q", None), (7, "http://c.net", None),
        (8, "http://free.org/", link), (9, "http://org", None), (None, "x://y://z", None),
    ], "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("node", "host", "path", "own", "component", "a", "b", "u", "v")})
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("com/de/", "block")]
    run = lambda p: filter_urls(p, rules)
    got = both(run, pages)
    assert len(got) == 11
    by_id = {r.page_id: r for r in got}
    assert (by_id[2].host, by_id[2].path, by_id[2].rule, by_id[2].verdict) == ("user@example.org", "/es/x", "org/", "allow")
    assert by_id[8].rule == "org/" and by_id[8].verdict == "allow" and by_id[5].verdict == "block"
    assert by_id[1].verdict == by_id[6].verdict == "allow"  # an explicitly allowed alias goes before the blocked one
    assert (by_id[3].host, by_id[4].path, by_id[9].rule, by_id[None].host) == ("", "", None, "y:")
    without = {r.page_id: r.verdict for r in run(pages.where("page_id <> 8")).collect()}
    assert without[1] == without[6] == "block" and without[7] == "allow"


def test_relative_targets_are_aliases(spark):
    base = "https://H.net/a/b/c.html?q=1#f"
    want = {
        "//X.org/y": "https://X.org/y", "/en/1?z": "https://h.net/en/1?z", "p.html": "https://h.net/a/b/p.html", "../p#g": "https://h.net/a/p#g", "../../../..": "https://h.net/",
        "./": "https://h.net/a/b/", "..": "https://h.net/a/", "?r=2": "https://h.net/a/b/c.html?r=2", "#g": base, "go?to=http://x.org/": "https://h.net/a/b/go?to=http://x.org/",
        "HTTP://x.org/": "HTTP://x.org/", "mailto:x": "mailto:x", "": "",
    }
    table = spark.createDataFrame([(t, base) for t in want], "target string, url string")
    assert {r.target: r.got for r in table.select("target", resolved(F.col("target"), F.col("url")).alias("got")).collect()} == want
    bare = spark.createDataFrame([("/x", "no scheme"), ("p", "http://h.net"), ("/x", None)], "target string, url string")
    assert [r[0] for r in bare.select(resolved(F.col("target"), F.col("url"))).collect()] == [None, "http://h.net/p", None]
    pages = spark.createDataFrame([
        (1, "https://h.net/fr/1", '<link rel="canonical" href="/bad/1">'), (2, "https://h.net/es/2", '<link rel=canonical href="//bad.net/2">'),
        (3, "https://h.net/bad/x/3", ""), (4, "https://h.net/de/4", '<meta http-equiv="refresh" content="0; url=../bad/4">'), (5, "https://h.net/en/5", '<link rel="canonical" href="5b">'),
    ], "page_id long, url string, html string")
    verdicts = {r.page_id: r.verdict for r in filter_urls(pages, [("h.net/bad/", "block"), ("bad.net/", "block")]).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        ("r1", "http://www.A.com:80/x/", 10, "response", 200, h(ETag='W/"1"', Content_Type="text/html", Server="a"), "d1"),
        ("r2", "https://a.com/x?utm_source=f", 20, "response", 404, h(ETag='"2"'), "d2"),
        ("v1", "https://a.com/x#top", 30, "revisit", 304, h(etag='"1"', Date="now", Server="b", Content_Type="no"), None),
        ("v1", "https://a.com/x#top", 30, "revisit", 304, h(etag='"1"', Date="now", Server="b", Content_Type="no"), None),
        ("v2", "https://a.com/x", 10, "revisit", 304, h(etag='"1"'), None), ("v3", "https://a.com/x", 10**7, "revisit", 304, h(etag='"9"'), None),
        ("v4", "https://a.com/x", 40, "revisit", 304, None, None), ("v5", None, 40, "revisit", 304, None, None),
        ("v6", "https://a.com/x", None, "revisit", None, None, None), (None, "https://a.com/x", 41, "revisit", 304, h(ETag='"1"'), None), ("x", "y", 1, None, None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id string, url string, captured_at long, record_type string, status int, headers map<string,string>, digest string")
    records = records.withColumns({c: F.lit("clash") for c in ("at", "span", "original", "o", "verdict", "start")})
    got = both(lambda r: resolve_revisits(r), records)
    assert sorted((r.record_id or "", r.verdict, r.original_id) for r in got) == [
        ("", "resolved", "r1"), ("v1", "resolved", "r1"), ("v1", "resolved", "r1"), ("v2", "no_original", None), ("v3", "validator_mismatch", "r1"),
        ("v4", "no_validator", "r1"), ("v5", "no_original", None), ("v6", "no_original", None),
    ]
    first = next(r for r in got if r.record_id == "v1")
    assert first.headers == {"etag": '"1"', "content-type": "text/html", "server": "a", "date": "now"} and first.digest == "d1"


def test_nearest(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (50, None)], "vec_id long, embedding array<double>")
    table = table.withColumns({c: F.lit("clash") for c in ("id", "v", "asks", "first", "ids", "vec", "q", "score")})
    got = both(lambda t: nearest(t, F.col("vec_id") == 1), table)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(1, 1, 2, 1.0), (1, 2, 3, 0.0)]


def test_pipeline_stages(spark, docs, tmp_path):
    sf = str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "a.b": F.lit(1), "keep": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES:
        kept = both(lambda d, stage=stage: stage(spark, d, sf), plain)
        ids = [r.doc_id for r in kept]
        if name == "near duplicates":
            assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 8] and None in ids
        else:
            assert {1, 2, 4, 7} <= set(ids)
        if name != "tokens":
            assert set(kept[0].asDict()) == set(plain.columns)


def test_near_duplicate_stage_finds_pairs_whose_lists_have_unrelated_hubs(spark):
    texts = documents_of_shared_passages(30, 40, 12)
    want = similar_by_force(texts, 5, 80, 100)
    assert sum(i != c for i, c in want.items()) == 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i, c in want.items() if i == c]


def test_pipeline_keeps_clean_and_drops_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    good = {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    left = docs.where(F.col("doc_id").isin(list(good)))
    first = {r.doc_id for r in similar_components(left).collect() if r.doc_id == r.component_id}
    clean = {r.doc_id for r in find_benchmark(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("NOT contaminated").collect()}
    assert kept == first & clean and len(kept) > 500


def test_stages_equal_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode().lower().decode() for r in docs.collect()}
    sets = {}
    for i, t in texts.items():
        w = t.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    first = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((first[a], first[b]))
            first = {i: low if c == high else c for i, c in first.items()}
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_similar(spark, docs, sf).collect())
    assert kept == sorted(i for i, c in first.items() if i == c) and len(kept) < len(texts)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    cut = lambda w, m: {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words((r.text or "").encode().lower().decode())
        if w:
            windows.setdefault(min(len(w), 10), set()).update(cut(w, min(len(w), 10)))
    clean = sorted(i for i, t in texts.items() if not any(cut(words(t), m) & own for m, own in windows.items()))
    assert sorted(r.doc_id for r in corpus_pipeline.keep_clean(spark, docs, sf).collect()) == clean and len(clean) < len(texts)
