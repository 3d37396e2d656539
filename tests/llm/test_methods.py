"""The parts of the operators against brute force."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from askspark.llm.bpe import AGREED, SPLIT, Encoder, Transducer, decode_stream, merge_bytes
from askspark.llm.components import connected_components
from askspark.llm.decontaminate import WuManber
from askspark.llm import jaccard_join
from askspark.llm.jaccard_join import divide_skip, may_link, parity_bits, searched, similar_components
from askspark.llm.lattice_lm import Lattice
from askspark.llm.nearest import hilbert_keys, nearest
from askspark.llm.quality import score_quality

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(BPE)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_transducer_in_portions_equals_merging_the_whole(encoder):
    rng = random.Random(5)
    letters = [b.decode() for b in encoder.v.ids if b.isalpha() and b.isascii()]
    for make in (lambda: "".join(rng.choices(letters, k=3000)), lambda: "a" * 9000, lambda: "".join(rng.choices("ab", k=9000)), lambda: "=" * 7001):
        data = make().encode()
        whole = [encoder.v.ids[p] for p in merge_bytes(data, encoder.v.ranks)]
        t, got, most = Transducer(encoder.v), [], 0
        for start in range(0, len(data), 137):
            got += t.feed(data[start : start + 137])
            most = max(most, len(t.kept))
        assert [*got, *t.end()] == whole
        assert most <= t.window + 137


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r\xa0ab'st1"))))
def test_encode_and_decode_any_text(encoder, tokenizer, text):
    for t in (text, text + "<|endoftext|>" + text):
        ids = list(encoder.encode(t))
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids
        assert "".join(decode_stream(ids, encoder.v.bytes, 3)) == tokenizer.decode(ids, skip_special_tokens=False) == t


def test_decoding_ids_that_are_no_text(encoder, tokenizer):
    rng = random.Random(2)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(40)]
        assert "".join(decode_stream(ids, encoder.v.bytes, 7)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_both_splitters_agree_on_the_agreed_characters(tokenizer):
    split, agreed = regex.compile(SPLIT).findall, regex.compile(AGREED).fullmatch
    for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x20000))):
        if agreed(c):
            text = f"a{c}1 {c}{c}b"
            assert split(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=8), st.lists(st.sampled_from("abcd"), max_size=40))
def test_wu_manber_finds_every_occurrence(patterns, words):
    for m in {len(p) for p in patterns}:
        own = sorted({tuple(p) for p in patterns if len(p) == m})
        want = [(i, p) for i in range(len(words) - m + 1) for p in own if tuple(words[i : i + m]) == p]
        assert sorted(WuManber(own).places(words)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1), st.lists(st.lists(st.integers(0, 30), min_size=1), max_size=12), st.sampled_from([(80, 100), (85, 100), (1, 3)]))
def test_divide_skip_equals_counting(query, candidates, limit):
    num, den = limit
    q, sets = np.unique(query), [np.unique(c) for c in candidates]
    want = [i for i, c in enumerate(sets) if den * len(np.intersect1d(q, c)) >= num * len(np.union1d(q, c))]
    assert divide_skip(q, sets, num, den) == want


def test_hilbert_keys_visit_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_keys(cells, bits)
        order = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells)))
        assert np.abs(np.diff(order, axis=0)).sum(axis=1).tolist() == [1] * (len(cells) - 1)


def test_lattice_sums_all_segmentations():
    pieces = {"a": math.log(0.2), "b": math.log(0.1), "ab": math.log(0.3), "ba": math.log(0.05), "aba": math.log(0.15)}
    lattice = Lattice(pieces, [math.log(0.001)] * 256)

    def brute(text: str) -> float:
        return 1.0 if not text else sum(math.exp(s) * brute(text[len(p) :]) for p, s in pieces.items() if text.startswith(p))

    for text in ("a", "ab", "abab", "ababa", "baba"):
        edges = lattice.edges(text)
        assert math.exp(lattice.forward(edges)[-1]) == pytest.approx(brute(text))
        assert math.exp(lattice.backward(edges)[0]) == pytest.approx(brute(text))
    assert lattice.forward(lattice.edges("é"))[-1] == pytest.approx(2 * math.log(0.001))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (500, 499)] + [(500, 499)] * 3
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {499: 499, 500: 499}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar_by_force(texts: dict[int, str], n: int, num: int, den: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(texts, 2):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_join_finds_chains_of_near_copies_and_hot_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts, number = {}, 0
    common = [rng.choice(words) for _ in range(30)]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(60)] + common
        for _ in range(20):  # each copy changes the one before it, so ends of a chain may differ widely
            base = [rng.choice(words) if rng.random() < 0.012 else w for w in base]
            texts[number], number = " ".join(base), number + 1
    for _ in range(30):
        texts[number], number = " ".join(common), number + 1
    texts[number] = ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, num, den in ((4, 85, 100), (5, 80, 100), (2, 50, 100)):
        got = {r.doc_id: r.component_id for r in similar_components(docs, n, num, den).collect()}
        assert got == similar_by_force(texts, n, num, den)


def sets_at_the_threshold(sizes, num, den, copies, seed):
    """Pairs of sets that just reach the threshold, and those pairs."""
    rng = np.random.default_rng(seed)
    draw = lambda k: rng.integers(-(2**63), 2**63 - 1, k)
    sets = []
    for size in sizes:
        own = (den - num) * size // (den + num)  # as many as equal sets at the threshold may have for themselves
        for _ in range(copies):
            both = draw(size - own)
            sets += [np.unique(np.concatenate([both, draw(own)])) for _ in range(2)]
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if den * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))}
    assert len(want) == len(sizes) * copies
    return sets, want


@pytest.mark.parametrize("num", [85, 80])
def test_sketches_leave_every_pair_at_the_threshold(num):
    sets, want = sets_at_the_threshold((60, 120, 300, 800, 1000, 2000, 5000, 20_000), num, 100, 6, num)
    n, bits = np.array([len(s) for s in sets]), [np.array(parity_bits(s), np.int64).view(np.uint64) for s in sets]
    none = [np.zeros(0, np.int64)] * len(sets)
    link = lambda pair, **more: may_link(n[pair], np.array([0, 1]), [bits[i] for i in pair], [none[i] for i in pair], 5, None, num, 100).tolist()
    for a, b in want:
        assert link([a, b]) == [True, True]
    apart = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if (a, b) not in want and 0.9 < n[a] / n[b] < 1.1]
    assert not any(any(link(list(p))) for p in apart)  # sets of any size that share nothing are ruled out


def test_a_pair_is_left_to_the_first_list_it_shares():
    bits = [np.zeros(8, np.uint64)] * 2
    ask = lambda firsts, gram, component=(0, 1), part=None: may_link(np.array([9, 9]), np.array(component), bits, [np.array(f, np.int64) for f in firsts], gram, part, 85, 100).tolist()
    assert ask(([1, 4], [2, 4]), 4) == [True, True] and ask(([1, 4], [2, 4]), 7) == [False, False]
    assert ask(([1], [2]), 7) == [True, True] and ask(([1], [2]), 7, (3, 3)) == [False, False]
    assert ask(([1], [2]), 7, part=np.array([0, 0])) == [False, False] and ask(([1], [2]), 7, part=np.array([0, 1])) == [True, True]


def test_index_search_joins_what_links(spark):
    rng = random.Random(9)
    for num, den in ((85, 100), (1, 2), (99, 100)):
        pool = [rng.randrange(-(2**63), 2**63) for _ in range(400)]
        sets = []
        for _ in range(12):
            seed = set(rng.sample(pool, rng.choice([5, 40, 200])))
            for _ in range(8):
                sets.append(np.array(sorted(seed ^ set(rng.sample(pool, rng.randrange(0, 1 + len(seed) // 8)))), np.int64))
        links = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if den * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))}
        got = searched(list(range(len(sets))), list(range(len(sets))), sets, num, den)
        assert set(got) <= links

        def groups(pairs):
            low = list(range(len(sets)))
            for _ in low:
                for a, b in pairs:
                    low[a] = low[b] = min(low[a], low[b])
            return low

        assert groups(got) == groups(links) and len(got) == len(sets) - len(set(groups(links)))
    sets, want = sets_at_the_threshold((2000, 5000, 20_000), 85, 100, 3, 2)
    assert set(searched(list(range(len(sets))), list(range(len(sets))), sets, 85, 100)) == want
    assert searched([0, 1], [7, 7], [sets[0]] * 2, 85, 100) == []


def documents_of_shared_passages(pairs: int, others: int, changed: int) -> dict[int, str]:
    """Long documents of passages that many of them hold, with words between that are theirs alone, so that the hub of a
    list is similar to hardly any of the list. Of ``pairs`` there is another version with ``changed`` more words of its own."""
    rng = random.Random(7)
    own = (f"own{i}" for i in itertools.count())
    pool = [[f"w{rng.randrange(3000)}" for _ in range(120)] for _ in range(20)]
    join = lambda passages: [w for p in passages for w in [*p, next(own)]]
    chosen = [rng.sample(pool, 8) for _ in range(pairs + others)]
    made = [join(c) for c in chosen]
    for c in chosen[:pairs]:
        again = join(c)
        for k in range(changed):
            again[k * len(again) // changed + 20] = next(own)
        made.append(again)
    rng.shuffle(made)
    return {i: " ".join(m) for i, m in enumerate(made)}


def test_join_finds_pairs_whose_lists_have_unrelated_hubs(spark):
    texts = documents_of_shared_passages(30, 40, 10)
    want = similar_by_force(texts, 4, 85, 100)
    assert sum(i != c for i, c in want.items()) == 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_components(docs, 4, 85, 100).collect()} == want


def test_lists_are_cut_into_parts_and_left_to_their_first(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRED", 3)
    texts = documents_of_shared_passages(12, 14, 10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_components(docs, 4, 85, 100, rounds=1).collect()}
    assert got == similar_by_force(texts, 4, 85, 100)


def test_texts_of_one_id_are_one_document(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda words, k: " ".join([*words[:k], "new", *words[k + 1 :]])
    rows = [(1, " ".join(base)), (2, near(base, 3)), (2, " ".join(other)), (3, near(other, 58)), (4, "alone in here"), (4, "not like the rest"), (5, "not like the rest")]
    got = sorted(map(tuple, similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()))
    assert [(i, c) for i, _, c in got] == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4)]


def test_nearest_is_exact_with_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 37]]) for i in range(60)]
    bad = [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [1.0]), (None, [1.0] * 6), (105, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(table, table.vec_id % 5 == 0, window=2, curves=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 60, 5))
    for q, found in got.items():
        cos = lambda i: float(np.dot(base[q % 37].astype(float), base[i % 37].astype(float)) / np.linalg.norm(base[q % 37].astype(float)) / np.linalg.norm(base[i % 37].astype(float)))
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-round(cos(i), 9), i))[:5]
        assert [i for _, i, _ in sorted(found)] == want
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in sorted(found)] == pytest.approx([cos(i) for i in want])
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert nearest(few, few.vec_id == 0).count() == 2


def test_blocks_of_queries_meet_every_slice_of_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda: sorted(map(tuple, nearest(table, table.vec_id % 4 == 0, window=1, curves=1).collect()))
    once = ask()
    monkeypatch.setattr("askspark.llm.nearest.QUERY_BLOCK", 5)
    monkeypatch.setattr("askspark.llm.nearest.SLICE_ROWS", 4)
    assert ask() == once and len(once) == 23 * 5


def test_windows_alone_find_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 16)) * 3
    vectors = [(i, [float(x) for x in centres[i % 100] + 0.3 * rng.normal(size=16)]) for i in range(2000)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    pairs = lambda exact: {(r.query_id, r.vec_id) for r in nearest(table, table.vec_id % 50 == 0, exact=exact).collect()}
    whole = pairs(True)
    assert len(whole & pairs(False)) >= 0.9 * len(whole)


def test_held_out_accuracy_of_the_quality_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = score_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality", "toxic").collect()
    poor = [not r.keep for r in rows if r.quality == 0 or r.toxic == 1]
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(poor) >= 0.9 * len(poor)
    assert sum(clean) >= 0.99 * len(clean)
