"""Benchmark passages in documents, found by Wu-Manber search over words.

The patterns are windows of consecutive item words. Patterns of one length are searched together: a shift table says for
each block of two words how far the search may jump, blocks that can end a pattern lead through a hash of the pattern's
last words to a few test strings, and those are compared word by word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askspark.llm.common import UPPER, WORD_CHARS, append_arrow, lower_ascii, per_worker
from askspark.session import cut_lineage

#: Patterns and bytes of pattern text that one scan of the documents searches for; more patterns take more scans.
PASS_PATTERNS = 200_000
PASS_BYTES = 32 << 20


def item_windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (``item_id``, ``window``): every ``size`` consecutive words of an item joined by blanks, or all of its words
    if it has fewer. Items without words, or null, have none. One item id on several rows is one item with all its texts."""
    words = F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(WORD_CHARS), F.lit(0))
    items = benchmark.select(F.col(id_col).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    windows = items.select("item_id", F.explode(starts).alias("i"), "w")
    return windows.select("item_id", F.array_join(F.slice("w", F.col("i") + 1, size), " ").alias("window")).distinct()


class WuManber:
    """Tables for patterns of one length in words."""

    def __init__(self, patterns: list[tuple[str, ...]], block: int = 2, suffix: int = 4):
        self.m = m = len(patterns[0])
        self.block = block = min(block, m)
        self.suffix = suffix = min(suffix, m)
        self.jump = m - block + 1
        self.shift: dict = {}
        self.tests: dict[int, list[tuple[str, ...]]] = {}
        for p in patterns:
            for end in range(block, m + 1):
                key = p[end - block : end] if block > 1 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, self.jump), m - end)
            self.tests.setdefault(hash(p[m - suffix :]), []).append(p)

    def places(self, words: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, pattern) of every occurrence, starts ascending."""
        m, block, suffix, jump, shift, tests = self.m, self.block, self.suffix, self.jump, self.shift.get, self.tests.get
        end, n = m, len(words)
        while end <= n:
            by = shift((words[end - 2], words[end - 1]) if block == 2 else words[end - 1], jump)
            if by:
                end += by
                continue
            for p in tests(hash(tuple(words[end - suffix : end])), ()):
                if tuple(words[end - m : end]) == p:
                    yield end - m, p
            end += 1


def search_groups(windows: DataFrame) -> tuple[DataFrame, int]:
    """The windows (``window``, ``item``, ``g``) dealt to groups that a task can hold, and the number of groups; a window of
    very many items is split as well."""
    size = F.sum(F.octet_length("window") + F.octet_length(F.col("item_id").cast("string")) + 64)
    n, total = windows.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    groups = max(1, -(-2 * n // PASS_PATTERNS), -(-2 * total // PASS_BYTES)) if n > PASS_PATTERNS or total > PASS_BYTES else 1
    rows = windows.select("window", F.col("item_id").cast("string").alias("item"))
    return rows.withColumn("g", F.pmod(F.xxhash64("window", "item"), F.lit(groups))), groups


def merge_spans(places: Iterable[tuple[int, int]]) -> list[int]:
    """[start, end) spans, touching ones joined, flat."""
    merged: list[int] = []
    for start, end in sorted(places):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def search_group(docs: DataFrame, text_col: str, shared: Broadcast) -> DataFrame:
    """``docs`` with what one group of windows hits: ``_n_words``, ``_spans`` and ``_items``. A worker keeps the tables of the
    latest group alone."""
    at, token = docs.columns.index(text_col), uuid.uuid4().hex

    def tables() -> tuple[list[WuManber], dict[tuple[str, ...], set[str]]]:
        items: dict[tuple[str, ...], set[str]] = {}
        for window, item in shared.value:
            items.setdefault(tuple(window.split(" ")), set()).update([] if item is None else [item])
        by_length: dict[int, list] = {}
        for p in items:
            by_length.setdefault(len(p), []).append(p)
        return [WuManber(ps) for ps in by_length.values()], items

    def begin():
        held = per_worker("decontaminate", "wu-manber tables", dict)
        if token not in held:
            held.clear()
            held[token] = tables()
        searches, items = held[token]
        find, lower = re.compile(WORD_CHARS).findall, str.maketrans(UPPER, UPPER.lower())

        def search(batch: pa.RecordBatch) -> list[pa.Array]:
            n_words, spans, found = [], [], []
            for value in batch.column(at):
                words = find((value.as_py() or "").translate(lower))
                places, hit = [], set()
                for s in searches:
                    for start, p in s.places(words):
                        places.append((start, start + s.m))
                        hit |= items[p]
                n_words.append(len(words))
                spans.append(merge_spans(places))
                found.append(sorted(hit))
            return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]

        return search

    return append_arrow(docs, begin, {"_n_words": "bigint", "_spans": "array<bigint>", "_items": "array<string>"})


def search_in_rounds(docs: DataFrame, text_col: str, windows: DataFrame, groups: int) -> DataFrame:
    """The same columns from many groups, one scan each. What a scan hits is written once per distinct text, by digest, and
    its windows are released before the next is fetched; at the end the hits, few beside the documents, are joined back."""
    spark = docs.sparkSession
    stored = cut_lineage(windows, "windows")
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    digest = F.sha2(F.col("text"), 256).alias("_digest")
    hits: DataFrame | None = None
    for g in range(groups):
        shared = spark.sparkContext.broadcast([tuple(r) for r in stored.where(F.col("g") == g).select("window", "item").collect()])
        found = search_group(texts, "text", shared).where(F.size("_spans") > 0).select(digest, "_spans", "_items")
        found = found.groupBy("_digest").agg(F.first("_spans").alias("_spans"), F.first("_items").alias("_items"))
        found = cut_lineage(found, "benchmark-hits")
        shared.unpersist()
        hits = found if hits is None else hits.union(found)
    both = hits.groupBy("_digest").agg(F.flatten(F.collect_list("_spans")).alias("_flat"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))

    def begin():
        def join_spans(batch: pa.RecordBatch) -> list[pa.Array]:
            flat = batch.column(1).to_pylist()
            return [pa.array([merge_spans(zip(f[::2], f[1::2])) for f in flat], pa.list_(pa.int64()))]

        return join_spans

    merged = cut_lineage(append_arrow(both, begin, {"_spans": "array<bigint>"}).drop("_flat"), "benchmark-hits")
    n_words = F.size(F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(WORD_CHARS), F.lit(0))).cast("long")
    own = F.sha2(F.col(text_col).cast("string"), 256)
    joined = docs.withColumns({"_n_words": n_words, "_digest": own}).join(merged, "_digest", "left")
    none = {"_spans": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")}
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), "_n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence of a benchmark window), ``n_items``
    (items with occurring windows), ``items`` (their ids as strings, sorted), ``hit_spans`` (merged [start, end) word
    positions, flat) and ``contaminated`` (``n_hit`` > 0). Columns of ``docs`` with these names are replaced.

    A null or empty text has no words and is clean; an item without words matches nothing; one without an id hits words but
    is not counted; an empty benchmark leaves all clean. Repeated rows give repeated rows. Documents are not shuffled: the
    windows go to the tasks. A benchmark of more than ``PASS_PATTERNS`` windows or ``PASS_BYTES`` is searched in groups of
    that size, one scan after the other, of which the driver holds one at a time.
    """
    made = ["n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"]
    windows, groups = search_groups(item_windows(benchmark, size, item_col, item_text_col))
    plain = docs.drop(*made, "_n_words", "_spans", "_items", "_digest")
    if groups == 1:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in windows.select("window", "item").collect()])
        found = search_group(plain, text_col, shared)
    else:
        found = search_in_rounds(plain, text_col, windows, groups)
    signed = F.transform("_spans", lambda at, i: F.when(i % 2 == 1, at).otherwise(-at))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    return found.withColumns({
        "n_words": F.col("_n_words"), "n_hit": n_hit, "n_items": F.size("_items").cast("long"), "items": F.array_sort("_items"),
        "hit_spans": F.col("_spans"), "contaminated": n_hit > 0,
    }).drop("_n_words", "_spans", "_items")
