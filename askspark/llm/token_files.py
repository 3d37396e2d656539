"""Token ids of a corpus as binary files, in the order of document ids.

Documents are range-partitioned and sorted by id; each task is a shard, numbered in that order. A shard is a run of
records, each of some whole documents: a head, the documents' sizes and ids, the block table, and the token ids in
Simple-8b words (see ``simple8b``). A record knows how many ids of its shard come before it, so that files can be read in
any order and by any number of tasks; what lies before a shard is a sum over shards. Spark's text sink writes the records
as they are, a line end after each, and its binary source reads the files back, so any store that Spark knows will do.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askspark.llm.common import per_worker, shuffle_parts
from askspark.llm.simple8b import pack, unpack

MAGIC = b"S8B1"
#: magic, shard, ids before the record in its shard, documents, ids, words, escapes, blocks, bytes of document ids
HEAD = "<4sIQIQIIII"
#: Ids from which a record is closed, records of a file, and bytes of text encoded at a time.
RECORD_IDS = 1 << 19
FILE_RECORDS = 64
TEXT_BYTES = 1 << 23
#: Fixed value: the split pattern of tokenizers that keep letters, digits and other characters apart.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of letters whose lower case is one letter in every Unicode version, and the marks they may end with.
MARKS = ".,;:!?"
PLAIN_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$"


def gathered(pool: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``place`` of ``pool``, whose runs have these sizes, one after another; and where each ends."""
    size = sizes[place]
    ends = np.cumsum(size)
    first = (np.cumsum(sizes) - sizes)[place]
    return pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class WordEncoder:
    """Texts to token ids for a tokenizer that drops white space and joins nothing across it: texts are cut at the white
    space of ASCII in Arrow, each distinct word of a batch is looked up or encoded once, and ids are gathered in numpy.

    Where the tokenizer's file says that it lower-cases and keeps letters and marks apart, Latin words are looked up in lower
    case and without a mark at their end. What is known is kept in two halves; the older one goes when the newer is full.
    """

    def __init__(self, tokenizer_file: str, known_words: int = 1_200_000, known_chars: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half, self.known_chars = known_words // 2, known_chars
        settings = json.loads(self.tokenizer.to_str())
        steps = [settings["normalizer"] or {}, settings["pre_tokenizer"] or {}]
        kinds = [x for s in steps for x in s.get("normalizers", s.get("pretokenizers", [s]))]
        self.plain = {"type": "Lowercase"} in kinds and any(k.get("pattern", {}).get("Regex") == LETTERS_APART for k in kinds)
        self.marks = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(list(MARKS), add_special_tokens=False)]

    def _entries(self, names: list[str]) -> list[bytes]:
        """Ids of distinct words, four bytes each."""
        if len(self.new) > self.half:
            self.new, self.old = {}, self.new
        get, older = self.new.get, self.old.get
        got = [g if (g := get(w)) is not None else older(w) for w in names]
        unknown = [i for i, g in enumerate(got) if g is None]
        for start in range(0, len(unknown), 10_000):
            some = unknown[start : start + 10_000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([names[i] for i in some], add_special_tokens=False)):
                got[i] = array("I", e.ids).tobytes()
        self.new.update((w, g) for w, g in zip(names, got) if len(w) <= self.known_chars)
        return got

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); null counts as empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary
        keys, mark = names, np.full(len(names), -1)
        if self.plain and len(names):
            simple = pc.match_substring_regex(names, PLAIN_WORD)
            keys = pc.if_else(simple, pc.utf8_lower(pc.ascii_rtrim(names, MARKS)), names)
            ending = pc.if_else(pc.and_(simple, pc.not_equal(pc.binary_length(keys), pc.binary_length(names))), pc.utf8_slice_codeunits(names, -1), "")
            mark = pc.fill_null(pc.index_in(ending, pa.array(list(MARKS))), -1).to_numpy()
        keys = keys.dictionary_encode()
        got = [b"", *self.marks, *self._entries(keys.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        pool = np.frombuffer(b"".join(got), np.uint32)
        pairs = np.column_stack((keys.indices.to_numpy() + 1 + len(MARKS), mark + 1)).ravel()
        pool, ends = gathered(pool, sizes, pairs)
        ids, ends = gathered(pool, np.diff(ends[1::2], prepend=0), coded.indices.to_numpy())
        edges = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, np.diff(np.concatenate(([0], ends))[edges])


def portions(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def make_record(shard: int, before: int, names: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One record. ``names`` are the document ids as text, with a leading 0 byte for null and 1 otherwise."""
    words, escapes, word_at, escape_at = pack(ids)
    joined = b"".join(names)
    head = struct.pack(HEAD, MAGIC, shard, before, len(names), len(ids), len(words), len(escapes), len(word_at), len(joined))
    lengths = np.fromiter(map(len, names), "<u4", len(names))
    parts = [sizes.astype("<u8"), lengths, word_at.astype("<u4"), escape_at.astype("<u4"), words.astype("<u8"), escapes.astype("<u4")]
    return head + joined + b"".join(p.tobytes() for p in parts)


def read_records(data: memoryview) -> Iterator[tuple[int, int, list[str | None], np.ndarray, np.ndarray]]:
    """(shard, ids before, document ids, sizes, token ids) of the records of one file."""
    at = 0
    while at < len(data):
        magic, shard, before, docs, n, n_words, n_escapes, n_blocks, n_names = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC:
            raise ValueError(f"no token record at byte {at}")
        at += struct.calcsize(HEAD)
        joined = bytes(data[at : at + n_names])
        at += n_names
        parts = []
        for kind, count in (("<u8", docs), ("<u4", docs), ("<u4", n_blocks), ("<u4", n_blocks), ("<u8", n_words), ("<u4", n_escapes)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        sizes, lengths, word_at, _, words, escapes = parts
        names, k = [], 0
        for length in lengths.tolist():
            names.append(joined[k + 1 : k + length].decode() if joined[k] else None)
            k += length
        at += 1  # the line end
        yield shard, before, names, sizes, unpack(words, escapes, word_at, n)


def write_token_files(
    docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every text (null: empty), appends ``end_id`` to each, and writes the ids below ``path``, which must be new, by
    ascending document id, null first; rows of one id by the hash of their text, then the text. The tokenizer must drop white
    space and join nothing across it; special strings in a text are treated as its default does.

    Document ids are stored as text, so they may be of any type with one. Rows of one id may lie in several shards; only
    rows equal in id and text must share one. Nothing but the texts is shuffled, once. An empty table gives no record;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.col("id").cast("string").alias("name"), F.xxhash64("text").alias("h"), "text")
    sorted_rows = rows.repartitionByRange(shuffle_parts(docs), F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("token files", tokenizer_file, lambda: WordEncoder(tokenizer_file))
        shard, before = TaskContext.get().partitionId(), 0
        names: list[bytes] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal before, held
            record = make_record(shard, before, names, np.concatenate(sizes), np.concatenate(parts))
            before, held = before + held, 0
            names.clear(), sizes.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])

        for batch in batches:
            for a, b in portions(batch.column("text")):
                ids, size = encoder(batch.column("text").slice(a, b - a))
                ends = np.cumsum(size)
                ids, size = np.insert(ids, ends, end_id), size + 1
                ends = np.cumsum(size)
                some = [b"\0" if v is None else b"\1" + v.encode() for v in batch.column("name").slice(a, b - a).to_pylist()]
                first = 0
                while first < len(some):
                    start = int(ends[first - 1]) if first else 0
                    last = min(int(np.searchsorted(ends, start + RECORD_IDS - held)) + 1, len(some))
                    names += some[first:last]
                    sizes.append(size[first:last])
                    parts.append(ids[start : int(ends[last - 1])])
                    held += len(parts[-1])
                    first = last
                    if held >= RECORD_IDS:
                        yield close()
        if names:
            yield close()

    records = sorted_rows.select("name", "text").mapInArrow(write, "record binary")
    records.select(F.col("record").cast("string")).write.option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_token_files(spark: SparkSession, path: str, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``shard``, ``doc_id`` as ``id_type``, ``at`` (ids of its shard before it),
    ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ``ids``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                for shard, before, names, sizes, ids in read_records(memoryview(value.as_buffer())):
                    ends = np.cumsum(sizes).astype(np.int64)
                    starts = ends - sizes.astype(np.int64)
                    data = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    arrays = [
                        pa.array(np.full(len(names), shard, np.int32)), pa.array(names, pa.string()), pa.array(before + starts),
                        pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64()),
                    ]
                    columns = ["shard", "name", "at", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                        columns.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    kind = "shard int, name string, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    found = files.mapInArrow(read, kind)
    return found.withColumn("name", F.col("name").cast(id_type)).withColumnRenamed("name", "doc_id")


def with_starts(found: DataFrame) -> DataFrame:
    """``found`` of ``read_token_files`` with ``start``, the ids of all documents before each, in place of ``shard`` and
    ``at``. One number per shard passes the driver."""
    sums = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    bases = [(r["shard"], b) for r, b in zip(sums, accumulate((r["n"] for r in sums), initial=0))]
    table = found.sparkSession.createDataFrame(bases, "shard int, base long")
    placed = found.join(F.broadcast(table), "shard").withColumn("start", F.col("base") + F.col("at"))
    return placed.select("doc_id", "start", *(c for c in found.columns if c not in ("shard", "doc_id", "at")))
