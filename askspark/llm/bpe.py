"""Byte-level BPE as a streaming transducer, and its decoder as a byte-to-text state machine.

A merge list fixes how far to the right a merge can look: whether ``u`` and ``v`` merge depends on text after ``v`` only
if an earlier merge takes a right end of ``v`` away, which may depend on a still earlier one, and so on. The ranks fall
along such a chain, so one pass over the merges finds the longest. Tokens that end at least that many bytes before the
end of what has been read are final; the rest is kept and encoded again with the next bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from askspark.llm.common import append_arrow, per_worker

#: Fixed value: the public split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes the regex library and the tokenizer's older Unicode tables agree on (a test goes through all);
#: texts with others are split by the tokenizer's own splitter.
AGREED = r"[\x00-՗Ḁ-῿ -⁯₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: printable bytes stand for themselves, the others for U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Runs of text that the split pattern never looks beyond, where blank, tab and line ends are the only white space.
UNIT = r" ?[^ \t\r\n]+|[ \t\r\n]+(?![^ \t\r\n])|[ \t\r\n]+"


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in data["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.merges = [(raw[a], raw[b]) for a, b in merges]
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(self.merges):
            self.ranks.setdefault(pair, i)
        self.lookahead = sufficient_lookahead(self.merges)
        self.longest = max(map(len, self.ids))


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that can still change it.

    ``reach[y]`` is the furthest that merges with left part ``y`` look. A merge of ``u`` and ``v`` looks over ``v`` and as
    far as any earlier merge whose left part is a right end of ``v`` in the way ``v`` was built.
    """
    reach: dict[bytes, int] = {}
    right: dict[bytes, bytes] = {}
    most = 0
    for u, v in merges:
        own, end = len(v), v
        far = reach.get(end, 0)
        while end in right:
            end = right[end]
            far = max(far, reach.get(end, 0))
        own += far
        reach[u] = max(reach.get(u, 0), own)
        right.setdefault(u + v, v)
        most = max(most, own)
    return most


def merge_bytes(data: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Applies the merges in rank order, leftmost first; short inputs scan, longer ones use a heap."""
    parts = [data[i : i + 1] for i in range(len(data))]
    if len(parts) < 64:
        get, none = ranks.get, 1 << 60
        waiting = [get(pair, none) for pair in zip(parts, parts[1:])]
        while waiting and (best := min(waiting)) < none:
            i = waiting.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del waiting[i]
            if i:
                waiting[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(waiting):
                waiting[i] = get((parts[i], parts[i + 1]), none)
        return parts
    n = len(parts)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if parts[i] else -1
        if j < 0 or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i] += parts[j]
        parts[j] = b""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (r, a))
    return [p for p in parts if p]


class Transducer:
    """Takes bytes of one split piece in any portions and gives token ids as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary, window: int = 4096):
        self.v = vocabulary
        self.window = max(window, 2 * (vocabulary.lookahead + vocabulary.longest))
        self.kept = b""

    def feed(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.window):
            self.kept += data[start : start + self.window]
            if len(self.kept) >= self.window:
                yield from self._final(len(self.kept) - self.v.lookahead)

    def end(self) -> Iterator[int]:
        yield from self._final(len(self.kept))

    def _final(self, until: int) -> Iterator[int]:
        done = 0
        for token in merge_bytes(self.kept, self.v.ranks):
            if done + len(token) > until:
                break
            done += len(token)
            yield self.v.ids[token]
        self.kept = self.kept[done:]


class Encoder:
    """Text to token ids; special strings in a text become their own ids, as in the tokenizer's default."""

    def __init__(self, path: str, known_units: int = 400_000, known_chars: int = 48):
        self.v = Vocabulary(path)
        self.path, self.known_units, self.known_chars = path, known_units, known_chars
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT).findall
        self.agreed = re.compile(AGREED).fullmatch
        self.units = re.compile(UNIT).findall
        self.other_space = re.compile(r"[^\S \t\r\n]").search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self._splitter = None

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or self.agreed(text):
            return self.split(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def one(self, unit: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.pieces(unit):
            if len(piece) > self.known_chars:
                transducer = Transducer(self.v)
                for start in range(0, len(piece), 1 << 16):
                    ids.extend(transducer.feed(piece[start : start + (1 << 16)].encode()))
                ids.extend(transducer.end())
            elif piece in self.known:
                ids.extend(self.known[piece])
            else:  # so short that all of it is kept until its end
                got = self.known[piece] = tuple(map(self.v.ids.__getitem__, merge_bytes(piece.encode(), self.v.ranks)))
                ids.extend(got)
        return tuple(ids)

    def encode(self, text: str) -> array:
        out = array("I")
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.v.special[part])
            elif part:
                self._plain(part, out)
        return out

    def _plain(self, text: str, out: array) -> None:
        units, known = self.pieces(text) if self.other_space(text) else self.units(text), self.known
        new = set(units).difference(known)
        if len(known) + len(new) > self.known_units:
            known.clear()
            new = set(units)
        once = {}
        for unit in new:
            (known if len(unit) <= self.known_chars else once)[unit] = self.one(unit)
        got = (once[u] if u in once else known[u] for u in units) if once else map(known.__getitem__, units)
        out.extend(chain.from_iterable(got))


def decode_stream(ids: Iterable[int], token_bytes: dict[int, bytes], portion: int = 8192) -> Iterator[str]:
    """Text in portions. The state is the unfinished character at the end of a portion (at most three bytes); bytes that
    are no UTF-8 become U+FFFD, one for each longest broken sequence."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    ids = list(ids)
    for start in range(0, len(ids), portion):
        yield machine.decode(b"".join(map(token_bytes.__getitem__, ids[start : start + portion])))
    yield machine.decode(b"", True)


def bpe_round_trip(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, with_ids: bool = False
) -> DataFrame:
    """Encodes and decodes every text. Per row: the id, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers), ``decoded_sha256`` (of the decoded UTF-8 text) and ``round_trip`` (decoded equals the text); with
    ``with_ids`` also ``ids`` and ``decoded``. ``keep_columns`` keeps all columns of the table; columns of these names are
    replaced.

    A null text counts as empty: no tokens, hashes of nothing. Rows are independent: no shuffle, repeated rows repeat.
    Short runs of text are encoded once per worker while they fit its memory of runs; a piece of any length goes through
    the transducer in windows.
    """
    made = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean"}
    made |= {"ids": "array<bigint>", "decoded": "string"} if with_ids else {}
    rows = docs.drop(*(n for n in made if n not in (id_col, text_col))) if keep_columns else docs.select(id_col, text_col)
    place = rows.columns.index(text_col)
    types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.string()][: len(made)]

    def begin():
        encoder = per_worker("bpe", tokenizer_file, lambda: Encoder(tokenizer_file))

        def encode(batch: pa.RecordBatch) -> list[pa.Array]:
            out: list[list] = [[] for _ in types]
            for value in batch.column(place):
                text = value.as_py() or ""
                ids = encoder.encode(text)
                decoded = "".join(decode_stream(ids, encoder.v.bytes))
                little = array("I", ids)
                if array("H", [1]).tobytes() == b"\x00\x01":
                    little.byteswap()
                digests = (hashlib.sha256(x).hexdigest() for x in (little.tobytes(), decoded.encode()))
                for column, x in zip(out, (len(ids), *digests, decoded == text, *((list(ids), decoded) if with_ids else ()))):
                    column.append(x)
            return [pa.array(x, t) for x, t in zip(out, types)]

        return encode

    return append_arrow(rows, begin, made)
