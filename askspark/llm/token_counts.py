"""Token counts without token ids.

Arrow batches go to the tokenizer in groups of similar byte size, and only lengths come back. A text is cut at blanks,
where the tokenizer drops the white space anyway, so that a text of any length is encoded piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askspark.llm.common import per_worker

#: A cut at one of these is safe: they are white space to the tokenizer, compose with no neighbour and end every word.
PIECE = r"[^ \t\r\n]+"


def token_counts(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
    batch_bytes: int = 1 << 18, known_pieces: int = 1_000_000, known_chars: int = 64,
) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The tokenizer must drop white space and never join text across it. Pieces of up to ``known_chars`` characters are
    encoded once per worker: at most ``known_pieces`` lengths are kept, then the memory starts afresh. New pieces go to
    the tokenizer in batches of up to ``batch_bytes`` of UTF-8; a longer piece is a batch of its own.
    A null text is empty and has no tokens. Repeated rows give repeated rows; an empty table gives an empty one. No
    shuffle; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = per_worker("token counts", f"tokenizer {tokenizer_file}", lambda: Tokenizer.from_file(tokenizer_file))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known = per_worker("token counts", f"lengths {tokenizer_file}", dict)
        find = re.compile(PIECE).findall

        def encode(pieces: list[str], into: dict) -> None:
            for piece, got in zip(pieces, tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
                into[piece] = len(got)

        def learn(pieces: set[str], into: dict) -> None:
            group, size = [], 0
            for piece in pieces:
                n = len(piece) if piece.isascii() else len(piece.encode())
                if group and size + n > batch_bytes:
                    encode(group, into)
                    group, size = [], 0
                group.append(piece)
                size += n
            if group:
                encode(group, into)

        for batch in batches:
            ids, n_bytes, n_tokens = batch.column(0), [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                pieces = find(text)
                new = set(pieces).difference(known)
                once: dict = {}
                if new:
                    long = {p for p in new if len(p) > known_chars}
                    if len(known) + len(new) > known_pieces:
                        known.clear()
                        new = set(pieces)
                        long = {p for p in new if len(p) > known_chars}
                    learn(new - long, known)
                    learn(long, once)
                if once:
                    n_tokens.append(sum(once[p] if p in once else known[p] for p in pieces))
                else:
                    n_tokens.append(sum(map(known.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
