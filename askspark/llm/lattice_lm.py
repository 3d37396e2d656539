"""Probability of a text under a unigram model of subword pieces, summed over all ways to cut it into pieces.

The pieces are those of an existing vocabulary. Their scores start from the vocabulary's own order and are re-estimated
once on the training documents: the expected use of each piece over all segmentations (forward and backward recursion).
A word that occurs in training is also an arc of its own: with n training tokens of v kinds it has the share n / (n + v) of
its frequency, and the segmentations have the rest.

Pieces do not cross words, so the sum over segmentations of a text is a product over its words, and each distinct word of
the corpus is worked out once, however often it occurs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askspark.session import cut_lineage

#: The most frequent words, up to so many and so many bytes, are looked up in the scan; rarer ones are joined. Bounds a broadcast.
FREQUENT, FREQUENT_BYTES = 200_000, 32 << 20
#: A word this long brings as many bytes with each occurrence, so it cannot be a hot key.
HUGE_BYTES = 1 << 16
START = "▁"
LN10 = math.log(10)


def vocabulary_scores(model_file: str) -> tuple[dict[str, float], list[float]]:
    """Natural log scores of the pieces of a sentencepiece file, and of the 256 bytes for characters outside it.

    The file gives ranks; a piece of rank r starts with a share of 1 / (r + 10). Control pieces are left out; byte pieces
    share what the last rank would get, each.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    shares = [1 / (r + 10) for r in range(len(names))]
    low = 1 / (len(names) + 10)
    total = math.log(sum(shares) + 256 * low)
    return {n: math.log(s) - total for n, s in zip(names, shares)}, [math.log(low) - total] * 256


class Lattice:
    """Segmentations of words into pieces; a character outside the vocabulary is its bytes."""

    def __init__(self, pieces: dict[str, float], byte_scores: list[float]):
        self.bytes = byte_scores
        self.open: dict[str, float | None] = {}
        for piece, score in pieces.items():
            for end in range(1, len(piece)):
                self.open.setdefault(piece[:end], None)
            self.open[piece] = score
        self.single = {p for p in pieces if len(p) == 1}

    def edges(self, text: str) -> list[list[tuple[int, float]]]:
        """For each start the (end, score) of the pieces that begin there."""
        n, get, missing = len(text), self.open.get, ""
        out = []
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                s = get(text[i:j], missing)
                if s is None:
                    continue
                if s == missing:
                    break
                here.append((j, s))
            if text[i] not in self.single:
                here.append((i + 1, sum(self.bytes[b] for b in text[i].encode("utf-8", "replace"))))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list[list[tuple[int, float]]]) -> list[float]:
        """Log of the summed weight of all segmentations of each prefix."""
        log1p, exp, none = math.log1p, math.exp, -math.inf
        a = [0.0] + [none] * len(edges)
        for i, here in enumerate(edges):
            base = a[i]
            if base == none:
                continue
            for j, s in here:
                x, y = base + s, a[j]
                a[j] = (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))) if y != none else x
        return a

    @staticmethod
    def backward(edges: list[list[tuple[int, float]]]) -> list[float]:
        log1p, exp, none = math.log1p, math.exp, -math.inf
        b = [none] * len(edges) + [0.0]
        for i in range(len(edges) - 1, -1, -1):
            y = none
            for j, s in edges[i]:
                x = s + b[j]
                y = (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))) if y != none and x != none else max(x, y)
            b[i] = y
        return b


def tokens_of(text: str | None) -> list[bytes]:
    """Words in UTF-8; splitting and lower-casing bytes takes exactly the white space and the letters of ASCII."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(``word``, ``c``): every word of the texts and its count in those that are not held out, pre-summed in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = Counter(), set()

        def rows() -> Iterator[pa.RecordBatch]:
            for word in seen:
                c.setdefault(word, 0)
            words = list(c)
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([c[w] for w in part], pa.int64())], names=["word", "c"])
            c.clear()
            seen.clear()

        for batch in batches:
            for value, held in zip(batch.column("text"), batch.column("held_out").to_pylist()):
                (seen if held else c).update(tokens_of(value.as_py()))
                if len(c) + len(seen) > 500_000:
                    yield from rows()
        yield from rows()

    return docs.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, pieces: dict[str, float], byte_scores: list[float]) -> tuple[dict[str, float], list[float]]:
    """Expected uses of each piece and byte in the training words, given the scores; summed in Spark, at most one row per
    piece comes back."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, byte_scores))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, exp = Lattice(*shared.value), math.exp
        uses: dict[str, float] = {}
        for batch in batches:
            for value, c in zip(batch.column("word"), batch.column("c").to_pylist()):
                text = START + value.as_py()
                edges = lattice.edges(text)
                a, b = lattice.forward(edges), lattice.backward(edges)
                whole = a[-1]
                for i, here in enumerate(edges):
                    base = a[i] - whole
                    for j, s in here:
                        p = exp(base + s + b[j]) * c
                        if p > 0:
                            piece = text[i:j]
                            uses[piece] = uses.get(piece, 0.0) + p
        # characters outside the vocabulary count for their bytes
        names = [k for k in uses if k in shared.value[0]]
        got = {k: uses[k] for k in names}
        for k, v in uses.items():
            if k not in got:
                for byte in k.encode("utf-8", "replace"):
                    got[f"<{byte}>\n"] = got.get(f"<{byte}>\n", 0.0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.float64())], names=["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    found = {r["piece"]: r["n"] for r in rows}
    return {p: found.get(p, 0.0) for p in pieces}, [found.get(f"<{b}>\n", 0.0) for b in range(256)]


def score_texts(
    docs: DataFrame, held_out: Column, model_file: str, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 0.1,
    reestimate: bool = True, whole_words: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (those that occur in
    training), ``train_tokens``, ``base_score`` (smoothed word unigram) and ``score`` (log10 probability of the text: the sum
    over all segmentations of its words, their own arcs included, and the end).

    Texts are lower-cased (A-Z). Training uses the rows where ``held_out`` is false; null counts as held out. A null or
    empty text is one end. Without training rows the scores of the vocabulary stand as they are, and all tokens are
    unknown. Repeated rows give repeated rows; other columns are ignored.

    ``reestimate=False`` leaves the pieces the scores of the vocabulary, ``whole_words=False`` leaves out the arcs of training
    words; with both false ``score`` is the likelihood of the vocabulary alone.

    Counts, expected uses and scores are made once per distinct word. The most frequent words (within ``FREQUENT`` and
    ``FREQUENT_BYTES``) are scored inside the scan, so that no hot word is a join key; the others are joined.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
    )
    words = cut_lineage(word_counts(rows), "words")
    pieces, byte_scores = vocabulary_scores(model_file)
    ends = rows.where(~F.col("held_out")).count()
    found = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (found["n"] or 0) + ends, found["v"] + (ends > 0)
    end = -math.log(101)
    if ends and reestimate:
        uses, byte_uses = piece_counts(words, pieces, byte_scores)
        total = math.log(sum(uses.values()) + sum(byte_uses) + ends + smoothing * (len(pieces) + 257))
        pieces = {p: math.log(u + smoothing) - total for p, u in uses.items()}
        byte_scores = [math.log(u + smoothing) - total for u in byte_uses]
        end = math.log(ends + smoothing) - total
    base = lambda c: (F.log10(c + smoothing) - math.log10(n + smoothing * (v + 1)))
    own = n / (n + v) if n and whole_words else 0.0
    mixed = lambda c, p: math.log10(own * c / max(n, 1) + (1 - own) * math.exp(p)) if c and own else p / LN10 + math.log10(1 - own)
    shared = spark.sparkContext.broadcast((pieces, byte_scores))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            sums = [lattice.forward(lattice.edges(START + w.as_py()))[-1] for w in batch.column("word")]
            scores = [mixed(c, p) for c, p in zip(batch.column("c").to_pylist(), sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["word", "c", "lattice"])

    scored = words.mapInArrow(weigh, "word string, c long, lattice double")
    scored = cut_lineage(scored.select("word", (F.col("c") > 0).cast("int").alias("known"), "c", base(F.col("c")).alias("base"), "lattice"), "scores")
    # the count from which a word is frequent: from a histogram of counts in steps of an eighth of a doubling
    step = F.floor(F.log2(F.col("c")) * 8)
    size = F.octet_length("word")
    short = size < HUGE_BYTES
    histogram = scored.where((F.col("c") > 0) & short).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum(size).alias("bytes")).orderBy(F.desc("step")).collect()
    least, n_words, n_bytes = None, 0, 0
    for r in histogram:
        n_words, n_bytes = n_words + r["words"], n_bytes + r["bytes"]
        if n_words > FREQUENT or n_bytes > FREQUENT_BYTES:
            break
        least = r["step"]
    frequent = [] if least is None else scored.where((F.col("c") > 0) & short & (step >= least)).select("word", "base", "lattice").collect()
    known = spark.sparkContext.broadcast({r["word"].encode(): (r["base"], r["lattice"]) for r in frequent})

    kind = rows.schema["id"].dataType
    fields = [("row", T.LongType()), ("id", kind), ("held_out", T.BooleanType()), ("word", T.StringType())]
    fields += [(c, T.LongType()) for c in ("times", "tokens", "known")] + [(c, T.DoubleType()) for c in ("base", "lattice")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text one row without a word: what its frequent words and counts give; and one for each other word."""
        get = known.value.get
        names = [n for n, _ in fields]
        types = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def flush(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            place, *rest = zip(*out)
            columns = [pa.array(x, t) for x, t in zip(rest, types)]
            columns[2] = columns[2].cast(pa.string())
            return pa.RecordBatch.from_arrays([columns[0], batch.column("id").take(pa.array(place, pa.int32())), *columns[1:]], names=names)

        for batch in batches:
            out: list[tuple] = []
            for place, (row, held, value) in enumerate(zip(batch.column("row").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"))):
                tokens = tokens_of(value.as_py())
                n_known = 0
                base_sum = lattice_sum = 0.0
                for word, times in Counter(tokens).items():
                    hit = get(word)
                    if hit is None:
                        out.append((place, row, held, word, times, 0, 0, 0.0, 0.0))
                    else:
                        n_known += times
                        base_sum += times * hit[0]
                        lattice_sum += times * hit[1]
                out.append((place, row, held, None, 0, len(tokens), n_known, base_sum, lattice_sum))
                if len(out) > 50_000:
                    yield flush(batch, out)
                    out = []
            if out:
                yield flush(batch, out)

    # rows are numbered and written in one job, so that a number means one row whatever is read or computed again later
    met = rows.select("row", "id", "held_out", "text").mapInArrow(look_up, T.StructType([T.StructField(*f) for f in fields]))
    met = cut_lineage(met, "tokens")
    rare = met.where(F.col("word").isNotNull()).select("row", "word", "times")
    rare = rare.join(scored.where(F.col("word").isNotNull()), "word")
    times = F.col("times")
    parts = rare.groupBy("row").agg(
        F.sum(times * F.col("known")).alias("known_too"), F.sum(times * F.col("base")).alias("base_too"), F.sum(times * F.col("lattice")).alias("lattice_too"),
    )
    sums = met.where(F.col("word").isNull()).drop("word", "times").join(parts, "row", "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_too"), F.lit(0))
    end_base = math.log10(ends + smoothing) - math.log10(n + smoothing * (v + 1))
    return sums.select(
        F.col("id").alias(id_col), "held_out", (F.col("tokens") + 1).alias("n_tokens"), (plus("known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (plus("base") + end_base).alias("base_score"),
        (plus("lattice") + mixed(ends, end)).alias("score"),
    )
