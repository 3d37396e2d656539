"""Similar documents by word n-grams: an exact join at a Jaccard threshold, and the components of its links.

Documents with equal n-gram sets are one. Two sets that reach the threshold share one of their rarest n-grams (the prefix
filter), so candidates come from inverted lists of those alone. A list of many similar documents is not expanded into
pairs: each document of a list is first compared with one of them, the list's hub. A hub's pairs are decided then, so it
leaves the list. What a list still has in different components after some rounds of hubs is decided inside bounded tasks:
sketches name the documents that may have a partner there; their n-grams become one inverted index, and every document
searches it by T-occurrence: its shorter lists are merged by a heap, its longer ones are probed (DivideSkip). A task gives
out links alone, fewer than it has documents.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askspark.llm.common import ROWS_AT_ONCE
from askspark.llm.components import connected_components
from askspark.session import cut_lineage

#: N-grams known to be frequent, which go last in the order; the count decides about speed alone. Bounds a broadcast.
FREQUENT = 1_000_000
#: Candidates that one search takes at a time.
BLOCK = 256
#: Fewest bits of the sketches that rule out pairs before their texts are fetched, in numbers of 64 bits, and most of those
#: that go to the tasks of a list.
LEAST_WORDS, MOST_WORDS = 8, 64
#: Documents and n-grams of one list that a task takes together with as many others.
PAIRED, PAIRED_GRAMS = 512, 1 << 20
#: Pairs of one list whose sizes are compared at a time.
PAIRS_AT_ONCE = 1 << 14
#: A pair that shares several lists is left to the first of them, as far as these many first lists of each tell.
FIRST_LISTS = 8
#: Bytes of ids that are sent to all tasks, which then take the texts of those ids from the input without a shuffle of it.
SENT_BYTES = 64 << 20
#: Bytes of text whose words are hashed together (a longer text is taken whole), and bytes of words that are hashed alone.
AT_ONCE, LONG_WORD = 1 << 20, 256
#: Fixed odd multipliers of the positions in an n-gram.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: The white space of ASCII; the first k of eight bytes.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_codes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places, all words eight bytes at a time."""
    import xxhash

    eights = np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")
    codes = lengths.astype(np.uint64) * FACTORS[0]
    at, rest, who = starts, lengths, slice(None)
    while len(at):
        shift = (at & 7).astype(np.uint64) << np.uint64(3)
        # two shifts, as one by 64 bits has no defined result
        eight = (eights[at >> 3] >> shift) | (eights[(at >> 3) + 1] << (np.uint64(63) - shift) << np.uint64(1))
        h = codes[who] ^ (eight & FIRST_BYTES[np.minimum(rest, 8)])
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        codes[who] = h
        more = np.flatnonzero((rest > 8) & (lengths[who] <= LONG_WORD))
        at, rest, who = at[more] + 8, rest[more] - 8, more if isinstance(who, slice) else who[more]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        codes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return codes


def windows(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` consecutive codes."""
    h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        h ^= codes[k : len(h) + k]
        h *= FACTORS[k % len(FACTORS)]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def sets_of(data: bytes, edges: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The n-grams of the texts that lie between ``edges`` in ``data``."""
    white = WHITE[np.frombuffer(data, np.uint8)]
    inside = ~white
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= white[:-1]
    end[:-1] &= white[1:]
    for mask, at in ((begin, edges[edges < len(data)]), (end, edges[edges > 0] - 1)):  # no word goes on in the next text
        mask[at] = inside[at]
    starts = np.flatnonzero(begin)
    codes = word_codes(data, starts, np.flatnonzero(end) + 1 - starts)
    grams, bounds = windows(codes, n), np.searchsorted(starts, edges).tolist()
    for a, b in zip(bounds, bounds[1:]):
        h = np.sort(grams[a : b - n + 1] if b - a >= n else windows(codes[a:b], b - a) if b > a else grams[:0])
        new = h[1:] != h[:-1]
        yield h if new.all() else h[np.concatenate(([True], new))]


def gram_sets(texts: pa.Array | pa.ChunkedArray, n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its n-grams of words; of all words together if there are fewer than
    ``n``. A null has none.

    Lower-casing bytes takes exactly the letters of ASCII, and so does ``WHITE`` its white space."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        _, offsets, data = chunk.buffers()
        edges = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        first = 0
        while first < len(chunk):
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + AT_ONCE, "right")) - 1)
            size = int(edges[last] - edges[first])
            yield from sets_of(data.slice(int(edges[first]), size).to_pybytes().lower() if size else b"", edges[first : last + 1] - edges[first], n)
            first = last


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """Bits as 64-bit numbers, a power of two of them and about one bit for each n-gram: whether an odd number of n-grams
    falls on it. Two sets differ in at least as many n-grams as their bits differ, also when bits are folded together."""
    bits = max(64 * LEAST_WORDS, 1 << max(0, len(grams) - 1).bit_length())
    odd = (np.bincount(grams & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """Smallest intersection of sets of these sizes with ``den`` * intersection >= ``num`` * union."""
    return -(-num * (a + b) // (num + den))


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], num: int, den: int, mu: float = 0.0085) -> list[int]:
    """Which candidates reach the least overlap with the query.

    The lists (for each n-gram of the query, the candidates that hold it, ascending) are divided: the longest are set
    aside, the others are merged, and a candidate met often enough there is looked up in the long ones until it has enough
    or cannot get there.
    """
    need = [least_overlap(len(query), len(c), num, den) for c in candidates]
    able = [i for i, c in enumerate(candidates) if need[i] <= min(len(query), len(c))]
    if not able:
        return []
    at, owner = [], []
    for i in able:
        place = np.searchsorted(query, candidates[i])
        place[place == len(query)] = 0
        place = place[query[place] == candidates[i]]
        at.append(place)
        owner.append(np.full(len(place), i))
    place, who = np.concatenate(at), np.concatenate(owner)
    order = np.lexsort((who, place))
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    lists = sorted((x.tolist() for x in np.split(who[order], cuts) if len(x)), key=len)
    if not lists:
        return []
    t = min(need[i] for i in able)
    aside = min(t - 1, len(lists), int(t / (mu * math.log(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    out = []
    for i, same in groupby(heapq.merge(*short)):
        count = sum(1 for _ in same)
        if count < need[i] - aside:
            continue
        for k, holders in enumerate(long):
            if count >= need[i] or count + len(long) - k < need[i]:
                break
            j = bisect.bisect_left(holders, i)
            count += j < len(holders) and holders[j] == i
        if count >= need[i]:
            out.append(i)
    return out


def folded(bits: Column, words: Column) -> Column:
    """Parity bits folded to so many numbers."""
    return F.transform(
        F.sequence(F.lit(1), words),
        lambda k: F.aggregate(F.sequence(k, F.size(bits), words), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.element_at(bits, i))),
    )


def may_link(n: np.ndarray, component: np.ndarray, bits: list[np.ndarray], firsts: list[np.ndarray], gram: int, apart: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Which documents have a possible partner: of fitting size, in another component, with sketches close enough, of the
    other part (``apart`` tells the parts; None if all are of one), and without an earlier list that both are on."""
    width = np.array([len(b) for b in bits])
    found = np.zeros(len(n), bool)
    counts = np.array([len(f) for f in firsts])
    earlier = np.full((len(n), max(1, counts.max(initial=0))), gram)
    earlier[np.arange(earlier.shape[1]) < counts[:, None]] = np.concatenate(firsts)
    for w in set(width.tolist()):
        own, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        at = np.concatenate((own, twice))
        # halves of a sketch fold onto each other; sizes further apart do not fit anyway
        sketch = np.array([bits[i] for i in own] + [bits[i][:w] ^ bits[i][w:] for i in twice], np.uint64).reshape(len(at), w)
        size, group, part = n[at], component[at], None if apart is None else apart[at]
        rows = max(1, PAIRS_AT_ONCE // len(at))
        for k in range(0, len(own), rows):
            these, rest = slice(k, min(k + rows, len(own))), slice(k + 1, None)
            x, y = size[these, None], size[rest]
            able = (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (group[these, None] != group[rest])
            if part is not None:
                able &= part[these, None] != part[rest]
            i, j = np.nonzero(np.triu(able))
            i, j = i + k, j + k + 1
            total = size[i] + size[j]
            differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            able = (num + den) * (total - differ) >= 2 * num * total
            i, j = at[i[able]], at[j[able]]
            told = ((earlier[i, :, None] == earlier[j, None, :]) & (earlier[i, :, None] < gram)).any(axis=(1, 2))
            found[i[~told]] = found[j[~told]] = True
    return found


def searched(ids: list, components: list, sets: list[np.ndarray], num: int, den: int, mu: float = 0.0085) -> list[tuple[int, int]]:
    """Links (places in ``ids``) that join the components of these documents as far as any link does.

    One inverted index holds all sets. Each document searches it for later ones that it is not yet connected with.
    """
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    index: dict[int, list[int]] = {}
    for i, grams in enumerate(sets):
        for g in grams.tolist():
            index.setdefault(g, []).append(i)
    sizes = [len(s) for s in sets]
    out = []
    for i, grams in enumerate(sets):
        lists = sorted((x for g in grams.tolist() if len(x := index[g]) > 1 and x[-1] > i), key=len)
        least = max(1, -(-num * sizes[i] // den))  # no partner needs less
        if len(lists) < least:
            continue
        aside = min(least - 1, int(least / (mu * math.log(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        for j, same in groupby(heapq.merge(*(x[bisect.bisect_right(x, i) :] for x in short))):
            if sizes[j] * den < sizes[i] * num or sizes[i] * den < sizes[j] * num:
                continue
            count, need = sum(1 for _ in same), least_overlap(sizes[i], sizes[j], num, den)
            if count + len(long) < need or find(components[i]) == find(components[j]):
                continue
            for k, holders in enumerate(long):
                if count >= need or count + len(long) - k < need:
                    break
                place = bisect.bisect_left(holders, j)
                count += place < len(holders) and holders[place] == j
            if count >= need:
                root[find(components[i])] = find(components[j])
                out.append((i, j))
    return out


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct (``id``, ``text``) of ``docs`` with these ids. As many ids as ``SENT_BYTES`` hold go to the tasks, so that no
    other text is moved."""
    ids = ids.distinct()
    sent = ids.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 32)).first()[0] or 0
    return docs.join(F.broadcast(ids) if sent <= SENT_BYTES else ids, "id", "left_semi").distinct()


def links_inside(known: DataFrame, split: DataFrame, sketches: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (``a``, ``b``) that connect the components of ``known`` (gram, id, n, component) on the lists of ``split`` (gram,
    holders, grams) as far as any pair on one list does.

    A list is cut into parts of about ``PAIRED`` documents and ``PAIRED_GRAMS`` n-grams, and each two parts meet in one group,
    so no group grows with its list. The first pass tells by sizes and sketches which documents a group needs; only their
    texts are fetched, and the second pass searches them.
    """
    rest = known.join(split, "gram")
    few = sketches.select("id", F.when(F.size("bits") > MOST_WORDS, folded(F.col("bits"), F.lit(MOST_WORDS))).otherwise(F.col("bits")).alias("bits"))
    firsts = rest.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("gram")), 1, FIRST_LISTS).alias("firsts"))
    parts = F.ceil(F.greatest(F.col("holders") / PAIRED, F.col("grams") / PAIRED_GRAMS)).cast("int")
    rows = rest.join(few, "id").join(firsts, "id").withColumns({"part": F.pmod(F.xxhash64("id"), parts).cast("int"), "parts": parts})
    met = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("gram", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "n", "component", "bits", "firsts")

    def lists_of(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
        whole = column.combine_chunks()
        values, edges = whole.flatten().to_numpy(zero_copy_only=False).view(kind), whole.offsets.to_numpy()
        return [values[a - edges[0] : b - edges[0]] for a, b in zip(edges, edges[1:])]

    def needed(group: pa.Table) -> pa.Table:
        component = group.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        one = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        bits, first = lists_of(group.column("bits"), np.uint64), lists_of(group.column("firsts"), np.int64)
        found = may_link(group.column("n").to_numpy(), component, bits, first, group.column("gram")[0].as_py(), None if one else group.column("part").to_numpy(), num, den)
        return group.select(["gram", "low", "high", "id", "component"]).filter(pa.array(found))

    kind = known.schema["id"].dataType.simpleString()
    members = met.groupBy("gram", "low", "high").applyInArrow(needed, f"gram long, low int, high int, id {kind}, component {kind}")
    members = cut_lineage(members.distinct(), "members")
    members = members.join(texts_of(members.select("id"), docs), "id")

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group.column("id")
        sets = list(gram_sets(group.column("text"), n))
        found = searched(ids.to_pylist(), group.column("component").to_pylist(), sets, num, den)
        a, b = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    return members.groupBy("gram", "low", "high").applyInArrow(search, f"a {kind}, b {kind}")


def frequent_grams(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams that many documents hold, and their counts, as far as tasks notice them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = (batch.column("text").slice(k, ROWS_AT_ONCE) for k in range(0, batch.num_rows, ROWS_AT_ONCE))
            grams = np.concatenate([np.zeros(0, np.int64), *(np.concatenate(list(gram_sets(x, n))) for x in some)])
            grams.sort()
            least = max(4, batch.num_rows // 2000)
            often = grams[: max(0, len(grams) - least + 1)]
            often = np.unique(often[often == grams[least - 1 :]])
            times = np.searchsorted(grams, often, "right") - np.searchsorted(grams, often)
            yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(times.astype(np.int64))], names=["gram", "times"])

    counts = cut_lineage(docs.select("text").mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")), "grams")
    step = F.floor(F.log2("times") * 4)
    least, sum_so_far = None, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        sum_so_far += r["count"]
        if sum_so_far > FREQUENT:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(step >= least).toPandas().sort_values("gram")
    return got["gram"].to_numpy(np.int64), got["times"].to_numpy(np.int64)


def signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row: ``id``, ``n`` (size of the set), ``same`` (128 bits of the whole set), ``bits`` (its parity bits) and
    ``prefix``, its rarest n-grams: as many as make sure that a similar set shares one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        frequent, times = shared.value
        # n-grams that may be frequent: an n-gram's mark, its count and itself give the order, the same in every task
        marks = np.zeros(1 << max(10, min(24, (16 * len(frequent)).bit_length())), bool)
        marks[frequent & (len(marks) - 1)] = True

        def rarest(grams: np.ndarray, first: int) -> np.ndarray:
            marked = marks[grams & (len(marks) - 1)]
            rare = grams[~marked]
            if len(rare) < first:
                rest = grams[marked]
                place = np.minimum(np.searchsorted(frequent, rest), len(frequent) - 1)
                weight = np.where(frequent[place] == rest, times[place], 0)
                rare = np.concatenate((rare, rest[np.argsort(weight, kind="stable")]))  # ascending among equal counts
            return rare[:first]

        def lists(parts: list[np.ndarray]) -> pa.ListArray:
            edges = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

        for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            sizes, same, bits, prefix = [], [], [], []
            for grams in gram_sets(batch.column("text"), n):
                size = len(grams)
                sizes.append(size)
                same.append(xxhash.xxh3_128_digest(grams.tobytes()))
                bits.append(parity_bits(grams))
                prefix.append(rarest(grams, size - -(-num * size // den) + 1 if size else 0))
            arrays = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), lists(bits), lists(prefix)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "same", "bits", "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, n long, same binary, bits array<long>, prefix array<long>")


def compare(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The (``a``, ``b``) of ``pairs`` that are similar. Candidates of one ``a`` are searched in blocks of about ``BLOCK``."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("id"))
    own = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("id"))
    members = mine.union(own).join(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs), "id")
    kind = pairs.schema["a"].dataType.simpleString()

    def search(group: pa.Table) -> pa.Table:
        owner, ids = group.column("a").to_pylist(), group.column("id").to_pylist()
        grams = list(gram_sets(group.column("text"), n))
        queries = [g for a, i, g in zip(owner, ids, grams) if a == i]  # several where one id has several texts
        others = [k for k, (a, i) in enumerate(zip(owner, ids)) if a != i]
        hits = [ids[others[k]] for query in queries for k in divide_skip(query, [grams[k] for k in others], num, den)]
        types = group.schema.field("a").type
        return pa.table({"a": pa.array([owner[0]] * len(hits), types), "b": pa.array(hits, types)})

    return members.select("a", "block", "id", "text").groupBy("a", "block").applyInArrow(search, f"a {kind}, b {kind}")


def similar_components(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` (distinct n-grams) and ``component_id``, the smallest id reachable
    over links. Two documents link where ``den`` * intersection >= ``num`` * union of their n-gram sets.

    Words are runs without white space, A-Z lower-cased. With fewer than ``n`` words all of them are one n-gram; a null or
    empty text has none and links with nothing. Repeated rows give repeated rows. Rows of one id are one document: it links
    with whatever one of its texts links with. A row without an id gets the component of documents with the same set, or
    null. Other columns are ignored.

    No link between components is lost: lists hold every document that shares a prefix n-gram, and what the ``rounds`` of
    hubs (at least one) leave in different components is searched. A list without its hubs has no undecided pair but among
    the rest.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut_lineage(signatures(rows, n, num, den), "signatures")
    some = signed.where("n > 0")
    copies = some.groupBy("same").agg(F.min("id").alias("first"))
    whole = some.where(F.col("id").isNotNull()).groupBy("same").agg(F.min(F.struct("id", "n", "bits", "prefix")).alias("s")).select("s.*")
    whole = cut_lineage(whole, "whole")
    spread = whole.select("id", "n", F.explode("prefix").alias("gram"))
    shared = spread.groupBy("gram").agg(F.count("*").alias("holders")).where("holders > 1").select("gram")
    lists = cut_lineage(spread.join(shared, "gram"), "lists")
    # the hub of each round: by turns the lowest and the highest document of a random order, so that two rounds have two hubs
    chosen = [(F.max if r % 2 else F.min)(F.struct(F.xxhash64("id", F.lit(r // 2)).alias("h"), "id", "n")).alias(f"hub{r}") for r in range(rounds)]
    lists = cut_lineage(lists.join(lists.groupBy("gram").agg(F.count("*").alias("holders"), *chosen), "gram"), "hubs")
    leads = [(F.col("id") == F.col(f"hub{r}.id")) & (F.col("n") == F.col(f"hub{r}.n")) for r in range(rounds)]

    sketches = whole.select("id", "n", "bits")

    def apart(pairs: DataFrame, found: DataFrame | None) -> DataFrame:
        """Pairs that are not connected so far and that sizes and parity bits leave possible."""
        fits = F.least("n", "m") * den >= F.greatest("n", "m") * num
        pairs = pairs.where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if found is not None:
            x, y = found.select(F.col("node").alias("a"), F.col("component").alias("x")), found.select(F.col("node").alias("b"), F.col("component").alias("y"))
            pairs = pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
        for side in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
        words = F.least(F.size("bits_a"), F.size("bits_b"))
        same = [F.when(F.size(c) > words, folded(F.col(c), words)).otherwise(F.col(c)) for c in ("bits_a", "bits_b")]
        differ = F.aggregate(F.zip_with(*same, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        # at least (n_a + n_b - 2 * the intersection) n-grams differ, and the intersection must reach its least
        return pairs.where((num + den) * (F.col("n_a") + F.col("n_b") - differ) >= 2 * num * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    links: DataFrame | None = None
    found: DataFrame | None = None
    for r in range(rounds):
        # the pairs of an earlier hub are decided
        open_ = lists.where(~reduce(or_, leads[:r], F.lit(False)))
        pairs = open_.select(F.col(f"hub{r}.id").alias("a"), F.col(f"hub{r}.n").alias("m"), F.col("id").alias("b"), "n")
        pairs = cut_lineage(apart(pairs, found), "pairs")
        new = cut_lineage(compare(pairs, rows, n, num, den), "links")
        links = new if links is None else links.union(new)
        found = cut_lineage(connected_components(links), "components")
    group = F.coalesce("component", "id")
    known = lists.where((F.col("holders") > rounds + 1) & ~reduce(or_, leads, F.lit(False))).select("gram", "id", "n")
    known = cut_lineage(known.join(found.withColumnRenamed("node", "id"), "id", "left").select("gram", "id", "n", group.alias("component")), "known")
    ends = [F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("holders"), F.sum("n").alias("grams")]
    members = [F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("xor")]
    split = known.groupBy("gram").agg(*ends, *members).where("low <> high")
    # lists of the same documents count once
    split = split.groupBy("holders", "sum", "xor").agg(F.min("gram").alias("gram"), F.max("grams").alias("grams")).select("gram", "holders", "grams")
    links = links.union(cut_lineage(links_inside(known, split, sketches, rows, n, num, den), "links"))
    # the sets of one id belong together
    several = some.where(F.col("id").isNotNull()).groupBy("id").agg((F.min("same") < F.max("same")).alias("several")).where("several").select("id")
    links = links.union(some.join(several, "id").join(copies, "same").select(F.col("id").alias("a"), F.col("first").alias("b")))
    found = connected_components(links).withColumnsRenamed({"node": "first", "component": "reached"})
    named = copies.join(found, "first", "left").select("same", F.coalesce("reached", "first").alias("component_id"))
    joined = signed.join(named, "same", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
