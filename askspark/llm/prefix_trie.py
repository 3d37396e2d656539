"""The trie of conversations that are rebuilt from the head of one conversation and the turns of another.

Turns are hashed once. A sequence of turns has a fingerprint that is a product in a monoid: with the hashes x1, x2, ... and a
base B modulo a prime it is the sum of xi * B^i, and the product of two sequences shifts the second by the length of the
first. So the fingerprints of all prefixes of a rebuilt conversation follow from stored prefix products of its two sources,
and no rebuilt text is ever made. The products of a long conversation are made in blocks of turns, then across blocks.

Equal (depth, fingerprint) is a node. That its members are equal is verified: they must have one parent and one last turn,
and turns of one hash must have one role and text. If not, all is hashed anew with another base.

Sums over subtrees need no walk through the tree. A node belongs to its smallest member, so every conversation owns the end
of its path from some depth on. What lies below a node is what its members own from that depth on: a suffix sum along the
owner's path, and the totals of the members that own only deeper nodes.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askspark.llm.common import shuffle_parts
from askspark.session import cut_lineage

PRIME = (1 << 31) - 1
LANES = 3
#: Turns of a block, parts of the children of one node, and ids of a piece of a list of ends.
BLOCK = 256
PARTS = 64
PIECE = 4096
FIRST_BLOCK = -(1 << 62)


def _bases(seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(1 << 20, PRIME) for _ in range(LANES)]


def _powers(base: int, count: int) -> Column:
    return F.expr("array(" + ", ".join(f"{pow(base, k, PRIME)}L" for k in range(count)) + ")")


def _power(base: int, exponent: Column) -> Column:
    """``base`` to a power below 2**32, from a table of powers for each of its eight hexadecimal digits."""
    out = None
    for level in range(8):
        powers = _powers(pow(base, 16**level, PRIME), 16)
        digit = F.element_at(powers, (F.shiftright(exponent, 4 * level) % 16 + 1).cast("int"))
        out = digit if out is None else out * digit % PRIME
    return out


def _lanes(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(LANES)]


def _hashed(turns: DataFrame, seed: int) -> DataFrame:
    """conv, turn, role, text with h0 and h1, 128 bits of the role and text."""
    return turns.withColumns({f"h{k}": F.xxhash64(F.lit(2 * seed + k), "role", "text") for k in (0, 1)})


def prefix_products(hashed: DataFrame, bases: list[int]) -> DataFrame:
    """Per turn: conv, pos (from 1), h0, h1, bytes, the product p0.. up to the turn and q0.. up to the one before."""
    x = [F.col("h0"), F.shiftrightunsigned("h0", 32), F.col("h1")]
    x = [v.bitwiseAND(F.lit(PRIME)) % PRIME for v in x]
    # a null turn comes first
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(FIRST_BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = hashed.withColumn("block", block)
    rows = rows.select("conv", "block", "h0", "h1", F.octet_length("text").cast("long").alias("bytes"), F.row_number().over(inside).cast("long").alias("r"))
    ordered = Window.partitionBy("conv", "block").orderBy("r")
    terms = rows.withColumns({f"t{i}": x[i] * _power(b, F.col("r")) % PRIME for i, b in enumerate(bases)})
    parts = cut_lineage(terms.withColumns({f"y{i}": F.sum(f"t{i}").over(ordered) % PRIME for i in range(LANES)}), "turn-products")
    blocks = parts.groupBy("conv", "block").agg(F.count("*").alias("n"), *(F.sum(f"t{i}").alias(f"z{i}") for i in range(LANES)))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.withColumns({f"f{i}": _power(b, F.col("off")) for i, b in enumerate(bases)})
    blocks = blocks.select("conv", "block", "off", *_lanes("f"), *(F.coalesce(F.sum(F.col(f"z{i}") % PRIME * F.col(f"f{i}") % PRIME).over(before), F.lit(0)).alias(f"l{i}") for i in range(LANES)))
    both = parts.join(blocks, ["conv", "block"])
    p = {f"p{i}": (F.col(f"l{i}") + F.col(f"y{i}") * F.col(f"f{i}")) % PRIME for i in range(LANES)}
    q = {f"q{i}": (F.col(f"l{i}") + (F.col(f"y{i}") - F.col(f"t{i}") + PRIME) % PRIME * F.col(f"f{i}")) % PRIME for i in range(LANES)}
    return both.select("conv", (F.col("off") + F.col("r")).alias("pos"), "h0", "h1", "bytes", *(v.alias(k) for k, v in (p | q).items()))


def _rebuilt(products: DataFrame, base: Column, head: Column, longest_head: int, bases: list[int]) -> DataFrame:
    """Per rebuilt conversation and depth: conv, depth, length, the product k0.. of the first turns and j0.. of one less, and
    the last turn (h0, h1, bytes)."""
    head = F.least(F.greatest(head, F.lit(0)), F.lit(longest_head)).cast("long")
    entry = F.struct("pos", "h0", "h1", "bytes", *_lanes("p"), *_lanes("q"))
    heads = products.where(F.col("pos") <= longest_head).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    cut = [F.coalesce(F.max(F.when(F.col("pos") == F.col("h"), F.col(f"p{i}"))), F.lit(0)).alias(f"c{i}") for i in range(LANES)]
    convs = products.withColumn("h", head).groupBy("conv", "h").agg(F.max("pos").alias("n"), *cut).withColumn("base", base)
    # few conversations share a base; where many do, adaptive execution splits their side
    convs = convs.join(heads, "base", "left")
    convs = convs.withColumn("taken", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.greatest(F.col("h"), F.lit(0)).cast("int")))
    convs = convs.withColumn("m", F.size("taken").cast("long"))
    shift = (F.col("h") - F.col("m")).cast("int")
    for i, b in enumerate(bases):
        convs = convs.withColumn(f"f{i}", F.element_at(_powers(pow(b, -1, PRIME), longest_head + 1), shift + 1))
        last = F.when(F.col("m") > 0, F.try_element_at("taken", F.col("m").cast("int"))[f"p{i}"]).otherwise(0)
        convs = convs.withColumn(f"g{i}", (last + PRIME - F.col(f"c{i}") * F.col(f"f{i}") % PRIME) % PRIME)
    convs = convs.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    out = ["conv", "depth", "length", *_lanes("k"), *_lanes("j"), "h0", "h1", "bytes"]
    nothing = [F.lit(0).cast("long").alias(c) for c in (*_lanes("k"), *_lanes("j"), "h0", "h1", "bytes")]
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), "length", *nothing)
    mine = convs.select("conv", "length", F.explode("taken").alias("t"))
    taken = mine.select("conv", F.col("t.pos").alias("depth"), "length", *(F.col(f"t.p{i}").alias(f"k{i}") for i in range(LANES)), *(F.col(f"t.q{i}").alias(f"j{i}") for i in range(LANES)), "t.h0", "t.h1", "t.bytes")
    rest = products.join(convs.select("conv", "h", "m", "length", *_lanes("f"), *_lanes("g")), "conv").where(F.col("pos") > F.col("h"))
    moved = lambda side, i: ((F.col(f"g{i}") + F.col(f"f{i}") * F.col(f"{side}{i}")) % PRIME)
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "length", *(moved("p", i).alias(f"k{i}") for i in range(LANES)), *(moved("q", i).alias(f"j{i}") for i in range(LANES)), "h0", "h1", "bytes")
    return roots.select(out).union(taken.select(out)).union(rest.select(out))


KEY = ["depth", *_lanes("k")]
PARENT = ["depth", *_lanes("j")]


def _end_digests(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of its ids in order, comma-joined. Pieces of a list are joined where they lie; a node's pieces
    then pass one task as a stream, as the hash of a list can only be made from its start to its end."""
    piece = F.floor(F.col("conv") / PIECE).cast("long")
    pieces = ends.groupBy(*KEY, piece.alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition(shuffle_parts(ends), *KEY).sortWithinPartitions(*KEY, "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=[*KEY, "ends_sha256"])

    return ordered.select(*KEY, "ids").mapInArrow(digest, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def _suffix_sums(shared: DataFrame) -> DataFrame:
    """(owner, depth, below): the weights of what an owner has from each depth on, in blocks of depths."""
    rows = shared.select("owner", "depth", "weight", F.floor(F.col("depth") / BLOCK).cast("long").alias("block"))
    later = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("owner", "block").agg(F.sum("weight").alias("w"))
    blocks = blocks.select("owner", "block", F.coalesce(F.sum("w").over(later), F.lit(0)).alias("later"))
    deeper = Window.partitionBy("owner", "block").orderBy(F.desc("depth"))
    rows = rows.withColumn("inside", F.sum("weight").over(deeper))
    return rows.join(blocks, ["owner", "block"]).select("owner", "depth", (F.col("inside") + F.col("later")).alias("below"))


def prefix_trie(
    turns: DataFrame, base: Column, head: Column, longest_head: int, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", seed: int = 0, most_seeds: int = 8,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, bytes of the last turn times members but
    one) and ``ends_sha256`` (of the ids of members that end here).

    ``base`` and ``head`` are expressions over a column ``conv``: conversation c becomes the first ``head`` turns of ``base``
    (all if it has fewer, none if it is absent; at most ``longest_head``) and its own turns after its first ``head``. Ids are
    whole numbers; rows without one are no conversation and are left out. Turns go by number, null first, equal ones by role,
    then text; repeated rows are repeated turns. A null role or text is empty. An empty table has no nodes, not even a
    root. Other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    for attempt in range(seed, seed + most_seeds):
        bases, hashed = _bases(attempt), _hashed(plain, attempt)
        products = cut_lineage(prefix_products(hashed, bases), "prefix-products")
        rows = cut_lineage(_rebuilt(products, base, head, longest_head, bases), "rebuilt-prefixes")
        same = [*_lanes("j"), "h0", "h1", "bytes"]
        nodes = rows.groupBy(*KEY).agg(
            F.count("*").alias("n_convs"), F.min("conv").alias("owner"), *(F.min(c).alias(c) for c in same),
            F.array(*(F.min(c) for c in same)).alias("low"), F.array(*(F.max(c) for c in same)).alias("high"),
        )
        nodes = cut_lineage(nodes.withColumn("unequal", F.col("low") != F.col("high")).drop("low", "high"), "trie-nodes")
        role, words = F.min("role") != F.max("role"), F.min("text") != F.max("text")
        mixed = hashed.groupBy("h0", "h1").agg((role | words).alias("mixed")).where("mixed")
        if nodes.where("unequal").isEmpty() and mixed.isEmpty():
            break
    else:
        raise RuntimeError(f"turns collide under {most_seeds} seeds")

    part = F.pmod(F.xxhash64("owner"), F.lit(PARTS)).cast("int")
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *(F.col(f"j{i}").alias(f"k{i}") for i in range(LANES)), part.alias("part"))
    children = below.groupBy(*KEY).agg(F.count("*").alias("n_children"), F.collect_set("part").alias("parts"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut_lineage(nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes")), "trie-parents")

    # the children of one node meet its row in PARTS parts, so that no task has them all
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(f"k{i}").alias(f"j{i}") for i in range(LANES)), F.col("owner").alias("parent_conv_id"), F.explode("parts").alias("part"))
    nodes_of = nodes.withColumn("part", part).join(parents, [*PARENT, "part"], "left")

    leaf = F.max((F.col("n_children") == 0).cast("int"))
    owners = nodes.groupBy("owner").agg(F.min("depth").alias("first"), F.sum("weight").alias("total"), leaf.alias("leaf"))
    bearing = owners.where("total > 0 OR leaf = 1").withColumnRenamed("owner", "conv")
    above = rows.select("conv", *KEY).join(bearing, "conv").where(F.col("depth") < F.col("first"))
    sums = above.groupBy(*KEY).agg(F.sum("total").alias("more"), F.sum("leaf").alias("leaves"))
    suffix = _suffix_sums(nodes.where("n_convs > 1"))
    ends = _end_digests(rows.where("depth = length").select("conv", *KEY))
    found = nodes_of.join(sums, KEY, "left").join(ends, KEY, "left")
    found = found.join(suffix, ["owner", "depth"], "left").join(owners.select("owner", "leaf"), "owner")
    zero = F.lit(0).cast("long")
    return found.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.coalesce("leaves", zero) + F.col("leaf")).alias("n_leaves"), (F.coalesce("more", zero) + F.coalesce("below", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
