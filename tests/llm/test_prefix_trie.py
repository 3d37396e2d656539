"""The conversation trie against rebuilding every conversation in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from askspark.llm import prefix_trie as P


def brute(rows, base, head):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {c: turns.get(base(c), [])[: head(c)] + v[head(c) :] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
        ends[tuple(rebuilt[c])].append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaves = [x for x in below if not any(y[:-1] == x for y in members if y)]
        out.append((
            m[0], len(k), members[k[:-1]][0] if k else None, len(m), sum(bool(y) and y[:-1] == k for y in members), len(leaves),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


SCHEMA = "conv_id long, turn int, role string, text string, depth int, `k0` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def standard(df, **more):
    conv = F.col("conv")
    return P.prefix_trie(df, conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8, **more)


def sides():
    return (lambda c: c - c % 5), (lambda c: zlib.crc32(str(c).encode()) % 9)


def test_trie_equals_rebuilding(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 1000, 1004, 99999]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "long text", None, ""])))
    rows += [(c, t, "user", "hi") for c in range(200, 260) for t in range(4)]  # a hot path, of which many end alike
    rows += [(None, 1, "user", "nobody"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]
    assert found(standard(table(spark, rows))) == brute(rows, *sides())


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "PIECE", 3)
    rng = random.Random(4)
    rows = [(c, t, "u", rng.choice("ab") if t > 30 else "same") for c in range(12) for t in range(45)]
    assert found(standard(table(spark, rows))) == brute(rows, *sides())


def test_turnless_and_empty(spark):
    rows = [(c, t, "u", "x") for c in (1, 2, 3, 4, 6, 7, 8) for t in range(2)]  # no conversation 0 or 5 to take heads from
    assert found(standard(table(spark, rows))) == brute(rows, *sides())
    assert standard(table(spark, [])).count() == 0


def test_colliding_turns_are_hashed_anew(spark, monkeypatch):
    real = P._hashed

    def worse(turns, seed):
        hashed = real(turns, seed)
        return hashed.withColumns({"h0": F.length("text").cast("long"), "h1": F.lit(1).cast("long")}) if seed == 0 else hashed

    monkeypatch.setattr(P, "_hashed", worse)
    rows = [(c, t, "u", "ab"[(c + t) % 2]) for c in range(9) for t in range(5)]
    assert found(standard(table(spark, rows))) == brute(rows, *sides())


def test_colliding_products_are_hashed_anew(spark, monkeypatch):
    real = P._bases
    monkeypatch.setattr(P, "_bases", lambda seed: [1] * P.LANES if seed == 0 else real(seed))  # with base 1 order is lost
    rows = [(c, t, "u", "abc"[(c * 2 + t) % 3]) for c in range(9) for t in range(3)]
    assert found(standard(table(spark, rows))) == brute(rows, *sides())
