"""Connected components with DataFrame operations alone.

Alternates two steps until nothing changes: every node passes its smallest neighbour to its larger neighbours, and every
node joins its smaller neighbours to the smallest of them. Each step is a minimum per node, which is pre-aggregated before
the shuffle, and a join back on the node, which adaptive execution splits for a node with very many edges. A round is
written to the shared folder, so that lost executors cost one round and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askspark.session import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node with an edge to another: the smallest node it is connected with.

    Edges have no direction; repeated edges, loops and edges with a null end change nothing. Without edges the result is
    empty. Nodes may be of any type that can be ordered.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = cut_lineage(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = _smallest(large)
        small = large.join(low, "u")
        moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
