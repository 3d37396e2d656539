"""Exact order statistics that never put one group into one task.

Values are cut into ranges by approximate quantiles or by sampled rows, and work is done per (group, range): a small piece
even when one group holds most of the rows. The bounds only steer the balance; every result is exact whatever they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askspark.session import cut_lineage

MIN_RANGES = 64


def join_back(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal, as grouping does, and keeps one copy of the key columns."""
    if not keys:
        return left.crossJoin(right)  # right is a global aggregate: one row
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _how_many(df: DataFrame, ranges: int | None) -> int:
    """As many ranges as there are shuffle partitions, so that pieces shrink as the cluster's settings grow."""
    return ranges or max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cuts(df: DataFrame, columns: list[str], ranges: int) -> list[list[float]]:
    """Approximate quantiles of each column in one pass, ascending, repeated where one value spans several."""
    return df.approxQuantile(columns, [i / ranges for i in range(1, ranges)], 0.25 / ranges)


def _number(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    """Number the range of a double column; missing values get the number after the last range."""
    edges = [-math.inf, *splits, math.inf]
    if len(edges) == 2:
        numbered = df.withColumn(out, F.when(F.col(col).isNotNull(), 0.0))
    else:
        numbered = Bucketizer(splits=edges, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
    return numbered.withColumn(out, F.coalesce(out, F.lit(float(len(edges) - 1))))


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], ranges: int | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per key, one column per entry of ``probs``; NULL values are ignored.

    Counting rows per (key, range) tells which ranges hold the wanted positions. Only rows of those ranges are then
    counted by value and ordered.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    (cuts,) = _cuts(rows, ["__x"], _how_many(df, ranges))
    rows = _number(rows, "__x", sorted(set(cuts)), "__range")

    def places(p: float) -> list[Column]:
        place = F.lit(float(p)) * (F.col("__total") - 1)
        return [F.floor(place), F.ceil(place)]

    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[c for p in probs.values() for c in places(p)])
    targets = (
        rows.groupBy(*keys, "__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(of_key))
        .where(F.exists(wanted, lambda at: (at >= F.col("__start")) & (at < F.col("__start") + F.col("__n"))))
        .drop("__n")
    )
    # Stored, so that its size is known: a small list of ranges then filters the rows without a shuffle.
    targets = cut_lineage(targets, "percentile-ranges")
    counted = (
        join_back(rows, targets, [*keys, "__range"])
        .groupBy(*keys, "__range", "__start", "__total", "__x")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    smaller = Window.partitionBy(*keys, "__range").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.col("__start") + F.coalesce(F.sum("__n").over(smaller), F.lit(0)))

    def at(place: Column) -> Column:
        hit = (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))
        return F.max(F.when(hit, F.col("__x")))

    ends, result = [F.max("__total").alias("__n")], []
    for name, p in probs.items():
        low, high = places(p)
        ends += [at(low).alias(f"__lo_{name}"), at(high).alias(f"__hi_{name}")]
        place = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        result.append((low + (place - F.floor(place)) * (high - low)).alias(name))
    return placed.groupBy(*keys).agg(*ends).select(*keys, *result)


def exact_ranks(
    df: DataFrame, part: list[str], by: str, tie: str, descending: bool = True, ranges: int | None = None
) -> DataFrame:
    """row_number, rank and dense_rank of *every* row, exact for hot groups and for hot values inside a group.

    Rows are dealt to ranges of (group, ``by``, ``tie``). The bounds are sampled rows, compared as they are, so texts with a
    common prefix, a value that fills a group and a group that fills the table are all cut, as ``tie`` is unique within its
    group. Rows are numbered inside a range and shifted by what earlier ranges hold of their group, told by one row per group
    and range. ``by`` and ``tie`` are columns that Spark can order: NaN is the largest number, rows without a value come last.
    """
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    how_many = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The group is never NULL, so that the join below keeps the windows' partitioning.
    rows = df.withColumn("__group", F.to_json(F.struct(*part)))
    dealt = rows.repartitionByRange(how_many, F.col("__group"), first, F.col(tie)).withColumn("__range", F.spark_partition_id())
    # Written once: numbers and shifts must see the same ranges.
    dealt = cut_lineage(dealt, "rank-ranges")

    cell = ["__group", "__range"]
    order = F.struct(F.col("__v").isNull() != F.lit(descending), "__v")
    value = F.struct("__v", "n")
    ends = [F.max_by(value, order), F.min_by(value, order)] if descending else [F.min_by(value, order), F.max_by(value, order)]
    heads = (
        dealt.groupBy(*cell, F.col(by).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*cell)
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), ends[0].alias("first"), ends[1].alias("last"))
    )
    of_group = Window.partitionBy("__group").orderBy("__range")
    before = of_group.rowsBetween(Window.unboundedPreceding, -1)
    # The first value of a range may go on from the range before. Its rank is where it began: remembered at the last range in
    # which a value began that reaches the range's end.
    shifts = (
        heads.withColumn("goes_on", F.coalesce(F.lag("last").over(of_group)["__v"].eqNullSafe(F.col("first.__v")) & (F.row_number().over(of_group) > 1), F.lit(False)))
        .withColumn("__n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("began", F.when((F.col("d") > 1) | ~F.col("goes_on"), F.col("__n0") + F.col("n") - F.col("last.n") + 1))
        .select(
            *cell, "__n0",
            F.when(F.col("goes_on"), F.last("began", ignorenulls=True).over(before)).alias("__began"),
            F.coalesce(F.sum(F.col("d") - F.col("goes_on").cast("int")).over(before), F.lit(0)).alias("__d0"),
        )
    )
    inside = Window.partitionBy(*cell)
    numbered = dealt.withColumns({
        "__row": F.row_number().over(inside.orderBy(first, tie)),
        "__rank": F.rank().over(inside.orderBy(first)),
        "__dense": F.dense_rank().over(inside.orderBy(first)),
    })
    goes_on = F.col("__began").isNotNull()
    return numbered.join(shifts, cell).select(
        *df.columns,
        (F.col("__n0") + F.col("__row")).alias("row_number"),
        F.when(goes_on & (F.col("__dense") == 1), F.col("__began")).otherwise(F.col("__n0") + F.col("__rank")).alias("rank"),
        (F.col("__d0") + F.col("__dense") - goes_on.cast("int")).alias("dense_rank"),
    )
