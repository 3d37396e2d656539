"""The named kinds of business question: filter, count, total, group, join, rank, share, compare, trend, growth."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askspark.operators.ordering import exact_percentiles, exact_ranks

GRAINS = ("day", "week", "month", "quarter", "year")


def filter_project(df: DataFrame, where: str, cols: list[str]) -> DataFrame:
    """Rows that pass ``where``, as the given column expressions."""
    return df.where(where).selectExpr(*cols)


def count_rows(df: DataFrame, where: str | None = None) -> DataFrame:
    """One row ``n``: how many rows pass ``where``."""
    return (df.where(where) if where else df).agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, sum, mean, minimum and maximum of each column, in one pass and one row."""
    parts = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        parts += [
            F.sum(c).alias(f"{c}_sum"),
            F.avg(c).alias(f"{c}_avg"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.agg(*parts)


def group_totals(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    """Group by ``keys``; ``aggs`` maps output names to aggregate expressions."""
    return df.groupBy(*keys).agg(*[F.expr(e).alias(name) for name, e in aggs.items()])


def group_having(df: DataFrame, keys: list[str], aggs: dict[str, str], having: str) -> DataFrame:
    """Groups whose aggregates pass ``having``."""
    return group_totals(df, keys, aggs).where(having)


def join_tables(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salt: int | None = None) -> DataFrame:
    """Equi-join; Catalyst and AQE choose the strategy from sizes and split skewed partitions.

    ``salt`` is for joins AQE cannot split, such as one feeding an aggregate on the same key: the left rows of a key are
    spread over ``salt`` tasks and the right rows are repeated for each, so use it with the smaller side on the right.
    """
    if not salt or salt < 2:
        return left.join(right, on, how)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a salted join repeats the right side, so it cannot keep unmatched right rows")
    others = [c for c in left.columns if c not in on] or on
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(salt)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return spread.join(repeated, [*on, "__salt"], how).drop("__salt")


def top_k(df: DataFrame, by: str, k: int, tie: list[str], ascending: bool = False) -> DataFrame:
    """First ``k`` rows by ``by`` (largest first unless ``ascending``), ties broken by ``tie``."""
    first = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(first, *tie).limit(k)


def rank_in_group(
    df: DataFrame, part: list[str], by: str, tie: str, k: int | None = None, ascending: bool = False
) -> DataFrame:
    """row_number, rank and dense_rank inside each group; with ``k`` only the first k rows of each group.

    With ``k`` the cut runs before the shuffle, so a hot group sends k rows per task. Without it every row is kept and
    ranked without ever collecting a group (see ``exact_ranks``).
    """
    if k is None:
        return exact_ranks(df, part, by, tie, descending=not ascending)
    first = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    place = Window.partitionBy(*part).orderBy(first, tie)
    cut = df.withColumn("row_number", F.row_number().over(place)).where(F.col("row_number") <= k)
    # Ranks look only at earlier rows of the group, and those are all inside the cut.
    value = Window.partitionBy(*part).orderBy(first)
    return cut.withColumns({
        "row_number": F.col("row_number").cast("bigint"),
        "rank": F.rank().over(value).cast("bigint"),
        "dense_rank": F.dense_rank().over(value).cast("bigint"),
    })


def share_of_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Total per group and its share of the whole; the whole is one scalar, not a window over all groups."""
    grouped = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    whole = grouped.agg(F.sum("total")).scalar()
    return grouped.withColumn("share", F.try_divide(F.col("total"), whole))


def compare_groups(df: DataFrame, key: str, pivot_col: str, values: list[str], agg: str) -> DataFrame:
    """One column per value of ``pivot_col``, and each later value minus the first. Values are given, not discovered.

    Every group is kept; ``agg`` is one SQL aggregate, so a count of a value that a group lacks is 0.
    """
    quoted = {v: str(v).replace("\\", "\\\\").replace("'", "\\'") for v in values}
    side = df.groupBy(key).agg(*(F.expr(f"{agg} FILTER (WHERE `{pivot_col}` = '{quoted[v]}')").alias(v) for v in values))
    diffs = {f"{v}_minus_{values[0]}": F.col(f"`{v}`") - F.col(f"`{values[0]}`") for v in values[1:]}
    return side.withColumns(diffs)


def trend(df: DataFrame, ts: str, grain: str, aggs: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Aggregates per calendar period (and ``keys``)."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    period = F.date_trunc(grain, F.col(ts)).cast(df.schema[ts].dataType).alias("period")
    return df.groupBy(*(keys or []), period).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])


def growth(df: DataFrame, ts: str, grain: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Total per period, the previous period's total, the change and the growth rate.

    A period without rows between others has total 0. Rows are reduced to one per period before the window, so the window
    is as long as the calendar, not the table.
    """
    keys = keys or []
    series = trend(df, ts, grain, {"total": f"sum({value})"}, keys).where("period IS NOT NULL")
    step = F.expr("interval 3 months" if grain == "quarter" else f"interval 1 {grain}")
    ends = series.groupBy(*keys).agg(F.min("period").alias("low"), F.max("period").alias("high")).where("low IS NOT NULL")
    calendar = ends.select(*(F.col(k).alias(f"__{k}") for k in keys), F.explode(F.sequence("low", "high", step)).alias("__period"))
    same = F.col("period") == F.col("__period")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    filled = calendar.join(series, same, "left")
    series = filled.select(
        *(F.col(f"__{k}").alias(k) for k in keys), F.col("__period").alias("period"),
        F.when(F.col("period").isNull(), 0).otherwise(F.col("total")).alias("total"),
    )
    previous = F.lag("total").over(Window.partitionBy(*keys).orderBy("period"))
    return (
        series.withColumn("previous", previous)
        .withColumn("change", F.col("total") - F.col("previous"))
        .withColumn("growth_rate", F.try_divide(F.col("total") - F.col("previous"), F.col("previous")))
    )


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum: one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    plain = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return plain.join(quartiles, "column", "left")


def correlation(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair, in one pass and one row."""
    return df.agg(*[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])


def distinct_values(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Number of distinct values per column, in one row; ``approx`` gives HyperLogLog estimates without the shuffle."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"{c}_distinct") for c in cols])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of a column."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def previous_period(grain: str, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Start and end (exclusive) of the last full period before ``as_of``."""
    day = dt.datetime(as_of.year, as_of.month, as_of.day)
    if grain == "day":
        return day - dt.timedelta(days=1), day
    if grain == "week":
        end = day - dt.timedelta(days=day.weekday())
        return end - dt.timedelta(days=7), end
    if grain == "year":
        return dt.datetime(day.year - 1, 1, 1), dt.datetime(day.year, 1, 1)
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    step = 3 if grain == "quarter" else 1
    months = day.year * 12 + (day.month - 1) // step * step
    start = months - step
    return dt.datetime(start // 12, start % 12 + 1, 1), dt.datetime(months // 12, months % 12 + 1, 1)


def in_last_period(df: DataFrame, ts: str, grain: str, as_of: dt.datetime) -> DataFrame:
    """Rows of the last full period before ``as_of``; a half-open range of literals, so it reaches the scan."""
    start, end = previous_period(grain, as_of)
    kind = df.schema[ts].dataType
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def range_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, grain: str = "month") -> DataFrame:
    """Pairs where ``start <= at < end``, found through calendar buckets instead of comparing all pairs.

    The ranges (right) are repeated once per period they touch; the points (left) keep one row. A hot period is split by
    AQE's skew join, as nothing after the join relies on its partitioning. A range that is empty or reversed holds nothing.
    """
    right = right.where(F.col(start) < F.col(end))
    kind = left.schema[at].dataType
    first = F.date_trunc(grain, F.col(start)).cast("timestamp_ntz")
    step = "interval 3 months" if grain == "quarter" else f"interval 1 {grain}"
    touched = F.sequence(first, F.col(end).cast("timestamp_ntz"), F.expr(step))
    ranges = right.withColumn("__bucket", F.explode(touched)).withColumn("__bucket", F.col("__bucket").cast(kind))
    points = left.withColumn("__bucket", F.date_trunc(grain, F.col(at)).cast(kind))
    return (
        points.join(ranges, "__bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")
    )
