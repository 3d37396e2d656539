"""Equi-joins with very frequent keys, and joins of points with intervals of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askspark.session import cut_lineage

#: Keys that may be called frequent, and how many the sketch keeps track of. Bounds what passes the driver.
MOST_KEYS, TRACKED = 1000, 20_000


def heavy_keys(df: DataFrame, on: list[str], parts: int | None = None) -> list[tuple[int, int]]:
    """(hash of the key, parts to cut it into) of the keys that hold more than a fair share of a task's rows, by a frequent-items
    sketch that each task fills and Spark merges. A key that is missed, or two of one hash, cost speed alone."""
    tasks = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)).select(F.xxhash64(*on).alias("k"))
    row = keys.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {MOST_KEYS}, {TRACKED})").alias("top")).first()
    fair = max(1.0, row["n"] / tasks / 2)
    return [(t["item"], min(tasks, int(-(-t["count"] // fair)))) for t in row["top"] or [] if t["count"] > 2 * fair]


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """Equi-join that spreads the left rows of frequent keys over several tasks and repeats the right rows of those keys alone.

    It reads the key columns of the left side once more, to find such keys. ``how`` is inner, left, left_semi or left_anti.
    Null keys match nothing. Needed where adaptive execution cannot split a join, as where an aggregate on the same key follows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the right side is repeated, so it cannot keep unmatched rows")
    found = heavy_keys(left, on, parts)
    if not found:
        return left.join(right, on, how)
    few = left.sparkSession.createDataFrame(found, "__hash long, __parts int")

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("__hash", F.xxhash64(*on)).join(F.broadcast(few), "__hash", "left")  # at most MOST_KEYS rows

    others = [c for c in left.columns if c not in on] or on
    spread = cut(left).withColumn("__salt", F.pmod(F.xxhash64(*others), F.coalesce("__parts", F.lit(1))).cast("int"))
    repeated = cut(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    gone = ["__hash", "__parts", "__salt"]
    kept = [c for c in right.columns if c not in on]
    return spread.drop("__hash", "__parts").join(repeated.select(*on, "__salt", *kept), [*on, "__salt"], how).drop(*gone)


def _whole(c: Column, kind: T.DataType, up: bool = False) -> Column:
    """A whole number that does not fall where the value rises; of an end, not below it."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        return F.unix_micros(c.cast("timestamp"))
    return (F.ceil(c) if up else F.floor(c)).cast("long")


def interval_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """Pairs where ``start <= at < end``, for numbers, dates and times and for intervals of any mix of lengths.

    The line is cut into cells of length 4 ** level, for every level. An interval is put down in the cells of its own level,
    the least with cells no shorter than a quarter of it: at most five. A point looks in its one cell of each level that any
    interval has (at most 32; which ones is read first). So neither a long nor a short interval makes more rows than another, and a cell with
    very many points is cut by ``skew_join``. An empty, reversed or unbounded interval holds nothing.
    """
    kind = left.schema[at].dataType
    some = right.where((F.col(start) < F.col(end))).withColumns({"__s": _whole(F.col(start), right.schema[start].dataType), "__e": _whole(F.col(end), right.schema[end].dataType, True)})
    length = F.greatest(F.col("__e") - F.col("__s"), F.lit(1))
    level = F.greatest(F.ceil(F.log2(length) / 2) - 1, F.lit(0)).cast("int")
    shifted = lambda x, lv: F.call_function("shiftright", x, 2 * lv)
    ranges = some.withColumn("__level", level)
    levels = sorted(r["__level"] for r in ranges.select("__level").distinct().collect())
    if not levels:
        levels = [0]
    cells = F.sequence(shifted(F.col("__s"), F.col("__level")), shifted(F.col("__e"), F.col("__level")))
    ranges = ranges.withColumn("__cell", F.explode(cells)).drop("__s", "__e")
    points = left.where(F.col(at).isNotNull()).withColumn("__x", _whole(F.col(at), kind))
    looks = F.array(*(F.struct(F.lit(lv).alias("level"), shifted(F.col("__x"), F.lit(lv)).alias("cell")) for lv in levels))
    points = points.withColumn("__look", F.explode(looks)).withColumns({"__level": F.col("__look.level"), "__cell": F.col("__look.cell")}).drop("__look", "__x")
    met = skew_join(points, ranges, ["__level", "__cell"], parts=parts)
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__level", "__cell")


def stored_interval_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """``interval_join`` over sides that are written first, for inputs that are dear to compute: they are read three times."""
    return interval_join(cut_lineage(left, "points"), cut_lineage(right, "intervals"), at, start, end)
