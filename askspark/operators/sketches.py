"""Distinct counts and percentiles from sketches that are stored per period and merged when asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct-count sketch (relative error about 1.04 / sqrt(2 ** LG)), and the size of a percentile
#: sketch (rank error about 1.3 / K).
LG, K = 12, 400


def sketch_periods(
    df: DataFrame, ts: str, grain: str, keys: list[str] | None = None, distinct: list[str] | None = None, numeric: list[str] | None = None,
    lg: int = LG, k: int = K,
) -> DataFrame:
    """Per period (and ``keys``): ``n_rows``, a sketch ``distinct_<c>`` of the values of each column of ``distinct``, and a
    sketch ``numeric_<c>`` of each column of ``numeric``. Tasks fill sketches where rows are read, so a hot group sends one row
    a task; a sketch has a fixed size. Null and NaN values are left out."""
    period = F.date_trunc(grain, F.col(ts)).cast(df.schema[ts].dataType).alias("period")
    made = [F.count(F.lit(1)).alias("n_rows")]
    for c in distinct or []:
        made.append(F.hll_sketch_agg(F.col(c).cast("string"), lg).alias(f"distinct_{c}"))
    for c in numeric or []:
        value = F.col(c).cast("double")
        made.append(F.expr(f"kll_sketch_agg_double(CASE WHEN NOT isnan(__{c}) THEN __{c} END, {k})").alias(f"numeric_{c}"))
        df = df.withColumn(f"__{c}", value)
    return df.groupBy(*(keys or []), period).agg(*made)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` from the rows of ``sketch_periods``: the sketches of a month are the merged ones of its days."""
    made = [F.sum("n_rows").alias("n_rows")]
    for c in sketches.columns:
        if c.startswith("distinct_"):
            made.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("numeric_"):
            made.append(F.expr(f"kll_merge_agg_double(`{c}`)").alias(c))
    return sketches.groupBy(*keys).agg(*made) if keys else sketches.agg(*made)


def read_sketches(sketches: DataFrame, probs: dict[str, float] | None = None) -> DataFrame:
    """Estimates in place of sketches: ``<c>_distinct``, and ``<c>_<name>`` for each entry of ``probs``; null without values."""
    out = []
    for c in sketches.columns:
        if c.startswith("distinct_"):
            out.append(F.hll_sketch_estimate(c).alias(c.removeprefix("distinct_") + "_distinct"))
        elif c.startswith("numeric_"):
            has = F.expr(f"kll_sketch_get_n_double(`{c}`) > 0")
            for name, p in (probs or {"q25": 0.25, "q50": 0.5, "q75": 0.75}).items():
                at = F.expr(f"kll_sketch_get_quantile_double(`{c}`, CAST({p} AS DOUBLE))")
                out.append(F.when(has, at).alias(c.removeprefix("numeric_") + f"_{name}"))
        else:
            out.append(F.col(c))
    return sketches.select(*out)
