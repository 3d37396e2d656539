"""Roll-ups of run traces: (run_id, session_id, active_file, run_name, latency_ms, tokens, is_error, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askspark.operators.ordering import exact_percentiles, join_back
from askspark.operators.relational import rank_in_group


def trace_rollup(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs, errors, mean and exact 95th percentile of latency, and tokens per key; hot keys are not gathered."""
    sums = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if("is_error").alias("n_errors"),
        F.avg("latency_ms").alias("latency_mean"),
        F.sum("tokens").alias("tokens"),
    )
    return join_back(sums, exact_percentiles(runs, keys, "latency_ms", {"latency_p95": 0.95}), keys, "left")


def slowest_runs(runs: DataFrame, keys: list[str], k: int, by: str = "latency_ms", tie: str = "run_id") -> DataFrame:
    """The ``k`` runs with the most latency (or tokens) per key."""
    return rank_in_group(runs, keys, by, tie, k=k)
