"""Batch text functions over rows: the place where a model would be called."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askspark.operators.skew import skew_join
from askspark.session import cut_lineage

# Words of an error that may pass, so that asking again makes sense.
PASSING_ERRORS = ("429", "rate", "quota", "timeout", "connection", "temporary", "unavailable")


def fill_template(template: str, columns: list[str]) -> Column:
    """``template`` with its ``{column}`` places filled from the row; a missing value becomes empty text."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in columns:
                raise ValueError(f"the template names an unknown column: {name!r}")
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def apply_text_fn(
    df: DataFrame,
    template: str,
    fn: Callable[[pd.Series], pd.Series] | None = None,
    out: str = "answer",
    fallback: str | None = None,
    attempts: int = 3,
    wait: float = 1.0,
) -> DataFrame:
    """Add ``out`` and ``out_error``: the function applied to each row's filled template, in Arrow batches.

    ``fn`` maps a batch of prompts to a batch of texts. A call that fails with an error that may pass (rate limits, timeouts,
    connections) is made again, up to ``attempts`` times in all, after ``wait``, 2 ``wait``, 4 ``wait``, ... seconds. If a
    batch fails for good, its rows are tried one by one, so that one bad row costs one error. Failed rows get the column named by ``fallback``, or NULL. Without ``fn`` nothing is asked: the
    answer is NULL, and so is the error.
    """
    if fn is None:
        fill_template(template, df.columns)
        return df.withColumns({out: F.lit(None).cast("string"), f"{out}_error": F.lit(None).cast("string")})
    passing = PASSING_ERRORS

    def call(batch: pd.Series) -> pd.Series:
        for attempt in range(1, attempts + 1):
            try:
                return fn(batch)
            except Exception as error:
                if attempt == attempts or not any(w in str(error).lower() for w in passing):
                    raise
                time.sleep(wait * 2 ** (attempt - 1))

    def safe(batch: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": call(batch).to_list(), "error": None}, index=batch.index)
        except Exception as error:
            if len(batch) == 1:
                return pd.DataFrame({"value": [None], "error": [str(error)[:500]]}, index=batch.index)
            return pd.concat([safe(batch.iloc[i : i + 1]) for i in range(len(batch))])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield safe(batch)

    udf = F.pandas_udf(run, "value string, error string")
    given = df.withColumn("__r", udf(fill_template(template, df.columns)))
    value = F.col("__r.value")
    if fallback is not None:
        value = F.when(F.col("__r.error").isNotNull(), F.col(fallback)).otherwise(value)
    return given.withColumns({out: value, f"{out}_error": F.col("__r.error")}).drop("__r")


def apply_text_fn_once(
    df: DataFrame,
    template: str,
    fn: Callable[[pd.Series], pd.Series] | None = None,
    out: str = "answer",
    fallback: str | None = None,
    attempts: int = 3,
    wait: float = 1.0,
) -> DataFrame:
    """``apply_text_fn`` that puts every distinct prompt once and joins the answers back; for a ``fn`` that gives equal prompts
    equal answers. Answers are written before they are joined, so that no later step asks again; a prompt that very many
    rows share is cut by ``skew_join``.
    """
    prompt = fill_template(template, df.columns)
    asked = df.select(prompt.alias("__prompt")).distinct()
    answered = cut_lineage(apply_text_fn(asked, "{__prompt}", fn, "__value", None, attempts, wait), "answers")
    given = skew_join(df.withColumn("__prompt", prompt), answered, ["__prompt"])
    error, value = F.col("__value_error"), F.col("__value")
    if fallback is not None:
        value = F.when(error.isNotNull(), F.col(fallback)).otherwise(value)
    return given.select(*df.columns, value.alias(out), error.alias(f"{out}_error"))
