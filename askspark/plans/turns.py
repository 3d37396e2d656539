"""One turn for a whole table of chats: prompts come in, summaries move on, answers and sessions go out."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askspark.functions.prompts import apply_text_fn
from askspark.functions.text import error_category, strip
from askspark.operators.conversations import (
    MAX_PROMPT_CHARS,
    NEW_TITLE,
    NO_ANSWER,
    SUMMARY_KEEP,
    SUMMARY_TRIGGER,
    TITLE_CHARS,
    compact_history,
    split_for_summary,
)
from askspark.session import cut_lineage

PROMPT = "Summary:\n{summary}\n\n{recent}"
FAILED = "❌ Pipeline Error: "
SESSION = ["session_id", "title", "file_metadata", "created_at", "updated_at", "summary"]


class Turns(NamedTuple):
    """``added`` are the new messages (conv_id, turn, role, text), ``sessions`` all sessions as they are now, ``refused`` the
    prompts that are too long and ``waiting`` those that come after a chat's first."""

    added: DataFrame
    sessions: DataFrame
    refused: DataFrame
    waiting: DataFrame


def take_turns(
    sessions: DataFrame,
    messages: DataFrame,
    prompts: DataFrame,
    as_of: str,
    fn: Callable[[pd.Series], pd.Series] | None = None,
    summarize: Callable[[Column, Column], Column] | None = None,
    trigger: int = SUMMARY_TRIGGER,
    keep: int = SUMMARY_KEEP,
) -> Turns:
    """Append each chat's prompt, bring its summary up to date, ask ``fn`` with the summary and the recent turns, append the
    answer and store the session.

    ``sessions`` has the columns of ``SESSION``, ``messages`` (conv_id, turn, role, text), ``prompts`` (conv_id, version,
    prompt). A chat takes one turn: its prompt of the lowest version (of equal ones the first as text), the rest waits.
    Prompts over ``MAX_PROMPT_CHARS`` are refused and leave no trace; those without text or chat are dropped. A chat without a
    session is begun; one still called "New Session" is named by the prompt. A failed call answers with the kind of error, or
    with its text, an empty answer with a notice, and both are stored like any other. Chats without a prompt stay as they
    are and their messages are not read beyond the join. Every chat gets two new positions after its last; recent turns are
    fewer than ``trigger``, so no chat is gathered.
    """
    given = prompts.where("conv_id IS NOT NULL AND prompt IS NOT NULL").select("conv_id", "version", "prompt")
    long = F.length("prompt") > MAX_PROMPT_CHARS
    fitting = given.where(~long)
    lowest = fitting.groupBy("conv_id").agg(F.min(F.struct("version", "prompt")).alias("first"))
    asked = cut_lineage(lowest.select("conv_id", "first"), "asked")
    waiting = fitting.join(asked, "conv_id").where(F.struct("version", "prompt") > F.col("first")).select(given.columns)

    own = messages.select("conv_id", "turn", "role", "text").join(asked.select("conv_id"), "conv_id", "left_semi")
    last = own.groupBy("conv_id").agg(F.max("turn").alias("last"))
    kind = messages.schema["turn"].dataType
    turn = F.coalesce(F.col("last") + 1, F.lit(0)).cast(kind).alias("turn")
    user = asked.join(last, "conv_id", "left").select("conv_id", turn, F.lit("user").alias("role"), F.col("first.prompt").alias("text"))
    now = cut_lineage(own.unionByName(user), "turns")

    known = sessions.select(*SESSION).withColumnRenamed("session_id", "conv_id")
    before = asked.join(known, "conv_id", "left")
    summary = compact_history(now, before.select("conv_id", "summary"), summarize, trigger, keep)
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.coalesce("text", F.lit("")))
    recent = (
        split_for_summary(now, trigger, keep)
        .where(~F.col("is_old") & F.col("role").isin("user", "assistant"))
        .groupBy("conv_id")
        .agg(F.max("turn").alias("turn"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
        .select("conv_id", "turn", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("recent"))
    )
    replied = cut_lineage(apply_text_fn(summary.join(recent, "conv_id"), PROMPT, fn).drop("recent"), "replies")
    failed = F.concat(F.lit(FAILED), F.coalesce(error_category(F.col("answer_error")), F.substring("answer_error", 1, 500)))
    spoken = F.when(F.length(strip(F.col("answer"))) > 0, strip(F.col("answer"))).otherwise(F.lit(NO_ANSWER))
    reply = F.when(F.col("answer_error").isNotNull(), failed).otherwise(spoken)
    answers = replied.select("conv_id", (F.col("turn") + 1).cast(kind).alias("turn"), F.lit("assistant").alias("role"), reply.alias("text"))

    named = F.when(F.coalesce("title", F.lit(NEW_TITLE)) == NEW_TITLE, F.substring("first.prompt", 1, TITLE_CHARS)).otherwise(F.col("title"))
    stored = before.drop("summary").join(replied.select("conv_id", "summary"), "conv_id").select(
        F.col("conv_id").alias("session_id"), named.alias("title"), "file_metadata",
        F.coalesce("created_at", F.lit(as_of)).alias("created_at"), F.lit(as_of).alias("updated_at"), "summary",
    )
    others = sessions.select(*SESSION).join(asked.select(F.col("conv_id").alias("session_id")), "session_id", "left_anti")
    return Turns(user.unionByName(answers), others.unionByName(stored), given.where(long), waiting)
