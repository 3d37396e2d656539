"""Jobs over tables of chats: one row per message (conv_id, turn, role, text) or per session.

``turn`` is a position column, unique within its chat. Texts of whole chats are made in parts of ``part_turns`` consecutive
positions, so no operator collects a chat of any length into one task. Transcripts and exports always have one row per chat
and part, in which position p belongs to part floor(p / part_turns); summaries always have one row per chat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askspark.functions.text import strip

PART_TURNS = 1000
# Retention, summary windows and text budgets.
RETENTION_DAYS = 7
SUMMARY_TRIGGER = 10
SUMMARY_KEEP = 6
LINE_CHARS = 800
SUMMARY_CHARS = 1600  # about 400 tokens
MAX_PROMPT_CHARS = 200_000
PREVIEW_CHARS = 120
TITLE_CHARS = 18
NEW_TITLE = "New Session"
NO_ANSWER = "⚠️ No response generated."


def retain_recent(sessions: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Sessions updated within ``days`` before ``as_of``; those without a readable time stay."""
    updated = F.col("updated_at").try_cast("timestamp_ntz")
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return sessions.where(updated.isNull() | (updated >= cutoff))


def upsert_sessions(
    current: DataFrame, updates: DataFrame, as_of: str | None = None, days: int | None = None
) -> DataFrame:
    """Current sessions with updates applied: the newest version of each id wins, its first created_at is kept.

    Versions within ``updates`` are ordered by ``version``. With ``days``, expired sessions are purged from ``current``
    first, so a purged id starts anew. One aggregate per id, combined before the shuffle.
    """
    if days is not None:
        current = retain_recent(current, as_of, days)
    body = [c for c in current.columns if c not in ("session_id", "created_at")]
    versions = current.withColumn("version", F.lit(-1).cast("bigint")).unionByName(
        updates.withColumn("version", F.col("version").cast("bigint"))
    )
    merged = versions.groupBy("session_id").agg(
        F.max_by(F.struct(*body), F.col("version")).alias("last"), F.min_by("created_at", "version").alias("created_at")
    )
    values = [F.coalesce("last.summary", F.lit("")).alias("summary") if c == "summary" else F.col(f"last.{c}") for c in body]
    return merged.select("session_id", "created_at", *values)


def delete_sessions(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Sessions whose id is not listed."""
    return sessions.join(ids.select("session_id"), "session_id", "left_anti")


def _part(turn: Column, part_turns: int = PART_TURNS) -> Column:
    return F.floor(turn / part_turns)


def split_for_summary(messages: DataFrame, trigger: int = SUMMARY_TRIGGER, keep: int = SUMMARY_KEEP) -> DataFrame:
    """Mark turns that are old enough to be summarised: all but the last ``keep`` of chats with ``trigger`` or more.

    Length and cut-off per chat come from narrow aggregates that shrink before the shuffle. They are joined back on chat
    *and* part, so a chat with most of the rows is spread over as many join keys as it has parts.
    """
    turns = messages.select("conv_id", "turn")
    size = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first"), F.max("turn").alias("last")
    )
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cutoff = (
        turns.withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= max(keep, 1))
        .groupBy("conv_id")
        .agg(F.min("turn").alias("keep_from"))
    )
    per_part = size.join(cutoff, "conv_id").select(
        "conv_id", "n_turns", "last", "keep_from", F.explode(F.sequence(_part(F.col("first")), _part(F.col("last")))).alias("part")
    )
    old = (F.col("turn") < F.col("keep_from")) if keep > 0 else F.lit(True)
    return (
        messages.withColumn("part", _part(F.col("turn")))
        .join(per_part, ["conv_id", "part"])
        .withColumn("is_old", (F.col("n_turns") >= trigger) & old)
        .select(*messages.columns, "n_turns", "is_old")
    )


def transcript_line(role: Column, text: Column, max_chars: int = LINE_CHARS) -> Column:
    """``[ROLE]: text`` with the text stripped and cut."""
    body = strip(text)
    cut = F.when(F.length(body) > max_chars, F.concat(F.substring(body, 1, max_chars), F.lit("..."))).otherwise(body)
    return F.concat(F.lit("["), F.upper(F.coalesce(role, F.lit("unknown"))), F.lit("]: "), cut)


def _joined(value: str, separator: str) -> Column:
    """The group's values in turn order; only for groups of bounded size."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", value)))
    return F.array_join(F.transform(ordered, lambda t: t[value]), separator)


def format_transcript(messages: DataFrame, max_chars: int = LINE_CHARS, part_turns: int = PART_TURNS) -> DataFrame:
    """Transcript per chat and part (conv_id, part, transcript); parts joined by newlines give the whole."""
    return (
        messages.select(
            "conv_id",
            _part(F.col("turn"), part_turns).alias("part"),
            "turn",
            transcript_line(F.col("role"), F.col("text"), max_chars).alias("line"),
        )
        .groupBy("conv_id", "part")
        .agg(_joined("line", "\n").alias("transcript"))
    )


def fade_to_budget(previous: Column, transcript: Column, max_chars: int = SUMMARY_CHARS) -> Column:
    """Default summary without a model: the end of the new lines and the end of the previous summary, in a character budget.

    New lines get at least half of it, so later turns always enter; what is oldest fades first.
    """
    room = F.greatest(F.lit(max_chars // 2), max_chars - F.length(previous) - 1)
    lines = F.right(transcript, room)
    before = F.right(previous, max_chars - F.length(lines) - 1)
    return F.when(F.length(before) > 0, F.concat(before, F.lit("\n"), lines)).otherwise(F.right(transcript, F.lit(max_chars)))


def _fold(parts: DataFrame, summarize: Callable[[Column, Column], Column], fan: int) -> DataFrame:
    """(conv_id, transcript): one text per chat. Chats of several parts have them summarised, and the summaries joined as the
    lines of fewer parts, until one is left."""
    highest = parts.agg(F.max("part")).first()[0] or 0
    while highest > 0:
        several = parts.groupBy("conv_id").agg((F.count(F.lit(1)) > 1).alias("several"))
        line = F.when(F.col("several"), summarize(F.lit(""), F.col("transcript"))).otherwise(F.col("transcript"))
        lines = parts.join(several, "conv_id").select("conv_id", F.col("part").alias("turn"), line.alias("line"))
        parts = lines.groupBy("conv_id", _part(F.col("turn"), fan).alias("part")).agg(_joined("line", "\n").alias("transcript"))
        highest //= fan
    return parts.select("conv_id", "transcript")


def compact_history(
    messages: DataFrame,
    previous: DataFrame,
    summarize: Callable[[Column, Column], Column] | None = None,
    trigger: int = SUMMARY_TRIGGER,
    keep: int = SUMMARY_KEEP,
    part_turns: int = PART_TURNS,
    fan: int = 16,
) -> DataFrame:
    """New summary per chat (conv_id, summary), one row each, from the previous one and the turns that became old.

    Chats without old turns keep their summary. The default shows at most ``SUMMARY_CHARS`` characters from the end, and
    every line has at least one, so nothing before the latest ``SUMMARY_CHARS`` old turns can show and no more is collected.
    A model given as ``summarize`` (previous summary, text) sees every old turn: a chat of several parts has each part
    summarised, ``fan`` summaries at a time made into one, and the last text summarised with the previous summary.
    """
    old = split_for_summary(messages, trigger, keep).where("is_old").select("conv_id", "turn", "role", "text")
    if summarize is None:
        # From where lines can show is found on positions alone, and joined back by parts: texts before it are not shuffled.
        latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
        shown = old.select("conv_id", "turn").withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= SUMMARY_CHARS)
        shown = shown.groupBy("conv_id").agg(F.min("turn").alias("show_from"), F.max("turn").alias("show_to"))
        parts = F.explode(F.sequence(_part(F.col("show_from")), _part(F.col("show_to")))).alias("part")
        old = old.withColumn("part", _part(F.col("turn"))).join(shown.select("conv_id", "show_from", parts), ["conv_id", "part"])
        text = (
            old.where(F.col("turn") >= F.col("show_from")).withColumn("line", transcript_line(F.col("role"), F.col("text")))
            .groupBy("conv_id")
            .agg(_joined("line", "\n").alias("transcript"))
        )
        summarize = fade_to_budget
    else:
        text = _fold(format_transcript(old, part_turns=part_turns), summarize, fan)
    kept = previous.select("conv_id", F.coalesce("summary", F.lit("")).alias("before"))
    both = kept.join(text, "conv_id", "left")
    summary = F.when(F.col("transcript").isNull(), F.col("before")).otherwise(summarize(F.col("before"), F.col("transcript")))
    return both.select("conv_id", summary.alias("summary"))


def final_answer(messages: DataFrame) -> DataFrame:
    """Answer per chat: last assistant text without tool calls, else the last assistant text, else a notice.

    ``messages`` has a boolean ``has_tool_calls``. One aggregate, combined before the shuffle.
    """
    text = strip(F.col("text"))
    spoken = (F.col("role") == "assistant") & (F.length(text) > 0)
    direct = spoken & ~F.coalesce("has_tool_calls", F.lit(False))
    best = F.max(F.when(spoken, F.struct(direct.alias("direct"), "turn", text.alias("text"))))
    return messages.groupBy("conv_id").agg(best.alias("best")).select(
        "conv_id", F.coalesce("best.text", F.lit(NO_ANSWER)).alias("answer")
    )


def derive_titles(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions still called "New Session" take the start of the attached file's name or of the first user text."""
    first = (
        messages.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.min_by(F.substring("text", 1, TITLE_CHARS), "turn").alias("asked"))
    )
    named = F.coalesce(F.substring("file_metadata", 1, TITLE_CHARS), F.col("asked"), F.col("title"))
    return sessions.join(first, "conv_id", "left").select(
        *[c for c in sessions.columns if c != "title"],
        F.when(F.col("title") == NEW_TITLE, named).otherwise(F.col("title")).alias("title"),
    )


def prepare_turns(messages: DataFrame, max_chars: int = MAX_PROMPT_CHARS) -> DataFrame:
    """User and assistant turns with a too-long flag for prompts and a short preview."""
    return messages.where(F.col("role").isin("user", "assistant")).withColumns({
        "too_long": (F.col("role") == "user") & (F.length("text") > max_chars),
        "preview": F.substring("text", 1, PREVIEW_CHARS),
    })


def export_markdown(messages: DataFrame, sessions: DataFrame, as_of: str, part_turns: int = PART_TURNS) -> DataFrame:
    """Markdown per chat and part (conv_id, part, markdown): head, optional summary, then every message.

    Parts concatenated in order give the document.
    """
    role = F.upper(F.coalesce("role", F.lit("unknown")))
    # Layout of the exported document.
    icon = F.when(role == "USER", "👤").otherwise("🤖")
    block = F.concat(F.lit("### "), icon, F.lit(" "), role, F.lit("\n\n"), strip(F.col("text")), F.lit("\n\n---\n\n"))
    blocks = messages.select("conv_id", _part(F.col("turn"), part_turns).alias("part"), "turn", block.alias("block"))
    head = F.concat(
        F.lit("# 💬 "), F.col("title"), F.lit(f"\n\n**Exported**: {as_of}\n\n"),
        F.when(F.length("summary") > 0, F.concat(F.lit("## 📝 Conversation Summary\n\n"), F.col("summary"), F.lit("\n\n")))
        .otherwise(""),
        F.lit("---\n\n## Full Conversation\n\n"),
    )
    # The head is one more block, placed before the first turn, so that no join has to gather a chat.
    heads = sessions.select("conv_id", F.lit(0).cast("bigint").alias("part"), F.lit(-1).cast("bigint").alias("turn"), head.alias("block"))
    return blocks.unionByName(heads).groupBy("conv_id", "part").agg(_joined("block", "").alias("markdown"))
