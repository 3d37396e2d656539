"""Chat history: JSON objects keyed by session id, as tables and back."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askspark.session import cut_lineage

SESSION_SCHEMA = (
    "struct<title string, file_metadata string, created_at string, updated_at string, summary string, "
    "part int, messages array<struct<role string, content string>>>"
)
PART_TURNS = 1000


class History(NamedTuple):
    """``sessions`` as ``read_sessions`` gives them; ``broken``: text (file, text) of members that are no readable session."""

    sessions: DataFrame
    broken: DataFrame


def read_sessions(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """One row per session (or per part of a long one) from history files.

    Each file is one JSON object keyed by session id; with ``whole_files=False`` each line is. Text that is not such an
    object gives no rows.
    """
    text = spark.read.text(path, wholetext=whole_files)
    parsed = text.select(F.from_json("value", f"map<string, {SESSION_SCHEMA}>").alias("m"))
    return parsed.select(F.explode("m").alias("session_id", "s")).select("session_id", "s.*")


def read_history(spark: SparkSession, path: str) -> History:
    """Sessions of history files, each one JSON object of any size keyed by session id, read by many tasks per file.

    Files are read in pieces that end at a closing brace, so one file is read by as many tasks as it has blocks. What a piece
    means depends on the text before it only by two facts, whether it starts inside a string and how many braces are open. Both
    are sums over earlier pieces: first within a block, then over one row per block. Pieces between two ends of a member are
    one session, the only text that is put together. An empty or blank file has no session; a member that does not parse, or a
    file that is cut off or goes on after its object, gives rows in ``broken``.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"),
    )
    # No escape reaches over a closing brace. Strings that end in the piece are taken out, then one that goes on.
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    outside = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), '"[^"]*$', "")
    after = F.when(plain.contains('"'), F.regexp_replace(plain, '^[^"]*"', "")).otherwise("")
    inside = F.regexp_replace(F.regexp_replace(after, '"[^"]*"', ""), '"[^"]*$', "")
    opened = lambda c: F.length(c) - F.length(F.replace(c, F.lit("{")))
    # Numbered pieces are written once: all sums below must see the same numbers.
    pieces = cut_lineage(
        text.withColumns({"quotes": (F.length(plain) - F.length(F.replace(plain, F.lit('"')))) % 2, "out": opened(outside), "in": opened(inside)}),
        "history-pieces",
    )
    block = ["file", "block"]
    in_block = Window.partitionBy(*block).orderBy("at")
    upto, before = (in_block.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    of_file = Window.partitionBy("file")
    blocks_before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def change(starts_inside: Column) -> Column:
        """Braces opened less braces closed by a piece; the one at its end counts unless it lies in a string."""
        ends_inside = (starts_inside.cast("int") + F.col("quotes")) % 2 == 1
        return F.when(starts_inside, F.col("in")).otherwise(F.col("out")) - F.when(ends_inside, 0).otherwise(1)

    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    pieces = pieces.withColumn("odd", odd)
    pieces = pieces.withColumns({"if_out": F.sum(change(F.col("odd"))).over(upto), "if_in": F.sum(change(~F.col("odd"))).over(upto)})
    blocks = (
        pieces.groupBy(*block)
        .agg(
            F.sum("quotes").alias("quotes"), F.max_by("if_out", "at").alias("if_out"), F.max_by("if_in", "at").alias("if_in"),
            F.sum(F.octet_length("text") + 1).alias("bytes"), F.max("size").alias("size"), F.max("at").alias("last"),
        )
        .withColumn("starts_in", F.coalesce(F.sum("quotes").over(blocks_before), F.lit(0)) % 2 == 1)
        .withColumn("open", F.coalesce(F.sum(F.when(F.col("starts_in"), F.col("if_in")).otherwise(F.col("if_out"))).over(blocks_before), F.lit(0)))
        # A file longer by one in pieces than in bytes does not end in a brace: its last piece has none.
        .withColumn("bare", F.when((F.sum("bytes").over(of_file) > F.col("size")) & (F.col("block") == F.max("block").over(of_file)), F.col("last")))
        .select(*block, "starts_in", "open", "bare")
    )
    depth = F.col("open") + F.when(F.col("starts_in"), F.col("if_in")).otherwise(F.col("if_out"))
    quoted = (F.col("starts_in").cast("int") + F.col("odd").cast("int") + F.col("quotes")) % 2 == 1
    ended = (~quoted & (depth <= 1) & ~F.col("at").eqNullSafe(F.col("bare"))).cast("int")
    placed = cut_lineage(pieces.join(blocks, block).select(*block, "at", "text", ended.alias("ended")), "history-ends")
    ends = placed.groupBy(*block).agg(F.sum("ended").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(blocks_before), F.lit(0)))
    member = F.col("earlier") + F.coalesce(F.sum("ended").over(before), F.lit(0))
    numbered = placed.join(ends.drop("n"), block).select("file", member.alias("member"), "block", "at", "text", "ended")
    members = numbered.groupBy("file", "member").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts"), F.max("ended").alias("ended")
    )
    body = F.concat(F.array_join("parts.text", "}"), F.when(F.col("ended") == 1, "}").otherwise(""))
    first = F.when(F.col("member") == 0, r"^\s*\{").otherwise(r"^\s*,")
    members = members.select("file", "member", body.alias("text")).withColumn("fits", F.regexp_like("text", first))
    # What is left at the end is the brace of the whole object, or blank.
    closing = F.regexp_like("text", F.when(F.col("member") == 0, F.lit(r"^\s*(\{\s*\})?\s*$")).otherwise(F.lit(r"^\s*\}?\s*$")))
    parsed = members.where(~closing).withColumn(
        "m", F.from_json(F.concat(F.lit("{"), F.regexp_replace("text", r"^\s*[{,]", ""), F.lit("}")), f"map<string, {SESSION_SCHEMA}>")
    )
    good = F.coalesce(F.col("fits") & (F.size("m") == 1) & F.map_values("m")[0].isNotNull(), F.lit(False))
    read = parsed.where(good).select(F.explode("m").alias("session_id", "s")).select("session_id", "s.*")
    unclosed = (
        members.withColumn("closed", F.col("text").contains("}") & closing).groupBy("file")
        .agg(F.max("closed").alias("closed"), F.max(~F.regexp_like("text", F.lit(r"^\s*$"))).alias("any"))
        .where("any AND NOT closed").select("file", F.lit(None).cast("string").alias("text"))
    )
    return History(read, parsed.where(~good).select("file", "text").unionByName(unclosed))


def session_messages(sessions: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per message of read sessions, numbered from 0 within the session; ``part_turns`` is that of the writer."""
    return sessions.select("session_id", F.coalesce("part", F.lit(0)).alias("part"), F.posexplode("messages").alias("pos", "m")).select(
        "session_id", (F.col("part").cast("bigint") * part_turns + F.col("pos")).alias("turn"), "m.role", "m.content"
    )


def write_sessions(sessions: DataFrame, messages: DataFrame, path: str, part_turns: int = PART_TURNS) -> None:
    """Write history as text, one JSON object keyed by session id per line.

    ``messages`` (session_id, turn, role, content) has turns numbered from 0 without gaps. A session is written in
    parts of ``part_turns`` turns, so that no line and no task has to hold a chat of any length.
    """
    parts = (
        messages.withColumn("part", F.floor(F.col("turn") / part_turns).cast("int"))
        .groupBy("session_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("turns"))
    )
    # Heads are repeated for each part of their session, so that a long session is joined under many keys.
    last = messages.groupBy("session_id").agg(F.floor(F.max("turn") / part_turns).cast("int").alias("last"))
    heads = sessions.join(last, "session_id", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))
    )
    no_turns = F.array().cast("array<struct<role:string,content:string>>")
    row = heads.join(parts, ["session_id", "part"], "left").select(
        F.col("session_id").cast("string").alias("id"),
        F.struct(
            "title", "file_metadata", "created_at", "updated_at", "summary", "part",
            F.coalesce(
                F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))), no_turns
            ).alias("messages"),
        ).alias("body"),
    )
    row.select(F.to_json(F.map_from_arrays(F.array("id"), F.array("body"))).alias("value")).write.text(path)
