"""Not-modified revisit records of a web archive, resolved to the full response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askspark.llm.common import UPPER

#: Headers that a not-modified answer may update on the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Key under which captures of one page meet: no scheme, user or fragment; host lower-cased without ``www.`` and
    default port; no tracking parameters; no slash at the end. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(bare, r"(?s)^[^/?]*", 0), UPPER, UPPER.lower()), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, r"(?s)(\?.*)$", 1), r"(?<=[?&])utm_[a-z]+=[^&]*(&|$)", "")
    return F.concat(host, path, F.regexp_replace(query, r"[?&]$", ""))


def lower_names(headers: Column) -> Column:
    """Header map with lower-cased names; of names that differ in case alone the last counts. Null becomes empty."""
    empty = F.create_map().cast("map<string,string>")
    entries = F.transform(F.map_entries(F.coalesce(headers, empty)), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def merged_headers(stored: Column, fresh: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """The stored headers, updated by the permitted ones of the revisit."""
    update = F.map_filter(fresh, lambda k, v: k.isin(*permitted) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(update, k)), update)


def resolve_revisits(records: DataFrame, bucket: int = 86_400, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row per revisit record: ``record_id``, ``canonical_url``, ``captured_at``, ``original_id``, ``original_at``,
    ``verdict``, ``headers`` (merged where resolved, else the revisit's own) and ``digest`` (of the original's payload).

    ``records`` has record_id, url, captured_at (long, seconds), record_type ('response' or 'revisit'), status, headers
    (map) and digest; other columns are ignored. A full response has status 200. The original is the latest full response
    of the same canonical url captured strictly earlier; of several at one time the largest record_id. Verdicts:
    'resolved' (a shared validator is equal: the entity tag, weakly compared, where both have one, else the time of last
    change), 'validator_mismatch', 'no_validator' (none in common) and 'no_original' (also for a null url or time).
    Repeated revisits give repeated rows; a table without revisits an empty result.

    A url captured very often is cut into spans of ``bucket`` seconds; each span learns from one row per span before it
    what to start with, so no task holds more of a url than one span and one row per span.
    """
    headers = lower_names(F.col("headers"))
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("url"), F.col("captured_at").cast("long").alias("at"), "record_type", "status",
        headers.alias("headers"), "digest",
    )
    # what is looked up: one row for each url and time
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    original = F.struct("record_id", "at", "headers", "digest")
    points = rows.where(F.col("url").isNotNull() & F.col("at").isNotNull() & (full | (F.col("record_type") == "revisit")))
    points = points.groupBy("url", "at").agg(
        F.max_by(F.when(full, original), F.when(full, F.col("record_id"))).alias("original"),
        F.max(F.col("record_type") == "revisit").alias("asked"),
    ).withColumn("span", F.floor(F.col("at") / bucket))
    earlier = Window.partitionBy("url", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = points.withColumn("inside", F.last("original", ignorenulls=True).over(earlier)).where("asked").select("url", "at", "span", "inside")
    ends = points.groupBy("url", "span").agg(F.max_by("original", F.when(F.col("original").isNotNull(), F.col("at"))).alias("end"))
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("url", "span", F.last("end", ignorenulls=True).over(before).alias("start"))
    latest = inside.join(starts, ["url", "span"], "left").select("url", "at", F.coalesce("inside", "start").alias("o"))

    revisits = rows.where(F.col("record_type") == "revisit").select("record_id", "url", "at", "headers")
    met = revisits.join(latest, ["url", "at"], "left")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    own, old = F.col("headers"), F.col("o.headers")
    same = F.when(tag(own).isNotNull() & tag(old).isNotNull(), tag(own) == tag(old)).otherwise(own["last-modified"] == old["last-modified"])
    verdict = (
        F.when(F.col("o").isNull(), "no_original").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    )
    met = met.withColumn("verdict", verdict)
    return met.select(
        "record_id", F.col("url").alias("canonical_url"), F.col("at").alias("captured_at"), F.col("o.record_id").alias("original_id"),
        F.col("o.at").alias("original_at"), "verdict",
        F.when(F.col("verdict") == "resolved", merged_headers(old, own, permitted)).otherwise(own).alias("headers"),
        F.when(F.col("verdict") == "resolved", F.col("o.digest")).alias("digest"),
    )
