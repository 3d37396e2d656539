"""Licence notices in documents, by diagonal voting.

Every rolling k-gram of words of a document joins the k-grams of the templates. A match at document word p and template
word q votes for the diagonal p - q: a notice that stands in the text unchanged puts all its votes on one diagonal, one
with words added or left out on neighbouring diagonals. Those are merged, and the merged span is accepted if enough
different template words stand in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askspark.llm.common import WORD_CHARS, lower_ascii

GRAM = 3
#: Phrases whose every exact place counts, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Opening sentences of public licence notices, as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}


def templates() -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, exact phrase or not, number of grams, position, gram) of every k-gram; a fixed, small list."""
    rows = []
    for number, (text, label, exact) in enumerate([*((t, x, True) for t, x in PHRASES.items()), *((t, x, False) for t, x in NOTICES.items())]):
        words = text.split(" ")
        n = len(words) - GRAM + 1
        rows += [(number, label, exact, n, i, " ".join(words[i : i + GRAM])) for i in range(n)]
    return rows


def template_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(templates(), "template int, label string, exact boolean, n_grams int, at int, t_gram string")
    return rows.withColumn("t_hash", F.xxhash64("t_gram"))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8, gap: int = 3
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_base`` (places of the exact phrases), ``first_word`` and
    ``last_word`` (smallest and largest start of such a place, else null), ``base_labels``, ``labels`` (with those of
    notices that have at least ``coverage`` of their k-grams in a span; both distinct, sorted, comma-joined), ``score``
    (largest coverage of any template, 0 to 1) and ``spans`` (label, start, end of each notice found, in words).

    Diagonals at most ``gap`` apart are merged. A null or empty text, or one of fewer than three words, has no labels and
    score 0. Repeated rows give repeated rows, as each row is a group of its own; other columns are ignored. The template
    list is fixed and small, so the k-grams meet it in the scan; only votes and one row per document are shuffled.
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(WORD_CHARS), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("w"))
    nothing = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("w") - GRAM),
        lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *(F.get("w", i + k) for k in range(GRAM))).alias("gram")),
    )
    # one element without a gram keeps a row for every document through the join
    each = F.explode(F.when(F.size("w") >= GRAM, F.concat(nothing, grams)).otherwise(nothing)).alias("g")
    exploded = rows.select("row", "id", F.size("w").cast("long").alias("n_words"), each)
    exploded = exploded.select("row", "id", "n_words", "g.pos", "g.gram", F.xxhash64("g.gram").alias("hash"))
    known = F.broadcast(template_table(spark))
    met = exploded.join(known, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    met = met.where((F.col("pos") < 0) | F.col("template").isNotNull())
    votes = met.groupBy("row", "id", "n_words", "template", "label", "exact", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(own) > gap
    group = F.sum(F.when(F.col("exact") | apart, 1).otherwise(0)).over(own)
    spans = votes.withColumn("group", group).groupBy("row", "id", "n_words", "template", "label", "exact", "n_grams", "group").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("first").alias("start"), (F.max("last") + GRAM).alias("end")
    )
    share = F.size("at") / F.col("n_grams")
    base = F.col("exact") & (F.size("at") == F.col("n_grams"))
    notice = ~F.col("exact") & (share >= coverage)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    found = spans.groupBy("row", "id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base"),
        F.collect_set(F.when(base | notice, F.col("label"))).alias("all"),
        F.max(F.coalesce(share, F.lit(0.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(notice, F.struct("start", "end", "label")))).alias("spans"),
    )
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.col("all")).alias("labels"), "score", "spans",
    )
