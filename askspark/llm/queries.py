"""The registered queries of this package and their SQL equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askspark.llm import bag_search, bpe, decontaminate, jaccard_join, lattice_lm, license_scan, nearest, prefix_trie, quality, revisits, token_counts, token_files, url_filter
from askspark.llm.common import md5_number, table
from askspark.session import cut_lineage, scratch_path

ORACLES: dict[str, str] = {}
ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
TOKENS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\\x20\\x09-\\x0D]+')"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records derived from ``pages``: six captures each, half a day apart. The first is a full response, the fourth
    sometimes, with a new entity tag; the others are revisits, of which some carry an old tag and some only a date."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length("html").alias("n"))
    key = F.concat(F.col("page_id").cast("string"), F.lit(":"), F.col("k").cast("string"))
    rows = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).withColumn("record_id", key)
    anew = md5_number(F.concat(F.col("page_id").cast("string"), F.lit(":new")), 3) == 0
    is_response = (F.col("k") == 0) | ((F.col("k") == 3) & anew)
    version = F.when((F.col("k") >= 3) & anew, "b").otherwise("a")
    stale = md5_number(key, 7) == 0
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 8), F.when(~is_response & stale, "old").otherwise(version), F.lit('"'))
    at = F.lit(1_700_000_000) + F.col("page_id") % 1000 * 60 + F.col("k") * 43_200
    text = lambda x: x.cast("string")
    response = F.create_map(
        F.lit("ETag"), etag, F.lit("Last-Modified"), text(F.col("page_id") % 100), F.lit("Content-Type"), F.lit("text/html"),
        F.lit("Content-Length"), text(F.coalesce("n", F.lit(0))), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Server"), F.lit("a"),
    )
    dated = F.create_map(F.lit("Last-Modified"), text(F.col("page_id") % 100), F.lit("Date"), text(at), F.lit("Server"), F.lit("b"))
    tagged = F.create_map(F.lit("ETag"), etag, F.lit("Date"), text(at), F.lit("Cache-Control"), F.lit("max-age=300"), F.lit("Content-Type"), F.lit("text/plain"))
    return rows.select(
        "record_id", "url", at.cast("long").alias("captured_at"), F.when(is_response, "response").otherwise("revisit").alias("record_type"),
        F.when(is_response, 200).otherwise(304).alias("status"),
        F.when(is_response, response).when(md5_number(key, 5) == 1, dated).otherwise(tagged).alias("headers"), "digest",
    )


def op1_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(captures(spark, sf_dir))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(lines, "; "))


ORACLES["op1_resolve_revisits"] = r"""
WITH page AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, coalesce(length(html), 0) AS n FROM pages),
captured AS (SELECT *, page_id || ':' || k AS record_id, ('0x' || left(md5(page_id || ':new'), 8))::BIGINT % 3 = 0 AS anew
  FROM page, (SELECT unnest(generate_series(0, 5)) AS k)),
kind AS (SELECT *, k = 0 OR (k = 3 AND anew) AS is_response, ('0x' || left(md5(record_id), 8))::BIGINT AS h,
  1700000000 + page_id % 1000 * 60 + k * 43200 AS moment FROM captured),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS u FROM kind),
parts AS (SELECT *,
    regexp_replace(translate(regexp_extract(u, '(?s)^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(u, '(?s)^[^/?]*([^?]*)', 1), '/+$', '')
    || regexp_replace(regexp_replace(regexp_extract(u, '(?s)(\?.*)$', 1), '([?&])utm_[a-z]+=[^&]*(&|$)', '\1', 'g'), '[?&]$', '') AS canon,
    '"' || left(digest, 8) || CASE WHEN NOT is_response AND h % 7 = 0 THEN 'old' WHEN k >= 3 AND anew THEN 'b' ELSE 'a' END || '"' AS tag,
    CAST(page_id % 100 AS VARCHAR) AS modified FROM bare),
record AS (SELECT *, NOT is_response AND h % 5 = 1 AS dated FROM parts),
paired AS (
  SELECT r.*, o.record_id AS o_id, o.moment AS o_moment, o.tag AS o_tag, o.modified AS o_modified, o.n AS o_n, o.digest AS o_digest,
    row_number() OVER (PARTITION BY r.record_id ORDER BY o.moment DESC, o.record_id DESC) AS place
  FROM record r LEFT JOIN record o ON o.canon = r.canon AND o.is_response AND o.moment < r.moment WHERE NOT r.is_response),
judged AS (SELECT *, CASE WHEN o_id IS NULL THEN 'no_original'
    WHEN CASE WHEN dated THEN modified = o_modified ELSE tag = o_tag END THEN 'resolved'
    ELSE 'validator_mismatch' END AS verdict FROM paired WHERE place = 1)
SELECT record_id, canon AS canonical_url, CAST(moment AS BIGINT) AS captured_at, o_id AS original_id, CAST(o_moment AS BIGINT) AS original_at, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: ' || CASE WHEN dated THEN 'max-age=60' ELSE 'max-age=300' END || '; content-length: ' || o_n
      || '; content-type: text/html; date: ' || moment || '; etag: ' || o_tag || '; last-modified: ' || o_modified || '; server: a'
    WHEN dated THEN 'date: ' || moment || '; last-modified: ' || modified || '; server: b'
    ELSE 'cache-control: max-age=300; content-type: text/plain; date: ' || moment || '; etag: ' || tag END AS headers,
  CASE WHEN verdict = 'resolved' THEN o_digest END AS digest
FROM judged
"""

#: The rules of the contract.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _rule_sql(host: str, path: str) -> str:
    fits = []
    for rule, verdict in URL_RULES:
        r_host, _, rest = rule.partition("/")
        fits.append(f"CASE WHEN ({host} = '{r_host}' OR ends_with({host}, '.{r_host}')) AND starts_with({path}, '/{rest}') THEN {{'n': {len(rule)}, 'rule': '{rule}', 'verdict': '{verdict}'}} END")
    return f"list_max(list_filter([{', '.join(fits)}], lambda x: x IS NOT NULL))"


def _url_sql(url: str, group: int) -> str:
    part = rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', {group})"
    return f"translate({part}, {ALPHABET})" if group == 1 else part


ORACLES["op2_filter_urls"] = rf"""
WITH RECURSIVE part AS (SELECT page_id, url, {_url_sql('url', 1)} AS host, {_url_sql('url', 2)} AS path, {_url_sql('url', 3)} AS query FROM pages),
page AS (SELECT *, {_rule_sql('host', 'path')} AS own,
    CASE WHEN host <> '' THEN lower(regexp_extract(url, '(?s)^(.*?)://', 1)) || '://' || host || path || query END AS node,
    CASE WHEN host <> '' THEN 'https://' || regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/+)$', '')
      || regexp_replace(regexp_replace(query, '([?&])(utm_[a-z]+|ref)=[^&]*(&|$)', '\1', 'g'), '[?&]$', '') END AS plain FROM part),
edge AS (SELECT DISTINCT node AS a, plain AS b FROM page WHERE node <> plain),
pair AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a AS node, a AS other FROM pair UNION SELECT reach.node, pair.b FROM reach JOIN pair ON reach.other = pair.a),
grouped AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
ruled AS (SELECT component, node, {_rule_sql(_url_sql('node', 1), _url_sql('node', 2))} AS own FROM grouped),
flag AS (SELECT component, bool_or(own.verdict = 'allow') AS allowed, bool_or(own.verdict = 'block') AS blocked FROM ruled GROUP BY component)
SELECT page_id, host, path, own.rule AS rule, coalesce(own.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, component
FROM page LEFT JOIN grouped USING (node) LEFT JOIN flag USING (component)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), held_out, public_tokenizers.path("piece_bpe_32k.model"))


def op6_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


ORACLES["op6_scan_licenses"] = f"""
WITH doc AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
template(template, label, exact, n_grams, t_at, gram) AS (VALUES {", ".join(str(r).replace("True", "true").replace("False", "false") for r in license_scan.templates())}),
place AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 3)) AS i FROM doc WHERE len(w) >= 3)),
vote AS (SELECT doc_id, template, label, exact, n_grams, t_at, i, i - t_at AS diagonal FROM place JOIN template USING (gram)),
line AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS apart
  FROM (SELECT DISTINCT doc_id, template, exact, diagonal FROM vote)),
part AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM line),
span AS (SELECT doc_id, template, label, exact, n_grams, part, count(DISTINCT t_at) AS hits, min(i) AS first
  FROM vote JOIN part USING (doc_id, template, exact, diagonal) GROUP BY ALL),
judged AS (SELECT *, hits / n_grams AS share, exact AND hits = n_grams AS base, NOT exact AND hits / n_grams >= 0.8 AS notice FROM span),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base OR notice))), ',') AS labels, max(share) AS score
  FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM doc LEFT JOIN found USING (doc_id)
"""


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op7_nearest"] = """
WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM vec q JOIN vec c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLES["op8_decontaminate"] = f"""
WITH doc AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
item AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS window_text, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT m FROM pattern),
place AS (
  SELECT doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') AS window_text
  FROM (SELECT doc_id, w, m, unnest(generate_series(0, len(w) - m)) AS i FROM doc, size WHERE len(w) >= m)),
found AS (SELECT doc_id, i, place.m, item_id FROM place JOIN pattern ON place.window_text = pattern.window_text AND place.m = pattern.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op9_similar_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), 4, 85, 100)


ORACLES["op9_similar_components"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 4, 0))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, b AS other FROM step UNION SELECT reach.node, step.b FROM reach JOIN step ON reach.other = step.a),
least_of AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least_of ON node = doc_id
"""


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text", "round_trip")


def op11_write_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.with_starts(cut_lineage(token_files.read_token_files(spark, path), "token-sums"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8)


_CRC_STEP = "list_reduce([xor(c, b)] || range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
_BYTES = "list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)"

ORACLES["op12_prefix_trie"] = f"""
WITH turn_row AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295::BIGINT] || {_BYTES}, lambda c, b: {_CRC_STEP}), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM turn_row)),
part AS (
  SELECT c.conv_id, 0 AS piece, pos, role, text FROM conv c JOIN turn_row t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM conv c JOIN turn_row t ON t.conv_id = c.conv_id WHERE pos > h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY piece, pos) AS depth FROM part),
prefix AS (
  SELECT conv_id, depth, strlen(text) AS bytes, string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM prefix GROUP BY key, depth),
child AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
sub AS (
  SELECT a.key, count(*) FILTER (child.key IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM node a JOIN node b ON starts_with(b.key, a.key) LEFT JOIN child ON child.key = b.key GROUP BY a.key),
tail AS (SELECT key, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM prefix JOIN (SELECT conv_id, max(depth) AS depth FROM prefix GROUP BY 1) USING (conv_id, depth) GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node n JOIN sub USING (key) LEFT JOIN child ON child.key = n.key LEFT JOIN tail ON tail.key = n.key
LEFT JOIN node p ON n.depth > 0 AND p.key = left(n.key, 32 * (n.depth - 1))
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.lexical_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = f"""
WITH doc AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM doc WHERE len(w) > 0),
posting AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc) GROUP BY ALL),
item AS (SELECT DISTINCT item_id, unnest({WORDS_SQL}) AS term FROM benchmark),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, total GROUP BY term, nn),
size AS (SELECT doc_id, 100 - 90 + (90 * len(w)::BIGINT * nn) // ll AS m FROM doc, total WHERE len(w) > 0),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item JOIN posting USING (term) JOIN weight USING (term) JOIN size USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_resolve_revisits, op2_filter_urls, op3_token_counts, op4_score_quality, op5_score_texts, op6_scan_licenses, op7_nearest,
        op8_decontaminate, op9_similar_components, op10_bpe_round_trip, op11_write_token_files, op12_prefix_trie,
        op13_ranked_search,
    )
}
