"""Corpus preparation and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from askspark.functions.prompts import apply_text_fn
from askspark.plans.rewriting import STRATEGY_PROMPT, rewrite_questions
from askspark.operators import chunking as C
from askspark.operators import lexical as L
from askspark.operators import retrieval as S
from askspark.operators import vectors as V
from askspark.plans.documents import answer_questions, index_documents
from askspark.session import cut_lineage
from askspark.sources.files import extract_page_text
from workload import tables as I
from workload.tables import table, texts

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("s04_extract_page_text", r"""
    WITH t AS (SELECT page_id, url, html AS h FROM pages),
    a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
        '<!--.*?(?:-->|$)', ' ', 'gs'), '<script\b[^>]*>.*?(?:</script\s*>|$)', ' ', 'gsi'),
        '<style\b[^>]*>.*?(?:</style\s*>|$)', ' ', 'gsi'), '<[^>]*(?:>|$)', ' ', 'gs') AS h FROM t),
    b AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'),
        '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS h FROM a)
    SELECT page_id AS doc_id, 1::INTEGER AS page, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text, url AS source
    FROM b WHERE length(trim(regexp_replace(h, '\s+', ' ', 'g'))) > 0""")
def _(spark, d):
    return extract_page_text(texts(spark, d, "pages", "page_id"))


@query("d01_drop_empty_documents", r"""
    SELECT doc_id, n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100""")
def _(spark, d):
    return C.drop_empty_documents(texts(spark, d, "documents", "doc_id"), min_chars=100).select("doc_id", "n_chars")


TIER_SQL = """
    SELECT doc_id, text, CASE WHEN n_pages <= 5 THEN 500 WHEN n_pages <= 15 THEN 1000 ELSE 2000 END::INTEGER AS chunk_size,
           CASE WHEN n_pages <= 5 THEN 50 WHEN n_pages <= 15 THEN 100 ELSE 200 END::INTEGER AS chunk_overlap
    FROM (SELECT *, ceil(n_chars / 3000.0) AS n_pages FROM documents)"""


def tiered(spark, d):
    return C.chunk_tier(texts(spark, d, "documents", "doc_id"), F.ceil(F.col("n_chars") / 3000))


@query("d02_chunk_tier", f"SELECT doc_id, chunk_size, chunk_overlap FROM ({TIER_SQL})")
def _(spark, d):
    return tiered(spark, d).select("doc_id", "chunk_size", "chunk_overlap")


def chunk_sql(source: str, columns: str) -> str:
    """Chunks of ``source`` (doc_id, text, chunk_size, chunk_overlap), built from pieces instead of offsets.

    Texts hold no blank lines, so there are two levels of pieces, lines and words. Every word is shorter than a chunk. A
    unit is a run of neighbouring short lines, or the words of one long line; a recursive query packs each unit.
    """
    return rf"""
    WITH RECURSIVE src AS ({source}),
    line AS (SELECT doc_id, chunk_size AS size, chunk_overlap AS lap, unnest(parts) AS piece, generate_subscripts(parts, 1) AS no
             FROM (SELECT *, list_filter(regexp_extract_all(text, '(?s)\n?[^\n]*'), lambda x: x <> '') AS parts FROM src)),
    placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY no) - length(piece) AS pos0,
               length(piece) >= size AS long FROM line),
    runs AS (SELECT *, sum(long::INT) OVER (PARTITION BY doc_id ORDER BY no) * 2 + (NOT long)::INT AS run FROM placed),
    lines AS (SELECT doc_id, size, lap, run * 1000000 AS unit, no AS i, piece, pos0 FROM runs WHERE NOT long),
    word AS (SELECT doc_id, size, lap, run * 1000000 + no AS unit, pos0 AS base, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
             FROM (SELECT *, list_filter(regexp_extract_all(piece, '(?s) ?[^ ]*'), lambda x: x <> '') AS parts FROM runs WHERE long)),
    words AS (SELECT doc_id, size, lap, unit, i, piece,
              base + sum(length(piece)) OVER (PARTITION BY doc_id, unit ORDER BY i) - length(piece) AS pos0 FROM word),
    pieces AS (SELECT * FROM lines UNION ALL SELECT * FROM words),
    bound AS (SELECT doc_id, unit, size[1] AS size, lap[1] AS lap, starts, list_append(starts, starts[len(starts)] + last) AS b FROM
              (SELECT doc_id, unit, list(size) AS size, list(lap) AS lap, list(pos0::BIGINT ORDER BY i) AS starts,
                      arg_max(length(piece), i) AS last FROM pieces GROUP BY doc_id, unit)),
    packed AS (
        SELECT doc_id, unit, size, lap, b, 1::BIGINT AS i, len(list_filter(b[1:size + 1], lambda x: x <= b[1] + size)) AS j FROM bound
        UNION ALL
        SELECT doc_id, unit, size, lap, b, i2, i2 - 1 + len(list_filter(b[i2:i2 + size], lambda x: x <= b[i2] + size)) FROM (
            SELECT *, i + len(list_filter(b[i:j], lambda x: x < greatest(b[j] - lap, b[j + 1] - size))) AS i2
            FROM packed WHERE j < len(b))),
    spans AS (SELECT doc_id, b[i] AS s, b[j] AS e FROM packed),
    cut AS (SELECT doc_id, s, e, substring(text, (s + 1)::BIGINT, (e - s)::BIGINT) AS piece FROM spans JOIN src USING (doc_id)),
    chunk AS (SELECT doc_id, s, e, piece, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS body FROM cut),
    numbered AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1)::INTEGER AS chunk_no,
        (s + length(piece) - length(regexp_replace(piece, '^\s+', '')))::INTEGER AS start, body AS text FROM chunk WHERE body <> '')
    SELECT {columns} FROM numbered"""


@query("d03_chunk_documents", chunk_sql(TIER_SQL, "doc_id, chunk_no, start, text"))
def _(spark, d):
    return C.chunk_documents(tiered(spark, d).select("doc_id", "text", "chunk_size", "chunk_overlap"))


@query("d03_chunk_totals", chunk_sql(
    "SELECT doc_id, text, 300 AS chunk_size, 0 AS chunk_overlap FROM documents",
    "doc_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, max(length(text))::INTEGER AS longest") + " GROUP BY doc_id")
def _(spark, d):
    chunks = C.chunk_documents(texts(spark, d, "documents", "doc_id").select("doc_id", "text"), 300, 0)
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("longest"))


TOKENS_SQL = "SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents"
BARE_SQL = r"SELECT doc_id AS key, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tokens FROM documents"


def index(spark, d, tokenizer="words"):
    return L.term_stats(texts(spark, d, "documents", "doc_id"), "doc_id", tokenizer=tokenizer)


@query("d04_postings", f"""
    SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(tokens) AS term FROM ({TOKENS_SQL})) GROUP BY key, term""")
def _(spark, d):
    return index(spark, d).postings


@query("d04_terms", f"""
    SELECT term, count(DISTINCT key) AS df FROM (SELECT key, unnest(tokens) AS term FROM ({BARE_SQL})) GROUP BY term""")
def _(spark, d):
    return index(spark, d, "whitespace").terms


@query("d04_stats", f"SELECT count(*) AS n_chunks, round(avg(len(tokens)), 6) AS mean_tokens FROM ({TOKENS_SQL})")
def _(spark, d):
    return index(spark, d).stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


def bm25_ctes(queries: str, tokens: str, query_tokens: str, idf: str) -> str:
    """CTEs ending in ``sparse`` (qid, key, score, rank) for the top 4."""
    return f"""
    tok AS ({tokens}), qs AS ({queries}),
    dl AS (SELECT key, len(tokens) AS n FROM tok), st AS (SELECT count(*) AS n, avg(n) AS mean FROM dl),
    post AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(tokens) AS term FROM tok) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    odds AS (SELECT term, (n - df + 0.5) / (df + 0.5) AS odds FROM dfs, st),
    idf AS (SELECT term, {idf} AS idf FROM odds),
    qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({query_tokens}) AS term FROM qs) GROUP BY ALL),
    scored AS (SELECT qid, key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.n / st.mean))), 9) AS score
               FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (key), st GROUP BY qid, key),
    sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::INTEGER AS rank FROM scored)
               WHERE rank <= 4)"""


WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
BARE = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
PLUS_ONE = "ln(1 + odds)"
OKAPI = "CASE WHEN ln(odds) < 0 THEN 0.25 * avg(ln(odds)) OVER () ELSE ln(odds) END"
ASKED_SQL = "SELECT item_id AS qid, text FROM benchmark"


def asked(spark, d):
    return table(spark, d, "benchmark").selectExpr("item_id AS qid", "text")


@query("d05_bm25_top_k", f"WITH {bm25_ctes(ASKED_SQL, TOKENS_SQL, WORDS, PLUS_ONE)} SELECT qid, key, round(score, 6) AS score, rank FROM sparse")
def _(spark, d):
    return L.bm25_top_k(asked(spark, d), index(spark, d)).withColumn("score", F.round("score", 6))


@query("d05_bm25_okapi", f"WITH {bm25_ctes(ASKED_SQL, BARE_SQL, BARE, OKAPI)} SELECT qid, key, round(score, 6) AS score, rank FROM sparse")
def _(spark, d):
    hits = L.bm25_top_k(asked(spark, d), index(spark, d, "whitespace"), idf="okapi")
    return hits.withColumn("score", F.round("score", 6))


def dense_ctes(queries: str) -> str:
    """CTEs ending in ``dense`` (qid, key, score, rank) for the nearest 4; ``queries`` gives (qid, v)."""
    return f"""
    qv AS ({queries}), vs AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings),
    far AS (SELECT qid, key, round(list_sum(list_transform(list_zip(qv.v, vs.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS score FROM qv, vs),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, key)::INTEGER AS rank FROM far) WHERE rank <= 4)"""


QUERY_VECTORS_SQL = "SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id"


def vectors(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id AS key", "embedding AS vector")


def query_vectors(spark, d):
    items = table(spark, d, "benchmark").selectExpr("item_id AS key")
    return items.join(vectors(spark, d), "key").withColumnRenamed("key", "qid")


DENSE_SQL = f"WITH {dense_ctes(QUERY_VECTORS_SQL)} SELECT qid, key, round(score, 6) AS score, rank FROM dense"


@query("d06_dense_top_k", DENSE_SQL)
def _(spark, d):
    return V.dense_top_k(query_vectors(spark, d), vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("d06_dense_top_k_blocks", DENSE_SQL)
def _(spark, d):
    # The way large query tables take: queries and corpus meet in bounded groups.
    hits = V.dense_top_k(query_vectors(spark, d), vectors(spark, d), max_shared_bytes=8192)
    return hits.withColumn("score", F.round("score", 6))


def mixed_vectors(spark, d):
    """Some zero vectors, and some with a NULL or NaN inside, among the others."""
    spoilt = "CASE vec_id % 7 WHEN 0 THEN transform(embedding, x -> CAST(0 AS FLOAT)) WHEN 1 THEN transform(embedding, (x, i) -> CASE i WHEN 3 THEN NULL ELSE x END) WHEN 2 THEN transform(embedding, (x, i) -> CASE i WHEN 3 THEN CAST('NaN' AS FLOAT) ELSE x END) ELSE embedding END AS vector"
    return table(spark, d, "embeddings").selectExpr("vec_id AS key", spoilt)


@query("d06_dense_top_k_cosine", """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS v
        FROM embeddings WHERE vec_id % 7 NOT IN (1, 2)),
    pair AS (SELECT item_id AS qid, c.vec_id AS key,
        round(CASE WHEN q.vec_id % 7 = 0 OR c.vec_id % 7 = 0 THEN 1.0 ELSE 1 - list_cosine_similarity(q.v, c.v) END, 9) AS score
        FROM benchmark JOIN v q ON item_id = q.vec_id, v c),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, key)::INTEGER AS rank FROM pair)
    SELECT qid, key, round(score, 6) AS score, rank FROM ranked WHERE rank <= 4""")
def _(spark, d):
    mixed = mixed_vectors(spark, d)
    asked = table(spark, d, "benchmark").selectExpr("item_id AS key").join(mixed, "key").withColumnRenamed("key", "qid")
    return V.dense_top_k(asked, mixed, metric="cosine").withColumn("score", F.round("score", 6))


@query("d07_dense_top_k_in_cells", DENSE_SQL)
def _(spark, d):
    hits = V.dense_top_k_in_cells(query_vectors(spark, d), V.build_cells(vectors(spark, d), 64))
    return hits.withColumn("score", F.round("score", 6))


FUSED_CTE = """
    both_ranks AS (SELECT qid, key, 0.3 / (60 + rank) AS part FROM sparse UNION ALL SELECT qid, key, 0.7 / (60 + rank) FROM dense),
    merged AS (SELECT qid, key, round(sum(part), 12) AS score FROM both_ranks GROUP BY qid, key),
    fused AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::INTEGER AS rank FROM merged)"""


@query("d08_fuse_ranks", f"""
    WITH {bm25_ctes(ASKED_SQL, TOKENS_SQL, WORDS, PLUS_ONE)}, {dense_ctes(QUERY_VECTORS_SQL)}, {FUSED_CTE}
    SELECT qid, key, round(score, 9) AS score, rank FROM fused""")
def _(spark, d):
    sparse = L.bm25_top_k(asked(spark, d), index(spark, d))
    dense = V.dense_top_k(query_vectors(spark, d), vectors(spark, d))
    return S.fuse_ranks(sparse, dense).withColumn("score", F.round("score", 9))


@query("d08_fuse_by_text", f"""
    WITH {bm25_ctes(ASKED_SQL, TOKENS_SQL, WORDS, PLUS_ONE)}, {dense_ctes(QUERY_VECTORS_SQL)},
    parts AS (SELECT qid, key, 0.3 / (60 + rank) AS part FROM sparse UNION ALL SELECT qid, key, 0.7 / (60 + rank) FROM dense),
    merged AS (SELECT qid, min(key) AS key, round(sum(part), 12) AS score FROM parts JOIN documents ON key = doc_id GROUP BY qid, text)
    SELECT qid, key, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key)::INTEGER AS rank FROM merged""")
def _(spark, d):
    sparse = L.bm25_top_k(asked(spark, d), index(spark, d))
    dense = V.dense_top_k(query_vectors(spark, d), vectors(spark, d))
    chunks = table(spark, d, "documents").selectExpr("doc_id AS key", "text")
    return S.fuse_ranks(sparse, dense, merge_on=chunks).withColumn("score", F.round("score", 9))


@query("d09_parse_strategy", f"""
    SELECT conv_id, turn, CASE WHEN label IN ('NONE', 'EXPANSION', 'DECOMPOSITION', 'HYDE') THEN lower(label) ELSE 'hyde' END AS strategy
    FROM (SELECT conv_id, turn, regexp_replace(upper({I.STRATEGY_REPLY}), '[^A-Z]', '', 'g') AS label FROM conversations)""")
def _(spark, d):
    replies = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{I.STRATEGY_REPLY} AS reply")
    return S.parse_strategy(replies, "reply").drop("reply")


def spoken(prompts):
    """Stands for a model: a noisy strategy by the length of the prompt, or the last line of the prompt as a bullet."""

    def one(prompt: str) -> str:
        if prompt.startswith("Name the best way"):
            return ["none.", "**Expansion**", "Decomposition!", "HYDE", "unsure"][len(prompt) % 5]
        return "- " + prompt.split("\n")[-1]

    return prompts.map(one)


@query("d09_rewrite_questions", f"""
    WITH q AS (SELECT conv_id || ':' || turn AS qid, {I.FIRST_LINE} AS question FROM conversations WHERE role = 'user'),
    s AS (SELECT *, CASE ({len(STRATEGY_PROMPT) - len("{question}")} + length(question)) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'expansion' WHEN 2 THEN 'decomposition' ELSE 'hyde' END AS strategy FROM q)
    SELECT qid, question, strategy, CASE WHEN strategy <> 'none' THEN '- ' || question END AS reply FROM s""")
def _(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").selectExpr("concat(conv_id, ':', turn) AS qid", f"{I.FIRST_LINE} AS question")
    return rewrite_questions(asked, spoken)


def lines_sql(reply: str) -> str:
    return (
        rf"list_transform(list_filter(string_split({reply}, chr(10)), lambda x: trim(x) <> ''), "
        rf"lambda x: regexp_replace(regexp_replace(x, '^\s*[\d.\-*]+\s*', ''), '^\s+|\s+$', '', 'g'))"
    )


def listed(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{I.FIRST_LINE} AS asked", f"{I.LISTED_REPLY} AS reply")


LISTED_SQL = f"SELECT conv_id, turn, {I.FIRST_LINE} AS asked, {I.LISTED_REPLY} AS reply FROM conversations"


def unnested(array: str, source: str, keep: str) -> str:
    return f"""SELECT {keep}, (generate_subscripts(a, 1) - 1)::INTEGER AS sub_no, unnest(a) AS sub_query
    FROM (SELECT *, {array} AS a FROM (SELECT *, {lines_sql('reply')} AS l FROM ({source})))"""


@query("d11_clean_variations", unnested(
    "(CASE WHEN list_contains(l, asked) THEN l ELSE list_prepend(asked, l) END)[1:4]", LISTED_SQL, "conv_id, turn, asked"))
def _(spark, d):
    return S.clean_variations(listed(spark, d), "asked", "reply")


@query("d12_clean_subquestions", unnested(
    "CASE WHEN len(list_filter(l, lambda x: x <> '')) > 0 THEN list_filter(l, lambda x: x <> '') ELSE [asked] END",
    LISTED_SQL, "conv_id, turn, asked"))
def _(spark, d):
    return S.clean_subquestions(listed(spark, d), "asked", "reply")


SUBS_SQL = f"""
    SELECT item_id, strategy, (generate_subscripts(a, 1) - 1)::INTEGER AS sub_no, unnest(a) AS text FROM (
        SELECT *, CASE strategy
            WHEN 'expansion' THEN (CASE WHEN list_contains(l, text) THEN l ELSE list_prepend(text, l) END)[1:4]
            WHEN 'decomposition' THEN (CASE WHEN len(list_filter(l, lambda x: x <> '')) > 0 THEN list_filter(l, lambda x: x <> '') ELSE [text] END)
            WHEN 'hyde' THEN [trim(reply)] ELSE [text] END AS a
        FROM (SELECT *, {lines_sql('reply')} AS l FROM (
            SELECT item_id, text, {I.STRATEGY} AS strategy, {I.BENCH_REPLY} AS reply FROM benchmark)))"""


def questions(spark, d):
    return table(spark, d, "benchmark").selectExpr(
        "item_id AS qid", "text AS question", f"{I.STRATEGY} AS strategy", f"{I.BENCH_REPLY} AS reply")


def subs(spark, d):
    found = S.sub_queries(questions(spark, d)).withColumn("key", F.col("qid") + F.col("sub_no"))
    return found.join(vectors(spark, d), "key").drop("key")


HITS_CTES = f"""
    subs AS ({SUBS_SQL}),
    {bm25_ctes("SELECT item_id || '#' || sub_no AS qid, text FROM subs", TOKENS_SQL, WORDS, PLUS_ONE)},
    {dense_ctes("SELECT item_id || '#' || sub_no AS qid, embedding::DOUBLE[] AS v FROM subs JOIN embeddings ON item_id + sub_no = vec_id")},
    {FUSED_CTE},
    hits AS (SELECT item_id AS qid, strategy, sub_no, key, score, row_number() OVER (PARTITION BY item_id ORDER BY sub_no, rank)::INTEGER AS rank
             FROM fused JOIN subs ON fused.qid = item_id || '#' || sub_no
             WHERE rank <= CASE strategy WHEN 'expansion' THEN 2 WHEN 'decomposition' THEN 2 WHEN 'hyde' THEN 4 ELSE 1000 END)"""


def hits(spark, d):
    return S.retrieve(subs(spark, d), index(spark, d), vectors(spark, d))


@query("d10_retrieve", f"WITH {HITS_CTES} SELECT qid, strategy, sub_no, key, round(score, 9) AS score, rank FROM hits")
def _(spark, d):
    return hits(spark, d).withColumn("score", F.round("score", 9))


@query("d13_assemble_context", f"""
    WITH {HITS_CTES}, ctx AS (SELECT qid, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
         FROM hits JOIN documents ON key = doc_id GROUP BY qid)
    SELECT item_id AS qid, context, context IS NOT NULL AS found FROM benchmark LEFT JOIN ctx ON item_id = qid""")
def _(spark, d):
    chunks = texts(spark, d, "documents", "doc_id").selectExpr("doc_id AS key", "text")
    return S.assemble_context(asked(spark, d), hits(spark, d), chunks)


def bucket_ctes(source: str) -> str:
    """Weights of the hashed terms of ``source`` (key, text)."""
    return f"""
    toks AS (SELECT key, ('0x' || left(md5(t), 8))::BIGINT % 256 AS bucket FROM (SELECT key, unnest({WORDS}) AS t FROM ({source}))),
    freq AS (SELECT bucket, count(DISTINCT key) AS df FROM toks GROUP BY bucket),
    idf AS (SELECT bucket, ln(((SELECT count(*) FROM ({source})) + 1) / (df + 1)) AS w FROM freq)"""


@query("d14_embed_text", f"""
    WITH {bucket_ctes("SELECT doc_id AS key, text FROM documents")},
    val AS (SELECT key, bucket, count(*) * any_value(w) AS x FROM toks JOIN idf USING (bucket) GROUP BY key, bucket),
    norm AS (SELECT key, sqrt(sum(x * x)) AS n FROM val GROUP BY key)
    SELECT key AS doc_id, bucket::INTEGER AS place, round(x / n, 6) AS value FROM val JOIN norm USING (key) WHERE round(x / n, 6) <> 0""")
def _(spark, d):
    """Every value of every vector that is not zero."""
    made = V.embed_text(texts(spark, d, "documents", "doc_id").select("doc_id", "text"), element="double")
    values = made.select("doc_id", F.posexplode("vector").alias("place", "value")).withColumn("value", F.round("value", 6))
    return values.where("value <> 0")


@query("d14_search_by_text", f"""
    WITH {bucket_ctes("SELECT doc_id || '#' || chunk_no AS key, text FROM (" + chunk_sql(TIER_SQL, "doc_id, chunk_no, text") + ")")},
    unit AS (SELECT key, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS x FROM (
        SELECT key, bucket, count(*) * any_value(w) AS x FROM toks JOIN idf USING (bucket) GROUP BY key, bucket)),
    asked AS (SELECT qid, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS x FROM (
        SELECT item_id AS qid, bucket, count(*) * any_value(w) AS x FROM (
            SELECT item_id, ('0x' || left(md5(t), 8))::BIGINT % 256 AS bucket FROM (SELECT item_id, unnest({WORDS}) AS t FROM benchmark)) JOIN idf USING (bucket)
        GROUP BY item_id, bucket)),
    pair AS (SELECT qid, key, round(2 - 2 * sum(asked.x * unit.x), 9) AS score FROM asked JOIN unit USING (bucket) GROUP BY qid, key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, key)::INTEGER AS rank FROM pair)
    SELECT qid, key, round(score, 6) AS score, rank FROM ranked WHERE rank <= 4""")
def _(spark, d):
    """Chunks found for benchmark passages by hashed vectors alone."""
    chunks = C.chunk_documents(tiered(spark, d).select("doc_id", "text", "chunk_size", "chunk_overlap"))
    keyed = cut_lineage(chunks.select(F.concat_ws("#", "doc_id", "chunk_no").alias("key"), "text"), "chunks")
    weights = V.rarity_weights(keyed)
    queries = V.embed_text(asked(spark, d), weights=weights, element="double", wordless="null")
    return V.dense_top_k(queries, V.embed_text(keyed, weights=weights, element="double", wordless="null")).withColumn("score", F.round("score", 6))


@query("ask_documents")
def _(spark, d):
    """The whole flow: chunk and index the documents, search by strategy, assemble contexts, answer."""
    documents = texts(spark, d, "documents", "doc_id").withColumn("n_pages", F.ceil(F.col("n_chars") / 3000))
    return answer_questions(questions(spark, d), index_documents(documents))


@query("u01_apply_text_fn", r"""
    SELECT conv_id, turn, regexp_replace(regexp_extract('Asked by ' || role || ': ' || text, '(?s)^\s*((?:[^.]*\.){1,2}|.*)', 1),
        '^\s+|\s+$', '', 'g') AS answer, NULL::VARCHAR AS answer_error FROM conversations""")
def _(spark, d):
    def first_two_sentences(prompts):
        return prompts.str.extract(r"(?s)^\s*((?:[^.]*\.){1,2}|.*)", expand=False).str.strip()

    return apply_text_fn(table(spark, d, "conversations"), "Asked by {role}: {text}", first_two_sentences).drop("role", "text")
