"""Question and query logs, conversations, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from askspark.functions import text as T
from askspark.operators import conversations as V
from askspark.operators import routing as G
from askspark.operators import traces
from askspark.operators.catalog import catalog_table
from askspark.plans.turns import take_turns
from workload import tables as I
from workload.tables import NAMES, table, texts

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def events(spark, d, **given):
    return texts(spark, d, "events", "event_id").selectExpr("event_id", *[f"{e} AS {n}" for n, e in given.items()])


def chats(spark, d, *more):
    return table(spark, d, "conversations").selectExpr("*", *more)


def any_sql(patterns: list[str], text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


def class_sql(text: str, words: bool = False) -> str:
    low = rf"lower(regexp_replace({text}, '^\s+|\s+$', '', 'g'))"
    plain = "(" + " OR ".join(f"contains({low}, '{w}')" for w in T.CALCULATION_WORDS) + ")"
    whole = rf"regexp_matches({low}, '\b({'|'.join(T.CALCULATION_WORDS)})\b')"
    return f"""CASE WHEN {any_sql(T.DISPLAY_PATTERNS, low)} THEN 'display' WHEN {any_sql(T.SCHEMA_PATTERNS, low)} THEN 'schema'
        WHEN {whole if words else plain} THEN 'calculation' WHEN {any_sql(T.GENERAL_PATTERNS, low)} THEN 'general' ELSE 'calculation' END"""


ASKED_SQL = f"""
    SELECT 'e' || event_id AS qid, {I.QUESTION} AS question FROM events UNION ALL
    SELECT 'c' || conv_id || ':' || turn, text FROM conversations"""


@query("g01_classify_questions", f"""
    SELECT qid, {class_sql('question')} AS question_class, {class_sql('question', True)} AS word_class FROM ({ASKED_SQL})""")
def _(spark, d):
    asked = texts(spark, d, "events", "event_id").selectExpr("concat('e', event_id) AS qid", f"{I.QUESTION} AS question")
    said = texts(spark, d, "conversations", "conv_id").selectExpr("concat('c', conv_id, ':', turn) AS qid", "text AS question")
    both = G.classify_questions(asked.unionByName(said), "question")
    return G.classify_questions(both, "question", "word", "word_class").drop("question")


LOG_SQL = f"SELECT event_id, {I.QUERY_TEXT} AS sql FROM events"
REFS_SQL = rf"""
    SELECT event_id, (generate_subscripts(r, 1) - 1)::INTEGER AS ref_no, unnest(r).db AS db, unnest(r).tbl AS tbl FROM (
        SELECT event_id, list_concat(
            list_transform(list_zip(regexp_extract_all(sql, '{T.QUOTED_REF}', 1), regexp_extract_all(sql, '{T.QUOTED_REF}', 2)),
                           lambda p: {{'db': p[1], 'tbl': p[2]}}),
            list_transform(list_zip(regexp_extract_all(sql, '{T.KEYWORD_REF}', 1), regexp_extract_all(sql, '{T.KEYWORD_REF}', 2)),
                           lambda p: {{'db': p[1], 'tbl': p[2]}})) AS r FROM ({LOG_SQL}))"""
# The tables as two databases, in catalog order.
SHOP = [n for n in NAMES if n not in ("events", "conversations", "pages")]
CATALOG = [("shop", t, 0, i) for i, t in enumerate(SHOP)] + [
    ("logs", t, 1, i) for i, t in enumerate(["events", "conversations", "pages", "orders", "the"])
]
CATALOG_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, CATALOG)) + ") AS c(db, tbl, db_pos, tbl_pos)"


def catalog(spark):
    return catalog_table(spark, CATALOG)


@query("g02_extract_table_refs", REFS_SQL)
def _(spark, d):
    return G.extract_table_refs(events(spark, d, sql=I.QUERY_TEXT), "sql")


@query("g03_unknown_table_refs", f"""
    WITH refs AS ({REFS_SQL}), cat AS ({CATALOG_SQL})
    SELECT event_id, ref_no, db, tbl, db IN (SELECT db FROM cat) AS db_known FROM refs
    WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.db = refs.db AND cat.tbl = refs.tbl)""")
def _(spark, d):
    return G.unknown_table_refs(events(spark, d, sql=I.QUERY_TEXT), "event_id", "sql", catalog(spark))


# Query texts of twenty shapes, and the tables that each names: {t} is one of several names, {n} a line end, {q} a quote.
SHAPES = [
    ("SELECT * FROM shop.{t}", ["shop"]),
    ("select `o`.`o_custkey` from `shop`.`{t}` `o`", ["shop"]),
    ("SELECT o.x FROM shop.{t} AS o JOIN logs.{t} p ON o.x = p.x", ["shop", "logs"]),
    ("SELECT 1 -- FROM no.table{n}FROM shop.{t}", ["shop"]),
    ("SELECT /* JOIN no.table */ a.b FROM shop.{t} a", ["shop"]),
    ("SELECT {q}text from no.table{q} AS x FROM shop.{t}", ["shop"]),
    ('SELECT "text from no.table" FROM logs.{t}', ["logs"]),
    ("WITH c AS (SELECT * FROM shop.{t}) SELECT c.x FROM c JOIN logs.{t} l ON c.x = l.x", ["shop", "logs"]),
    ("SELECT shop.{t}.x FROM shop.{t}", ["shop"]),
    ("SELECT * FROM shop.{t} a, logs.{t} b, other.{t} WHERE a.x = b.x", ["shop", "logs", "other"]),
    ("SELECT EXTRACT(YEAR FROM o.day) FROM shop.{t} o", ["shop"]),
    ("SELECT x IS DISTINCT FROM o.y FROM shop.{t} o", ["shop"]),
    ("SELECT * FROM shop.{t} WHERE x IN (SELECT l.x FROM logs.{t} l WHERE l.y = {q}it{q}{q}s from no.table{q})", ["shop", "logs"]),
    ("SELECT * FROM (shop.{t} a JOIN logs.{t} b ON a.x = b.x)", ["shop", "logs"]),
    ("UPDATE shop.{t} SET a.x = 1 WHERE a.y = 2", ["shop"]),
    ("INSERT INTO shop.{t} SELECT * FROM lake.logs.{t}", ["shop", "logs"]),
    ("SELECT count(DISTINCT o.x), max(o.y) FROM shop . {t} o GROUP BY o.z", ["shop"]),
    ("SELECT * FROM {t}", []),
    ("SELECT * FROM `my shop`.`{t}` UNION ALL SELECT * FROM Logs.{t} ORDER BY a.x", ["my shop", "Logs"]),
    ("SELECT (SELECT max(p.x) FROM logs.{t} p) AS m FROM shop.{t} s LEFT JOIN logs.events e ON s.x = e.x AND e.y = s.y", ["logs", "shop", "logs.events"]),
]
NAMED = "CASE event_id % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'events' ELSE 'missing' END"
SHAPED = (
    f"CASE event_id % {len(SHAPES)} "
    + " ".join(f"WHEN {i} THEN '" + s.replace("{t}", f"' || {NAMED} || '").replace("{n}", "' || chr(10) || '").replace("{q}", "''") + "'" for i, (s, _) in enumerate(SHAPES))
    + " END"
)
TOKEN_REFS_SQL = " UNION ALL ".join(
    f"SELECT event_id, {k}::INTEGER AS ref_no, '{ref.partition('.')[0]}' AS db, " + (f"'{ref.partition('.')[2]}'" if "." in ref else NAMED) + f" AS tbl FROM events WHERE event_id % {len(SHAPES)} = {i}"
    for i, (_, refs) in enumerate(SHAPES) for k, ref in enumerate(refs)
)


@query("g02_table_refs_by_tokens", TOKEN_REFS_SQL)
def _(spark, d):
    return G.extract_table_refs(events(spark, d, sql=SHAPED), "sql", "tokens")


@query("g03_unknown_refs_by_tokens", f"""
    WITH refs AS ({TOKEN_REFS_SQL}), cat AS ({CATALOG_SQL})
    SELECT event_id, ref_no, db, tbl, lower(db) IN (SELECT db FROM cat) AS db_known FROM refs
    WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.db = lower(refs.db) AND cat.tbl = lower(refs.tbl))""")
def _(spark, d):
    return G.unknown_table_refs(events(spark, d, sql=SHAPED), "event_id", "sql", catalog(spark), "tokens", match_case=False)


def aggregate_sql(text: str) -> str:
    return "(" + " OR ".join(f"contains(upper({text}), '{m}')" for m in T.AGGREGATE_MARKS) + ")"


@query("g04_plan_limits", rf"""
    SELECT event_id, sql, {aggregate_sql('sql')} AS is_aggregate,
           CASE WHEN NOT contains(upper(sql), 'LIMIT') AND NOT {aggregate_sql('sql')}
                THEN regexp_replace(regexp_replace(sql, ';+$', ''), '^\s+|\s+$', '', 'g') || ' LIMIT 100;' ELSE sql END AS limited_sql
    FROM ({LOG_SQL})""")
def _(spark, d):
    return G.plan_limits(events(spark, d, sql=I.QUERY_TEXT), "sql")


def fenced_sql(lang: str) -> str:
    tag = "```" + lang
    return rf"""regexp_replace(CASE WHEN contains(reply, '{tag}')
            THEN split_part(substr(reply, instr(reply, '{tag}') + {len(tag)}), '```', 1)
        WHEN contains(reply, '```') THEN split_part(substr(reply, instr(reply, '```') + 3), '```', 1) ELSE reply END,
        '^\s+|\s+$', '', 'g')"""


@query("g06_extract_fenced_block", f"""
    SELECT event_id, {fenced_sql('sql')} AS sql, {fenced_sql('python')} AS python
    FROM (SELECT event_id, {I.REPLY_WITH_CODE} AS reply FROM events)""")
def _(spark, d):
    replies = events(spark, d, reply=I.REPLY_WITH_CODE)
    return G.extract_fenced_block(G.extract_fenced_block(replies, "reply", "sql", "sql"), "reply", "python", "python").drop("reply")


@query("g07_route_requests", f"""
    WITH r AS (SELECT event_id, {I.ASSET} AS asset, {I.QUESTION} AS question, {I.ASKED} AS asked FROM events),
    f AS (SELECT *, CASE WHEN lower(asset) IN ('.pdf', '.docx', '.doc', '.txt', 'url') THEN 'document'
              WHEN lower(asset) IN ('.csv', '.xlsx', '.xls') THEN 'dataset'
              WHEN lower(asset) IN ('.png', '.jpg', '.jpeg', '.webp', '.gif', 'image') THEN 'image'
              WHEN lower(asset) = 'mysql' THEN 'database' ELSE 'unsupported' END AS family, {class_sql('question')} AS k FROM r)
    SELECT event_id, asset, asked, family,
           CASE WHEN family = 'unsupported' OR (family = 'database' AND k = 'general') THEN 'web_search' ELSE family END AS handler,
           CASE WHEN asked <> 'web_search' AND asked <> family THEN 'no active ' || asked END AS refusal FROM f""")
def _(spark, d):
    requests = events(spark, d, asset=I.ASSET, question=I.QUESTION, asked=I.ASKED)
    return G.route_requests(requests, "asset", "question", "asked").drop("question")


@query("k04_resolve_table", rf"""
    WITH q AS (SELECT event_id, lower(regexp_replace({I.QUESTION}, '^\s+|\s+$', '', 'g')) AS q FROM events), cat AS ({CATALOG_SQL}),
    pick AS (SELECT event_id, arg_min(db, db_pos) AS pdb FROM q JOIN cat ON regexp_matches(q, '(^|\b)' || db || '($|\b)') GROUP BY event_id),
    hit AS (SELECT event_id, arg_min({{'db': db, 'tbl': tbl}}, db_pos * 1000 + tbl_pos) AS h
            FROM q LEFT JOIN pick USING (event_id) JOIN cat ON (pdb IS NULL OR db = pdb) AND tbl <> 'the'
             AND regexp_matches(q, '(^|\b)' || tbl || '($|\b)') GROUP BY event_id)
    SELECT event_id, h.db AS db, h.tbl AS tbl FROM q LEFT JOIN hit USING (event_id)""")
def _(spark, d):
    return G.resolve_tables(events(spark, d, question=I.QUESTION), "event_id", "question", catalog(spark)).drop("question")


# Conversations

SESSION_LIST = "session_id, created_at, title, file_metadata, updated_at, summary"


def retained_sql(source: str) -> str:
    return f"""SELECT * FROM ({source}) WHERE TRY_CAST(updated_at AS TIMESTAMP) IS NULL
        OR TRY_CAST(updated_at AS TIMESTAMP) >= TIMESTAMP '{I.AS_OF}' - INTERVAL 7 DAYS"""


@query("v01_upsert_sessions", f"""
    WITH cur AS ({retained_sql(I.SESSIONS_SQL)}), upd AS ({I.UPDATES_SQL}),
    allv AS (SELECT *, -1 AS version FROM cur UNION ALL BY NAME SELECT * FROM upd)
    SELECT session_id, arg_min(created_at, version) AS created_at, arg_max(title, version) AS title,
           (arg_max({{'v': file_metadata}}, version)).v AS file_metadata, (arg_max({{'v': updated_at}}, version)).v AS updated_at,
           coalesce((arg_max({{'v': summary}}, version)).v, '') AS summary FROM allv GROUP BY session_id""")
def _(spark, d):
    return V.upsert_sessions(I.sessions(spark, d), I.session_updates(spark, d), I.AS_OF, V.RETENTION_DAYS)


@query("v02_retain_recent", retained_sql(I.SESSIONS_SQL))
def _(spark, d):
    return V.retain_recent(I.sessions(spark, d), I.AS_OF)


@query("v03_delete_sessions", f"SELECT * FROM ({I.SESSIONS_SQL}) WHERE session_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def _(spark, d):
    gone = chats(spark, d).where("role = 'system'").selectExpr("conv_id AS session_id")
    return V.delete_sessions(I.sessions(spark, d), gone)


def split_sql(trigger: int, keep: int) -> str:
    return f"""SELECT conv_id, turn, role, text, n_turns, n_turns >= {trigger} AND rn > {keep} AS is_old FROM (
        SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_turns, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
        FROM conversations)"""


def split_query(trigger, keep):
    def run(spark, d):
        return V.split_for_summary(chats(spark, d), trigger, keep).drop("role", "text")

    return run


for _name, _trigger, _keep in (("v04_split_for_summary", 10, 6), ("v04_split_short_chats", 6, 4)):
    QUERIES[_name] = split_query(_trigger, _keep)
    ORACLES[_name] = f"SELECT conv_id, turn, n_turns, is_old FROM ({split_sql(_trigger, _keep)})"

STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
LINE = f"'[' || upper(role) || ']: ' || CASE WHEN length({STRIPPED}) > 800 THEN left({STRIPPED}, 800) || '...' ELSE {STRIPPED} END"


@query("v05_format_transcript", f"""
    SELECT conv_id, turn // 1000 AS part, string_agg({LINE}, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY ALL""")
def _(spark, d):
    return V.format_transcript(chats(spark, d))


# Every conversation eight times over, as two chats.
GLUED = ["conv_id % 2 AS conv_id", "row_number() OVER (PARTITION BY conv_id % 2 ORDER BY k, conv_id, turn) - 1 AS turn", "role", "text"]
GLUED_SQL = f"(SELECT {', '.join(GLUED)} FROM conversations, (SELECT unnest(range(8)) AS k))"


def glued(spark, d):
    """A turn's number is the lengths of what comes before: copies, blocks of conversations, conversations. Only counts are
    summed in order, so no task gathers a chat."""
    said = table(spark, d, "conversations")
    count = said.groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr("conv_id AS id", "conv_id % 2 AS half", "floor(conv_id / 1024) AS block", "n")
    blocks = count.groupBy("half", "block").agg(F.sum("n").alias("size")).selectExpr(
        "half AS h", "block AS b", "sum(size) OVER (PARTITION BY half) AS whole", "sum(size) OVER (PARTITION BY half ORDER BY block) - size AS base")
    starts = count.join(blocks, F.col("half").eqNullSafe(F.col("h")) & F.col("block").eqNullSafe(F.col("b"))).selectExpr(
        "id", "half", "whole", "base + sum(n) OVER (PARTITION BY half, block ORDER BY id) - n AS start")
    placed = said.selectExpr("*", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place").join(starts, F.col("conv_id").eqNullSafe(F.col("id")))
    repeated = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return repeated.selectExpr("half AS conv_id", "k * whole + start + place AS turn", "role", "text")


@query("v05_format_transcript_parts", f"""
    SELECT conv_id, turn // 100 AS part, string_agg({LINE}, chr(10) ORDER BY turn) AS transcript FROM {GLUED_SQL} GROUP BY ALL""")
def _(spark, d):
    return V.format_transcript(glued(spark, d), part_turns=100)


def compacted_sql(split: str, previous: str) -> str:
    lines = "right(t, greatest(800, 1600 - length(summary) - 1))"
    return f"""
    WITH old AS (SELECT conv_id, string_agg({LINE}, chr(10) ORDER BY turn) AS t FROM ({split}) WHERE is_old GROUP BY conv_id),
    prev AS ({previous})
    SELECT conv_id, CASE WHEN t IS NULL THEN summary WHEN summary = '' THEN right(t, 1600)
           ELSE right(summary, 1600 - length({lines}) - 1) || chr(10) || {lines} END AS summary FROM prev LEFT JOIN old USING (conv_id)"""


LONG_PREVIOUS = ["conv_id", "CASE conv_id WHEN 0 THEN '' ELSE repeat('earlier ', 300) END AS summary"]


@query("v06_compact_long_chat", compacted_sql(split_sql(10, 6).replace("FROM conversations", f"FROM {GLUED_SQL}"), f"SELECT {', '.join(LONG_PREVIOUS)} FROM (SELECT DISTINCT conv_id % 2 AS conv_id FROM conversations)"))
def _(spark, d):
    """New turns enter however long the summary is, and every chat has one."""
    previous = table(spark, d, "conversations").selectExpr("conv_id % 2 AS conv_id").distinct().selectExpr(*LONG_PREVIOUS)
    return V.compact_history(glued(spark, d), previous)


@query("v06_compact_history", compacted_sql(split_sql(6, 4), f"SELECT session_id AS conv_id, summary FROM ({I.SESSIONS_SQL})"))
def _(spark, d):
    previous = I.sessions(spark, d).selectExpr("session_id AS conv_id", "summary")
    return V.compact_history(chats(spark, d), previous, trigger=6, keep=4)


# Each user turn of a chat asks once more, the first of them now.
NOW = "(SELECT * FROM conversations WHERE conv_id IN (SELECT conv_id FROM asked) UNION ALL SELECT conv_id, turn, 'user', prompt FROM asked)"
TURN_CTES = f"""asked AS (SELECT conv_id, max(turn) + 1 AS turn, min_by(text, turn) FILTER (role = 'user' AND text IS NOT NULL) AS prompt FROM conversations
        GROUP BY conv_id HAVING count(*) FILTER (role = 'user' AND text IS NOT NULL) > 0),
    marked AS ({split_sql(10, 6).replace("FROM conversations", f"FROM {NOW}")}),
    ses AS ({I.SESSIONS_SQL}),
    told AS ({compacted_sql("SELECT * FROM marked", "SELECT session_id AS conv_id, summary FROM ses WHERE session_id IN (SELECT conv_id FROM asked)")}),
    recent AS (SELECT conv_id, string_agg('[' || upper(role) || ']: ' || coalesce(text, ''), chr(10) ORDER BY turn) AS lines
        FROM marked WHERE NOT is_old AND role IN ('user', 'assistant') GROUP BY conv_id)"""


def turns_taken(spark, d):
    messages = chats(spark, d)
    prompts = messages.where("role = 'user'").selectExpr("conv_id", "turn AS version", "text AS prompt")
    return take_turns(I.sessions(spark, d), messages, prompts, "2024-02-01T00:00:00", lambda p: "Read " + p.str.len().astype(str) + " characters")


@query("ask_chats_messages", f"""
    WITH {TURN_CTES}
    SELECT conv_id, turn, 'user' AS role, prompt AS text FROM asked UNION ALL
    SELECT conv_id, turn + 1, 'assistant', 'Read ' || length('Summary:' || chr(10) || summary || chr(10) || chr(10) || lines) || ' characters'
    FROM asked JOIN told USING (conv_id) JOIN recent USING (conv_id)""")
def _(spark, d):
    return turns_taken(spark, d).added


@query("ask_chats_sessions", f"""
    WITH {TURN_CTES}
    SELECT session_id, CASE WHEN prompt IS NOT NULL AND title = 'New Session' THEN left(prompt, 18) ELSE title END AS title, file_metadata, created_at,
           CASE WHEN prompt IS NOT NULL THEN '2024-02-01T00:00:00' ELSE updated_at END AS updated_at, coalesce(told.summary, ses.summary) AS summary
    FROM ses LEFT JOIN asked ON asked.conv_id = session_id LEFT JOIN told ON told.conv_id = session_id""")
def _(spark, d):
    return turns_taken(spark, d).sessions


@query("v07_normalize_content", f"""
    SELECT conv_id, turn, CASE
        WHEN json_type(j) = 'ARRAY' AND len(list_filter(json_extract(j, '$[*]'), lambda b: json_type(b) NOT IN ('VARCHAR', 'OBJECT'))) = 0 THEN coalesce((SELECT string_agg(t, chr(10) ORDER BY i) FROM (
            SELECT i, CASE WHEN json_type(b) = 'VARCHAR' THEN json_extract_string(b, '$') ELSE nullif(json_extract_string(b, '$.text'), '') END AS t
            FROM (SELECT unnest(json_extract(j, '$[*]')) AS b, unnest(range(len(json_extract(j, '$[*]')))) AS i))), '')
        WHEN json_type(j) = 'OBJECT' THEN coalesce(nullif(json_extract_string(j, '$.text'), ''), content)
        ELSE content END AS plain
    FROM (SELECT *, CASE WHEN json_valid(content) THEN content ELSE 'null' END AS j
          FROM (SELECT conv_id, turn, {I.CONTENT} AS content FROM conversations))""")
def _(spark, d):
    stored = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{I.CONTENT} AS content")
    return stored.select("conv_id", "turn", T.message_text(F.col("content")).alias("plain"))


@query("v08_final_answer", f"""
    SELECT conv_id, coalesce(
        arg_max({STRIPPED}, turn) FILTER (role = 'assistant' AND {STRIPPED} <> '' AND NOT ({I.HAS_TOOL_CALLS})),
        arg_max({STRIPPED}, turn) FILTER (role = 'assistant' AND {STRIPPED} <> ''), '{V.NO_ANSWER}') AS answer
    FROM conversations GROUP BY conv_id""")
def _(spark, d):
    return V.final_answer(chats(spark, d, f"{I.HAS_TOOL_CALLS} AS has_tool_calls"))


@query("v09_derive_titles", f"""
    WITH first AS (SELECT conv_id, arg_min(left(text, 18), turn) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id)
    SELECT session_id AS conv_id, file_metadata,
           CASE WHEN title = 'New Session' THEN coalesce(left(file_metadata, 18), asked, title) ELSE title END AS title
    FROM ({I.SESSIONS_SQL}) LEFT JOIN first ON conv_id = session_id""")
def _(spark, d):
    sessions = I.sessions(spark, d).selectExpr("session_id AS conv_id", "title", "file_metadata")
    return V.derive_titles(chats(spark, d), sessions)


@query("v10_prepare_turns", """
    SELECT conv_id, turn, role, text, role = 'user' AND length(text) > 600 AS too_long, left(text, 120) AS preview
    FROM conversations WHERE role IN ('user', 'assistant')""")
def _(spark, d):
    return V.prepare_turns(chats(spark, d), max_chars=600)


@query("v11_classify_errors", f"""
    SELECT event_id, CASE {" ".join(f"WHEN regexp_matches(lower(error), '{p}') THEN '{n}'" for n, p in T.ERROR_PATTERNS)} END AS category,
           left(error, 500) AS shown FROM (SELECT event_id, {I.ERROR_TEXT} AS error FROM events)""")
def _(spark, d):
    errors = events(spark, d, error=I.ERROR_TEXT)
    return errors.select("event_id", T.error_category(F.col("error")).alias("category"), F.substring("error", 1, 500).alias("shown"))


@query("s08_export_markdown", f"""
    WITH body AS (SELECT conv_id, string_agg('### ' || CASE WHEN role = 'user' THEN '👤' ELSE '🤖' END || ' ' || upper(role) || chr(10) || chr(10)
            || {STRIPPED} || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY turn) AS b FROM conversations GROUP BY conv_id)
    SELECT conv_id, 0::BIGINT AS part, '# 💬 ' || title || chr(10) || chr(10) || '**Exported**: 2024-01-31 00:00:00' || chr(10) || chr(10)
        || CASE WHEN summary <> '' THEN '## 📝 Conversation Summary' || chr(10) || chr(10) || summary || chr(10) || chr(10) ELSE '' END
        || '---' || chr(10) || chr(10) || '## Full Conversation' || chr(10) || chr(10) || b AS markdown
    FROM ({I.SESSIONS_SQL}) JOIN body ON conv_id = session_id""")
def _(spark, d):
    sessions = I.sessions(spark, d).selectExpr("session_id AS conv_id", "title", "summary")
    return V.export_markdown(chats(spark, d), sessions, "2024-01-31 00:00:00")


# Traces


def rollup_sql(key: str) -> str:
    return f"""
    SELECT {key}, count(*) AS n_runs, count(*) FILTER (is_error) AS n_errors, round(avg(latency_ms), 6) AS latency_mean,
           sum(tokens)::BIGINT AS tokens, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95 FROM ({I.RUNS_SQL}) GROUP BY {key}"""


def rollup(key):
    def run(spark, d):
        out = traces.trace_rollup(I.runs(spark, d), [key])
        return out.withColumns({"latency_mean": F.round("latency_mean", 6), "latency_p95": F.round("latency_p95", 6)})

    return run


for _name, _key in (("t01_trace_rollup", "run_name"), ("t01_trace_by_session", "session_id")):
    QUERIES[_name] = rollup(_key)
    ORACLES[_name] = rollup_sql(_key)


@query("t02_slowest_runs", f"""
    SELECT * FROM (SELECT run_id, run_name, latency_ms, row_number() OVER (PARTITION BY run_name ORDER BY latency_ms DESC, run_id) AS row_number,
        rank() OVER (PARTITION BY run_name ORDER BY latency_ms DESC) AS rank,
        dense_rank() OVER (PARTITION BY run_name ORDER BY latency_ms DESC) AS dense_rank FROM ({I.RUNS_SQL})) WHERE row_number <= 3""")
def _(spark, d):
    return traces.slowest_runs(I.runs(spark, d).select("run_id", "run_name", "latency_ms"), ["run_name"], 3)
