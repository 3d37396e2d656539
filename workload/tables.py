"""Driver tables, and inputs derived from them by expressions that Spark and DuckDB both read.

The tables hold no query log, question table or model replies, so these are computed from the rows of `events`,
`conversations` and `benchmark`: they are as long as those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askspark.session import spread

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Table for work that is heavy per row; the setting ``askspark.tasks`` spreads it over so many tasks."""
    tasks = spark.conf.get("askspark.tasks", None)
    return spread(table(spark, sf_dir, name), key, int(tasks) if tasks else None)


def paths(sf_dir: str) -> dict[str, str]:
    return {name: f"{sf_dir}/{name}.parquet" for name in NAMES}


def case(value: str, texts: list[str]) -> str:
    """One text per remainder of ``value``."""
    arms = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    return f"CASE CAST({value} AS BIGINT) % {len(texts)} {arms} END"


USER = "CAST(user_id AS STRING)"
ID = "CAST(event_id AS STRING)"

QUESTION = case("event_id", [
    "'Show me the ' || event_type || ' table'",
    "'Show me the orders table'",
    "'List all columns of lineitem'",
    f"'What columns does customer ' || {USER} || ' have'",
    f"'How many tables are there for user ' || {USER}",
    "'describe the part catalogue in shop'",
    f"'Count ' || event_type || ' events of user ' || {USER}",
    f"'Which country has users like ' || {USER}",
    f"'How is the weather for user ' || {USER}",
    "'Tell me a joke about ' || event_type",
    "'Stop the ' || event_type || ' job'",
    "'who is Ada Lovelace'",
    "'Show orders records from logs'",
    "'get pages from LOGS please, not orders'",
    "'  view the supplier tables '",
    f"'Hello ' || {USER}",
])

QUERY_TEXT = case("event_id", [
    f"'SELECT * FROM `shop`.`orders` WHERE o_orderkey = ' || {ID}",
    "'SELECT COUNT(*) FROM shop.customer'",
    "'SELECT count (*) FROM `shop`.`' || event_type || '`'",
    f"'select credit_limit from billing.accounts where id = ' || {USER}",
    "'SELECT a.* FROM shop.orders a JOIN `shop`.`lineitem` b ON a.o_orderkey = b.l_orderkey;;'",
    "'SELECT MAX(value) OVER () FROM logs.events LIMIT 5'",
    "'INSERT INTO logs.' || event_type || ' SELECT * FROM logs.events'",
    "'select 1 ; '",
    f"'UPDATE `hr`.`staff-list` SET pay = ' || {USER}",
    "'SELECT * FROM events'",
    f"'SELECT o_orderkey FROM shop.orders HAVING ' || {ID}",
])

REPLY_WITH_CODE = case("event_id", [
    f"'Here it is:' || chr(10) || '```sql' || chr(10) || ({QUERY_TEXT}) || chr(10) || '```' || ' and ```more```'",
    f"'``` ' || ({QUERY_TEXT}) || '``` done'",
    f"'  ' || ({QUERY_TEXT}) || chr(10)",
    f"'```python' || chr(10) || 'x = ' || {ID} || '```'",
    f"'```sql' || chr(10) || ({QUERY_TEXT})",
])

ASSET = case("event_id", ["'.pdf'", "'.CSV'", "'mysql'", "'image'", "'.zip'", "'url'", "'.gif'", "'mysql'", "'.xlsx'"])
ASKED = case("event_id", ["'document'", "'database'", "'database'", "'image'", "'web_search'"])

ERROR_TEXT = case("event_id", [
    "'API key invalid for project'",
    "'Permission_Denied: user ' || " + USER,
    "'quota-exceeded today'",
    "'HTTP 429 returned'",
    "'rate limit hit'",
    "'the file too large'",
    "'unsupported format .' || event_type",
    "'Out of memory in stage ' || " + ID,
    "'request timeout after ' || " + ID,
    "'connection reset'",
    "'pymysql failed'",
    "'404 for ' || event_type",
    "'table not found'",
    "'sandbox refused'",
    "'something else ' || " + ID,
    "'memoryless timeouts of ' || event_type",
])

# conversations
ESCAPED = (
    "replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
)
CONTENT = case("conv_id + turn", [
    "text",
    f"'[{{\"type\":\"text\",\"text\":\"' || {ESCAPED} || '\"}}]'",
    f"'{{\"type\":\"text\",\"text\":\"' || {ESCAPED} || '\"}}'",
    f"'[\"' || {ESCAPED} || '\",{{\"type\":\"image_url\",\"image_url\":\"x\"}},{{\"type\":\"text\",\"text\":\"end\"}}]'",
    "'{\"kind\":\"note\",\"n\":' || CAST(turn AS STRING) || '}'",
    "'[{\"type\":\"text\",\"text\":\"\"}]'",
    "'[broken ' || text",
    "'[1, 2, 3]'",
    "'[1] see ' || text",
    "'[[\"a\"], \"b\"]'",
    "'[\"a\", 2]'",
    "'{\"text\":\"x\"} and more'",
])
STRATEGY_REPLY = case("conv_id + turn", [
    "'hyde.'", "'**Expansion**'", "'unsure'", "' none '", "'DECOMPOSITION!'", "text", "'E-X-P-A-N-S-I-O-N'",
])
FIRST_LINE = "split_part(text, chr(10), 1)"
LISTED_REPLY = case("conv_id + turn", [
    "'1. ' || replace(text, chr(10), chr(10) || '2. ')",
    "' - ' || replace(text, chr(10), chr(10) || chr(10) || '* ')",
    "text",
    "chr(10) || '3.' || chr(10) || '  '",
])
HAS_TOOL_CALLS = "(conv_id + turn) % 4 = 1"

# benchmark
STRATEGY = case("item_id", ["'none'", "'expansion'", "'decomposition'", "'hyde'"])
BENCH_REPLY = "'1. ' || replace(replace(text, '. ', chr(10)), chr(10), chr(10) || '2. ')"

AS_OF = "2024-01-31"

# sessions: one row per conversation, from (conv_id, n_turns)
HOURS = "lpad(CAST(n_turns % 24 AS STRING), 2, '0')"
DAY = "lpad(CAST(1 + conv_id % 30 AS STRING), 2, '0')"
NEXT_DAY = "lpad(CAST(1 + (conv_id + 1) % 30 AS STRING), 2, '0')"
SESSION_COLUMNS = {
    "session_id": "conv_id",
    "title": "CASE WHEN conv_id % 4 = 0 THEN 'Chat ' || CAST(conv_id AS STRING) ELSE 'New Session' END",
    "file_metadata": "CASE WHEN conv_id % 5 = 0 THEN 'quarterly_report_' || CAST(conv_id AS STRING) || '.pdf' END",
    "created_at": f"'2024-01-' || {DAY} || 'T00:00:00'",
    "updated_at": (
        "CASE WHEN conv_id % 17 = 0 THEN NULL WHEN conv_id % 19 = 0 THEN 'not-a-date' "
        f"ELSE '2024-01-' || {DAY} || 'T' || {HOURS} || ':00:00' END"
    ),
    "summary": "CASE WHEN conv_id % 2 = 0 THEN 'Earlier: topic ' || CAST(conv_id AS STRING) ELSE '' END",
}
# Two kinds of update: a newer version of every third session, and new ids from every tenth.
UPDATE_COLUMNS = {
    "session_id": "CASE WHEN conv_id % 3 = 0 THEN conv_id ELSE 1000000 + conv_id END",
    "title": "'Renamed ' || CAST(conv_id AS STRING)",
    "file_metadata": "CAST(NULL AS STRING)",
    "created_at": f"'2024-01-' || {NEXT_DAY} || 'T12:00:00'",
    "updated_at": f"'2024-01-' || {NEXT_DAY} || 'T' || {HOURS} || ':30:00'",
    "summary": "CAST(NULL AS STRING)",
    "version": "CAST(n_turns AS BIGINT)",
}
UPDATE_WHERE = "conv_id % 3 = 0 OR conv_id % 10 = 0"


def columns(given: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in given.items()]


def select(given: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(columns(given))} FROM {source}"


CHATS_SQL = "(SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id)"
SESSIONS_SQL = select(SESSION_COLUMNS, CHATS_SQL)
UPDATES_SQL = select(UPDATE_COLUMNS, f"{CHATS_SQL} WHERE {UPDATE_WHERE}")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").count().withColumnRenamed("count", "n_turns")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).selectExpr(*columns(SESSION_COLUMNS))


def session_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).where(UPDATE_WHERE).selectExpr(*columns(UPDATE_COLUMNS))


# traces
RUN_COLUMNS = {
    "run_id": "event_id",
    "session_id": "user_id",
    "run_name": "event_type",
    "latency_ms": "value",
    "is_error": "event_type = 'error'",
    "ts": "ts",
}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = "CAST(get_json_object(props, '$.k') AS BIGINT) AS tokens"
    return table(spark, sf_dir, "events").selectExpr(*columns(RUN_COLUMNS), tokens)


RUNS_SQL = f"SELECT {', '.join(columns(RUN_COLUMNS))}, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events"
