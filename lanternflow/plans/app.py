"""Registered queries on conversations, events and the answer cache, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.functions import text as T
from lanternflow.operators import chats as C
from lanternflow.sources.scratch import scratch_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _messages(spark, d):
    """Two turns of a conversation share a minute, so that ties occur."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("turn") / 2) * 60 + F.col("conv_id"))
    rows = _t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), "role", F.col("text").alias("content"), at.alias("created_at"))
    # Every fifth value is cut off, and so malformed.
    sources = F.concat(F.lit('[{"title": "t", "url": "u'), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, F.lit('"')).otherwise(F.lit('"}]')))
    return rows.withColumns({"sources_json": F.when(F.col("id") % 5 != 1, sources), "debug_json": F.when(F.col("id") % 3 == 0, F.lit("{}")).when(F.col("id") % 3 == 1, F.lit(""))})


def _chats(spark, d):
    """A third of the chats has a title of its own, a third New chat, a third none."""
    title = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Topic "), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, F.lit("New chat"))
    ids = _t(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return ids.select("id", (F.col("id") % 50).alias("user_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 7).alias("created_at"), F.lit(None).cast("timestamp").alias("last_message_at"), title.alias("title"))


def _feedback(spark, d):
    rating = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return _t(spark, d, "events").select("event_id", "ts", F.concat(F.lit("Q  "), (F.col("user_id") % 200).cast("string"), F.lit(" \t"), F.hour("ts").cast("string")).alias("question"), F.col("event_id").cast("string").alias("answer"), rating.alias("rating"))


def _questions(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit(" q "), (F.col("c_custkey") % 200).cast("string"), F.lit(" "), (F.col("c_custkey") % 24).cast("string")).alias("text"))


def _visits(spark, d):
    """Access-log rows: the event's user as an address, in the forms that header values take."""
    ip = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 200).cast("string"), F.lit("."), (F.col("user_id") % 200).cast("string"))
    form = F.col("event_id") % 6
    value = (
        F.when(form == 0, F.concat(F.lit('"'), ip, F.lit('"')))
        .when(form == 1, F.concat(F.lit("for="), ip, F.lit(";proto=https")))
        .when(form == 2, F.concat(ip, F.lit(", 192.0.2.1")))
        .when(form == 3, F.concat(F.lit("[2001:db8::"), F.col("user_id").cast("string"), F.lit("]:443")))
        .when(form == 4, F.concat(ip, F.lit(":8080")))
        .otherwise(F.lit("  "))
    )
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), "ts", value.alias("forwarded"), F.when(F.col("event_id") % 12 == 5, ip).alias("peer"))


def clean_ip(spark, d):
    rows = _visits(spark, d)
    return rows.select("id", T.clean_ip(F.col("forwarded")).alias("cleaned"), T.client_ip([F.col("forwarded")], F.col("peer")).alias("address"))


def resolve_users(spark, d):
    """In two batches by time, the second of which holds a part of the first again; they are those of one batch."""
    visits = _visits(spark, d).select("id", "ts", T.client_ip([F.col("forwarded")], F.col("peer")).alias("address"))
    lo, hi = visits.select(F.min(F.col("ts").cast("string")), F.max(F.col("ts").cast("string"))).first()
    kind = dict(visits.dtypes)["ts"]
    micros = lambda x: F.unix_micros(F.lit(x).cast("timestamp"))
    at = lambda part: F.timestamp_micros(F.floor((micros(lo) * (4 - part) + micros(hi) * part) / 4).cast("long")).cast(kind)
    users = C.Users(spark, scratch_path(spark, "users"), kind, 8)
    users.resolve(visits.filter(F.col("ts") < at(2)))
    users.resolve(visits.filter(F.col("ts") >= at(1)))
    return users.read().select("address", "user_id")


def recent_messages(spark, d):
    return C.last_messages(_messages(spark, d), 3).select("chat_id", "position", "id", "role", F.length("content").cast("long").alias("n_chars"))


def message_view(spark, d):
    view = C.message_view(_messages(spark, d), 3)
    return view.select("chat_id", "position", "id", "role", F.size("sources").cast("long").alias("n_sources"), F.get("sources", F.lit(0))["url"].alias("url"), "has_debug")


def _ratings(spark, d):
    """A rating of each message, five seconds later; some by another user, some of a message that is not there."""
    at = F.col("created_at") + F.expr("INTERVAL 5 SECONDS")
    user = F.col("chat_id") % 50 + F.when(F.col("id") % 11 == 0, 1).otherwise(0)
    rating = F.when(F.col("id") % 4 == 0, -1).when(F.col("id") % 4 == 3, 0).otherwise(1)
    return _messages(spark, d).select("id", (F.col("id") + F.when(F.col("id") % 17 == 0, 10**9).otherwise(0)).alias("message_id"), user.alias("user_id"), rating.alias("rating"), at.alias("created_at"))


def rated_cache(spark, d):
    """The cache that ratings of messages make."""
    events = C.feedback_events(_ratings(spark, d), _messages(spark, d), _chats(spark, d))
    return C.feedback_cache(events).select("question_hash", "good_count", "bad_count", F.md5("answer_text").alias("answer_md5"), "sources_json")


def cache_touch(spark, d):
    """The cache after all questions were asked."""
    asked = _questions(spark, d).withColumn("asked_at", F.timestamp_seconds(F.lit(1_900_000_000) + F.col("query_id")))
    return C.touched(C.feedback_cache(_feedback(spark, d)), asked).select("question_hash", F.unix_seconds("last_used_at").alias("used_s"))


def owned_messages(spark, d):
    users = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"))
    return C.owned(_messages(spark, d), _chats(spark, d), users).select("id", "chat_id", "role")


def prev_user_message(spark, d):
    return C.previous_question(_messages(spark, d)).select("id", "question_id", F.md5("question").alias("question_md5"))


def recent_chats(spark, d):
    return C.recent_chats(C.touch_chats(_chats(spark, d), _messages(spark, d)), 5).select("user_id", "position", "id", F.unix_seconds("last_message_at").alias("last_s"))


def recent_profiles(spark, d):
    """The latest 100 users by first sight."""
    first = _t(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return first.orderBy(F.desc("created_at"), "user_id").limit(100).select("user_id")


def chat_titles(spark, d):
    return C.derived_titles(_chats(spark, d), _messages(spark, d)).select("id", "title")


def renamed_chats(spark, d):
    """Three changes of every chat: the second one counts, but the third does where it is not blank; those of others' chats change nothing."""
    chats = _chats(spark, d)
    title = F.when(F.col("nth") == 3, F.when(F.col("id") % 2 == 0, F.lit("  "))).when(F.col("nth") == 2, F.concat(F.lit(" to  "), F.col("id").cast("string"))).otherwise(F.lit("first"))
    owner = F.col("user_id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)
    changes = chats.select("id", "user_id", F.explode(F.array(*map(F.lit, (1, 3, 2)))).alias("nth")).select("id", owner.alias("user_id"), F.coalesce(title, F.lit("third")).alias("new_title"), "nth")
    return C.rename(chats, changes, ["nth"]).select("id", "title")


def title_search(spark, d):
    return C.search_titles(_chats(spark, d), " Chat 1 ").select("id")


def question_keys(spark, d):
    norm = T.normalize_question(F.col("text"))
    return _t(spark, d, "benchmark").select("item_id", norm.alias("question_norm"), T.hash_question(norm).alias("question_hash"))


def json_sources(spark, d):
    """Every seventh value is cut off, and so malformed."""
    text = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 5)).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    items = C.json_list(text, "k:bigint")
    return _t(spark, d, "events").select("event_id", F.size(items).cast("long").alias("n_items"), F.when(F.size(items) > 0, F.element_at(items, 1)["k"]).alias("k"), F.to_json(items).alias("again"))


def feedback_cache(spark, d):
    return C.feedback_cache(_feedback(spark, d)).select("question_hash", "question_norm", "good_count", "bad_count", "answer_text")


def cache_lookup(spark, d):
    return C.cache_lookup(_questions(spark, d), C.feedback_cache(_feedback(spark, d))).select("query_id", "answer_text")


def cache_routing(spark, d):
    return C.cache_routing(_questions(spark, d), C.feedback_cache(_feedback(spark, d))).select("query_id", "route", "answer_text")


_MESSAGES = """
WITH m AS (
  SELECT conv_id * 100 + turn AS id, conv_id AS chat_id, role, text AS content, 1704067200 + (turn // 2) * 60 + conv_id AS created_at FROM conversations
), c AS (
  SELECT DISTINCT conv_id AS id, conv_id % 50 AS user_id, CASE conv_id % 3 WHEN 0 THEN 'Topic ' || conv_id WHEN 1 THEN 'New chat' END AS title FROM conversations
)
"""
_CACHE = r"""
WITH f AS (
  SELECT event_id, ts, 'q ' || (user_id % 200) || ' ' || hour(ts) AS norm, event_id::VARCHAR AS answer,
         CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS rating FROM events
), g AS (
  SELECT *, min(CASE WHEN rating = 1 THEN {'ts': ts, 'e': event_id} END) OVER (PARTITION BY norm) AS first FROM f WHERE rating <> 0
), cache AS (
  SELECT sha256(norm) AS question_hash, norm AS question_norm, count(*) FILTER (rating = 1) AS good_count, count(*) FILTER (rating = -1) AS bad_count,
         arg_max(answer, {'ts': ts, 'e': event_id}) FILTER (rating = 1) AS answer_text
  FROM g WHERE first IS NOT NULL AND {'ts': ts, 'e': event_id} >= first GROUP BY norm
), q AS (
  SELECT c_custkey AS query_id, 'q ' || (c_custkey % 200) || ' ' || (c_custkey % 24) AS norm FROM customer
), ok AS (
  SELECT * FROM cache WHERE good_count >= 1 AND bad_count = 0
)
"""
_VISITS = r"""
WITH v AS (
  SELECT event_id AS id, ts, '10.0.' || (user_id // 200) || '.' || (user_id % 200) AS ip, user_id FROM events
), a AS (
  SELECT id, ts, CASE WHEN id % 6 = 3 THEN '2001:db8::' || user_id WHEN id % 6 = 5 THEN '' ELSE ip END AS cleaned, CASE WHEN id % 12 = 5 THEN ip END AS peer FROM v
), w AS (
  SELECT id, ts, cleaned, coalesce(nullif(cleaned, ''), peer, 'unknown') AS address FROM a
)
"""

ORACLES = {
    "clean_ip": _VISITS + "SELECT id, cleaned, address FROM w",
    "resolve_users": _VISITS + "SELECT address, row_number() OVER (ORDER BY ts, id) AS user_id FROM (SELECT address, min(ts) AS ts, arg_min(id, {'ts': ts, 'id': id}) AS id FROM w GROUP BY address)",
    "recent_messages": _MESSAGES + "SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC) AS position, id, role, length(content) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id) AS n FROM m) WHERE n <= 3",
    "message_view": _MESSAGES + "SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC) AS position, id, role, CASE WHEN id % 5 IN (0, 1) THEN 0 ELSE 1 END::BIGINT AS n_sources, CASE WHEN id % 5 NOT IN (0, 1) THEN 'u' || id END AS url, id % 3 = 0 AS has_debug FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, id) AS n FROM m) WHERE n <= 3",
    "rated_cache": _MESSAGES + r""", q AS (
  SELECT a.id, any_value(a.content) AS answer, any_value(a.created_at) + 5 AS ts, arg_min(u.content, {'t': -u.created_at, 'i': u.id}) AS question, CASE a.id % 4 WHEN 0 THEN -1 WHEN 3 THEN 0 ELSE 1 END AS rating
  FROM m a JOIN m u ON a.chat_id = u.chat_id AND u.role = 'user' AND u.created_at <= a.created_at WHERE a.role = 'assistant' AND a.id % 17 <> 0 AND a.id % 11 <> 0 GROUP BY a.id
), k AS (
  SELECT *, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS norm FROM q WHERE rating <> 0
), g AS (
  SELECT *, min(CASE WHEN rating = 1 THEN {'ts': ts, 'e': id} END) OVER (PARTITION BY norm) AS first FROM k
)
SELECT sha256(norm) AS question_hash, count(*) FILTER (rating = 1) AS good_count, count(*) FILTER (rating = -1) AS bad_count, md5(arg_max(answer, {'ts': ts, 'e': id}) FILTER (rating = 1)) AS answer_md5,
       arg_max(CASE WHEN id % 5 <> 1 THEN '[{"title": "t", "url": "u' || id || CASE WHEN id % 5 = 0 THEN '"' ELSE '"}]' END END, {'ts': ts, 'e': id}) FILTER (rating = 1 AND id % 5 <> 1) AS sources_json
FROM g WHERE first IS NOT NULL AND {'ts': ts, 'e': id} >= first GROUP BY norm""",
    "cache_touch": _CACHE + """, t AS (
  SELECT norm, epoch(max(ts) FILTER (rating = 1)) AS used FROM g WHERE first IS NOT NULL AND {'ts': ts, 'e': event_id} >= first GROUP BY norm
), a AS (SELECT norm, 1900000000 + max(query_id) AS asked FROM q GROUP BY norm)
SELECT sha256(norm) AS question_hash, CAST(floor(CASE WHEN norm IN (SELECT question_norm FROM ok) THEN coalesce(asked, used) ELSE used END) AS BIGINT) AS used_s FROM t LEFT JOIN a USING (norm)""",
    "owned_messages": _MESSAGES + "SELECT m.id, chat_id, role FROM m WHERE chat_id IN (SELECT id FROM c WHERE user_id IN (SELECT n_nationkey FROM nation))",
    "prev_user_message": _MESSAGES + "SELECT a.id, arg_min(u.id, {'t': -u.created_at, 'i': u.id}) AS question_id, md5(arg_min(u.content, {'t': -u.created_at, 'i': u.id})) AS question_md5 FROM m a LEFT JOIN m u ON a.chat_id = u.chat_id AND u.role = 'user' AND u.created_at <= a.created_at WHERE a.role = 'assistant' GROUP BY a.id",
    "recent_chats": _MESSAGES + "SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_s DESC, id) AS position, id, last_s FROM (SELECT c.id, user_id, max(created_at) AS last_s FROM c JOIN m ON chat_id = c.id GROUP BY ALL)) WHERE position <= 5",
    "recent_profiles": "SELECT user_id FROM (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id ORDER BY t DESC, user_id LIMIT 100)",
    "chat_titles": _MESSAGES + r"SELECT c.id, CASE WHEN title LIKE 'Topic%' THEN title ELSE coalesce(said, title) END AS title FROM c LEFT JOIN (SELECT chat_id, substr(trim(regexp_replace(arg_min(content, {'t': created_at, 'i': id}), '\s+', ' ', 'g')), 1, 80) AS said FROM m WHERE role = 'user' AND trim(content) <> '' GROUP BY chat_id) ON chat_id = c.id",
    "renamed_chats": _MESSAGES + "SELECT id, CASE WHEN id % 5 = 0 THEN title WHEN id % 2 = 0 THEN 'to ' || id ELSE 'third' END AS title FROM c",
    "title_search": _MESSAGES + "SELECT id FROM c WHERE contains(lower(coalesce(title, 'Chat ' || id)), 'chat 1')",
    "question_keys": r"SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS question_norm, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS question_hash FROM benchmark",
    "json_sources": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS n_items, CASE WHEN event_id % 7 <> 0 THEN CAST(props ->> '$.k' AS BIGINT) END AS k, CASE WHEN event_id % 7 = 0 THEN '[]' ELSE '[{\"k\":' || (props ->> '$.k') || '}]' END AS again FROM events",
    "feedback_cache": _CACHE + "SELECT * FROM cache",
    "cache_lookup": _CACHE + "SELECT query_id, answer_text FROM q JOIN ok ON q.norm = ok.question_norm",
    "cache_routing": _CACHE + "SELECT query_id, CASE WHEN answer_text IS NULL THEN 'retrieval' ELSE 'cache' END AS route, answer_text FROM q LEFT JOIN ok ON q.norm = ok.question_norm",
}

QUERIES = {name: globals()[name] for name in ORACLES}
