"""Queries about when work happens."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.dates import ymd
from ..operators import blocks, rhythm
from .registry import cte, query, sql
from .usage_queries import ZONE, _usage

GAP = 1_800_000
cte("timed", "SELECT tool, session_id, epoch_ms(ts) AS ms FROM usage", "usage")
cte(
    "sittings",
    f"""SELECT tool, session_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS replies, max(ms) - min(ms) AS duration_ms FROM (
 SELECT *, sum(CASE WHEN ms - p <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY tool, session_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT *, lag(ms) OVER (PARTITION BY tool, session_id ORDER BY ms) AS p FROM timed)) GROUP BY tool, session_id, run""",
    "timed",
)
cte(
    "session_project",
    """SELECT tool, session_id, coalesce(CASE WHEN p LIKE '/Users/%' THEN 'p2' ELSE regexp_extract(p, '([^/]+)$', 1) END, 'unknown') AS project, replies
 FROM (SELECT tool, session_id, arg_min(project_path, seq) FILTER (WHERE project_path IS NOT NULL) AS p, count(*) AS replies FROM usage GROUP BY 1, 2)""",
    "usage",
)


@query("sittings", sql("SELECT * FROM sittings", "sittings"))
def _(spark, d):
    return rhythm.sittings(_usage(spark, d))


@query(
    "longest_sitting",
    sql(
        """SELECT s.tool, s.session_id, duration_ms, s.replies, strftime(make_timestamp(start_ms * 1000) - INTERVAL 5 HOUR, '%Y-%m-%d') AS date, project
 FROM (SELECT * FROM sittings ORDER BY duration_ms DESC, start_ms, tool, session_id LIMIT 1) s JOIN session_project p ON p.tool = s.tool AND p.session_id = s.session_id""",
        "sittings", "session_project",
    ),
)
def _(spark, d):
    return rhythm.longest_sitting(_usage(spark, d), ZONE)


cte(
    "loop_events",
    "SELECT session_id, epoch_ms(ts) AS at_ms, input + output + cache_write AS tokens, project_path FROM usage_raw WHERE tool <> 'antigravity' AND coalesce(project_path, '') NOT LIKE '/tmp/%'",
    "usage_raw",
)
cte(
    "turns",
    """SELECT session_id, at_ms, min(text) AS text FROM (SELECT 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, epoch_ms(date_trunc('millisecond', ts)) AS at_ms, 'turn **' || event_id || '** go on' AS text
 FROM events WHERE event_type = 'signup') GROUP BY 1, 2""",
)
cte(
    "loops",
    f"""SELECT session_id, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) AS steps, CAST(sum(tokens) AS BIGINT) AS tokens, arg_min(trig, at_ms) AS trig FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR at_ms - p > {GAP} OR coalesce(trig > p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY at_ms, ord ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT e.*, lag(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms, ord) AS p FROM (
      SELECT e.session_id, e.at_ms, e.tokens, row_number() OVER (ORDER BY e.at_ms) AS ord, t.at_ms AS trig FROM loop_events e ASOF LEFT JOIN turns t ON t.session_id = e.session_id AND e.at_ms >= t.at_ms
      WHERE e.session_id IN (SELECT session_id FROM turns)) e)) GROUP BY session_id, run""",
    "loop_events", "turns",
)
cte(
    "loops_timed",
    f"""SELECT l.session_id, start_ms, end_ms, steps, tokens, t.text AS trigger_text, CASE WHEN start_ms - trig <= {GAP} THEN trig ELSE start_ms END AS anchor_ms,
 end_ms - CASE WHEN start_ms - trig <= {GAP} THEN trig ELSE start_ms END AS duration_ms FROM loops l LEFT JOIN turns t ON t.session_id = l.session_id AND t.at_ms = l.trig""",
    "loops", "turns",
)


def _loops(spark, d):
    return rhythm.autonomous_loops(B.loop_events(spark, d), B.user_turns(spark, d))


@query("autonomous_loops", sql("SELECT * FROM loops_timed", "loops_timed"))
def _(spark, d):
    return _loops(spark, d)


@query(
    "loop_summary",
    sql(
        """SELECT session_id, duration_ms, steps, tokens, strftime(make_timestamp(anchor_ms * 1000) - INTERVAL 5 HOUR, '%Y-%m-%d') AS date,
 strftime(make_timestamp(anchor_ms * 1000) - INTERVAL 5 HOUR, '%-I:%M %p') AS start_clock, trim(regexp_replace(regexp_replace(trigger_text, '[#*`>_|]+', ' ', 'g'), '\\s+', ' ', 'g')) AS prompt,
 (SELECT count(*) FROM loops_timed) AS count, (SELECT quantile_cont(duration_ms::DOUBLE, 0.5) FROM loops_timed) AS median_ms
 FROM loops_timed ORDER BY duration_ms DESC, start_ms, session_id LIMIT 1""",
        "loops_timed",
    ),
)
def _(spark, d):
    return rhythm.loop_summary(_loops(spark, d), ZONE)


@query(
    "asof_trigger",
    sql("SELECT e.seq, t.at_ms AS trigger_ms FROM (SELECT seq, session_id, epoch_ms(ts) AS at_ms FROM usage_raw) e ASOF LEFT JOIN turns t ON t.session_id = e.session_id AND e.at_ms >= t.at_ms", "usage_raw", "turns"),
)
def _(spark, d):
    events = B.usage_raw(spark, d).select("seq", "session_id", F.unix_millis("ts").alias("at_ms"))
    return blocks.asof_previous(events, B.user_turns(spark, d), ["session_id"], "at_ms", "at_ms", F.col("at_ms"), "trigger_ms").select("seq", "trigger_ms")


cte("local_times", "SELECT ts - INTERVAL 5 HOUR AS l FROM usage", "usage")


@query("heat_map", sql("SELECT CAST(dayofweek(ts - INTERVAL 5 HOUR) AS BIGINT) AS weekday, CAST(hour(ts - INTERVAL 5 HOUR) AS BIGINT) AS hour, count(*) AS messages FROM usage GROUP BY 1, 2", "usage"))
def _(spark, d):
    return rhythm.heat_map(_usage(spark, d), ZONE)


@query(
    "rhythm",
    sql(
        """SELECT (SELECT hour(l) FROM local_times GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour, (SELECT CAST(dayofweek(l) AS BIGINT) FROM local_times GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_weekday,
 count(DISTINCT CAST(l AS DATE)) FILTER (WHERE hour(l) <= 4) AS nights, (SELECT strftime(l, '%Y-%m-%d') FROM local_times WHERE hour(l) <= 4 ORDER BY hour(l) * 60 + minute(l) DESC, CAST(l AS DATE) LIMIT 1) AS latest_date,
 max(hour(l) * 60 + minute(l)) FILTER (WHERE hour(l) <= 4) AS latest_minute, (count(*) FILTER (WHERE hour(l) >= 22 OR hour(l) <= 5))::DOUBLE / count(*) AS night_share FROM local_times""",
        "local_times",
    ),
)
def _(spark, d):
    return rhythm.rhythm(_usage(spark, d), ZONE)


@query("distinct_session_counts", sql("SELECT 'tool' AS kind, tool AS name, count(*) AS sessions FROM session_project GROUP BY 2 UNION ALL SELECT 'project', project, count(*) FROM session_project GROUP BY 2", "session_project"))
def _(spark, d):
    return rhythm.distinct_session_counts(_usage(spark, d))


@query("median_replies", sql("SELECT count(*) AS sessions, quantile_cont(replies::DOUBLE, 0.5) AS median_replies FROM session_project", "session_project"))
def _(spark, d):
    return rhythm.median_replies(_usage(spark, d))


CANON = """CASE model WHEN 'claude-opus-4-8' THEN 'Opus 4.8' WHEN 'claude-haiku-4-5-20251001' THEN 'Haiku 4.5' WHEN 'gpt-5.4' THEN 'GPT-5.4' WHEN 'anthropic/claude-sonnet-4-6' THEN 'Sonnet 4.6'
 WHEN 'claude-opus-9' THEN 'Opus 9' WHEN 'gpt-5.5' THEN 'GPT-5.5' ELSE model END"""
cte("canon_day", f"SELECT {CANON} AS model, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, count(*) AS n FROM usage WHERE model NOT LIKE '<%' GROUP BY 1, 2", "usage")


@query(
    "model_adoption",
    sql(
        """SELECT s.model, strftime(f, '%Y-%m-%d') AS first_seen, strftime(t, '%Y-%m-%d') AS first_top_day FROM (SELECT model, min(day) f FROM canon_day GROUP BY 1) s
 LEFT JOIN (SELECT model, min(day) t FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, model) rn FROM canon_day) WHERE rn = 1 GROUP BY 1) l ON l.model = s.model""",
        "canon_day",
    ),
)
def _(spark, d):
    out = rhythm.model_adoption(_usage(spark, d), ZONE)
    return out.select("model", ymd(F.col("first_seen")).alias("first_seen"), ymd(F.col("first_top_day")).alias("first_top_day"))


@query("event_cache_rate", sql("SELECT CAST(sum(cache_read) AS BIGINT) AS cache_read_tokens, sum(cache_read)::DOUBLE / sum(input + cache_read)::DOUBLE AS cache_hit_rate FROM usage", "usage"))
def _(spark, d):
    return rhythm.event_cache_rate(_usage(spark, d))


@query("not_junk_cwd", sql("SELECT project_path, count(*) AS n FROM usage_raw WHERE coalesce(project_path, '') NOT LIKE '/tmp/%' GROUP BY 1", "usage_raw"))
def _(spark, d):
    return B.usage_raw(spark, d).where(rhythm.not_junk_cwd(F.col("project_path"))).groupBy("project_path").agg(F.count(F.lit(1)).alias("n"))
