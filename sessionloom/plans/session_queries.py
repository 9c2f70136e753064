"""Queries over transcripts, sessions and messages derived from ``conversations``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import bindings as B
from ..context import cut
from ..functions import text as T
from ..functions.dates import ymd
from ..operators import sessions as S
from ..operators import transcripts as X
from ..sources.lines import parse_lines, sniff_format
from . import usage_queries  # noqa: F401  (shared SQL)
from .registry import cte, query, sql

NOW = "2024-02-01 00:00:00"
TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
ONE_LINE = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"

cte(
    "conv",
    """SELECT conv_id, turn, role, coalesce(text, '') AS text, (['claude','codex','opencode'])[conv_id % 3 + 1] AS tool, '/srv/work/p' || (conv_id % 7) AS cwd,
 make_timestamp(1704067200000000 + conv_id * 7200000000 + turn * 60000000) AS ats, '/data/' || (['claude','codex','opencode'])[conv_id % 3 + 1] || '/s' || conv_id || '.jsonl' AS file_path,
 's' || conv_id AS session_id, role = 'assistant' AS asst, turn % 3 AS kind, 'src/f' || (turn % 5) || '.py' AS fname,
 (['git status -sb','ls -la','npm test','make build'])[turn % 4 + 1] AS command FROM conversations""",
)
cte(
    "msgs",
    f"""SELECT file_path, tool, row_number() OVER (PARTITION BY file_path ORDER BY turn) - 1 AS msg_index, CASE WHEN asst THEN 'assistant' ELSE 'user' END AS role, text, role <> 'system' AS genuine, turn
 FROM conv WHERE (role <> 'system' OR tool = 'claude') AND {TRIM.format(c='text')} <> ''""",
    "conv",
)


def _first_seen(value: str, cond: str, limit: int) -> str:
    return (
        f"(SELECT file_path, string_agg(v, ',' ORDER BY t) AS a, count(*) AS n FROM (SELECT file_path, {value} AS v, min(turn) AS t FROM conv WHERE {cond} GROUP BY 1, 2 "
        f"QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY min(turn)) <= {limit}) GROUP BY 1)"
    )


cte(
    "sess",
    f"""SELECT m.*, coalesce(ft.a, '') AS files_touched, coalesce(ft.n, 0) AS n_touched, coalesce(fr.a, '') AS files_read, coalesce(fr.n, 0) AS n_read, coalesce(cm.a, '') AS commands, coalesce(cm.n, 0) AS n_commands FROM (
 SELECT file_path, tool, session_id, cwd, any_value(conv_id) AS conv_id, CAST(min(ats) AS DATE) AS created_at, CAST(arg_max(ats, turn) AS DATE) AS date, min(ats) AS started_at, arg_max(ats, turn) AS ended_at,
  CAST(sum(CASE WHEN tool = 'claude' OR role <> 'system' THEN 1 ELSE 0 END) AS BIGINT) AS message_count,
  coalesce(substr({ONE_LINE.format(c="regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user' AND " + TRIM.format(c='text') + " <> ''), '<[^>]+>', '', 'g')")}, 1, 100), '') AS first_prompt,
  CASE WHEN tool = 'claude' THEN 'Talk ' || any_value(conv_id) ELSE '' END AS custom_title,
  coalesce(substr({TRIM.format(c="arg_max(text, turn) FILTER (WHERE role = 'user' AND " + TRIM.format(c='text') + " <> '')")}, 1, 500), '') AS closing_user,
  coalesce(substr({TRIM.format(c="regexp_replace(arg_max(text, turn) FILTER (WHERE asst AND " + TRIM.format(c='text') + " <> ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")}, 1, 500), '') AS closing_assistant,
  CAST(sum(CASE WHEN tool = 'claude' THEN (role = 'system')::INT WHEN tool = 'codex' THEN (asst AND kind <> 0 AND turn % 5 = 0)::INT ELSE (asst AND turn % 5 = 0)::INT END) AS BIGINT) AS error_count,
  CASE WHEN tool = 'codex' THEN 'trunk' WHEN tool = 'claude' AND max(turn) FILTER (WHERE asst) IS NOT NULL THEN CASE WHEN max(turn) FILTER (WHERE asst) % 2 = 0 THEN 'main' ELSE 'dev' END ELSE '' END AS branch
 FROM conv GROUP BY 1, 2, 3, 4) m
 LEFT JOIN {_first_seen('fname', 'asst AND kind = 0', 50)} ft ON ft.file_path = m.file_path
 LEFT JOIN {_first_seen('fname', "asst AND kind = 2 AND tool <> 'codex'", 50)} fr ON fr.file_path = m.file_path
 LEFT JOIN {_first_seen('command', "asst AND (kind = 1 OR (tool = 'codex' AND kind <> 0))", 100)} cm ON cm.file_path = m.file_path""",
    "conv",
)
_SESS_OUT = """SELECT file_path, tool, session_id, cwd, strftime(created_at, '%Y-%m-%d') AS created_at, strftime(date, '%Y-%m-%d') AS date, epoch_ms(started_at) AS started_ms, epoch_ms(ended_at) AS ended_ms,
 first_prompt, custom_title, message_count, files_touched, files_read, commands, error_count, error_count > 0 AS errored, closing_user, closing_assistant, branch FROM sess"""


def _lines(spark, d):
    return B.transcript_lines(spark, d)


def _extract(spark, d, written=True):
    return X.extract_lines(parse_lines(_lines(spark, d)), written)


def _flat_sessions(df):
    j = lambda c: F.array_join(c, ",").alias(c)
    return df.select(
        "file_path", "tool", "session_id", "cwd", ymd(F.col("created_at")).alias("created_at"), ymd(F.col("date")).alias("date"),
        F.unix_millis("started_at").alias("started_ms"), F.unix_millis("ended_at").alias("ended_ms"), "first_prompt", "custom_title", "message_count",
        j("files_touched"), j("files_read"), j("commands"), "error_count", "errored", "closing_user", "closing_assistant", "branch",
    )


# --- transcripts ---------------------------------------------------------------
@query("session_rows", sql(_SESS_OUT, "sess"))
def _(spark, d):
    x = _extract(spark, d)
    return _flat_sessions(X.session_rows(x, cut(X.extract_messages(x))))


@query("session_index_binding", sql(_SESS_OUT, "sess"))
def _(spark, d):
    return _flat_sessions(B.session_index(spark, d))


@query(
    "session_metadata",
    sql("SELECT file_path, session_id, cwd, custom_title, strftime(created_at, '%Y-%m-%d') AS created_at, strftime(date, '%Y-%m-%d') AS date, message_count, branch FROM sess", "sess"),
)
def _(spark, d):
    m = X.session_metadata(_extract(spark, d, False))
    return m.select("file_path", "session_id", "cwd", "custom_title", ymd(F.col("created_at")).alias("created_at"), ymd(F.col("date")).alias("date"), "message_count", "branch")


@query(
    "metadata_fields",
    sql("SELECT file_path, strftime(created_at, '%Y-%m-%d') AS first_day, strftime(date, '%Y-%m-%d') AS last_day, CASE WHEN tool = 'claude' THEN custom_title END AS title FROM sess", "sess"),
)
def _(spark, d):
    return X.metadata_fields(parse_lines(_lines(spark, d)))


@query("sniff_format", sql("SELECT file_path, tool = 'codex' AS rollout FROM sess", "sess"))
def _(spark, d):
    return sniff_format(_lines(spark, d))


@query("read_lines_parsed", sql("SELECT tool, count(*) + count(DISTINCT file_path) + CAST(count(*) FILTER (WHERE tool = 'codex' AND role <> 'system') AS BIGINT) AS n FROM conv GROUP BY 1", "conv"))
def _(spark, d):
    return parse_lines(_lines(spark, d)).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query("extract_messages", sql("SELECT file_path, msg_index, role, text, genuine FROM msgs", "msgs"))
def _(spark, d):
    return X.extract_messages(_extract(spark, d)).select("file_path", "msg_index", "role", "text", "genuine")


@query("indexed_messages", sql("SELECT file_path, msg_index, role, text FROM msgs WHERE genuine OR role = 'assistant'", "msgs"))
def _(spark, d):
    return X.indexed_messages(B.message_rows(spark, d))


@query(
    "match_rollout_events",
    sql("SELECT file_path, turn * 2 + 11 AS line_no, true AS typed_event, true AS matched FROM conv WHERE tool = 'codex' AND role = 'user' AND " + TRIM.format(c="text") + " <> ''", "conv"),
)
def _(spark, d):
    return X.match_rollout_events(_extract(spark, d))


@query(
    "fold_tool_calls",
    sql(
        """SELECT file_path, greatest(coalesce((SELECT max(m.msg_index) FROM msgs m WHERE m.file_path = c.file_path AND m.turn <= c.turn), 0), 0) AS msg_index, name, summary FROM (
 SELECT file_path, turn, (['Edit','Bash','Read'])[kind + 1] AS name, CASE WHEN kind = 1 THEN command ELSE fname END AS summary FROM conv WHERE tool = 'claude' AND asst
 UNION ALL SELECT file_path, turn, 'apply_patch', '*** Begin Patch *** Update File: ' || fname || ' *** End Patch' FROM conv WHERE tool = 'codex' AND asst AND kind = 0) c""",
        "conv", "msgs",
    ),
)
def _(spark, d):
    return X.fold_tool_calls(X.numbered_rows(_extract(spark, d))).select("file_path", "msg_index", "name", "summary")


@query("summarize_messages", sql("SELECT file_path, first_prompt, closing_user, closing_assistant FROM sess WHERE file_path IN (SELECT file_path FROM msgs)", "sess", "msgs"))
def _(spark, d):
    return X.summarize_messages(B.message_rows(spark, d))


@query(
    "human_turns",
    sql("SELECT session_id, epoch_ms(ats) AS at_ms, substr(" + TRIM.format(c="text") + ", 1, 200) AS text FROM conv WHERE tool = 'claude' AND role = 'user' AND " + TRIM.format(c="text") + " <> ''", "conv"),
)
def _(spark, d):
    return X.user_turns(parse_lines(_lines(spark, d))).select("session_id", F.unix_millis("at").alias("at_ms"), "text")


for _kind, _col in (("files_touched", "files_touched"), ("files_read", "files_read"), ("commands", "commands")):

    def _run(spark, d, fn=_kind):
        out = getattr(X, fn)(X.facts(_extract(spark, d, False)))
        return out.select("file_path", F.array_join(fn, ",").alias(fn))

    query(f"extract_{_kind}", sql(f"SELECT file_path, {_col} FROM sess WHERE {_col} <> ''", "sess"))(_run)


@query(
    "extract_errors",
    sql("SELECT file_path, error_count, substr(repeat(CASE tool WHEN 'claude' THEN ',boom' WHEN 'codex' THEN ',bad exit' ELSE ',denied' END, CAST(least(error_count, 20) AS INTEGER)), 2) AS messages FROM sess WHERE error_count > 0", "sess"),
)
def _(spark, d):
    return X.errors(cut(X.facts(_extract(spark, d, False)))).select("file_path", "error_count", F.array_join("error_messages", ",").alias("messages"))


@query(
    "extract_thinking",
    sql("SELECT file_path, substr(string_agg('plan ' || turn, chr(10) ORDER BY turn), 1, 20000) AS thinking FROM conv WHERE tool = 'claude' AND asst GROUP BY 1", "conv"),
)
def _(spark, d):
    return X.thinking_text(cut(X.facts(_extract(spark, d, False))))


@query(
    "strip_injected",
    sql("SELECT conv_id, turn, 'a' || text || 'b' AS text FROM conversations WHERE text IS NOT NULL"),
)
def _(spark, d):
    c = B.table(spark, d, "conversations").where("text is not null")
    dirty = F.concat(F.lit("a<command-name>x\ny</command-name>"), F.col("text"), F.lit('<bash-stdout k="1">z</bash-stdout>b'))
    return c.select("conv_id", "turn", T.strip_injected(dirty).alias("text"))


@query(
    "clean_title",
    sql(
        """SELECT doc_id, CASE WHEN t = '' THEN 'untitled' WHEN length(t) > 72 THEN rtrim(substr(t, 1, 72), ' ') || '…' ELSE t END AS title FROM (
 SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[#*`>_|]+', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM documents)"""
    ),
)
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.clean_title(F.col("text")).alias("title"))


@query(
    "clip_text",
    sql(
        """SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(CASE WHEN sp > 48 THEN substr(h, 1, sp) ELSE h END, ' ') || '…' END AS clip FROM (
 SELECT doc_id, t, h, CASE WHEN strpos(reverse(h), ' ') > 0 THEN length(h) - strpos(reverse(h), ' ') ELSE -1 END AS sp FROM (
 SELECT doc_id, t, substr(t, 1, 79) AS h FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM documents)))"""
    ),
)
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.clip(F.col("text"), 80).alias("clip"))


@query(
    "resolve_project",
    sql("SELECT DISTINCT cwd, regexp_extract(cwd, '([^/]+)$', 1) AS project FROM conv", "conv"),
)
def _(spark, d):
    return B.session_index(spark, d).select("cwd", T.resolve_project(F.col("cwd")).alias("project")).distinct()


@query("canonical_model", sql("SELECT model, CASE model WHEN 'claude-opus-4-8' THEN 'Opus 4.8' WHEN 'claude-haiku-4-5-20251001' THEN 'Haiku 4.5' WHEN 'gpt-5.4' THEN 'GPT-5.4' WHEN 'anthropic/claude-sonnet-4-6' THEN 'Sonnet 4.6' WHEN 'claude-opus-9' THEN 'Opus 9' WHEN 'gpt-5.5' THEN 'GPT-5.5' ELSE model END AS name, model NOT LIKE '<%' AS real, count(*) AS n FROM usage_raw GROUP BY 1", "usage_raw"))
def _(spark, d):
    u = B.usage_raw(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return u.select("model", T.canonical_model(F.col("model")).alias("name"), T.is_real_model(F.col("model")).alias("real"), "n")


@query(
    "command_family",
    sql("SELECT command, CASE WHEN command LIKE '% -%' AND command NOT LIKE 'git%' THEN split_part(command, ' ', 1) ELSE split_part(command, ' ', 1) || ' ' || split_part(command, ' ', 2) END AS family, count(*) AS n FROM conv WHERE asst AND kind = 1 GROUP BY 1, 2", "conv"),
)
def _(spark, d):
    r = B._conversation_rows(spark, d).where("role = 'assistant' and turn % 3 = 1")
    cmd = F.element_at(F.array(*[F.lit(x) for x in ("git status -sb", "ls -la", "npm test", "make build")]), (F.col("turn") % 4 + 1).cast("int"))
    return r.groupBy(cmd.alias("command")).agg(F.count(F.lit(1)).alias("n")).select("command", T.command_family(F.col("command")).alias("family"), "n")


@query(
    "normalise_events",
    sql("SELECT file_path, count(*) + 1 + CAST(max((tool = 'claude')::INT) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM msgs GROUP BY 1", "msgs"),
)
def _(spark, d):
    m = B.message_rows(spark, d)
    events = m.select(
        "file_path", F.col("msg_index").alias("line_no"), "role", "text", F.lit(None).cast("string").alias("thinking"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit(None).cast("array<struct<name:string,input:string,id:string>>").alias("calls"),
    )
    heads = B.session_index(spark, d).join(m.select("file_path").distinct(), "file_path", "left_semi").select(
        "file_path", "session_id", "cwd", F.nullif("custom_title", F.lit("")).alias("name")
    )
    lines = X.normalise_events(events, heads)
    text = F.coalesce(F.get_json_object("value", "$.message.content[0].text"), F.lit(""))
    return lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length(text)).alias("chars"))


# --- sessions --------------------------------------------------------------------
def _s(spark, d):
    return B.session_index(spark, d)


@query("filter_sessions", sql("SELECT file_path FROM sess WHERE tool = 'claude' AND (cwd = '/srv/work/p1' OR cwd LIKE '/srv/work/p1/%') AND error_count > 0 AND coalesce(date >= DATE '2024-01-02', true) AND date <= DATE '2024-01-30'", "sess"))
def _(spark, d):
    return S.filter_sessions(_s(spark, d), tool="claude", project="/srv/work/p1", errored=True, after=date(2024, 1, 2), before=date(2024, 1, 30)).select("file_path")


@query("filter_files", sql("SELECT file_path FROM sess WHERE contains(lower(files_touched || ',' || files_read), 'rc/f') AND contains(lower(files_touched || ',' || files_read), '3.py')", "sess"))
def _(spark, d):
    return S.filter_sessions(_s(spark, d), files=("RC/F", "3.PY")).select("file_path")


@query("created_between", sql("SELECT file_path, strftime(created_at, '%Y-%m-%d') AS created_at FROM sess WHERE created_at BETWEEN DATE '2024-01-03' AND DATE '2024-01-06'", "sess"))
def _(spark, d):
    return S.created_between(_s(spark, d), date(2024, 1, 3), date(2024, 1, 6)).select("file_path", ymd(F.col("created_at")).alias("created_at"))


@query("repo_scope", sql("SELECT file_path, cwd FROM sess WHERE cwd IN ('/srv/work/p2', '/srv/work/p5')", "sess"))
def _(spark, d):
    roots = spark.sql("SELECT * FROM VALUES ('/srv/work/p2'), ('/srv/work/p2/sub'), ('/srv/work/p5'), ('/srv/work/p'), ('') AS t(root)")
    return S.repo_scope(_s(spark, d), roots).select("file_path", "cwd")


@query("lookback_days", sql("SELECT file_path FROM sess WHERE created_at >= DATE '2024-01-08' - 3", "sess"))
def _(spark, d):
    return S.lookback_days(_s(spark, d), 3, date(2024, 1, 8)).select("file_path")


@query("resolve_session", sql("SELECT session_id, file_path FROM sess", "sess"))
def _(spark, d):
    return S.resolve_session(_s(spark, d))


@query("recent_order", sql("SELECT file_path FROM sess ORDER BY date DESC, file_path LIMIT 50", "sess"))
def _(spark, d):
    return S.recent_order(_s(spark, d)).select("file_path")


cte(
    "topics",
    """SELECT created_at, cwd, string_agg(topic, '|' ORDER BY pos) AS topics FROM (SELECT created_at, cwd, topic, pos, row_number() OVER (PARTITION BY created_at, cwd ORDER BY pos) rn FROM
 (SELECT created_at, cwd, coalesce(nullif(custom_title, ''), nullif(first_prompt, '')) AS topic, min((strftime(date, '%Y-%m-%d') || file_path)) AS pos FROM sess WHERE coalesce(nullif(custom_title, ''), nullif(first_prompt, '')) IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn <= 10 GROUP BY 1, 2""",
    "sess",
)


@query(
    "activity_digest",
    sql(
        """SELECT strftime(s.created_at, '%Y-%m-%d') AS created_at, s.cwd, sessions, messages, tools, coalesce(topics, '') AS topics, paths FROM
 (SELECT created_at, cwd, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT unnest(list_distinct(list(tool))) AS t)) AS tools,
  array_to_string(list_reverse(list_slice(list(file_path ORDER BY date DESC, file_path DESC), 1, 5)), ',') AS paths FROM sess GROUP BY 1, 2) s
 LEFT JOIN topics t ON t.created_at = s.created_at AND t.cwd = s.cwd""",
        "sess", "topics",
    ),
)
def _(spark, d):
    a = S.activity_digest(_s(spark, d))
    return a.select(ymd(F.col("created_at")).alias("created_at"), "cwd", "sessions", "messages", "tools", F.array_join("topics", "|").alias("topics"), F.array_join("file_paths", ",").alias("paths"))


@query(
    "digest_sessions",
    sql("SELECT strftime(created_at, '%Y-%m-%d') AS created_at, cwd, file_path, message_count FROM (SELECT *, row_number() OVER (PARTITION BY created_at, cwd ORDER BY message_count DESC, date, file_path) rn FROM sess WHERE message_count > 3) WHERE rn <= 10", "sess"),
)
def _(spark, d):
    return S.digest_sessions(_s(spark, d), highlights=True).select(ymd(F.col("created_at")).alias("created_at"), "cwd", "file_path", "message_count")


_CUT = "CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '…' ELSE text END"


@query(
    "digest_user_messages",
    sql(f"SELECT file_path, msg_index, {_CUT.format(n=500)} AS text FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY msg_index) rn FROM msgs WHERE role = 'user') WHERE rn <= 20", "msgs"),
)
def _(spark, d):
    return S.digest_user_messages(S.digest_sessions(_s(spark, d)), B.message_rows(spark, d))


@query(
    "digest_highlights",
    sql(
        f"""SELECT m.file_path, msg_index, {_CUT.format(n=300)} AS text FROM msgs m JOIN (SELECT file_path, min(msg_index) a, max(msg_index) b FROM msgs WHERE role = 'user' GROUP BY 1) e ON e.file_path = m.file_path AND msg_index IN (a, b)
 WHERE m.file_path IN (SELECT file_path FROM (SELECT *, row_number() OVER (PARTITION BY created_at, cwd ORDER BY message_count DESC, date, file_path) rn FROM sess WHERE message_count > 3) WHERE rn <= 10)""",
        "msgs", "sess",
    ),
)
def _(spark, d):
    return S.digest_user_messages(S.digest_sessions(_s(spark, d), highlights=True), B.message_rows(spark, d), highlights=True)


@query(
    "session_metrics",
    sql(
        """SELECT 'total' AS kind, NULL AS key, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages FROM sess
 UNION ALL SELECT 'tool', tool, count(*), CAST(sum(message_count) AS BIGINT) FROM sess GROUP BY 2 UNION ALL SELECT 'project', cwd, count(*), CAST(sum(message_count) AS BIGINT) FROM sess GROUP BY 2
 UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*), CAST(sum(message_count) AS BIGINT) FROM sess GROUP BY 2
 UNION ALL SELECT 'hour', strftime(started_at - INTERVAL 5 HOUR, '%H'), count(*), CAST(sum(message_count) AS BIGINT) FROM sess GROUP BY 2""",
        "sess",
    ),
)
def _(spark, d):
    return S.session_metrics(_s(spark, d), "America/Bogota")


@query("recent_sessions_by_id", sql("SELECT session_id, tool, strftime(created_at, '%Y-%m-%d') AS created_at, custom_title, (SELECT count(*) FROM sess) AS total FROM sess ORDER BY sess.created_at DESC, date DESC, session_id LIMIT 50", "sess"))
def _(spark, d):
    return S.recent_sessions_by_id(_s(spark, d)).select("session_id", "tool", ymd(F.col("created_at")).alias("created_at"), "custom_title", "total")


ARTIFACT = "regexp_matches(closing_user || ' ' || closing_assistant, '(?i)/(?:pull|merge_requests)/\\d+|`[0-9a-f]{7,40}`|\\([0-9a-f]{7,40}\\)')"
cte(
    "scored",
    f"""SELECT *, message_count <= 2 AND n_touched = 0 AND NOT {ARTIFACT} AS trivia, log2(message_count + 1) + 0.5::DOUBLE * least(n_touched, 10) + CASE WHEN {ARTIFACT} THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS significance FROM sess""",
    "sess",
)
cte("blended", "SELECT *, significance * pow(0.5::DOUBLE, greatest((epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(created_at::TIMESTAMP))::DOUBLE / 86400000.0::DOUBLE, 0.0::DOUBLE) / 7.0::DOUBLE) AS score FROM scored", "scored")


@query("significance", sql("SELECT file_path, trivia, round(significance, 9) AS significance, round(score, 9) AS score FROM blended", "blended"))
def _(spark, d):
    return S.scored_sessions(_s(spark, d), NOW).select("file_path", "trivia", F.round("significance", 9).alias("significance"), F.round("score", 9).alias("score"))


cte(
    "first_tier",
    """SELECT * FROM blended WHERE NOT trivia OR (SELECT bool_and(trivia) FROM blended) ORDER BY score DESC, created_at DESC, date DESC, file_path LIMIT 10""",
    "blended",
)
_TIER = """file_path, coalesce(nullif(branch, ''), regexp_extract(cwd, '([^/]+)$', 1)) AS branch, coalesce(nullif(custom_title, ''), nullif(first_prompt, ''), '') AS intent, n_touched AS file_count"""


@query(
    "context_primer",
    sql(
        f"""SELECT 'recent' AS tier, {_TIER} FROM first_tier UNION ALL SELECT * FROM (SELECT 'headline' AS tier, {_TIER} FROM sess
 WHERE file_path NOT IN (SELECT file_path FROM first_tier) ORDER BY created_at DESC, date DESC, file_path LIMIT 40)""",
        "first_tier", "sess",
    ),
)
def _(spark, d):
    return S.context_primer(_s(spark, d), NOW).select("tier", "file_path", "branch", "intent", "file_count")


@query(
    "format_result",
    sql(
        """SELECT file_path, CAST(len(list_distinct(list_concat(string_split(nullif(files_touched, ''), ','), string_split(nullif(files_read, ''), ',')))) AS BIGINT) AS file_count, n_commands AS command_count,
 'cd "' || cwd || '"' || CASE tool WHEN 'claude' THEN ' && claude --resume ' || session_id WHEN 'opencode' THEN ' && opencode --session ' || session_id ELSE '' END AS resume_command FROM sess""",
        "sess",
    ),
)
def _(spark, d):
    return S.format_result(_s(spark, d)).select("file_path", "file_count", "command_count", "resume_command")


cte(
    "arcs",
    """SELECT file_path, min(msg_index) AS msg_index, arg_min(text, msg_index) AS u, coalesce(arg_max(text, msg_index) FILTER (WHERE role = 'assistant'), '') AS a, turn_no FROM (
 SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY msg_index ROWS UNBOUNDED PRECEDING) AS turn_no FROM msgs WHERE role = 'assistant' OR genuine) WHERE turn_no > 0 GROUP BY file_path, turn_no""",
    "msgs",
)


def _clip(c: str, n: int) -> str:
    flat = f"trim(regexp_replace({c}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
    head = f"substr({flat}, 1, {n - 1})"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE rtrim(CASE WHEN strpos({head}, ' ') > 0 AND {last} > {n} * 0.6 THEN substr({head}, 1, {last}) ELSE {head} END, ' ') || '…' END"


cte("arcs_clipped", f"SELECT file_path, turn_no, msg_index, {_clip('u', 200)} AS user, {_clip('a', 300)} AS assistant FROM arcs", "arcs")


@query("exchanges", sql("SELECT file_path, msg_index, \"user\", assistant FROM arcs_clipped", "arcs_clipped"))
def _(spark, d):
    return S.exchanges(B.message_rows(spark, d)).select("file_path", "msg_index", "user", "assistant")


@query(
    "elide_middle",
    sql(
        """, sized AS (SELECT *, length(to_json({'index': msg_index, 'user': "user", 'assistant': assistant})) + 1 AS sz, row_number() OVER (PARTITION BY file_path ORDER BY turn_no) AS h,
   row_number() OVER (PARTITION BY file_path ORDER BY turn_no DESC) AS t, count(*) OVER (PARTITION BY file_path) AS e FROM arcs_clipped),
 cum AS (SELECT *, sum(sz) OVER (PARTITION BY file_path ORDER BY turn_no) AS hs, sum(sz) OVER (PARTITION BY file_path ORDER BY turn_no DESC) AS ts FROM sized),
 ks AS (SELECT c.file_path, c.e, k, length('{"messageCount":' || n || ',"exchangeCount":' || c.e || ',"exchanges":[],"elided":' || (c.e - k) || '}') + a.hs + coalesce(b.ts, 0) - 1 AS total
   FROM (SELECT DISTINCT file_path, e, unnest(range(1, e + 1)) AS k FROM sized) c JOIN (SELECT file_path, count(*) n FROM msgs GROUP BY 1) m ON m.file_path = c.file_path
   JOIN cum a ON a.file_path = c.file_path AND a.h = (k + 1) // 2 LEFT JOIN cum b ON b.file_path = c.file_path AND b.t = k // 2),
 best AS (SELECT file_path, max(k) AS k FROM ks WHERE total <= 2000 OR k = 1 GROUP BY 1)
 SELECT s.file_path, msg_index, e AS exchange_count, e - k AS elided FROM sized s JOIN best b ON b.file_path = s.file_path WHERE h <= (k + 1) // 2 OR t <= k // 2""".replace(
            ", sized AS", "SELECT * FROM (WITH sized AS", 1
        )
        + ")",
        "arcs_clipped", "msgs",
    ),
)
def _(spark, d):
    m = B.message_rows(spark, d)
    return S.elide_middle(cut(S.exchanges(m)), m, budget=2000).select("file_path", "msg_index", "exchange_count", "elided")


@query("page_messages", sql("SELECT file_path, msg_index, msg_index // 5 AS page FROM msgs", "msgs"))
def _(spark, d):
    return S.page_messages(B.message_rows(spark, d), 5).select("file_path", "msg_index", "page")


@query(
    "page_text",
    sql("SELECT doc_id, CAST(o AS INTEGER) AS \"offset\", substr(text, CAST(o AS INTEGER) + 1, 2000) AS text, CAST(CASE WHEN o + 2000 < length(text) THEN o + 2000 END AS INTEGER) AS next_offset FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 2000)) AS o FROM documents)"),
)
def _(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return S.page_text(docs, 2000, "doc_id").select("doc_id", "offset", "text", "next_offset")


@query("page_events")
def _(spark, d):
    return S.page_events(_lines(spark, d), 20)


@query(
    "page_records",
    sql(
        """WITH RECURSIVE rec AS (
  SELECT file_path, line_no, length(v) AS size, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS k FROM (
   SELECT 'd' || doc_id AS file_path, unnest(lines) AS v, unnest(range(0, len(lines))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE trim(v) <> ''
 ), walk AS (
  SELECT file_path, k, line_no, 0 AS page, 1 AS used, 700 - least(700, size) AS room, 0 AS start, least(700, size) AS take, size FROM rec WHERE k = 1
  UNION ALL
  SELECT file_path, k, line_no, page, used + 1, room - least(room, size - start), start, least(room, size - start), size FROM (
   SELECT r.file_path, r.k, r.line_no, r.size, w.page + full_::INTEGER AS page, CASE WHEN full_ THEN 0 ELSE used END AS used, CASE WHEN full_ THEN 700 ELSE room END AS room, CASE WHEN whole THEN 0 ELSE upto END AS start
   FROM (SELECT *, used >= 8 OR room <= 0 AS full_, start + take AS upto, start + take >= size AS whole FROM walk) w JOIN rec r ON r.file_path = w.file_path AND r.k = w.k + whole::INTEGER)
 )
 SELECT file_path, page::BIGINT AS page, line_no::BIGINT AS line_no, start::BIGINT AS char_offset, take::BIGINT AS size, start + take >= size AS complete FROM walk"""
    ),
)
def _(spark, d):
    """The lines of documents as records, on pages of 8 records and 700 characters."""
    docs = B.table(spark, d, "documents")
    lines = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return S.page_events(lines.withColumn("line_no", F.col("line_no").cast("long")), 8, 700)


@query("content_version")
def _(spark, d):
    return S.content_version(_lines(spark, d))


@query(
    "budgeted_list",
    sql("SELECT file_path, msg_index FROM (SELECT file_path, msg_index, sum(length(to_json({'file_path': file_path, 'msg_index': msg_index, 'text': text}))) OVER (PARTITION BY file_path ORDER BY msg_index) AS upto FROM msgs) WHERE upto <= 3000", "msgs"),
)
def _(spark, d):
    from ..operators.blocks import line_block

    m = B.message_rows(spark, d).select("file_path", "msg_index", "text").withColumn("block", line_block(F.col("msg_index")))
    return S.budgeted(m, ["msg_index"], "file_path", "block", 3000).select("file_path", "msg_index")
