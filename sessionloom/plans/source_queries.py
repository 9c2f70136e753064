"""Sources: every native shape is derived from the driver's tables, read back, and checked against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import bindings as B
from ..context import cut
from ..sources import lines as L
from ..sources import native as N
from ..sources import usage as U
from ..operators.blocks import dealt
from ..operators.usage import normalise_project
from . import archive_queries  # noqa: F401  (shared SQL)
from .registry import cte, query, sql

_K = "coalesce(CAST(props->>'$.k' AS BIGINT), 0)"


def _js(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


# --- files -------------------------------------------------------------------------
def _files(spark, d):
    n = F.col("doc_id").cast("string")
    base = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/h/.claude/projects/p/"), n, F.lit(".jsonl"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("/h/.codex/sessions/2024/"), n, F.lit(".jsonl"))
    ).otherwise(F.concat(F.lit("/h/other/"), n, F.lit(".txt")))
    docs = B.table(spark, d, "documents").select("doc_id", base.alias("path"), (F.col("doc_id") * 86_400_000).alias("mtime_ms"), F.col("n_chars").alias("size"))
    twins = docs.where("doc_id % 6 = 1").withColumn("path", F.concat("path", F.lit(".zst")))
    lone = docs.where("doc_id % 12 <> 1 or doc_id % 3 <> 1")
    return lone.unionByName(twins)


@query(
    "discover_files",
    sql(
        """SELECT CASE WHEN doc_id % 3 = 0 THEN 'claude' ELSE 'codex' END AS tool, CASE WHEN doc_id % 3 = 0 THEN '/h/.claude/projects/p/' || doc_id || '.jsonl' ELSE '/h/.codex/sessions/2024/' || doc_id || '.jsonl' || CASE WHEN doc_id % 12 = 1 THEN '.zst' ELSE '' END END AS path
 FROM documents WHERE doc_id % 3 <> 2"""
    ),
)
def _(spark, d):
    return L.discover_files(_files(spark, d)).select("tool", "path")


@query("prefer_plain_twin", sql("SELECT doc_id, count(*) AS n FROM documents GROUP BY 1"))
def _(spark, d):
    return L.prefer_plain_twin(_files(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("prune_by_mtime", sql("SELECT doc_id FROM documents WHERE doc_id >= 100 - 2 AND doc_id % 6 <> 1 UNION ALL SELECT doc_id FROM documents WHERE doc_id >= 98 AND doc_id % 6 = 1 AND doc_id % 12 <> 1 UNION ALL SELECT doc_id FROM documents WHERE doc_id >= 98 AND doc_id % 6 = 1"))
def _(spark, d):
    return L.prune_by_mtime(_files(spark, d), F.timestamp_millis(F.lit(100 * 86_400_000))).select("doc_id")


# --- relational and tree sessions -------------------------------------------------------
def _tables(spark, d):
    r = B._conversation_rows(spark, d)
    ms = F.unix_millis("at")
    sid, mid = F.format_string("c%d", F.col("conv_id")), F.format_string("c%dm%d", F.col("conv_id"), F.col("turn"))
    sessions = r.groupBy("conv_id", "cwd").agg(F.min(ms).alias("time_created")).select(
        sid.alias("id"), F.col("cwd").alias("directory"), "time_created",
        F.when(F.col("conv_id") % 2 == 0, F.lit("New session - 1")).otherwise(F.format_string("Talk %d", F.col("conv_id"))).alias("title"),
    )
    messages = r.select(mid.alias("id"), sid.alias("session_id"), ms.alias("time_created"), _js(F.col("role").alias("role")).alias("data"))
    said = r.select(F.concat(mid, F.lit("a")).alias("id"), mid.alias("message_id"), ms.alias("time_created"), _js(F.lit("text").alias("type"), F.col("text").alias("text")).alias("data"))
    tool = r.where("role = 'assistant'").select(
        F.concat(mid, F.lit("b")).alias("id"), mid.alias("message_id"), ms.alias("time_created"),
        _js(F.lit("tool").alias("type"), F.lit("bash").alias("tool"), F.struct(F.lit("completed").alias("status")).alias("state")).alias("data"),
    )
    return sessions, messages, said.unionByName(tool)


_TREE_SQL = sql(
    """SELECT 'c' || conv_id AS file_path, count(*) FILTER (WHERE asst OR trim(text, ' ') <> '') + 1 + CAST(any_value(conv_id) % 2 AS BIGINT) AS lines, count(*) FILTER (WHERE asst) AS tools,
 CAST(sum(CASE WHEN trim(text, ' ') <> '' THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM conv GROUP BY 1""",
    "conv",
)


def _tree_stats(lines):
    first = F.coalesce(F.get_json_object("value", "$.message.content[0].text"), F.lit(""))
    tools = F.coalesce(F.get_json_object("value", "$.message.content[1].tool"), F.get_json_object("value", "$.message.content[0].tool")).isNotNull()
    return lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"), F.sum(tools.cast("int")).alias("tools"), F.sum(F.length(first)).alias("chars"))


@query("tables_to_messages", _TREE_SQL)
def _(spark, d):
    return _tree_stats(N.tables_to_messages(*_tables(spark, d)))


@query("json_tree_to_messages", _TREE_SQL)
def _(spark, d):
    sessions, messages, parts = _tables(spark, d)
    timed = F.struct(F.col("time_created").alias("created")).alias("time")
    texts = (
        sessions.select(F.concat(F.lit("/s/session/p/"), "id", F.lit(".json")).alias("path"), _js(F.col("directory"), F.col("title"), timed).alias("value"))
        .unionByName(messages.select(F.concat(F.lit("/s/message/"), "session_id", F.lit("/"), "id", F.lit(".json")).alias("path"), _js(F.get_json_object("data", "$.role").alias("role"), timed).alias("value")))
        .unionByName(parts.select(F.concat(F.lit("/s/part/"), "message_id", F.lit("/"), "id", F.lit(".json")).alias("path"), F.col("data").alias("value")))
    )
    return _tree_stats(N.tables_to_messages(*N.json_tree(texts)))


@query("project_cursor_lines", sql("SELECT conv_id, turn, role, text, contains(text, '[REDACTED]') AS truncated FROM conv", "conv"))
def _(spark, d):
    r = B._conversation_rows(spark, d)
    asked = F.concat(F.lit("ctx <user_query>"), F.col("text"), F.lit("</user_query> tail"))
    user = _js(F.lit("user").alias("role"), F.struct(F.array(F.struct(F.lit("text").alias("type"), asked.alias("text"))).alias("content")).alias("message"))
    other = _js(F.col("role").alias("role"), F.struct(F.col("text").alias("content")).alias("message"))
    lines = r.select(
        F.col("conv_id").cast("string").alias("file_path"), F.lit("cursor").alias("tool"), F.col("turn").alias("line_no"),
        F.when(F.col("role") == "user", user).otherwise(other).alias("value"),
    )
    return N.project_cursor_lines(L.parse_lines(lines)).select(F.col("file_path").cast("long").alias("conv_id"), F.col("line_no").alias("turn"), "role", "text", "truncated")


def _steps(spark, d):
    r = B._conversation_rows(spark, d)
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("CHECKPOINT")
    origin = F.when(F.col("role") == "user", "USER_EXPLICIT").otherwise("MODEL")

    def log(text: Column, cond: str, prio: int, clipped: bool):
        value = _js(
            F.col("turn").alias("step_index"), kind.alias("type"), origin.alias("source"), F.col("iso").alias("created_at"), text.alias("content"),
            F.when(F.lit(clipped), F.array(F.lit("content"))).alias("truncated_fields"),
        )
        out = r.where(cond).select(F.col("conv_id").cast("string").alias("file_path"), F.lit("antigravity").alias("tool"), F.col("turn").alias("line_no"), value.alias("value"))
        return N.project_step_logs(L.parse_lines(out)).withColumn("prio", F.lit(prio))

    return log(F.substring("text", 1, 5), "true", 1, True), log(F.col("text"), "turn % 2 = 0", 2, False)


@query("merge_step_logs", sql("SELECT conv_id, turn AS step, role, CASE WHEN turn % 2 = 0 THEN text ELSE substr(text, 1, 5) END AS text, turn % 2 <> 0 AS truncated, 2 - turn % 2 AS variants FROM conv", "conv"))
def _(spark, d):
    clean, full = _steps(spark, d)
    return N.merge_step_logs(clean.unionByName(full)).select(F.col("file_path").cast("long").alias("conv_id"), "step", "role", "text", "truncated", "variants")


@query(
    "merge_stored_and_companion",
    sql("SELECT conv_id, turn AS step, CASE WHEN turn % 3 = 0 THEN role ELSE 'assistant' END AS role, CASE WHEN turn % 3 = 0 OR (turn % 3 = 1 AND text <> '') THEN text ELSE 'stored' END AS text, CASE WHEN turn % 3 = 1 THEN 2 ELSE 1 END AS calls FROM conv WHERE turn % 3 < 2 OR true", "conv"),
)
def _(spark, d):
    r = B._conversation_rows(spark, d)

    def call(i: Column, name: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit("{}").alias("input"), i.cast("string").alias("id"))

    def events(cond: str, role: Column, text: Column, calls: Column):
        return r.where(cond).select(
            F.col("conv_id").cast("string").alias("file_path"), F.col("turn").cast("string").alias("id"), role.alias("role"), text.alias("text"),
            F.lit(None).cast("string").alias("thinking"), F.col("iso").alias("timestamp"), calls.alias("calls"),
        )

    stored = events("turn % 3 <> 0", F.lit("assistant"), F.lit("stored"), F.array(call(F.col("turn"), "old")))
    companion = events(
        "turn % 3 <> 2", F.when(F.col("turn") % 3 == 1, "unknown").otherwise(F.col("role")), F.col("text"),
        F.when(F.col("turn") % 3 == 1, F.array(call(F.col("turn"), "new"), call(F.col("turn") + 1, "more"))).otherwise(F.array(call(F.col("turn"), "new"))),
    )
    out = N.merge_stored_and_companion(stored, companion)
    return out.select(F.col("file_path").cast("long").alias("conv_id"), F.col("id").cast("long").alias("step"), "role", "text", F.size("calls").alias("calls"))


@query("retain_vanished_steps", sql("SELECT conv_id, turn AS step, turn % 3 = 0 AS retained FROM conv WHERE turn % 3 <> 0 OR turn % 2 = 0", "conv"))
def _(spark, d):
    r = B._conversation_rows(spark, d).select(F.col("conv_id").alias("file_path"), F.col("turn").alias("step"), "text")
    return N.retain_vanished_steps(r.where("step % 3 <> 0"), r.where("step % 2 = 0")).select(F.col("file_path").alias("conv_id"), "step", "retained")


@query("last_workspace", sql(f"SELECT user_id AS conversation_id, '/w/' || arg_max({_K}, event_id) AS cwd FROM events WHERE {_K} % 3 <> 0 GROUP BY 1"))
def _(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    h = B.table(spark, d, "events").select(
        F.col("user_id").alias("conversation_id"), F.when(k % 3 == 0, F.lit("rel")).otherwise(F.concat(F.lit("/w/"), k.cast("string"))).alias("workspace"), F.col("event_id").alias("line_no")
    )
    return N.last_workspace(h)


def _kv(spark, d):
    r = B._conversation_rows(spark, d)
    ref = F.struct(F.format_string("b%d", F.col("turn")).alias("bubbleId"))
    heads = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", ref.alias("h")))).alias("a")).select(
        F.format_string("composerData:%d", F.col("conv_id")).alias("key"), _js(F.col("a.h").alias("fullConversationHeadersOnly")).alias("value")
    )
    bubbles = r.where("(conv_id + turn) % 13 <> 0").select(
        F.format_string("bubbleId:%d:b%d", F.col("conv_id"), F.col("turn")).alias("key"),
        _js(F.when(F.col("role") == "user", 1).otherwise(2).alias("type"), F.col("text").alias("text"), F.unix_millis("at").alias("timestamp"), F.col("cwd").alias("workspaceProjectDir")).alias("value"),
    )
    return heads.unionByName(bubbles)


@query("kv_to_messages", sql("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conv WHERE (conv_id + turn) % 13 <> 0", "conv"))
def _(spark, d):
    events, _ = N.kv_to_messages(_kv(spark, d))
    return events.select(F.col("file_path").cast("long").alias("conv_id"), F.substring("id", 2, 9).cast("long").alias("turn"), "role", "text")


@query("kv_sessions", sql("SELECT conv_id, CASE WHEN count(*) FILTER (WHERE (conv_id + turn) % 13 <> 0) > 0 THEN any_value(cwd) ELSE '' END AS cwd, bool_or((conv_id + turn) % 13 = 0) AS incomplete FROM conv GROUP BY 1", "conv"))
def _(spark, d):
    _, sessions = N.kv_to_messages(_kv(spark, d))
    return sessions.select(F.col("session_id").cast("long").alias("conv_id"), "cwd", "incomplete")


@query(
    "reachable_messages",
    "WITH RECURSIVE ok AS (SELECT doc_id FROM documents WHERE doc_id % 97 <> 5), walk AS (SELECT CAST(0 AS BIGINT) AS id UNION SELECT d.doc_id FROM walk w JOIN documents d ON d.doc_id // 16 = w.id AND d.doc_id > 0 WHERE w.id IN (SELECT doc_id FROM ok)) "
    "SELECT id FROM walk WHERE id IN (SELECT doc_id FROM ok)",
)
def _(spark, d):
    docs = B.table(spark, d, "documents").select(F.lit("s").alias("store"), F.col("doc_id").alias("id"))
    parent = F.floor(F.col("id") / 16)
    edges = docs.where("id > 0").select("store", parent.alias("parent"), F.col("id").alias("child")).where("parent % 97 <> 5")
    reached, _ = N.reachable_messages(edges, docs.where("id % 97 <> 5"), docs.where("id = 0"))
    return reached.select("id")


@query("scan_documents", sql("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'claude' ELSE 'opencode' END AS harness, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 3 <> 2"))
def _(spark, d):
    n = F.col("doc_id")
    path = F.when(n % 3 == 2, F.concat(F.lit("/h/notes/"), n.cast("string"), F.lit(".md"))).when(n % 2 == 0, F.concat(F.lit("/h/.claude/rules/"), n.cast("string"), F.lit(".md"))).otherwise(
        F.concat(F.lit("/h/"), n.cast("string"), F.lit("/.config/opencode/AGENTS.md"))
    )
    raw = F.when(n % 10 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    files = B.table(spark, d, "documents").select("doc_id", path.alias("path"), raw.alias("content"), F.lit(0).alias("modified_ms"))
    out = N.scan_documents(files)
    return out.select(F.regexp_extract("path", r"/(\d+)", 1).cast("long").alias("doc_id"), "harness", "sha256")


@query(
    "parse_commits",
    sql("SELECT 'c' || o_orderkey AS sha, epoch_ms(o_orderdate) AS authored_ms, o_orderpriority AS subject, o_orderkey % 5 = 0 AS merge, 'a.py,b' || (o_orderkey % 9) || '.py' AS files, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS trailers FROM orders"),
)
def _(spark, d):
    o, us = B.table(spark, d, "orders"), "\u001f"
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("c"), key, F.lit(us), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(us), "o_orderpriority", F.lit(us),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("p1 p2")).otherwise(F.lit("p1")), F.lit(us), F.when(F.col("o_orderkey") % 2 == 0, F.lit("Reviewed-by: A")).otherwise(F.lit("")),
        F.lit("\n\na.py\nb"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".py\n"),
    )
    c = N.parse_commits(o.select(text.alias("value")))
    return c.select("sha", F.unix_millis("authored_at").alias("authored_ms"), "subject", "merge", F.array_join("files", ",").alias("files"), F.size("trailers").alias("trailers"))


# --- usage --------------------------------------------------------------------------------
def _claude_lines(spark, d):
    u = B.usage_raw(spark, d).where("tool = 'claude-code'")
    usage = F.struct(
        F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_write").alias("cache_creation_input_tokens"),
        F.struct(F.col("cache_write_1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"), F.col("speed"),
    )
    told = _js(F.lit("user").alias("type"), F.struct(F.col("agent_id").alias("agentId"), F.col("agent_type").alias("agentType")).alias("toolUseResult"))
    said = _js(
        F.lit("assistant").alias("type"), F.col("session_id").alias("sessionId"), F.col("project_path").alias("cwd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("branch").alias("gitBranch"), F.col("agent_id").alias("agentId"), F.struct(F.col("dedup_key").alias("id"), "model", usage.alias("usage")).alias("message"),
    )
    path = F.concat(F.lit("/t/"), F.substring("session_id", 1, 3), F.lit(".jsonl"))
    rows = u.select(path.alias("file_path"), F.lit("claude").alias("tool"), F.col("seq"), F.explode(F.array(F.struct(F.lit(0).alias("o"), said.alias("value")), F.struct(F.lit(1).alias("o"), F.when(F.col("agent_id").isNotNull(), told).alias("value")))).alias("x"))
    return rows.where("x.value is not null").select("file_path", "tool", (F.col("seq") * 2 + F.col("x.o")).alias("line_no"), "x.value")


_UOUT = "model, epoch_ms(ts) AS ts_ms, session_id, project_path, input, output, cache_read, cache_write, cache_write_1h, speed, agent_id, branch"


def _flat(df, *more):
    return df.select(*more, "model", F.unix_millis("ts").alias("ts_ms"), "session_id", "project_path", "input", "output", "cache_read", "cache_write", "cache_write_1h", "speed", "agent_id", "branch")


@query("usage_claude", sql(f"SELECT {_UOUT}, dedup_key || '|' AS dedup_key FROM usage_raw WHERE tool = 'claude-code'", "usage_raw"))
def _(spark, d):
    e = U.usage_claude(L.parse_lines(_claude_lines(spark, d)))
    return _flat(e, "dedup_key")


@query("resolve_agents", sql("SELECT agent_id, agent_type, count(*) AS n FROM usage_raw WHERE tool = 'claude-code' AND agent_id IS NOT NULL GROUP BY 1, 2", "usage_raw"))
def _(spark, d):
    records = L.parse_lines(_claude_lines(spark, d))
    e = U.resolve_agents(U.usage_claude(records), U.agent_names(records))
    return e.where("agent_id is not null").groupBy("agent_id", "agent_type").agg(F.count(F.lit(1)).alias("n"))


def _opencode(spark, d):
    u = B.usage_raw(spark, d).where("tool = 'opencode'")
    data = _js(
        F.lit("assistant").alias("role"), F.col("model").alias("modelID"), F.col("provider").alias("providerID"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost"),
        F.struct(F.unix_millis("ts").alias("created")).alias("time"), F.struct(F.col("project_path").alias("cwd")).alias("path"),
        F.struct("input", (F.col("output") - 1).alias("output"), F.lit(1).alias("reasoning"), F.struct(F.col("cache_read").alias("read"), F.col("cache_write").alias("write")).alias("cache")).alias("tokens"),
    )
    sessions = u.select(F.col("session_id").alias("id")).distinct().withColumn("directory", F.lit("/dir"))
    return u.select(F.col("seq").cast("string").alias("id"), "session_id", data.alias("data")), sessions


@query("usage_opencode", sql("SELECT model, epoch_ms(ts) AS ts_ms, session_id, coalesce(project_path, '/dir') AS project_path, input, output, cache_read, cache_write, CASE WHEN cost_usd > 0 THEN cost_usd END AS cost_usd FROM usage_raw WHERE tool = 'opencode'", "usage_raw"))
def _(spark, d):
    e = U.usage_opencode(*_opencode(spark, d))
    return e.select("model", F.unix_millis("ts").alias("ts_ms"), "session_id", "project_path", "input", "output", "cache_read", "cache_write", "cost_usd")


cte(
    "counts",
    """SELECT *, sum(q) OVER (PARTITION BY l_orderkey, n > 4 ORDER BY n) AS ti, sum(q // 10) OVER (PARTITION BY l_orderkey, n > 4 ORDER BY n) AS tout, sum(q // 4) OVER (PARTITION BY l_orderkey, n > 4 ORDER BY n) AS tc FROM (
 SELECT l_orderkey, CAST(l_quantity AS BIGINT) * 100 AS q, l_returnflag = 'R' AS receipt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem)""",
)
cte(
    "deltas",
    """SELECT *, CASE WHEN pi IS NULL OR ti < pi THEN ti ELSE ti - pi END AS di, CASE WHEN pi IS NULL OR ti < pi THEN tout ELSE greatest(tout - po, 0) END AS dout, CASE WHEN pi IS NULL OR ti < pi THEN tc ELSE greatest(tc - pc, 0) END AS dc FROM (
 SELECT *, lag(ti) OVER w AS pi, lag(tout) OVER w AS po, lag(tc) OVER w AS pc FROM counts WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)) WHERE pi IS NULL OR NOT (ti = pi AND tout = po AND tc = pc)""",
    "counts",
)


def _rollout_counts(spark, d):
    from pyspark.sql import Window

    table = B.table(spark, d, "lineitem")
    li = dealt(table, ["l_orderkey"], table.count()).select("l_orderkey", (F.col("l_quantity").cast("long") * 100).alias("q"), (F.col("l_returnflag") == "R").alias("receipt"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    n = li.withColumn("n", F.row_number().over(w))
    cw = Window.partitionBy("l_orderkey", F.col("n") > 4).orderBy("n")
    return n.select("l_orderkey", "q", "receipt", "n", *[F.sum(x).over(cw).alias(c) for c, x in (("ti", F.col("q")), ("tout", F.expr("q div 10")), ("tc", F.expr("q div 4")))])


def _rollout_lines(spark, d):
    n, stamp = F.col("n"), F.col("stamp").alias("timestamp")
    start = F.lit("2024-01-01T00:00:00.000Z").alias("timestamp")
    order = F.col("l_orderkey").cast("string")

    def tokens(i: Column, o: Column, k: Column) -> Column:
        return F.struct(i.alias("input_tokens"), o.alias("output_tokens"), k.alias("cached_input_tokens"))

    totals = tokens(F.col("ti"), F.col("tout"), F.col("tc"))
    meta = _js(F.lit("session_meta").alias("type"), start, F.struct(F.concat(F.lit("o"), order).alias("id"), F.lit("/srv/r").alias("cwd")).alias("payload"))
    turn = _js(F.lit("turn_context").alias("type"), start, F.struct(F.lit("gpt-5.4").alias("model")).alias("payload"))
    count = _js(F.lit("event_msg").alias("type"), stamp, F.struct(F.lit("token_count").alias("type"), F.struct(totals.alias("total_token_usage")).alias("info")).alias("payload"))
    receipt = _js(
        F.lit("token_usage_record").alias("type"), stamp,
        F.struct(F.concat(F.lit("r"), order, F.lit("-"), n.cast("string")).alias("response_id"), tokens(F.col("q"), F.expr("q div 10"), F.expr("q div 4")).alias("usage"), totals.alias("thread_token_usage")).alias("payload"),
    )
    twice, first, said = n % 3 == 0, n == 1, F.col("said")
    places = (
        (F.lit(0), F.when(first, meta)), (F.lit(1), F.when(first, turn)), (n * 10, said), (n * 10 + 1, F.when(twice, said)), (n * 10 + 1 + twice.cast("int"), F.when(F.col("receipt"), receipt)),
    )
    c = _rollout_counts(spark, d).withColumn("stamp", F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + n * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).withColumn("said", count)
    lines = F.array(*[F.struct(i.cast("long").alias("line_no"), value.alias("value")) for i, value in places])
    return c.select(F.concat(F.lit("/r/"), order, F.lit(".jsonl")).alias("file_path"), F.inline(lines)).where("value is not null").withColumn("tool", F.lit("codex"))


@query(
    "usage_codex",
    sql(
        """SELECT 'o' || l_orderkey AS session_id, epoch_ms(TIMESTAMP '2024-01-01') + n * 60000 AS ts_ms, CAST(di - dc AS BIGINT) AS input, CAST(dout AS BIGINT) AS output, CAST(dc AS BIGINT) AS cache_read FROM deltas d
  WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.receipt AND c.l_orderkey = d.l_orderkey AND c.ti = d.ti AND c.tout = d.tout AND c.tc = d.tc)
    AND NOT EXISTS (SELECT 1 FROM counts c WHERE c.receipt AND c.l_orderkey = d.l_orderkey AND c.n = d.n AND c.q = d.di AND c.q // 10 = d.dout AND c.q // 4 = d.dc)
 UNION ALL SELECT 'o' || l_orderkey, epoch_ms(TIMESTAMP '2024-01-01') + n * 60000, q - q // 4, q // 10, q // 4 FROM counts WHERE receipt""",
        "deltas", "counts",
    ),
)
def _(spark, d):
    e = U.usage_codex(L.parse_lines(_rollout_lines(spark, d)))
    return e.select("session_id", F.unix_millis("ts").alias("ts_ms"), "input", "output", "cache_read")


@query("counter_delta", sql("SELECT l_orderkey, n, CAST(di AS BIGINT) AS delta FROM deltas", "deltas"))
def _(spark, d):
    from ..operators.blocks import line_block

    totals = F.struct(F.col("ti").alias("input_tokens"), F.col("tout").alias("output_tokens"), F.col("tc").alias("cached_input_tokens"))
    c = _rollout_counts(spark, d).select(F.col("l_orderkey").alias("file_path"), F.col("n").cast("long").alias("line_no"), line_block(F.col("n")).alias("block"), totals.alias("totals"))
    return U.counter_deltas(c).select(F.col("file_path").alias("l_orderkey"), F.col("line_no").alias("n"), F.col("delta.input_tokens").alias("delta"))


@query("import_export_array", sql("SELECT model, epoch_ms(ts) AS ts_ms, session_id, input, output, cache_read, cache_write FROM usage_raw WHERE tool = 'cursor'", "usage_raw"))
def _(spark, d):
    u = B.usage_raw(spark, d).where("tool = 'cursor'")
    row = F.struct(
        F.col("session_id").alias("conversationId"), "model", F.unix_millis("ts").cast("string").alias("timestamp"),
        F.struct(F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"), F.col("cache_read").alias("cacheReadTokens"), F.col("cache_write").alias("cacheWriteTokens")).alias("tokenUsage"),
    )
    texts = u.select(F.col("seq").cast("string").alias("file_path"), _js(F.array(row).alias("usageEventsDisplay")).alias("value"))
    e, _ = U.import_export_array(texts)
    return e.select("model", F.unix_millis("ts").alias("ts_ms"), "session_id", "input", "output", "cache_read", "cache_write")


cte(
    "export_lines",
    """SELECT *, last_value(CASE WHEN seq % 10 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY substr(session_id, 1, 3) ORDER BY seq ROWS UNBOUNDED PRECEDING) AS fallback FROM usage_raw WHERE tool = 'antigravity'""",
    "usage_raw",
)


def _export_lines(spark, d):
    u = B.usage_raw(spark, d).where("tool = 'antigravity'")
    meta = _js(F.lit("session_meta").alias("type"), F.col("model").alias("modelId"))
    row = _js(
        F.lit("usage").alias("type"), F.col("session_id").alias("sessionId"), F.unix_millis("ts").alias("timestamp"), F.when(F.col("seq") % 2 == 1, F.col("model")).alias("modelId"),
        "input", (F.col("output") - 2).alias("output"), F.lit(2).alias("reasoning"), F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite"),
    )
    return u.select(F.substring("session_id", 1, 3).alias("file_path"), F.col("seq").alias("line_no"), F.when(F.col("seq") % 10 == 0, meta).otherwise(row).alias("value"))


@query(
    "import_export_lines",
    sql("SELECT CASE WHEN seq % 2 = 1 THEN model ELSE fallback END AS model, session_id, input, output FROM export_lines WHERE seq % 10 <> 0 AND (seq % 2 = 1 OR fallback IS NOT NULL) AND input + output > 0 AND output >= 2", "export_lines"),
)
def _(spark, d):
    e, _ = U.import_export_lines(_export_lines(spark, d))
    return e.where("input + output > 0 and output >= 2").select("model", "session_id", "input", "output")


@query("export_rejects", sql("SELECT count(*) AS n FROM export_lines WHERE seq % 10 <> 0 AND seq % 2 = 0 AND fallback IS NULL", "export_lines"))
def _(spark, d):
    _, bad = U.import_export_lines(_export_lines(spark, d))
    return bad.where("model is null").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gather_usage",
    sql(
        """, live AS (SELECT * FROM usage_raw WHERE tool IN ('claude-code', 'opencode')), old AS (SELECT * FROM usage_raw WHERE tool = 'codex' OR tool = 'opencode'),
 every AS (SELECT * FROM live UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.tool = o.tool AND l.session_id = o.session_id AND l.agent_id IS NOT DISTINCT FROM o.agent_id))
 SELECT tool, count(DISTINCT coalesce(dedup_key, 's' || seq)) AS n FROM every GROUP BY 1""".replace(", live AS", "SELECT tool, CAST(sum(n) AS BIGINT) AS n FROM (WITH live AS", 1).replace(
            "SELECT tool, count(DISTINCT coalesce(dedup_key, 's' || seq)) AS n FROM every GROUP BY 1",
            "SELECT tool, 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(dedup_key, 's' || seq) ORDER BY input + output + cache_read + cache_write DESC, coalesce(cost_usd, 0) DESC, CASE WHEN speed = 'fast' THEN 0 ELSE 1 END, seq) rn FROM every) WHERE rn = 1",
        )
        + ") GROUP BY 1",
        "usage_raw",
    ),
)
def _(spark, d):
    u = B.usage_raw(spark, d)
    out = U.gather_usage([u.where("tool = 'claude-code'"), u.where("tool = 'opencode'")], u.where("tool in ('codex', 'opencode')"))
    return out.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalise_project",
    sql("SELECT coalesce(CASE WHEN project_path LIKE '/Users/%' THEN '/Users/ana/Developer/p2' WHEN project_path = '/srv/work/p5' THEN '/srv/work/p5' ELSE project_path END, 'unknown') AS project, count(*) AS n FROM usage_raw GROUP BY 1", "usage_raw"),
)
def _(spark, d):
    roots = spark.sql("SELECT * FROM VALUES ('/Users/ana/Developer/p2'), ('/Users/ana'), ('/srv/work/p5'), ('/srv/work/p') AS t(root)")
    return normalise_project(B.usage_raw(spark, d), roots).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
