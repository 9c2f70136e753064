
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .context import utc

MODELS = (
    "claude-opus-4-8", "claude-haiku-4-5-20251001", "gpt-5.4", "anthropic/claude-sonnet-4-6",
    "claude-opus-9", "mystery-1", "gpt-5.5", "<synthetic>",
)
TOOL_OF_TYPE = {"click": "claude-code", "view": "codex", "purchase": "opencode", "error": "cursor"}
# A live price row on top of the override list: rates above the tier threshold included.
LIVE_PRICES = (
    {"model": "gpt-5.5", "input": 5e-6, "output": 30e-6, "cache_read": 0.5e-6, "cache_write": 5e-6,
     "input_above": 10e-6, "output_above": 45e-6, "cache_read_above": 1e-6, "cache_write_above": None},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def project_of(number: Column) -> Column:
    """Twelve working directories, among them none, a temporary one and one below a developer root."""
    return (
        F.when(number == 0, F.lit(None).cast("string"))
        .when(number == 1, F.lit("/tmp/scratch"))
        .when(number == 2, F.lit("/Users/ana/Developer/p2/sub"))
        .otherwise(F.concat(F.lit("/srv/work/p"), number.cast("string")))
    )


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage event per row of ``events``; about one in ten repeats the response before it."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    tool = F.create_map(*[F.lit(x) for pair in TOOL_OF_TYPE.items() for x in pair])[F.col("event_type")]
    base = e.select(
        F.col("event_id").alias("seq"),
        F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp")).alias("ts"),
        "user_id",
        "value",
        k.alias("k"),
        F.coalesce(tool, F.lit("antigravity")).alias("tool"),
    )
    counted = F.when(F.col("k") == 13, F.lit(0)).otherwise(F.lit(1)).cast("long")
    v = F.floor(F.col("value") * 100).cast("long")
    return base.select(
        "seq",
        "tool",
        F.when(F.col("tool") == "claude-code", "anthropic").when(F.col("tool") == "codex", "openai").otherwise("openrouter").alias("provider"),
        _pick(F.col("k") % 8, MODELS).alias("model"),
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        project_of(F.col("user_id") % 12).alias("project_path"),
        (v * 100 * counted).alias("input"),
        (v * 10 * counted).alias("output"),
        (F.col("k") * 1000 * counted).alias("cache_read"),
        (F.col("k") * 100 * counted).alias("cache_write"),
        F.when(F.col("k") % 3 == 0, F.col("k") * 50 * counted).otherwise(F.lit(0)).cast("long").alias("cache_write_1h"),
        F.when((F.col("tool") == "opencode") & (F.col("k") % 4 == 1), F.col("value") / F.lit(100.0)).alias("cost_usd"),
        F.when(F.col("k") % 10 == 0, F.lit("fast")).when(F.col("k") % 10 < 5, F.lit("standard")).alias("speed"),
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("a"), F.col("user_id").cast("string"), F.lit("-"), (F.col("k") % 3).cast("string"))).alias("agent_id"),
        F.when(F.col("k") % 7 == 0, _pick(F.col("k") % 3, ("explore", "review", "plan"))).alias("agent_type"),
        F.when(F.col("k") % 6 != 0, F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))).alias("branch"),
        F.when(
            F.col("k") % 5 != 0,
            F.concat(F.lit("r"), F.when(F.col("seq") % 10 == 9, F.col("seq") - 1).otherwise(F.col("seq")).cast("string")),
        ).alias("dedup_key"),
    )


def prices(spark: SparkSession) -> DataFrame:
    from .sources.pricing import merge_prices, override_prices, price_rows

    return merge_prices(live=price_rows(spark, LIVE_PRICES), overrides=override_prices(spark))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human turns: sign-up events, spoken in the session of every tool the user ran that day."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        ms.alias("at_ms"),
        F.concat(F.lit("turn **"), F.col("event_id").cast("string"), F.lit("** go on")).alias("text"),
    )


def loop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage_raw(spark, sf_dir).where(F.col("tool") != "antigravity")
    return u.select(
        "session_id",
        F.unix_millis("ts").alias("at_ms"),
        (F.col("input") + F.col("output") + F.col("cache_write")).alias("tokens"),
        "project_path",
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pull requests; line items give the change size. Dates fall into the usage month."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("additions"), F.count(F.lit(1)).alias("deletions")
    )
    created = F.to_date(F.lit("2023-12-20")) + (F.col("o_orderkey") % 45).cast("int")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        F.concat(F.lit("https://git.example/r/pull/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("r"), (F.col("o_custkey") % 20).cast("string")).alias("repo"),
        F.col("o_orderkey").alias("number"),
        F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        F.coalesce("additions", F.lit(0)).cast("long").alias("additions"),
        F.coalesce("deletions", F.lit(0)).cast("long").alias("deletions"),
        created.alias("created_day"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(created, (F.col("o_orderkey") % 5).cast("int"))).alias("merged_day"),
    )


# --- transcripts derived from conversations ---------------------------------

TRANSCRIPT_TOOLS = ("claude", "codex", "opencode")


def _conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("conv_id") * 7_200_000 + F.col("turn") * 60_000)
    return c.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        at.alias("at"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"),
        _pick(F.col("conv_id") % 3, TRANSCRIPT_TOOLS).alias("tool"),
        F.concat(F.lit("/srv/work/p"), (F.col("conv_id") % 7).cast("string")).alias("cwd"),
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSONL lines (file_path, tool, line_no, value) in the shape each harness writes.

    Assistant turns carry a tool call: an edit, a shell command or a read, by turn number; every fifth
    tool call fails. Line 0 is the session header.
    """
    r = _conversation_rows(spark, sf_dir)
    path = F.format_string("/data/%s/s%d.jsonl", F.col("tool"), F.col("conv_id"))
    sid = F.format_string("s%d", F.col("conv_id"))
    file_name = F.format_string("src/f%d.py", F.col("turn") % 5)
    command = F.element_at(
        F.array(*[F.lit(x) for x in ("git status -sb", "ls -la", "npm test", "make build")]), (F.col("turn") % 4 + 1).cast("int")
    )
    kind = F.col("turn") % 3
    is_user, is_assistant = F.col("role") == "user", F.col("role") == "assistant"

    def obj(*cols: Column) -> Column:
        return F.struct(*cols)

    # --- claude -------------------------------------------------------------
    claude_tool = obj(
        F.lit("tool_use").alias("type"),
        F.when(kind == 0, "Edit").when(kind == 1, "Bash").otherwise("Read").alias("name"),
        obj(F.when(kind != 1, file_name).alias("file_path"), F.when(kind == 1, command).alias("command")).alias("input"),
    )
    text_block = obj(F.lit("text").alias("type"), F.col("text").alias("text"))
    thinking_block = obj(F.lit("thinking").alias("type"), F.concat(F.lit("plan "), F.col("turn").cast("string")).alias("thinking"))
    envelope = [F.col("iso").alias("timestamp"), F.col("cwd").alias("cwd"), sid.alias("sessionId")]
    claude = (
        F.when(
            is_assistant,
            F.to_json(obj(
                F.lit("assistant").alias("type"), *envelope,
                F.when(F.col("turn") % 2 == 0, F.lit("main")).otherwise(F.lit("dev")).alias("gitBranch"),
                obj(
                    F.lit("assistant").alias("role"),
                    F.array(F.to_json(text_block), F.to_json(thinking_block), F.to_json(claude_tool)).alias("content"),
                ).alias("message"),
            )),
        )
        .when(
            is_user,
            F.to_json(obj(
                F.lit("user").alias("type"), *envelope, F.lit("typed").alias("promptSource"),
                obj(F.lit("user").alias("role"), F.concat(F.lit("<system-reminder>x</system-reminder>"), F.col("text")).alias("content")).alias("message"),
            )),
        )
        .otherwise(
            F.to_json(obj(
                F.lit("user").alias("type"), *envelope, F.lit("system").alias("promptSource"),
                obj(
                    F.lit("user").alias("role"),
                    F.array(
                        F.to_json(text_block),
                        F.to_json(obj(F.lit("tool_result").alias("type"), F.lit(True).alias("is_error"), F.lit("boom").alias("content"))),
                    ).alias("content"),
                ).alias("message"),
            ))
        )
    )
    # --- codex --------------------------------------------------------------
    codex_message = F.to_json(obj(
        F.lit("response_item").alias("type"), F.col("iso").alias("timestamp"),
        obj(
            F.lit("message").alias("type"),
            F.when(F.col("role") == "system", F.lit("developer")).otherwise(F.col("role")).alias("role"),
            F.array(obj(F.when(is_assistant, "output_text").otherwise("input_text").alias("type"), F.col("text").alias("text"))).alias("content"),
        ).alias("payload"),
    ))
    codex_tool = F.to_json(obj(
        F.when(kind == 0, "response_item").otherwise("event_msg").alias("type"), F.col("iso").alias("timestamp"),
        obj(
            F.when(kind == 0, "custom_tool_call").otherwise("exec_command_end").alias("type"),
            F.when(kind == 0, F.lit("apply_patch")).alias("name"),
            F.when(kind == 0, F.concat(F.lit("*** Begin Patch\n*** Update File: "), file_name, F.lit("\n*** End Patch"))).alias("input"),
            F.when(kind != 0, F.split(command, " ")).alias("command"),
            F.when(kind != 0, F.when(F.col("turn") % 5 == 0, 1).otherwise(0)).alias("exit_code"),
            F.when(kind != 0, F.lit("bad exit")).alias("stderr"),
        ).alias("payload"),
    ))
    codex_ui = F.to_json(obj(
        F.lit("event_msg").alias("type"), F.col("iso").alias("timestamp"),
        obj(F.lit("user_message").alias("type"), F.col("text").alias("message")).alias("payload"),
    ))
    # --- opencode -----------------------------------------------------------
    open_tool = obj(
        F.lit("tool").alias("type"),
        F.when(kind == 0, "edit").when(kind == 1, "bash").otherwise("read").alias("tool"),
        obj(
            F.when(F.col("turn") % 5 == 0, "error").otherwise("completed").alias("status"),
            obj(F.when(kind != 1, file_name).alias("filePath"), F.when(kind == 1, command).alias("command")).alias("input"),
            F.when(F.col("turn") % 5 == 0, F.lit("denied")).alias("error"),
        ).alias("state"),
    )
    opencode = F.to_json(obj(
        F.lit("message").alias("type"), F.col("iso").alias("timestamp"),
        obj(
            F.col("role").alias("role"),
            F.when(is_assistant, F.array(F.to_json(text_block), F.to_json(open_tool))).otherwise(F.array(F.to_json(text_block))).alias("content"),
        ).alias("message"),
    ))
    # Blocks of different shapes are serialised one by one and unquoted inside the content array.
    raw = r.select(
        "conv_id", "turn", "tool", path.alias("file_path"), "role",
        F.when(F.col("tool") == "claude", claude).when(F.col("tool") == "opencode", opencode).otherwise(codex_message).alias("line"),
        F.when(F.col("tool") == "codex", F.when(is_assistant, codex_tool).when(is_user, codex_ui)).alias("second"),
    )
    headed = raw.withColumn("head", F.when(F.col("tool") != "codex", F.regexp_extract("line", r'(?s)^(.*?"content":)\[', 1)).otherwise(F.lit("")))
    members = headed.withColumn(
        "members",
        F.when(
            F.col("head") != "",
            F.from_json(F.substring("line", F.length("head") + 1, F.length("line") - F.length("head") - 2), "array<string>"),
        ),
    )
    whole = F.concat("head", F.lit("["), F.array_join("members", ","), F.lit("]}}"))
    lines = members.select(
        "conv_id", "turn", "tool", "file_path", "role",
        F.filter(F.array(F.when(F.col("head") != "", whole).otherwise(F.col("line")), F.col("second")), lambda x: x.isNotNull()).alias("out"),
    )
    body = lines.select(
        "conv_id", "file_path", "tool", (F.col("turn") * 2 + 10).alias("base"), F.posexplode("out").alias("i", "value")
    ).select("file_path", "tool", (F.col("base") + F.col("i")).cast("long").alias("line_no"), "value")
    heads = r.groupBy("conv_id", "tool", "cwd").agg(F.min("iso").alias("iso"))
    header = heads.select(
        F.format_string("/data/%s/s%d.jsonl", F.col("tool"), F.col("conv_id")).alias("file_path"),
        "tool",
        F.lit(0).cast("long").alias("line_no"),
        F.when(
            F.col("tool") == "codex",
            F.to_json(F.struct(
                F.lit("session_meta").alias("type"), F.col("iso").alias("timestamp"),
                F.struct(
                    F.format_string("s%d", F.col("conv_id")).alias("id"), F.col("cwd").alias("cwd"),
                    F.struct(F.lit("trunk").alias("branch")).alias("git"),
                ).alias("payload"),
            )),
        )
        .when(
            F.col("tool") == "opencode",
            F.to_json(F.struct(
                F.lit("session").alias("type"), F.format_string("s%d", F.col("conv_id")).alias("sessionId"),
                F.col("cwd").alias("cwd"), F.col("iso").alias("timestamp"),
            )),
        )
        .otherwise(
            F.to_json(F.struct(F.lit("custom-title").alias("type"), F.format_string("Talk %d", F.col("conv_id")).alias("customTitle")))
        ).alias("value"),
    )
    return header.unionByName(body)


def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the transcript pipeline numbers them: file_path, tool, msg_index, role, text, genuine."""
    from .operators.blocks import line_block, running

    r = _conversation_rows(spark, sf_dir).where((F.col("role") != "system") | (F.col("tool") == "claude"))
    r = r.where(F.regexp_replace("text", r"^\s+|\s+$", "") != "").withColumn("block", line_block(F.col("turn")))
    n = running(r, ["conv_id"], "block", ["turn"], sums={"n": F.lit(1)})
    return n.select(
        F.format_string("/data/%s/s%d.jsonl", F.col("tool"), F.col("conv_id")).alias("file_path"), "tool",
        (F.col("n") - 1).cast("long").alias("msg_index"),
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), "text",
        (F.col("role") != "system").alias("genuine"),
    )


def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions table built straight from ``conversations`` (same values as the transcript pipeline)."""
    from .functions import text as T
    from . import constants as K

    r = _conversation_rows(spark, sf_dir)
    turn, role, tool = F.col("turn"), F.col("role"), F.col("tool")
    assistant = role == "assistant"
    kind = F.when(assistant, turn % 3)
    name = F.format_string("src/f%d.py", turn % 5)
    command = F.element_at(F.array(*[F.lit(x) for x in ("git status -sb", "ls -la", "npm test", "make build")]), (turn % 4 + 1).cast("int"))
    seen = F.regexp_replace("text", r"^\s+|\s+$", "") != ""
    failed = (
        F.when(tool == "claude", role == "system")
        .when(tool == "codex", assistant & (kind != 0) & (turn % 5 == 0))
        .otherwise(assistant & (turn % 5 == 0))
    )
    counted = F.when(tool == "claude", F.lit(1)).otherwise((role != "system").cast("int"))

    def first_seen(values: Column) -> Column:
        pairs = F.array_sort(F.collect_set(F.struct(turn.alias("t"), values.alias("v"))))
        return F.array_distinct(F.filter(pairs["v"], lambda x: x.isNotNull()))

    g = r.groupBy("conv_id", "tool", "cwd").agg(
        F.min("at").alias("started_at"), F.max_by("at", "turn").alias("ended_at"),
        F.sum(counted).alias("message_count"),
        F.min_by("text", F.when((role == "user") & seen, turn)).alias("first"),
        F.max_by("text", F.when((role == "user") & seen, turn)).alias("last_user"),
        F.max_by("text", F.when(assistant & seen, turn)).alias("last_assistant"),
        F.max(F.when(assistant, turn)).alias("last_turn"),
        first_seen(F.when(kind == 0, name)).alias("files_touched"),
        first_seen(F.when((tool != "codex") & (kind == 2), name)).alias("files_read"),
        first_seen(F.when((kind == 1) | ((tool == "codex") & (kind != 0)), command)).alias("commands"),
        F.sum(failed.cast("int")).alias("error_count"),
    )

    def finish(c: Column) -> Column:
        return F.coalesce(F.substring(T.trim_space(T.strip_injected(c)), 1, K.CLOSING_CHARS), F.lit(""))

    return g.select(
        F.format_string("/data/%s/s%d.jsonl", tool, F.col("conv_id")).alias("file_path"), "tool", "cwd",
        F.format_string("s%d", F.col("conv_id")).alias("session_id"),
        (F.col("conv_id") * 1000).cast("double").alias("mtime_ms"),
        F.to_date("started_at").alias("created_at"), F.to_date("ended_at").alias("date"), "started_at", "ended_at",
        F.coalesce(T.clean(F.col("first")), F.lit("")).alias("first_prompt"),
        F.when(tool == "claude", F.format_string("Talk %d", F.col("conv_id"))).otherwise(F.lit("")).alias("custom_title"),
        F.col("message_count"), "files_touched", "files_read", "commands",
        F.coalesce("error_count", F.lit(0)).alias("error_count"), (F.coalesce("error_count", F.lit(0)) > 0).alias("errored"),
        finish(F.col("last_user")).alias("closing_user"), finish(T.strip_insight_fences(F.col("last_assistant"))).alias("closing_assistant"),
        F.when(tool == "codex", F.lit("trunk")).when((tool == "claude") & F.col("last_turn").isNotNull(), F.when(F.col("last_turn") % 2 == 0, "main").otherwise("dev")).otherwise(F.lit("")).alias("branch"),
    )


# --- commits, work and accounts derived from events ---------------------------


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as commits, each touching two files; ten users share a repository."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    names = [F.concat(F.lit("f"), (x % 20).cast("string")) for x in (k, k + 7)]
    return e.select(
        F.floor(F.col("user_id") / 10).alias("repo"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("sha"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.array(*names).alias("files"),
    )


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's other events of one half day as a session with the files it touched."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "purchase")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    half = F.floor(ms / 43_200_000)
    return e.groupBy(F.floor(F.col("user_id") / 10).alias("repo"), F.concat_ws("-", F.col("user_id").cast("string"), half.cast("string")).alias("session_key")).agg(
        F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"), F.array_sort(F.collect_set(F.concat(F.lit("f"), (k % 20).cast("string")))).alias("files")
    )


def account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of review metrics per user, counted from the user's events."""
    from . import constants as K

    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long"))
    ts = F.col("ts").cast("timestamp")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    rest = {
        "total_errors": F.col("event_type") == "error", "indexed_sessions": F.col("event_type") == "view", "user_avg": k % 9 == 0,
        "assistant_avg": k % 9 == 1, "nights": F.hour(ts) <= 4, "drive_bys": k % 3 == 0, "abandoned_sessions": k % 40 == 7,
        "activity": F.lit(True), "weekend": F.dayofweek(ts).isin(1, 7), "active_days": k % 6 == 0, "models_tried": k % 12 == 5,
    }
    return e.groupBy(F.col("user_id").alias("account")).agg(
        *[count(k % 20 == i).alias(name) for i, (name, _, _) in enumerate(K.PHRASES)],
        *[count(cond).alias(name) for name, cond in rest.items()],
        (count(k % 4 == 0) * 100).alias("longest_user"),
        F.sum(F.floor(F.col("value")).cast("long")).alias("cost_usd"),
        (count(k % 10 != 3) / F.count(F.lit(1))).alias("cache_hit_rate"),
        F.countDistinct(F.to_date(ts)).alias("distinct_sessions"),
        (count(F.hour(ts) >= 18) / F.count(F.lit(1))).alias("night_share"),
        (count(F.col("event_type") == "click") / F.count(F.lit(1))).alias("focus_share"),
        F.when(F.col("account") % 3 != 0, F.count(F.lit(1)).cast("double")).alias("depth_median"),
        F.lit(20.0).alias("median_replies"),
    )
