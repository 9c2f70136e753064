"""Usage events from transcript records, tables and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..context import cut
from ..functions import variant as V
from ..operators.blocks import dealt, line_block, once, running
from ..operators.usage import dedupe_usage

COLUMNS = (
    "seq", "tool", "provider", "model", "ts", "session_id", "project_path", "input", "output", "cache_read", "cache_write",
    "cache_write_1h", "cost_usd", "speed", "agent_id", "branch", "dedup_key",
)


def position() -> Column:
    """The order of a line: its file, by a hash of the path, then its number. Lines of one file follow each other."""
    return F.xxhash64("file_path").bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.col("line_no").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def usage_claude(records: DataFrame) -> DataFrame:
    """One event per assistant record with usage, model, time and session."""
    v = F.col("v")
    u = V.get(v, "$.message.usage")
    file_agent = F.nullif(F.regexp_extract("file_path", r"/subagents/agent-([^/]+)\.jsonl$", 1), F.lit(""))
    own = F.coalesce(V.text(v, "$.agentId"), V.text(v, "$.data.agentId"))
    mid = F.nullif(V.text(v, "$.message.id"), F.lit(""))
    speed = V.text(v, "$.message.usage.speed")
    tokens = {n: _zero(V.whole(u, f"$.{p}")) for n, p in (
        ("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_input_tokens"),
        ("cache_write", "cache_creation_input_tokens"), ("cache_write_1h", "cache_creation.ephemeral_1h_input_tokens"),
    )}
    return records.where((V.any_text(v, "$.type") == "assistant") & V.is_object(u)).select(
        position().alias("seq"), F.lit("claude-code").alias("tool"), F.lit("anthropic").alias("provider"),
        F.nullif(V.text(v, "$.message.model"), F.lit("")).alias("model"), F.try_to_timestamp(V.text(v, "$.timestamp")).alias("ts"),
        F.nullif(V.text(v, "$.sessionId"), F.lit("")).alias("session_id"), V.text(v, "$.cwd").alias("project_path"),
        *[c.alias(n) for n, c in tokens.items()], _null("double").alias("cost_usd"),
        F.when(speed.isin("standard", "fast"), speed).alias("speed"), F.coalesce(own, file_agent).alias("agent_id"),
        F.nullif(V.text(v, "$.gitBranch"), F.lit("")).alias("branch"),
        F.when(mid.isNotNull(), F.concat(mid, F.lit("|"), F.coalesce(V.text(v, "$.requestId"), F.lit("")))).alias("dedup_key"),
    ).where("model is not null and ts is not null and session_id is not null").select(*COLUMNS)


def agent_names(records: DataFrame, metas: DataFrame | None = None) -> DataFrame:
    """agent_id, type, strong: names told by parent records (weak) and by the dispatch's own metadata (strong)."""
    v = F.col("v")
    weak = records.where(V.any_text(v, "$.type") == "user").select(
        V.text(v, "$.toolUseResult.agentId").alias("agent_id"), V.text(v, "$.toolUseResult.agentType").alias("type"), F.lit(False).alias("strong"), "file_path", "line_no"
    ).where("agent_id is not null and type <> ''")
    if metas is not None:
        m = F.try_parse_json("value")
        weak = weak.unionByName(metas.select(
            F.regexp_extract("file_path", r"/agent-([^/]+)\.meta\.json$", 1).alias("agent_id"), V.text(m, "$.agentType").alias("type"), F.lit(True).alias("strong"),
            "file_path", F.lit(0).cast("long").alias("line_no"),
        ).where("agent_id <> '' and type <> ''"))
    return weak


def resolve_agents(events: DataFrame, names: DataFrame) -> DataFrame:
    """Adds agent_type: a strong name beats a weak one, of equals the first told; compaction runs by prefix."""
    best = names.groupBy("agent_id").agg(F.min_by("type", F.struct(~F.col("strong"), "file_path", "line_no")).alias("named"))
    kind = F.when(F.col("agent_id").startswith(K.AUTOCOMPACT_PREFIX), "auto-compact").otherwise(F.coalesce("named", F.lit("unknown")))
    return events.join(best, "agent_id", "left").withColumn("agent_type", F.when(F.col("agent_id").isNotNull(), kind)).drop("named")


_TOTALS = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens", "total_tokens")
_USE = f"struct<{', '.join(f'{n}: variant' for n in _TOTALS)}>"
#: What is read of a rollout record, in one pass over it. A struct is null where the record has no object.
_RECORD = (
    "struct<type: string, timestamp: variant, payload: struct<type: string, id: variant, cwd: variant, model: variant, response_id: variant, "
    f"usage: {_USE}, thread_token_usage: {_USE}, info: struct<total_token_usage: {_USE}, last_token_usage: {_USE}>>>"
)


def _counters(u: Column) -> Column:
    return F.when(u.isNotNull(), F.struct(*[V.as_whole(u[n]).alias(n) for n in _TOTALS]))


def _counter_key(u: Column) -> Column:
    return F.when(u.isNotNull(), F.struct(*[_zero(u[n]).alias(n) for n in _TOTALS[:4]]))


def _delta(names: list[str]) -> Column:
    """The step from ``prev`` to ``totals``."""
    reset = F.coalesce(_zero(F.col("totals.input_tokens")) < _zero(F.col("prev.input_tokens")), F.lit(False)) & F.col("prev").isNotNull()
    steps = [
        F.when(F.col(f"totals.{n}").isNotNull(), F.greatest(F.col(f"totals.{n}") - F.when(reset, F.lit(0)).otherwise(_zero(F.col(f"prev.{n}"))), F.lit(0))).alias(n) for n in names
    ]
    return F.when(F.col("totals").isNotNull(), F.struct(*steps))


def _fresh() -> Column:
    return F.col("totals").isNull() | F.col("prev").isNull() | ~F.col("totals").eqNullSafe(F.col("prev"))


def counter_deltas(counts: DataFrame) -> DataFrame:
    """Running totals to steps: adds ``prev`` (the totals last seen) and ``delta``; repeated totals drop out.

    ``counts``: file_path, line_no, block, totals (a struct of counters, null where a line names none). A smaller input
    counter is a reset: the step is then the total itself.
    """
    stepped = running(counts, ["file_path"], "block", ["line_no"], befores={"prev": F.col("totals")})
    return stepped.where(_fresh()).withColumn("delta", _delta([f.name for f in counts.schema["totals"].dataType.fields]))


def _rollout_parts(records: DataFrame) -> DataFrame:
    """Counts, receipts and context of rollouts: file_path, line_no, block, stamp, part, meta, model, response_id, use, totals.

    ``use`` and ``totals`` are the counters of one response and those of all so far.
    """
    place = ["file_path", "line_no"]
    read = once(records, place, F.try_variant_get("v", "$", _RECORD).alias("r"))
    p, kind = F.col("r.payload"), F.col("r.type")
    info = F.when((kind == "event_msg") & (p["type"] == "token_count"), p["info"])
    members = once(
        read, place, V.as_text(F.col("r.timestamp")).alias("stamp"), F.when(kind == "token_usage_record", V.as_text(p["response_id"])).alias("response_id"), info.alias("info"),
        F.when(kind == "session_meta", V.as_text(p["id"])).alias("named"), F.when(kind == "session_meta", V.as_text(p["cwd"])).alias("cwd"),
        F.when(kind == "turn_context", V.as_text(p["model"])).alias("model"), p["usage"].alias("usage"), p["thread_token_usage"].alias("thread"),
    )
    is_receipt, own = F.col("response_id").isNotNull(), ["stamp", "model", "response_id", "part", "meta"]
    # One generator for each step: the code of a row in a single one is too long a method to be compiled.
    uses = once(
        members, [*place, "stamp", "model", "response_id"], F.when(is_receipt, "receipt").when(F.col("info").isNotNull(), "count").otherwise("context").alias("part"),
        F.when(F.col("named").isNotNull(), F.struct(F.col("named").alias("id"), "cwd")).alias("meta"),
        F.when(is_receipt, F.col("usage")).otherwise(F.col("info.last_token_usage")).alias("u"), F.when(is_receipt, F.col("thread")).otherwise(F.col("info.total_token_usage")).alias("t"),
    ).where("part = 'count' or part = 'receipt' and u is not null or meta is not null or model is not null")
    used = once(uses, [*place, *own, "t"], _counters(F.col("u")).alias("use"))
    return once(used, [*place, *own, "use"], _counters(F.col("t")).alias("totals"), line_block(F.col("line_no")).alias("block"))


_READY = "part <> 'context' and cur_meta is not null and cur_model is not null and stamp is not null"


def _measured(parts: DataFrame) -> DataFrame:
    """Adds ``usage`` and the keys by which a receipt covers a count; ``delta`` is null in receipts."""
    return parts.withColumn("usage", F.coalesce("use", "delta")).withColumn("total_key", _counter_key(F.col("totals"))).withColumn("use_key", _counter_key(F.col("usage")))


def _events_of_files(parts: DataFrame) -> DataFrame:
    """Receipts and the counts that none covers, in files of one block: a file stays in one task, sorted for each question."""
    walk = Window.partitionBy("file_path").orderBy("line_no")
    upto, before = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow), walk.rowsBetween(Window.unboundedPreceding, -1)
    is_count, is_receipt = F.col("part") == "count", F.col("part") == "receipt"
    filled = dealt(parts, ["file_path"], parts.count()).select(
        "*", F.last("meta", ignorenulls=True).over(upto).alias("cur_meta"), F.last("model", ignorenulls=True).over(upto).alias("cur_model")
    ).where(_READY)
    stepped = filled.withColumn("prev", F.last(F.when(is_count, F.col("totals")), ignorenulls=True).over(before)).where(is_receipt | _fresh())
    measured = _measured(stepped.where("use is not null or totals is not null").withColumn("delta", F.when(is_count, _delta(list(_TOTALS)))))
    by_total = F.max(is_receipt).over(Window.partitionBy("file_path", "total_key")) & F.col("total_key").isNotNull()
    by_time = F.max(is_receipt).over(Window.partitionBy("file_path", "stamp", "use_key"))
    return measured.withColumn("by_total", by_total).where(is_receipt | ~F.col("by_total")).withColumn("by_time", by_time).where(is_receipt | ~F.col("by_time"))


def _events_of_blocks(parts: DataFrame) -> DataFrame:
    """The same for files of any length: no task holds more than a block of a file."""
    filled = running(parts, ["file_path"], "block", ["line_no"], lasts={"cur_meta": F.col("meta"), "cur_model": F.col("model")})
    ready = cut(filled.where(_READY))
    receipts = _measured(ready.where("part = 'receipt'").withColumn("delta", F.lit(None).cast(ready.schema["use"].dataType)))
    counts = _measured(counter_deltas(ready.where("part = 'count'")).where("use is not null or totals is not null"))
    by_total = receipts.where("total_key is not null").select("file_path", "total_key").distinct()
    by_time = receipts.select("file_path", "stamp", "use_key").distinct()
    unique = counts.join(by_total, ["file_path", "total_key"], "left_anti").join(by_time, ["file_path", "stamp", "use_key"], "left_anti")
    return unique.unionByName(receipts, allowMissingColumns=True)


def usage_codex(records: DataFrame) -> DataFrame:
    """Token counts of rollouts to events.

    Session and model are carried forward, repeated totals are skipped, totals become deltas (a shrinking input
    counter is a reset), and counts that a per-response receipt covers drop out.
    """
    parts = cut(_rollout_parts(records))
    long = cut(parts.where("block > 0").select("file_path").distinct())
    if long.isEmpty():
        both = _events_of_files(parts)
    else:
        wanted = ["file_path", "line_no", "stamp", "part", "response_id", "cur_meta", "cur_model", "totals", "usage"]
        both = _events_of_files(parts.join(long, "file_path", "left_anti")).select(*wanted).unionByName(_events_of_blocks(parts.join(long, "file_path", "left_semi")).select(*wanted))
    is_receipt = F.col("part") == "receipt"
    signature = F.coalesce(F.to_json("totals"), F.to_json("usage"))
    key = F.when(is_receipt, F.concat(F.lit("codex:response:"), "response_id")).otherwise(F.concat(F.lit("codex:"), F.col("cur_meta.id"), F.lit(":"), "stamp", F.lit(":"), signature))
    cached = _zero(F.col("usage.cached_input_tokens"))
    return both.select(
        position().alias("seq"), F.lit("codex").alias("tool"), F.lit("openai").alias("provider"), F.col("cur_model").alias("model"),
        F.try_to_timestamp("stamp").alias("ts"), F.col("cur_meta.id").alias("session_id"), F.col("cur_meta.cwd").alias("project_path"),
        F.greatest(_zero(F.col("usage.input_tokens")) - cached, F.lit(0)).alias("input"), _zero(F.col("usage.output_tokens")).alias("output"),
        cached.alias("cache_read"), F.when(is_receipt, _zero(F.col("usage.cache_write_input_tokens"))).otherwise(F.lit(0)).cast("long").alias("cache_write"),
        F.lit(0).cast("long").alias("cache_write_1h"), _null("double").alias("cost_usd"),
        _null("string").alias("speed"), _null("string").alias("agent_id"), _null("string").alias("branch"), key.alias("dedup_key"),
    ).select(*COLUMNS)


def usage_opencode(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant message rows (id, session_id, data) to events; a positive recorded cost is trusted."""
    m = messages.select("id", "session_id", F.try_parse_json("data").alias("v"))
    v = F.col("v")
    joined = m.join(sessions.select(F.col("id").alias("session_id"), "directory"), "session_id", "left")
    at = F.coalesce(V.number(v, "$.time.completed"), V.number(v, "$.time.created"))
    cost = V.number(v, "$.cost")
    n = lambda path: _zero(V.whole(v, path))
    return joined.where((V.any_text(v, "$.role") == "assistant") & V.is_object(V.get(v, "$.tokens"))).select(
        F.xxhash64("id").alias("seq"), F.lit("opencode").alias("tool"), V.text(v, "$.providerID").alias("provider"), V.text(v, "$.modelID").alias("model"),
        F.timestamp_millis(at.cast("long")).alias("ts"), "session_id", F.coalesce(V.text(v, "$.path.cwd"), F.col("directory")).alias("project_path"),
        n("$.tokens.input").alias("input"), (n("$.tokens.output") + n("$.tokens.reasoning")).alias("output"), n("$.tokens.cache.read").alias("cache_read"),
        n("$.tokens.cache.write").alias("cache_write"), F.lit(0).cast("long").alias("cache_write_1h"), F.when(cost > 0, cost).alias("cost_usd"),
        _null("string").alias("speed"), _null("string").alias("agent_id"), _null("string").alias("branch"), _null("string").alias("dedup_key"),
    ).where("provider <> '' and model <> '' and ts is not null").select(*COLUMNS)


def import_export_array(texts: DataFrame, tool: str = "cursor") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of JSON exports with a ``usageEventsDisplay`` list."""
    rows = texts.select("file_path", F.posexplode(V.array(F.try_parse_json("value"), "$.usageEventsDisplay")).alias("line_no", "v"))
    v = F.col("v")
    n = lambda f: _zero(V.whole(v, f"$.tokenUsage.{f}"))
    at = F.coalesce(V.any_text(v, "$.timestamp").try_cast("long"), V.whole(v, "$.timestamp"))
    return _export_events(rows, tool, V.text(v, "$.model"), V.text(v, "$.conversationId"), at, n("inputTokens"), n("outputTokens"), n("cacheReadTokens"), n("cacheWriteTokens"), _null("string"))


def import_export_lines(lines: DataFrame, tool: str = "antigravity") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of JSONL exports; a ``session_meta`` row names the model of later rows without one."""
    v = F.try_parse_json("value")
    kind = V.any_text(v, "$.type")
    rows = lines.where(F.trim("value") != "").select(
        "file_path", "line_no", "value", kind.alias("kind"), F.when(kind == "session_meta", F.struct(V.text(v, "$.modelId").alias("model"))).alias("meta"),
        line_block(F.col("line_no")).alias("block"),
    )
    filled = running(rows, ["file_path"], "block", ["line_no"], lasts={"fallback": F.col("meta")}).where("kind = 'usage'").withColumn("v", F.try_parse_json("value"))
    w = F.col("v")
    n = lambda f: _zero(V.whole(w, f"$.{f}"))
    at = F.coalesce(V.any_text(w, "$.timestamp").try_cast("long"), V.whole(w, "$.timestamp"))
    return _export_events(
        filled, tool, F.coalesce(V.text(w, "$.modelId"), F.col("fallback.model")), V.text(w, "$.sessionId"), at, n("input"), n("output") + n("reasoning"),
        n("cacheRead"), n("cacheWrite"), V.text(w, "$.responseId"),
    )


def _export_events(rows, tool, model, session, at, inp, out, read, write, key) -> tuple[DataFrame, DataFrame]:
    events = rows.select(
        position().alias("seq"), F.lit(tool).alias("tool"), F.lit(tool).alias("provider"), model.alias("model"),
        F.timestamp_millis(at).alias("ts"), F.nullif(session, F.lit("")).alias("session_id"), _null("string").alias("project_path"), inp.alias("input"), out.alias("output"),
        read.alias("cache_read"), write.alias("cache_write"), F.lit(0).cast("long").alias("cache_write_1h"), _null("double").alias("cost_usd"),
        _null("string").alias("speed"), _null("string").alias("agent_id"), _null("string").alias("branch"), key.alias("dedup_key"),
    ).select(*COLUMNS)
    good = F.col("model").isNotNull() & F.col("session_id").isNotNull() & F.col("ts").isNotNull() & (F.least("input", "output", "cache_read", "cache_write") >= 0)
    return events.where(good), events.where(~good)


def archived_minus_live(archived: DataFrame, live: DataFrame) -> DataFrame:
    """Receipts of sessions (by harness, session and agent) that no live source reports."""
    keys = live.select("tool", "session_id", "agent_id").distinct().alias("l")
    a = archived.alias("a")
    same = (F.col("a.tool") == F.col("l.tool")) & (F.col("a.session_id") == F.col("l.session_id")) & F.col("a.agent_id").eqNullSafe(F.col("l.agent_id"))
    return a.join(keys, same, "left_anti")


def gather_usage(sources: list[DataFrame], archived: DataFrame | None = None) -> DataFrame:
    """Union of all sources, archived receipts of vanished sessions, one event per response."""
    live = sources[0]
    for s in sources[1:]:
        live = live.unionByName(s, allowMissingColumns=True)
    if archived is not None:
        live = live.unionByName(archived_minus_live(archived, live), allowMissingColumns=True)
    return dedupe_usage(live)
