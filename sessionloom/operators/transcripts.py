"""Transcript lines to typed sessions, messages, tool calls and facts.

``records`` is the parse_lines output (file_path, tool, line_no, v). ``extract_lines`` turns each record into
plain columns in one pass over the JSON; everything else reads those columns. A line number is unique within
its file, which bounds every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..context import cut
from ..functions import text as T
from ..functions import variant as V
from .blocks import line_block, running, top_n

def v() -> Column:
    return F.col("v")


def stage(records: DataFrame) -> DataFrame:
    """The members that most expressions need, read from the record once."""
    p = F.col("p")
    first = records.select(
        "file_path", "tool", "line_no", "v", V.any_text(v(), "$.type").alias("kind"), V.get(v(), "$.message").alias("m"), V.get(v(), "$.payload").alias("p")
    )
    return first.select(
        "*", V.any_text(F.col("m"), "$.role").alias("m_role"), V.array(F.col("m"), "$.content").alias("blocks"),
        V.text(F.col("m"), "$.content").alias("m_text"),
        V.any_text(p, "$.type").alias("p_kind"), V.any_text(p, "$.role").alias("p_role"), V.array(p, "$.content").alias("p_blocks"),
    )


def _type() -> Column:
    return F.col("kind")


def _blocks(column: str = "blocks") -> Column:
    return F.coalesce(column, F.array().cast("array<variant>"))


def _block_type(b: Column) -> Column:
    return V.any_text(b, "$.type")


def _joined(blocks: Column, *types: str) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: _block_type(b).isin(*types)), lambda b: F.coalesce(V.any_text(b, "$.text"), F.lit("")))
    return F.array_join(texts, " ")


def is_user() -> Column:
    """A user-role line in either envelope."""
    return F.coalesce((_type() == "user") | ((_type() == "message") & (F.col("m_role") == "user")), F.lit(False))


def user_text() -> Column:
    has_array = F.col("blocks").isNotNull()
    raw = F.when(has_array, _joined(_blocks(), "text", "input_text")).otherwise(F.coalesce(F.col("m_text"), F.lit("")))
    return T.strip_injected(raw)


def assistant_text() -> Column:
    has_array = F.col("blocks").isNotNull()
    content = F.when(has_array, _joined(_blocks(), "text")).otherwise(F.coalesce(F.col("m_text"), F.lit("")))
    plain = F.coalesce(V.text(F.col("m"), "$"), content)
    mine = (_type() == "assistant") | ((_type() == "message") & (F.col("m_role") == "assistant"))
    return F.when(_type() == "assistant", plain).when(mine, content).otherwise(F.lit(""))


def is_genuine(stripped: Column) -> Column:
    """A human typed it: no compaction summary, no skill body, and a typed or queued source where one is given."""
    source_given = V.get(v(), "$.promptSource").isNotNull()
    source = F.coalesce(V.text(v(), "$.promptSource").isin("typed", "queued"), F.lit(False))
    return (
        ~V.flag(v(), "$.isCompactSummary")
        & (stripped != "")
        & ~stripped.startswith(K.SKILL_PREAMBLE)
        & F.when(source_given, source).otherwise(F.lit(True))
    )


def summarize_input(o: Column) -> Column:
    """The most telling string of a tool input on one line."""
    preferred = [F.when(T.trim_space(V.text(o, f"$.{k}")) != "", V.text(o, f"$.{k}")) for k in K.TOOL_SUMMARY_KEYS]
    members = F.map_values(F.try_variant_get(o, "$", "map<string,variant>"))
    first = F.try_element_at(
        F.filter(
            F.transform(F.filter(members, lambda m: V.kind(m) == "STRING"), lambda m: F.try_variant_get(m, "$", "string")),
            lambda s: T.trim_space(s) != "",
        ),
        F.lit(1),
    )
    return T.cut_with_mark(T.collapse(F.coalesce(*preferred, first, F.lit(""))), K.TOOL_SUMMARY_CHARS)


def _tool_use_list() -> Column:
    uses = F.filter(_blocks(), lambda b: _block_type(b) == "tool_use")
    return F.transform(
        uses,
        lambda b: F.struct(F.coalesce(V.text(b, "$.name"), F.lit("?")).alias("name"), summarize_input(V.get(b, "$.input")).alias("summary")),
    )


_CALLS = "array<struct<name:string,summary:string>>"


def _rollout_call() -> Column:
    p = F.col("p")
    raw = F.coalesce(V.get(p, "$.arguments"), V.get(p, "$.input"), V.get(p, "$.action"))
    as_text = F.when(V.kind(raw) == "STRING", F.try_variant_get(raw, "$", "string"))
    parsed = F.try_parse_json(as_text)
    plain = T.cut_with_mark(T.collapse(as_text), K.TOOL_SUMMARY_CHARS)
    summary = F.when(V.is_object(parsed), summarize_input(parsed)).when(as_text.isNotNull(), plain).otherwise(summarize_input(raw))
    name = F.coalesce(V.text(p, "$.name"), F.col("p_kind"), F.lit("?"))
    return F.array(F.struct(name.alias("name"), F.coalesce(summary, F.lit("")).alias("summary")))


# --- session metadata ---------------------------------------------------------


def _metadata_columns() -> list[Column]:
    tool, kind = F.col("tool"), _type()
    native = tool.isin("opencode", "cursor", "antigravity")
    role = F.col("p_role")
    session_id = F.when(
        tool == "codex", F.when(kind == "session_meta", V.text(F.col("p"), "$.id"))
    ).otherwise(F.when((tool == "claude") | (kind == "session"), V.text(v(), "$.sessionId")))
    cwd = (
        F.when(tool == "claude", V.text(v(), "$.cwd"))
        .when(native & (kind == "session"), V.text(v(), "$.cwd"))
        .when((tool == "codex") & (kind == "session_meta"), V.text(F.col("p"), "$.cwd"))
    )
    thread_name = V.text(F.col("p"), "$.thread_name")
    title = F.when(kind == "custom-title", F.coalesce(V.text(v(), "$.customTitle"), F.lit(""))).when(
        (kind == "event_msg") & (F.col("p_kind") == "thread_name_updated") & (T.trim_space(thread_name) != ""), thread_name
    )
    stamp = V.text(v(), "$.timestamp")
    counted = (
        is_user()
        | (kind == "assistant")
        | ((kind == "message") & (F.col("m_role") == "assistant"))
        | ((kind == "response_item") & (F.col("p_kind") == "message") & role.isin("user", "assistant"))
    )
    return [
        F.when(T.trim_space(session_id) != "", session_id).alias("sid"),
        F.nullif(cwd, F.lit("")).alias("cwd"),
        title.alias("title"),
        F.when(stamp.startswith("2"), stamp).alias("stamp"),
        F.coalesce(counted, F.lit(False)).cast("int").alias("counted"),
        F.when(tool == "claude", F.nullif(V.text(v(), "$.gitBranch"), F.lit(""))).alias("last_branch"),
        F.when((tool == "codex") & (kind == "session_meta"), F.nullif(V.text(F.col("p"), "$.git.branch"), F.lit(""))).alias("first_branch"),
    ]


def session_metadata(lines: DataFrame) -> DataFrame:
    """One row per file: id, cwd, title, first and last instants in file order, message count, branch."""

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))

    grouped = lines.groupBy("file_path", "tool").agg(
        first("sid").alias("session_id"), F.coalesce(first("cwd"), F.lit("")).alias("cwd"),
        F.coalesce(last("title"), F.lit("")).alias("custom_title"),
        first("stamp").alias("started_text"), last("stamp").alias("ended_text"),
        F.sum("counted").alias("message_count"),
        F.coalesce(last("last_branch"), first("first_branch"), F.lit("")).alias("branch"),
    )

    def day(c: str) -> Column:
        return F.try_to_date(F.substring(c, 1, 10))

    return grouped.select(
        "file_path", "tool", "session_id", "cwd", "custom_title",
        day("started_text").alias("created_at"), day("ended_text").alias("date"),
        F.try_to_timestamp("started_text").alias("started_at"), F.try_to_timestamp("ended_text").alias("ended_at"),
        "message_count", "branch",
    )


def metadata_fields(records: DataFrame) -> DataFrame:
    """The metadata fields as separate aggregations: a cross-check of ``session_metadata``."""
    records = stage(records)
    stamps = records.select("file_path", "line_no", V.text(v(), "$.timestamp").alias("s")).where(F.col("s").startswith("2"))
    firsts = top_n(stamps, ["file_path"], [F.col("line_no")], 1).select("file_path", F.substring("s", 1, 10).alias("first_day"))
    lasts = top_n(stamps, ["file_path"], [F.desc("line_no")], 1).select("file_path", F.substring("s", 1, 10).alias("last_day"))
    titles = top_n(
        records.where(_type() == "custom-title").select("file_path", "line_no", V.text(v(), "$.customTitle").alias("title")),
        ["file_path"], [F.desc("line_no")], 1,
    ).select("file_path", "title")
    return firsts.join(lasts, "file_path", "full_outer").join(titles, "file_path", "left")


def child_session_id(file_path: Column, session_id: Column) -> Column:
    """Sub-agent transcripts keep the parent's id in front of their own name."""
    stem = F.regexp_extract(file_path, r"/subagents/([^/]+)\.jsonl$", 1)
    return F.when(stem != "", F.concat(session_id, F.lit("/subagents/"), stem)).otherwise(session_id)


# --- messages -------------------------------------------------------------------


def _rollout_columns() -> dict[str, Column]:
    """Responses, tool calls and UI events of a rollout line."""
    p = F.col("p")
    kind, role = F.col("p_kind"), F.col("p_role")
    response, event = _type() == "response_item", _type() == "event_msg"
    is_msg = response & (kind == "message") & role.isin("user", "assistant")
    is_call = response & kind.isin(*K.ROLLOUT_TOOL_CALLS)
    item = F.when(kind == "item_completed", V.get(p, "$.item"))
    item_type = V.any_text(item, "$.type")
    ui_role = F.when((kind == "user_message") | (item_type == "UserMessage"), "user").when(
        (kind == "agent_message") | (item_type == "AgentMessage"), "assistant"
    )
    item_text = F.array_join(
        F.transform(F.coalesce(V.array(item, "$.content"), F.array().cast("array<variant>")), lambda b: F.coalesce(V.text(b, "$.text"), F.lit(""))), ""
    )
    ui_text = F.when(item.isNotNull() & V.is_object(item), item_text).otherwise(F.coalesce(V.text(p, "$.message"), F.lit("")))
    spoken = F.when(role == "user", _joined(_blocks("p_blocks"), "input_text")).otherwise(
        _joined(_blocks("p_blocks"), "output_text")
    )
    is_event = event & ui_role.isNotNull() & (T.trim_space(ui_text) != "")
    return {
        "part": F.when(is_msg, "response").when(is_call, "call").when(is_event, "event"),
        "role": F.when(is_msg, role).when(is_event, ui_role),
        "text": F.when(is_msg, spoken).when(is_event, ui_text).otherwise(F.lit("")),
        "calls": F.when(is_call, _rollout_call()).otherwise(F.array().cast(_CALLS)),
        "turn": V.text(p, "$.turn_id"),
        "native_id": V.text(item, "$.id"),
        "typed_event": F.coalesce(event & (kind == "user_message"), F.lit(False)),
    }


def extract_lines(records: DataFrame, written: bool = True) -> DataFrame:
    """Plain columns of every record: metadata fields, message parts, facts. One pass over the JSON.

    The extract is written once because messages and sessions read it several times; ``written=False`` suits a
    single reader.
    """
    rollout = F.col("tool") == "codex"
    r = _rollout_columns()
    talk = F.coalesce((T.trim_space(F.col("text")) != "") | (F.size("calls") > 0), F.lit(False))
    none = F.array().cast(_CALLS)
    keep = ["file_path", "tool", "line_no", "sid", "cwd", "title", "stamp", "counted", "last_branch", "first_branch", "turn", "native_id", "typed_event", "found"]
    first = stage(records).withColumn("from_user", is_user())
    wide = first.select(
        "file_path", "tool", "line_no", "v", "from_user", *_metadata_columns(),
        F.when(rollout, r["part"]).alias("part"),
        F.when(rollout, r["role"]).when(F.col("from_user"), "user").otherwise("assistant").alias("role"),
        F.when(rollout, r["text"]).when(F.col("from_user"), user_text()).otherwise(assistant_text()).alias("text"),
        F.when(rollout, r["calls"]).when(F.col("from_user"), none).otherwise(_tool_use_list()).alias("calls"),
        F.when(rollout, r["turn"]).alias("turn"),
        F.when(rollout, r["native_id"]).alias("native_id"),
        (rollout & r["typed_event"]).alias("typed_event"),
        _fact_list().alias("found"),
    )
    extract = wide.select(
        *keep, F.when(rollout, F.col("part")).when(talk, F.lit("message")).alias("part"), "role", "text", "calls",
        F.when(~rollout & F.col("from_user"), is_genuine(T.trim_space(F.col("text")))).otherwise(F.lit(True)).alias("genuine"),
    )
    return cut(extract) if written else extract


def match_rollout_events(lines: DataFrame) -> DataFrame:
    """UI events of rollouts with ``matched``: each response occurrence absorbs one event of equal role and text.

    Events with a turn id prefer responses of that turn, then responses without one; events without a turn
    take any. Where turns cannot matter, the n-th event meets the n-th response by counting. The remaining
    groups depend on the order of events and are walked as a sorted stream with one counter per turn.
    """
    key = F.sha2(F.concat_ws("\u0000", "role", T.trim_space(F.col("text"))), 256)
    occurrences = lines.where(F.col("part").isin("response", "event")).select(
        "file_path", "line_no", "part", key.alias("key"), F.sha2("text", 256).alias("exact"), "turn", "native_id", "typed_event"
    )
    group = ["file_path", "key"]
    responses = occurrences.where("part = 'response'").select("file_path", "key", "turn", "line_no")
    heard = occurrences.where("part = 'event'")
    # A completed item that is reported again counts once.
    named = heard.where("native_id is not null").groupBy("file_path", "key", "exact", "turn", "native_id").agg(
        F.min("line_no").alias("line_no"), F.max("typed_event").alias("typed_event")
    )
    columns = ["file_path", "key", "turn", "line_no", "typed_event"]
    events = heard.where("native_id is null").select(*columns).unionByName(named.select(*columns))
    is_response = F.col("part") == "response"
    shape = occurrences.groupBy(*group).agg(
        F.sum(is_response.cast("int")).alias("n_all"),
        F.max(F.coalesce(~is_response & F.col("turn").isNotNull(), F.lit(False))).alias("turned_events"),
        F.max(F.coalesce(is_response & F.col("turn").isNotNull(), F.lit(False))).alias("turned_responses"),
    ).select(*group, "n_all", (F.col("turned_events") & F.col("turned_responses")).alias("ordered"))
    shaped = events.join(shape, group).withColumn("block", line_block(F.col("line_no")))
    counted = running(shaped.where("not ordered"), group, "block", ["line_no"], sums={"nth": F.lit(1)}).select(
        "file_path", "line_no", "typed_event", (F.col("nth") <= F.col("n_all")).alias("matched")
    )
    walked = _walk_ordered(
        shaped.where("ordered").select(*columns), responses.join(shape.where("ordered").select(*group), group, "left_semi")
    )
    return counted.unionByName(walked)


def _walk_ordered(events: DataFrame, responses: DataFrame) -> DataFrame:
    rows = events.withColumn("k", F.lit(1)).unionByName(
        responses.select("file_path", "key", "turn", "line_no", F.lit(False).alias("typed_event"), F.lit(0).alias("k"))
    )

    def walk(batches):
        current, stock = None, {}
        for pdf in batches:
            matched = []
            for file, key, turn, k in zip(pdf["file_path"], pdf["key"], pdf["turn"], pdf["k"]):
                if (file, key) != current:
                    current, stock = (file, key), {}
                turn = turn if isinstance(turn, str) else None
                if k == 0:
                    stock[turn] = stock.get(turn, 0) + 1
                    matched.append(False)
                    continue
                wanted = list(stock) if turn is None else [turn, None]
                take = next((t for t in wanted if stock.get(t, 0) > 0), "\u0000")
                if take != "\u0000":
                    stock[take] -= 1
                matched.append(take != "\u0000")
            pdf["matched"] = matched
            yield pdf[pdf["k"] == 1][["file_path", "line_no", "typed_event", "matched"]]

    return rows.repartition("file_path", "key").sortWithinPartitions("file_path", "key", "k", "line_no").mapInPandas(
        walk, "file_path string, line_no long, typed_event boolean, matched boolean"
    )


def _rollout_rows(lines: DataFrame) -> DataFrame:
    events = cut(match_rollout_events(lines))
    base = lines.where("tool = 'codex' and part is not null").select("file_path", "tool", "line_no", "part", "role", "text", "calls")
    seen = events.select("file_path", "line_no", "matched")
    joined = base.join(seen, ["file_path", "line_no"], "left")
    # Responses, calls, and the events no response stands for; events dropped as repeats have no match row.
    rows = joined.where((F.col("part") != "event") | (F.col("matched") == False)).withColumn(  # noqa: E712
        "text", F.when(F.col("role") == "user", T.strip_injected(F.col("text"))).otherwise(F.col("text"))
    ).withColumn("stripped", T.trim_space(F.col("text")))
    typed_at = events.where("matched and typed_event").select("file_path", "line_no")
    typed = base.where("part = 'event'").join(typed_at, ["file_path", "line_no"], "left_semi").select(
        "file_path", F.sha2(T.trim_space(F.col("text")), 256).alias("typed_hash"), F.lit(True).alias("typed")
    ).distinct()
    flagged = cut(
        rows.withColumn("typed_hash", F.when(F.col("role") == "user", F.sha2("stripped", 256)))
        .join(typed, ["file_path", "typed_hash"], "left")
        .drop("typed_hash", "matched", "part")
    )
    meets = flagged.groupBy("file_path").agg(F.max(F.coalesce("typed", F.lit(False))).alias("streams_meet"))
    genuine = ~F.col("stripped").rlike(K.ROLLOUT_INJECTED) & (~F.col("streams_meet") | F.coalesce("typed", F.lit(False)))
    return flagged.join(meets, "file_path").select(
        "file_path", "tool", "line_no", "role", "text",
        F.when(F.col("role") == "user", genuine).otherwise(F.lit(True)).alias("genuine"),
        "calls", ((F.col("stripped") != "") & F.col("role").isNotNull()).alias("is_message"),
    ).where(F.col("is_message") | (F.size("calls") > 0))


def numbered_rows(lines: DataFrame) -> DataFrame:
    """Message and call-only rows with the dense index of the message each belongs to.

    ``lines`` is read several times: pass the written extract.
    """
    conversational = lines.where("tool <> 'codex' and part = 'message'").select(
        "file_path", "tool", "line_no", "role", "text", "genuine", "calls", (T.trim_space(F.col("text")) != "").alias("is_message")
    )
    rows = conversational.unionByName(_rollout_rows(lines)).withColumn("block", line_block(F.col("line_no")))
    counted = running(rows, ["file_path"], "block", ["line_no"], sums={"upto": F.col("is_message").cast("int")})
    return counted.withColumn("msg_index", F.greatest(F.col("upto") - 1, F.lit(0)).cast("long")).drop("upto", "block")


def messages_of(numbered: DataFrame) -> DataFrame:
    return numbered.where("is_message").select("file_path", "tool", "msg_index", "line_no", "role", "text", "genuine")


def extract_messages(lines: DataFrame) -> DataFrame:
    """Every non-empty message: file_path, tool, msg_index, line_no, role, text, genuine."""
    return messages_of(numbered_rows(lines))


def fold_tool_calls(numbered: DataFrame) -> DataFrame:
    """Tool calls with the message they belong to; calls before any message go to the first."""
    return numbered.select("file_path", "msg_index", "line_no", F.posexplode("calls").alias("pos", "call")).select(
        "file_path", "msg_index", "line_no", "pos", "call.name", "call.summary"
    )


def summarize_messages(messages: DataFrame) -> DataFrame:
    """Opening prompt and closing texts per file."""
    human = (F.col("role") == "user") & F.col("genuine")
    idx = F.col("msg_index")
    grouped = messages.groupBy("file_path").agg(
        F.min_by("text", F.when(human, idx)).alias("first"),
        F.max_by("text", F.when(human, idx)).alias("last_user"),
        F.max_by("text", F.when(F.col("role") == "assistant", idx)).alias("last_assistant"),
    )

    def finish(c: Column) -> Column:
        return F.coalesce(F.substring(T.trim_space(T.strip_injected(c)), 1, K.CLOSING_CHARS), F.lit(""))

    return grouped.select(
        "file_path",
        F.coalesce(T.clean(F.col("first")), F.lit("")).alias("first_prompt"),
        finish(F.col("last_user")).alias("closing_user"),
        finish(T.strip_insight_fences(F.col("last_assistant"))).alias("closing_assistant"),
    )


def user_turns(records: DataFrame) -> DataFrame:
    """Human turns per session and instant, bounded text; side chains do not count."""
    records = stage(records)
    text = T.trim_space(user_text())
    turns = records.where(is_user() & ~V.flag(v(), "$.isSidechain")).select(
        V.text(v(), "$.sessionId").alias("session_id"), F.try_to_timestamp(V.text(v(), "$.timestamp")).alias("at"),
        text.alias("text"), is_genuine(text).alias("genuine"), "file_path", "line_no",
    ).where(F.col("genuine") & F.col("session_id").isNotNull() & F.col("at").isNotNull())
    return turns.groupBy("session_id", "at").agg(
        F.substring(F.min_by("text", F.struct("file_path", "line_no")), 1, K.TURN_CHARS).alias("text")
    )


# --- files, commands, errors, thinking ------------------------------------------


def _fact_list() -> Column:
    """Everything a record did: kind in edit/read/command/error/thinking and text, in order."""
    tool, kind = F.col("tool"), _type()
    empty = F.array().cast("array<struct<kind:string,text:string>>")

    def fact(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), text.alias("text"))

    def facts_of(name: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: fact(name, t))

    blocks = _blocks()
    # claude: tool_use blocks of assistant turns, tool results of user turns
    uses = F.filter(blocks, lambda b: _block_type(b) == "tool_use")

    def claude_use(b: Column) -> Column:
        name, i = V.text(b, "$.name"), V.get(b, "$.input")
        edit_path = F.when(name == "NotebookEdit", V.text(i, "$.notebook_path")).otherwise(V.text(i, "$.file_path"))
        read_value = F.coalesce(V.get(i, "$.file_path"), V.get(i, "$.path"), V.get(i, "$.pattern"))
        return (
            F.when(name.isin(*K.EDIT_TOOLS), fact("edit", edit_path))
            .when(name.isin(*K.READ_TOOLS), fact("read", V.text(read_value, "$")))
            .when(name == "Bash", fact("command", T.trim_space(V.text(i, "$.command"))))
        )

    def text_of(value: Column) -> Column:
        parts = F.transform(F.coalesce(V.array(value, "$"), F.array().cast("array<variant>")), lambda c: F.coalesce(V.text(c, "$.text"), F.lit("")))
        return F.coalesce(V.text(value, "$"), F.trim(F.array_join(parts, " ")))

    failed = F.filter(blocks, lambda b: (_block_type(b) == "tool_result") & V.flag(b, "$.is_error"))
    claude_errors = F.transform(failed, lambda b: fact("error", F.coalesce(F.nullif(text_of(V.get(b, "$.content")), F.lit("")), F.lit("tool error"))))
    api_error = F.array(fact("error", F.coalesce(F.nullif(text_of(V.get(F.col("m"), "$.content")), F.lit("")), F.lit("api error"))))
    claude = F.concat(
        F.when(kind == "assistant", F.transform(uses, claude_use)).otherwise(empty),
        F.when(V.flag(v(), "$.isApiErrorMessage"), api_error).when(kind == "user", claude_errors).otherwise(empty),
    )
    # codex: patch headers, finished commands, error records
    p = F.col("p")
    ptype = F.col("p_kind")
    patch = F.when((ptype == "custom_tool_call") & (V.any_text(p, "$.name") == "apply_patch"), V.text(p, "$.input"))
    paths = F.coalesce(F.regexp_extract_all(patch, F.lit(K.PATCH_HEADER), 1), F.array().cast("array<string>"))
    command = F.coalesce(V.text(p, "$.command"), F.array_join(V.strings(p, "$.command"), " "))
    exit_code = V.whole(p, "$.exit_code")
    exec_end = ptype == "exec_command_end"
    exec_error = F.coalesce(
        F.nullif(text_of(V.get(p, "$.stderr")), F.lit("")), F.nullif(text_of(V.get(p, "$.formatted_output")), F.lit("")),
        F.concat(F.lit("exit "), exit_code.cast("string")),
    )
    codex = F.concat(
        facts_of("edit", paths),
        F.when(exec_end, F.array(fact("command", T.trim_space(command)))).otherwise(empty),
        F.when(exec_end & (exit_code != 0), F.array(fact("error", exec_error)))
        .when(ptype == "error", F.array(fact("error", F.coalesce(F.nullif(text_of(V.get(p, "$.message")), F.lit("")), F.lit("error")))))
        .otherwise(empty),
    )
    # opencode: tool and patch blocks of assistant messages
    def open_block(b: Column) -> Column:
        name, i = V.any_text(b, "$.tool"), V.get(b, "$.state.input")
        patch_paths = F.coalesce(F.regexp_extract_all(V.text(i, "$.patchText"), F.lit(K.PATCH_HEADER), 1), F.array().cast("array<string>"))
        status = V.any_text(b, "$.state.status")
        message = F.coalesce(F.nullif(V.text(b, "$.state.error"), F.lit("")), F.concat(F.coalesce(name, F.lit("tool")), F.lit(" error")))
        is_tool = _block_type(b) == "tool"
        return F.concat(
            F.when(_block_type(b) == "patch", facts_of("edit", V.strings(b, "$.files"))).otherwise(empty),
            F.when(is_tool & name.isin("edit", "write"), F.array(fact("edit", V.text(i, "$.filePath")))).otherwise(empty),
            F.when(is_tool & (name == "apply_patch"), facts_of("edit", patch_paths)).otherwise(empty),
            F.when(is_tool & (name == "read"), F.array(fact("read", V.text(i, "$.filePath"))))
            .when(is_tool & name.isin("grep", "glob", "list"), F.array(fact("read", F.coalesce(V.text(i, "$.path"), V.text(i, "$.pattern")))))
            .otherwise(empty),
            F.when(is_tool & (name == "bash"), F.array(fact("command", T.trim_space(V.text(i, "$.command"))))).otherwise(empty),
            F.when(is_tool & (status == "error"), F.array(fact("error", message))).otherwise(empty),
        )

    opencode = F.when(
        (kind == "message") & (F.col("m_role") == "assistant"), F.flatten(F.transform(blocks, open_block))
    ).otherwise(empty)
    thoughts = F.filter(blocks, lambda b: (_block_type(b) == "thinking") & V.text(b, "$.thinking").isNotNull())
    thinking = F.when(
        (tool != "codex") & kind.isin("assistant", "message"), F.transform(thoughts, lambda b: fact("thinking", V.text(b, "$.thinking")))
    ).otherwise(empty)
    return F.concat(
        F.when(tool == "claude", claude).when(tool == "codex", codex).when(tool == "opencode", opencode).otherwise(empty), thinking
    )


def facts(lines: DataFrame) -> DataFrame:
    """One row per fact: file_path, line_no, pos, kind, text."""
    rows = lines.where(F.size("found") > 0).select("file_path", "line_no", F.posexplode("found").alias("pos", "f"))
    return rows.select("file_path", "line_no", "pos", "f.kind", "f.text").where(
        F.col("text").isNotNull() & ((F.col("text") != "") | (F.col("kind") == "thinking"))
    )


def distinct_in_order(found: DataFrame, kind: str, limit: int, out: str) -> DataFrame:
    """First occurrence of each text in file order, at most ``limit`` per file: file_path, array."""
    first = found.where(F.col("kind") == kind).groupBy("file_path", "text").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    kept = top_n(first, ["file_path"], [F.col("at")], limit)
    return kept.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("a")).select(
        "file_path", F.col("a.text").alias(out)
    )


def files_touched(found: DataFrame) -> DataFrame:
    return distinct_in_order(found, "edit", K.MAX_FILES, "files_touched")


def files_read(found: DataFrame) -> DataFrame:
    return distinct_in_order(found, "read", K.MAX_FILES, "files_read")


def commands(found: DataFrame) -> DataFrame:
    return distinct_in_order(found, "command", K.MAX_COMMANDS, "commands")


def errors(found: DataFrame) -> DataFrame:
    """Total number of errors and the first messages, each cut."""
    failed = found.where("kind = 'error'")
    totals = failed.groupBy("file_path").agg(F.count(F.lit(1)).alias("error_count"))
    first = top_n(failed, ["file_path"], [F.col("line_no"), F.col("pos")], K.MAX_ERRORS).groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "pos", F.substring("text", 1, K.MAX_ERROR_CHARS).alias("text")))).alias("a")
    )
    return totals.join(first, "file_path").select("file_path", "error_count", F.col("a.text").alias("error_messages"))


def thinking_text(found: DataFrame) -> DataFrame:
    """Thinking joined in order and cut; only the pieces that can fit are gathered."""
    parts = found.where("kind = 'thinking'").withColumn("block", line_block(F.col("line_no")))
    sized = running(parts, ["file_path"], "block", ["line_no", "pos"], sums={"upto": F.length("text") + 1})
    fitting = sized.where(F.col("upto") - F.length("text") - 1 <= K.MAX_THINKING_CHARS)
    return fitting.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line_no", "pos", "text"))).alias("a")).select(
        "file_path", F.substring(F.array_join(F.col("a.text"), "\n"), 1, K.MAX_THINKING_CHARS).alias("thinking")
    )


def fold_subagent_text(messages: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One sentinel row (index -1) per session with the user texts of its sub-agents: file_path, msg_index, role, text.

    The parent is found from the child's path alone; texts follow each other by child path and message. ``records``
    (file_path, v: parsed lines) adds the text that a table-backed session stores of its children. Texts of one
    session form one searchable row, as those of its messages do.
    """
    parent = F.concat(F.regexp_extract("file_path", r"^(.*)/subagents/[^/]+\.jsonl$", 1), F.lit(".jsonl"))
    children = messages.where(F.col("file_path").rlike(r"/subagents/[^/]+\.jsonl$") & (F.col("role") == "user"))
    parts = children.select(parent.alias("parent"), F.col("file_path").alias("child"), "msg_index", "text")
    if records is not None:
        stored = V.text(F.col("v"), "$.subagentText")
        kept = records.where((V.any_text(F.col("v"), "$.type") == "session") & stored.isNotNull())
        first = kept.groupBy("file_path").agg(F.min_by(stored, "line_no").alias("text")).where("text <> ''")
        parts = parts.unionByName(first.select(F.col("file_path").alias("parent"), F.lit("").alias("child"), F.lit(0).cast("long").alias("msg_index"), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("child", "msg_index", "text")))
    return parts.groupBy(F.col("parent").alias("file_path")).agg(F.array_join(ordered["text"], "\n").alias("text")).select(
        "file_path", F.lit(-1).cast("long").alias("msg_index"), F.lit("user").alias("role"), "text"
    )


def session_rows(lines: DataFrame, messages: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """The sessions table: metadata, summaries and capped lists. Files without a usable cwd drop out.

    ``lines`` is the written extract; ``messages`` may be passed when they are already numbered.
    """
    meta = session_metadata(lines)
    found = cut(facts(lines))
    messages = extract_messages(lines) if messages is None else messages
    empty = F.array().cast("array<string>")
    stem = F.regexp_replace(F.regexp_extract("file_path", r"([^/]+)$", 1), r"\.jsonl(\.zst)?$", "")
    excluded = F.lit(False)
    for marker in K.EXCLUDED_CWD_MARKERS:
        excluded = excluded | F.col("cwd").contains(marker)
    usable = ((F.col("cwd") != "") | F.col("tool").isin("cursor", "antigravity")) & ~excluded
    own_id = F.coalesce("session_id", stem)
    sid = F.when(F.col("tool") == "claude", child_session_id(F.col("file_path"), own_id)).otherwise(own_id)
    joined = (
        meta.where(usable)
        .join(summarize_messages(messages), "file_path", "left")
        .join(files_touched(found), "file_path", "left")
        .join(files_read(found), "file_path", "left")
        .join(commands(found), "file_path", "left")
        .join(errors(found), "file_path", "left")
        .join(thinking_text(found), "file_path", "left")
    )
    if files is not None:
        joined = joined.join(files.select(F.col("path").alias("file_path"), "mtime_ms", "size"), "file_path", "left")
    blank = F.lit("")
    return joined.select(
        *[c for c in ("mtime_ms", "size") if files is not None],
        "file_path", "tool", sid.alias("session_id"), "cwd", "created_at", "date", "started_at", "ended_at",
        F.coalesce("first_prompt", blank).alias("first_prompt"), "custom_title", "message_count",
        F.coalesce("files_touched", empty).alias("files_touched"), F.coalesce("files_read", empty).alias("files_read"),
        F.coalesce("commands", empty).alias("commands"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        (F.coalesce("error_count", F.lit(0)) > 0).alias("errored"),
        F.coalesce("error_messages", empty).alias("error_messages"),
        F.coalesce("closing_user", blank).alias("closing_user"), F.coalesce("closing_assistant", blank).alias("closing_assistant"),
        F.coalesce("thinking", blank).alias("thinking"), "branch",
    )


def indexed_messages(messages: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Messages that search sees: assistant turns and genuine user turns, plus sub-agent sentinels."""
    visible = messages.where(
        ((F.col("role") == "assistant") | F.col("genuine"))
    ).select("file_path", "msg_index", "role", "text")
    return visible.unionByName(fold_subagent_text(messages, records))


# --- events of native stores --------------------------------------------------------


def normalise_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Source events to transcript lines: a header, a title and one record per event.

    ``events``: file_path, line_no, role, text, thinking, timestamp, calls (name, input, id).
    ``sessions``: file_path, session_id, cwd, name.
    """
    first = events.groupBy("file_path").agg(F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("line_no"))).alias("timestamp"))
    heads = sessions.join(first, "file_path", "left")
    header = heads.select(
        "file_path", F.lit(-2).cast("long").alias("line_no"),
        F.to_json(F.struct(F.lit("session").alias("type"), F.col("session_id").alias("sessionId"), "cwd", "timestamp")).alias("value"),
    )
    title = heads.where("name is not null").select(
        "file_path", F.lit(-1).cast("long").alias("line_no"),
        F.to_json(F.struct(F.lit("custom-title").alias("type"), F.col("name").alias("customTitle"))).alias("value"),
    )
    block = "struct<type:string,text:string,thinking:string,name:string,input:string,id:string>"

    def b(kind: str, **fields: Column) -> Column:
        return F.struct(*[fields.get(n, F.lit(None).cast("string") if n != "type" else F.lit(kind)).alias(n) for n in ("type", "text", "thinking", "name", "input", "id")])

    none = F.array().cast(f"array<{block}>")
    content = F.concat(
        F.when(F.col("text") != "", F.array(b("text", text=F.col("text")))).otherwise(none),
        F.when(F.col("thinking") != "", F.array(b("thinking", thinking=F.col("thinking")))).otherwise(none),
        F.transform(F.coalesce("calls", F.array().cast("array<struct<name:string,input:string,id:string>>")), lambda c: b("tool_use", name=c["name"], input=c["input"], id=c["id"])),
    )
    body = events.select(
        "file_path", "line_no",
        F.to_json(F.struct(F.lit("message").alias("type"), "timestamp", F.struct("role", content.alias("content")).alias("message"))).alias("value"),
    )
    return header.unionByName(title).unionByName(body)
