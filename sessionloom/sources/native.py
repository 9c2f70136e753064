"""Native stores of the harnesses, given as tables or text, turned into message records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..context import shared_dir
from ..functions import variant as V
from ..operators.blocks import running


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# --- relational sessions ----------------------------------------------------------


def part_blocks(parts: DataFrame) -> DataFrame:
    """Message parts to content blocks as JSON: message_id, time_created, id, block. Empty texts drop out."""
    v = F.try_parse_json("data")
    kind, text = V.any_text(v, "$.type"), V.text(v, "$.text")
    spoken = F.trim(text) != ""
    block = (
        F.when((kind == "text") & spoken, F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))))
        .when((kind == "reasoning") & spoken, F.to_json(F.struct(F.lit("thinking").alias("type"), text.alias("thinking"))))
        .when(kind == "tool", F.to_json(F.struct(F.lit("tool").alias("type"), V.get(v, "$.tool").alias("tool"), V.get(v, "$.state").alias("state"))))
        .when((kind == "patch") & V.array(v, "$.files").isNotNull(), F.to_json(F.struct(F.lit("patch").alias("type"), V.get(v, "$.files").alias("files"))))
    )
    return parts.select("message_id", "time_created", "id", block.alias("block")).where("block is not null")


def tables_to_messages(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """session, message and part tables to transcript lines: file_path, line_no, value.

    Messages without content drop out. A line is one message as the harness stores it; parts are ordered by
    time and id.
    """
    blocks = part_blocks(parts).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("time_created", "id", "block"))).alias("b"))
    m = F.try_parse_json("m.data")
    rows = messages.alias("m").join(blocks.alias("p"), F.col("m.id") == F.col("p.message_id")).select(
        F.col("m.session_id").alias("session_id"), F.col("m.time_created").alias("at"), F.col("m.id").alias("mid"), V.text(m, "$.role").alias("role"),
        F.concat(F.lit("["), F.array_join(F.col("p.b.block"), ","), F.lit("]")).alias("content"),
    )
    body = rows.withColumn("order", F.struct("at", "mid")).select(
        F.col("session_id").alias("file_path"), "at", "mid",
        F.concat(
            F.lit('{"type":"message","timestamp":"'), _iso(F.col("at")), F.lit('","message":{"role":"'), "role", F.lit('","content":'), "content", F.lit("}}")
        ).alias("value"),
    )
    head = sessions.select(
        F.col("id").alias("file_path"), F.lit(None).cast("long").alias("at"), F.lit("").alias("mid"),
        F.to_json(F.struct(F.lit("session").alias("type"), F.col("id").alias("sessionId"), F.col("directory").alias("cwd"), _iso(F.col("time_created")).alias("timestamp"))).alias("value"),
    )
    placeholder = F.col("title").rlike("^(New session|Child session) - ")
    title = sessions.where(F.coalesce(F.trim("title") != "", F.lit(False)) & ~placeholder).select(
        F.col("id").alias("file_path"), F.lit(None).cast("long").alias("at"), F.lit("\u0001").alias("mid"),
        F.to_json(F.struct(F.lit("custom-title").alias("type"), F.col("title").alias("customTitle"))).alias("value"),
    )
    every = head.unionByName(title).unionByName(body).withColumn("ms", F.coalesce("at", F.lit(-1)))
    every = every.withColumn("block", F.floor(F.col("ms") / K.HOUR_MS))
    numbered = running(every, ["file_path"], "block", ["ms", "mid"], sums={"n": F.lit(1)})
    return numbered.select("file_path", (F.col("n") - 1).cast("long").alias("line_no"), "value")


def json_tree(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files ``…/session|message|part/…json`` (path, value) to the three tables of ``tables_to_messages``."""
    v = F.try_parse_json("value")
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+\.json$", 1)
    of = lambda kind: texts.where(F.col("path").contains(f"/{kind}/"))
    sessions = of("session").select(
        stem.alias("id"), V.text(v, "$.directory").alias("directory"), V.text(v, "$.title").alias("title"),
        V.whole(v, "$.time.created").alias("time_created"), V.text(v, "$.parentID").alias("parent_id"),
    )
    messages = of("message").select(stem.alias("id"), parent.alias("session_id"), V.whole(v, "$.time.created").alias("time_created"), F.col("value").alias("data"))
    parts = of("part").select(stem.alias("id"), parent.alias("message_id"), F.coalesce(V.whole(v, "$.time.start"), F.lit(0)).alias("time_created"), F.col("value").alias("data"))
    return sessions, messages, parts


# --- conversational records of an editor --------------------------------------------


def project_cursor_lines(records: DataFrame) -> DataFrame:
    """Role, text, thinking and calls of editor records; a user's text is the body of the query tag."""
    v = F.col("v")
    m = F.when(V.is_object(V.get(v, "$.message")), V.get(v, "$.message")).otherwise(v)
    role = F.coalesce(V.any_text(v, "$.role"), V.any_text(m, "$.role"))
    staged = records.select("file_path", "line_no", V.text(v, "$.timestamp").alias("timestamp"), role.alias("r"), V.array(m, "$.content").alias("blocks"), V.text(m, "$.content").alias("plain"))
    blocks = F.coalesce("blocks", F.array().cast("array<variant>"))

    def strings(field: str) -> Column:
        return F.filter(F.transform(blocks, lambda b: V.text(b, f"$.{field}")), lambda s: s.isNotNull())

    joined = F.coalesce("plain", F.array_join(strings("text"), "\n"))
    asked = F.regexp_extract(joined, r"(?s)<user_query>(.*?)</user_query>", 1)
    thoughts = F.array_join(strings("thinking"), "\n")
    uses = F.filter(blocks, lambda b: V.any_text(b, "$.type").isin("tool_use", "tool-call") & V.text(b, "$.name").isNotNull())
    calls = F.transform(
        uses, lambda b: F.struct(V.text(b, "$.name").alias("name"), F.to_json(F.coalesce(V.get(b, "$.input"), V.get(b, "$.args"))).alias("input"), V.text(b, "$.id").alias("id"))
    )
    return staged.select(
        "file_path", "line_no", "timestamp",
        F.when(F.col("r").isin("user", "assistant", "tool", "system"), F.col("r")).otherwise("unknown").alias("role"),
        F.when((F.col("r") == "user") & joined.contains("<user_query>"), asked).otherwise(joined).alias("text"),
        F.nullif(thoughts, F.lit("")).alias("thinking"), calls.alias("calls"), joined.contains("[REDACTED]").alias("truncated"),
    )


def kv_to_messages(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key-value composer rows (key, value) to (events, sessions).

    A composer's header list names its bubbles; each is looked up under its composed key, else taken from the
    header itself. A missing bubble makes the session incomplete; the workspace counts only when it is unique.
    """
    v = F.try_parse_json("value")
    composers = kv.where(F.col("key").startswith("composerData:")).select(F.expr("substring(key, 14)").alias("session_id"), v.alias("v")).where(V.is_object(F.col("v")))
    listed = F.coalesce(*[V.array(F.col("v"), f"$.{n}") for n in ("fullConversationHeadersOnly", "conversationHeaders", "conversation")])
    heads = composers.select("session_id", listed.alias("headers"))
    refs = heads.select("session_id", F.posexplode("headers").alias("pos", "h")).select("session_id", "pos", "h", V.text(F.col("h"), "$.bubbleId").alias("bubble"))
    first = refs.where("bubble is not null").groupBy("session_id", "bubble").agg(F.min_by(F.struct("pos", "h"), "pos").alias("r")).select("session_id", "bubble", "r.*")
    bubbles = kv.where(F.col("key").startswith("bubbleId:")).select("key", v.alias("b"))
    looked = first.withColumn("key", F.concat(F.lit("bubbleId:"), "session_id", F.lit(":"), "bubble")).join(bubbles, "key", "left")
    h = F.col("h")
    inline = V.get(h, "$.text").isNotNull() | V.get(h, "$.rawText").isNotNull() | V.get(h, "$.thinking").isNotNull() | F.coalesce(V.whole(h, "$.capabilityType") == 15, F.lit(False))
    raw = F.when(V.is_object(F.col("b")), F.col("b")).when(F.col("b").isNull() & inline, h)
    found = looked.select("session_id", "pos", "bubble", raw.alias("raw"))
    r = F.col("raw")
    text = F.coalesce(V.text(r, "$.text"), V.text(r, "$.rawText"), F.lit(""))
    thought = V.flag(r, "$.isThought")
    when = F.coalesce(V.text(r, "$.timestamp"), _iso(V.whole(r, "$.timestamp")))
    kind = V.whole(r, "$.type")
    events = found.where("raw is not null").select(
        F.col("session_id").alias("file_path"), F.col("pos").cast("long").alias("line_no"), F.col("bubble").alias("id"),
        F.when(kind == 1, "user").when(kind == 2, "assistant").otherwise("unknown").alias("role"),
        F.when(thought, F.lit("")).otherwise(text).alias("text"),
        F.coalesce(V.text(r, "$.thinking.text"), F.when(thought, text)).alias("thinking"), when.alias("timestamp"),
        F.when(
            V.text(r, "$.toolFormerData.name").isNotNull(),
            F.array(F.struct(V.text(r, "$.toolFormerData.name").alias("name"), V.any_text(r, "$.toolFormerData.rawArgs").alias("input"), V.text(r, "$.toolFormerData.toolCallId").alias("id"))),
        ).alias("calls"),
        V.text(r, "$.workspaceProjectDir").alias("workspace"),
    )
    missing = found.groupBy("session_id").agg(F.max(r.isNull()).alias("missing"))
    unnamed = refs.groupBy("session_id").agg(F.max(F.col("bubble").isNull()).alias("unnamed"))
    place = events.where(F.col("workspace").startswith("/")).groupBy(F.col("file_path").alias("session_id")).agg(
        F.when(F.min("workspace") == F.max("workspace"), F.min("workspace")).alias("cwd")
    )
    sessions = heads.join(missing, "session_id", "left").join(unnamed, "session_id", "left").join(place, "session_id", "left").select(
        "session_id", F.coalesce("cwd", F.lit("")).alias("cwd"),
        (F.col("headers").isNull() | F.coalesce("missing", F.lit(False)) | F.coalesce("unnamed", F.lit(False))).alias("incomplete"),
    )
    return events, sessions


def reachable_messages(edges: DataFrame, blobs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reached blobs, incomplete stores) from each store's root, every blob once.

    ``edges``: store, parent, child. ``blobs``: store, id. ``roots``: store, id. One join per level; each level is
    written once, beside the earlier ones, and the loop ends when a level is empty, however deep the store.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/sessionloom/levels-{uuid.uuid4().hex}"
    frontier, level = roots.select("store", "id").distinct(), 0
    schema = frontier.schema
    while True:
        frontier.write.parquet(f"{folder}/level={level}")
        frontier = spark.read.schema(schema).parquet(f"{folder}/level={level}")
        visited = spark.read.schema(schema).parquet(folder).select("store", "id")
        if frontier.isEmpty():
            break
        step = frontier.join(edges.select("store", F.col("parent").alias("id"), "child"), ["store", "id"]).select("store", F.col("child").alias("id")).distinct()
        frontier, level = step.join(visited, ["store", "id"], "left_anti"), level + 1
    reached = visited.join(blobs.select("store", "id"), ["store", "id"], "left_semi")
    incomplete = visited.join(blobs.select("store", "id"), ["store", "id"], "left_anti").select("store").distinct()
    return reached, incomplete


# --- step logs -------------------------------------------------------------------------


def project_step_logs(records: DataFrame) -> DataFrame:
    """Steps of an agent log: file_path, source, step, role, text, thinking, calls, truncated."""
    v = F.col("v")
    kind, origin = V.text(v, "$.type"), V.any_text(v, "$.source")
    role = (
        F.when((kind == "USER_INPUT") & (origin == "USER_EXPLICIT"), "user")
        .when(kind == "PLANNER_RESPONSE", "assistant")
        .when(kind.isin("SYSTEM_MESSAGE", "EPHEMERAL_MESSAGE", "CHECKPOINT", "CONVERSATION_HISTORY"), "system")
        .when(origin == "MODEL", "tool")
        .when(origin == "SYSTEM", "system")
        .otherwise("unknown")
    )
    content = F.coalesce(V.text(v, "$.content"), F.lit(""))
    request = F.regexp_extract(content, r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1)
    calls = F.filter(F.coalesce(V.array(v, "$.tool_calls"), F.array().cast("array<variant>")), lambda c: V.text(c, "$.name").isNotNull())
    step = V.number(v, "$.step_index")
    keep = [c for c in ("file_path", "source_log", "line_no") if c in records.columns]
    return records.where((step == F.floor(step)) & kind.isNotNull()).select(
        *keep, step.cast("long").alias("step"), role.alias("role"),
        F.when((role == "user") & content.contains("<USER_REQUEST>"), request).otherwise(content).alias("text"),
        V.text(v, "$.thinking").alias("thinking"), V.text(v, "$.created_at").alias("timestamp"),
        F.transform(calls, lambda c: F.struct(V.text(c, "$.name").alias("name"), F.to_json(V.get(c, "$.args")).alias("input"), V.text(c, "$.id").alias("id"))).alias("calls"),
        (F.size(F.coalesce(V.array(v, "$.truncated_fields"), F.array().cast("array<variant>"))) > 0).alias("truncated"), F.to_json(v).alias("raw"),
    )


def merge_step_logs(steps: DataFrame, priority: str = "prio") -> DataFrame:
    """One row per file and step: the log of the highest priority wins, the number of variants stays visible."""
    row = F.struct(*[c for c in steps.columns if c not in ("file_path", "step", priority)])
    return steps.groupBy("file_path", "step").agg(
        F.max_by(row, F.struct(priority, "line_no")).alias("r"), F.count(F.lit(1)).alias("variants")
    ).select("file_path", "step", "r.*", "variants")


def merge_stored_and_companion(stored: DataFrame, companion: DataFrame) -> DataFrame:
    """Full outer merge by id: companion text, time and thinking win where present; calls merge by call id."""
    columns = ["role", "text", "thinking", "timestamp", "calls"]
    s = stored.select("file_path", "id", *[F.col(c).alias(f"s_{c}") for c in columns])
    c = companion.select("file_path", "id", *[F.col(x).alias(f"c_{x}") for x in columns])
    joined = s.join(c, ["file_path", "id"], "full_outer")
    none = F.array().cast("array<struct<name:string,input:string,id:string>>")
    sc, cc = F.coalesce("s_calls", none), F.coalesce("c_calls", none)

    def replaced(x: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(cc, lambda y: y["id"] == x["id"]), F.lit(-1)), x)

    added = F.filter(cc, lambda y: ~F.exists(sc, lambda x: F.coalesce(x["id"] == y["id"], F.lit(False))))
    has_c = F.col("c_role").isNotNull()
    return joined.select(
        "file_path", "id",
        F.when(has_c & (F.col("c_role") != "unknown"), F.col("c_role")).otherwise(F.coalesce("s_role", F.lit("unknown"))).alias("role"),
        F.coalesce(F.nullif("c_text", F.lit("")), F.col("s_text"), F.lit("")).alias("text"),
        F.coalesce("c_thinking", "s_thinking").alias("thinking"), F.coalesce("c_timestamp", "s_timestamp").alias("timestamp"),
        F.concat(F.transform(sc, replaced), added).alias("calls"),
    )


def retain_vanished_steps(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current steps plus steps of the previous archive that are gone, ``retained`` marked; order by step."""
    gone = previous.join(current.select("file_path", "step"), ["file_path", "step"], "left_anti")
    return current.withColumn("retained", F.lit(False)).unionByName(gone.select(*current.columns).withColumn("retained", F.lit(True)))


def last_workspace(history: DataFrame) -> DataFrame:
    """conversation_id -> the last absolute workspace recorded for it."""
    ok = history.where(F.col("workspace").startswith("/"))
    return ok.groupBy("conversation_id").agg(F.max_by("workspace", "line_no").alias("cwd"))


# --- documents, commits ----------------------------------------------------------------------


def scan_documents(files: DataFrame) -> DataFrame:
    """Binary files (path, content, modified_ms) to native documents; invalid UTF-8 drops out."""
    path = F.col("path")
    match = F.lit(None).cast("struct<harness:string,kind:string>")
    for harness, kind, pattern in reversed(K.DOCUMENT_LOCATIONS):
        match = F.when(path.rlike(pattern), F.struct(F.lit(harness).alias("harness"), F.lit(kind).alias("kind"))).otherwise(match)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", match.alias("m"), text.alias("text"), F.sha2("content", 256).alias("sha256"), "modified_ms").where(
        F.col("m").isNotNull() & F.col("text").isNotNull()
    ).select(F.col("m.harness").alias("harness"), F.col("m.kind").alias("kind"), "path", F.col("text").alias("content"), "sha256", "modified_ms")


def parse_commits(chunks: DataFrame, column: str = "value") -> DataFrame:
    """Exported log records (one per row, split at the record separator) to commits."""
    text = F.col(column)
    header = F.split(F.substring_index(text, "\n", 1), "\u001f")
    rest = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    lines = F.filter(F.transform(F.split(rest, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    part = lambda i: F.coalesce(F.try_element_at(header, F.lit(i)), F.lit(""))
    return chunks.where(F.trim(text) != "").select(
        part(1).alias("sha"), part(3).alias("subject"), F.try_to_timestamp(part(2)).alias("authored_at"), lines.alias("files"),
        F.filter(F.slice(header, F.lit(5), F.size(header)), lambda t: F.trim(t) != "").alias("trailers"), F.trim(part(4)).contains(" ").alias("merge"),
    ).where("sha <> ''")


def read_commits(spark, path: str) -> DataFrame:
    return parse_commits(spark.read.option("lineSep", "\u001e").text(path))


