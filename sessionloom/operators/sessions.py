"""Operators over the sessions table: filters, digests, metrics, context, session arcs, pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from ..functions import text as T
from ..functions.dates import local_hour
from .blocks import line_block, running, top_n


# --- filters -------------------------------------------------------------------


def under_path(path: Column, root: str | Column) -> Column:
    """The root itself or something below it; a sibling with the same prefix is neither."""
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def filter_sessions(
    sessions: DataFrame,
    tool: str | None = None,
    project: str | None = None,
    errored: bool = False,
    after: date | None = None,
    before: date | None = None,
    files: Sequence[str] = (),
) -> DataFrame:
    """All given conditions. An undated session passes a lower bound and fails an upper one."""
    out = sessions
    if tool:
        out = out.where(F.col("tool") == tool)
    if project:
        out = out.where(under_path(F.col("cwd"), project))
    if errored:
        out = out.where("errored")
    if after:
        out = out.where(F.coalesce(F.col("date") >= F.lit(after), F.lit(True)))
    if before:
        out = out.where(F.col("date") <= F.lit(before))
    for fragment in files:
        if fragment:
            out = out.where(mentions_file(fragment))
    return out


_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mentions_file(fragment: str) -> Column:
    """Some touched or read path contains the fragment; case folds for ASCII letters only."""
    wanted = fragment.translate(str.maketrans(_ASCII_UPPER, _ASCII_LOWER))

    def hit(column: str) -> Column:
        return F.exists(column, lambda f: F.contains(F.translate(f, _ASCII_UPPER, _ASCII_LOWER), F.lit(wanted)))

    return hit("files_touched") | hit("files_read")


def created_between(sessions: DataFrame, first: date, last: date, tool: str | None = None, project: str | None = None) -> DataFrame:
    out = sessions.where(F.col("created_at").between(F.lit(first), F.lit(last)))
    return filter_sessions(out, tool=tool, project=project)


def covering_roots(roots: DataFrame) -> DataFrame:
    """Roots that no other root contains (column ``root``)."""
    distinct = roots.where(F.coalesce("root", F.lit("")) != "").select("root").distinct()
    parts = F.split("root", "/")
    above = distinct.select(
        "root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("parent")
    ).where("parent <> root")
    covered = above.join(distinct.select(F.col("root").alias("parent")), "parent", "left_semi").select("root").distinct()
    return distinct.join(covered, "root", "left_anti")


def repo_scope(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Sessions at or below any root; no roots select nothing. Ancestor paths make it an equi-join."""
    parts = F.split("cwd", "/")
    places = sessions.select("cwd").distinct().select(
        "cwd", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root")
    )
    inside = places.join(covering_roots(roots), "root", "left_semi").select("cwd").distinct()
    return sessions.join(inside, "cwd", "left_semi")


def lookback_days(sessions: DataFrame, days: int, today: date) -> DataFrame:
    return sessions.where(F.col("created_at") >= F.date_sub(F.lit(today), days))


def resolve_session(sessions: DataFrame) -> DataFrame:
    """session_id -> newest file (ties: larger path)."""
    return sessions.groupBy("session_id").agg(F.max_by("file_path", F.struct("mtime_ms", "file_path")).alias("file_path"))


def recent_order(sessions: DataFrame, limit: int = K.RANKED_LIMIT, by_creation: bool = False) -> DataFrame:
    """Newest first by last activity, or by creation for file questions; undated sessions lead."""
    column = "created_at" if by_creation else "date"
    return sessions.orderBy(F.desc_nulls_first(column), "file_path").limit(max(1, limit))


# --- digests and metrics ----------------------------------------------------------


def _position() -> Column:
    return F.struct("created_at", "date", "file_path")


def _title() -> Column:
    return F.coalesce(F.nullif("custom_title", F.lit("")), F.nullif("first_prompt", F.lit("")))


def activity_digest(sessions: DataFrame, keys: Sequence[str] = ("created_at", "cwd")) -> DataFrame:
    """Per day and project: sessions, messages, harnesses, first distinct topics, last paths."""
    keys = list(keys)
    sums = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"),
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"),
    )
    topic = sessions.where(_title().isNotNull()).groupBy(*keys, _title().alias("topic")).agg(F.min(_position()).alias("at"))
    topics = top_n(topic, keys, [F.col("at")], K.DIGEST_TOPICS).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", "topic"))).alias("a")
    )
    path = sessions.select(*keys, "file_path", _position().alias("at"))
    paths = top_n(path, keys, [F.desc("at")], K.DIGEST_PATHS).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", "file_path"))).alias("p")
    )
    return (
        sums.join(topics, keys, "left")
        .join(paths, keys, "left")
        .select(*keys, "sessions", "messages", "tools", F.coalesce(F.col("a.topic"), F.array().cast("array<string>")).alias("topics"), F.col("p.file_path").alias("file_paths"))
    )


def digest_sessions(sessions: DataFrame, highlights: bool = False, keys: Sequence[str] = ("created_at", "cwd")) -> DataFrame:
    """The longest sessions of each day and project (more than three messages in highlights)."""
    least = K.DIGEST_HIGHLIGHT_MIN_MESSAGES if highlights else 0
    wide = sessions.where(F.col("message_count") > least)
    return top_n(wide, list(keys), [F.desc("message_count"), F.col("created_at"), F.col("date"), F.col("file_path")], K.DIGEST_SESSIONS).select(
        *keys, "session_id", "tool", F.coalesce(_title(), F.lit("")).alias("title"), "message_count", "file_path"
    )


def digest_user_messages(chosen: DataFrame, messages: DataFrame, highlights: bool = False) -> DataFrame:
    """User messages of the chosen sessions: the first twenty, or the first and the last, each cut."""
    spoken = messages.where("role = 'user'").join(chosen.select("file_path").distinct(), "file_path", "left_semi")
    spoken = spoken.select("file_path", "msg_index", "text")
    if not highlights:
        return top_n(spoken, ["file_path"], [F.col("msg_index")], K.DIGEST_USER_MESSAGES).withColumn(
            "text", T.cut_with_mark(F.col("text"), K.DIGEST_MESSAGE_CHARS)
        )
    ends = spoken.groupBy("file_path").agg(
        F.min_by(F.struct("msg_index", "text"), "msg_index").alias("a"), F.max_by(F.struct("msg_index", "text"), "msg_index").alias("b")
    )
    return ends.select("file_path", F.explode(F.array_distinct(F.array("a", "b"))).alias("m")).select(
        "file_path", "m.msg_index", T.cut_with_mark(F.col("m.text"), K.DIGEST_HIGHLIGHT_CHARS).alias("text")
    )


def session_metrics(sessions: DataFrame, tz: str = "UTC") -> DataFrame:
    """Totals and breakdowns by harness, project, day and local start hour, one pass: kind, key, sessions, messages."""
    hour = F.lpad(local_hour(F.col("started_at"), tz).cast("string"), 2, "0")
    slim = sessions.select("tool", "cwd", F.date_format("created_at", "yyyy-MM-dd").alias("day"), hour.alias("hour"), "message_count")
    dims = ("tool", "cwd", "day", "hour")
    sets = [[], *[[F.col(c)] for c in dims]]
    grouped = slim.groupingSets(sets, *[F.col(c) for c in dims]).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"), *[F.grouping(c).alias(f"__{c}") for c in dims]
    )
    kind = F.lit("total")
    names = {"tool": "tool", "cwd": "project", "day": "day", "hour": "hour"}
    for c, name in names.items():
        kind = F.when(F.col(f"__{c}") == 0, name).otherwise(kind)
    out = grouped.select(kind.alias("kind"), F.coalesce(*dims).alias("key"), "sessions", "messages")
    return out.where((F.col("kind") != "hour") | F.col("key").isNotNull())


def recent_sessions_by_id(sessions: DataFrame, limit: int = K.RANKED_LIMIT) -> DataFrame:
    """One row per session id, taken from its latest file, newest first, with the true number of ids."""
    row = F.struct("tool", "date", "created_at", "first_prompt", "custom_title", "file_path")
    latest = sessions.groupBy("session_id").agg(F.max_by(row, F.struct("created_at", "date", "file_path")).alias("r")).select("session_id", "r.*")
    total = latest.agg(F.count(F.lit(1)).alias("total"))
    top = latest.orderBy(F.desc_nulls_first("created_at"), F.desc_nulls_first("date"), "session_id").limit(max(1, limit))
    return top.join(F.broadcast(total))  # one row


# --- context -------------------------------------------------------------------------


def scored_sessions(sessions: DataFrame, now: str) -> DataFrame:
    files = F.size("files_touched")
    closing = S.closing_text()
    score = S.significance(F.col("message_count"), files, closing)
    return sessions.withColumn("trivia", S.is_trivia(F.col("message_count"), files, closing)).withColumn("significance", score).withColumn(
        "score", S.blended_score(score, F.coalesce("created_at", "date"), now)
    )


def context_primer(sessions: DataFrame, now: str, limit: int = K.CONTEXT_RECENT, headlines: int = K.CONTEXT_HEADLINES) -> DataFrame:
    """Two tiers: substantial sessions by recency-weighted score, then headlines of the rest, newest first.

    When every session is trivial they all compete for the first tier.
    """
    scored = scored_sessions(sessions, now)
    any_real = scored.agg(F.coalesce(F.max((~F.col("trivia")).cast("int")), F.lit(0)).alias("any_real"))
    pool = scored.join(F.broadcast(any_real)).where(~F.col("trivia") | (F.col("any_real") == 0))  # one row
    recent = pool.orderBy(F.desc("score"), F.desc_nulls_first("created_at"), F.desc_nulls_first("date"), "file_path").limit(max(1, limit))
    shown = [
        "file_path", "session_id", "tool", F.coalesce(F.nullif("branch", F.lit("")), T.branch_label(F.col("cwd"))).alias("branch"), "date", "message_count",
        F.coalesce(_title(), F.lit("")).alias("intent"), F.size("files_touched").cast("long").alias("file_count"), "created_at",
    ]
    first = recent.select(F.lit("recent").alias("tier"), *shown)
    rest = sessions.join(first.select("file_path"), "file_path", "left_anti").select(F.lit("headline").alias("tier"), *shown)
    return first.unionByName(rest.orderBy(F.desc_nulls_first("created_at"), F.desc_nulls_first("date"), "file_path").limit(max(1, headlines)))


def format_result(results: DataFrame) -> DataFrame:
    """Result rows with capped lists, their true sizes and the command that resumes the session."""
    files = F.array_union("files_touched", "files_read")
    return results.select(
        "file_path", "session_id", "tool", "date", "created_at", F.col("cwd").alias("project"),
        F.nullif("custom_title", F.lit("")).alias("title"), "message_count",
        F.slice(files, 1, K.RESULT_FILES).alias("files"), F.size(files).cast("long").alias("file_count"),
        F.slice("commands", 1, K.RESULT_COMMANDS).alias("commands"), F.size("commands").cast("long").alias("command_count"),
        "errored", T.resume_command(F.col("tool"), F.col("cwd"), F.col("session_id")).alias("resume_command"),
    )


# --- session arc ------------------------------------------------------------------------


def exchanges(messages: DataFrame) -> DataFrame:
    """Each human turn with the last assistant text before the next one: file_path, msg_index, user, assistant."""
    human = (F.col("role") == "user") & F.col("genuine")
    talk = messages.where(human | (F.col("role") == "assistant")).select(
        "file_path", "msg_index", "role", "text", human.alias("human"), line_block(F.col("msg_index")).alias("block")
    )
    counted = running(talk, ["file_path"], "block", ["msg_index"], sums={"turn": F.col("human").cast("int")}).where("turn > 0")
    idx = F.col("msg_index")
    return counted.groupBy("file_path", "turn").agg(
        F.min("msg_index").alias("msg_index"),
        F.min_by("text", idx).alias("user"),
        F.max_by("text", F.when(F.col("role") == "assistant", idx)).alias("assistant"),
    ).select(
        "file_path", "turn", "msg_index",
        T.clip(F.col("user"), K.ARC_USER_CHARS).alias("user"),
        F.coalesce(T.clip(T.strip_insight_fences(F.col("assistant")), K.ARC_ASSISTANT_CHARS), F.lit("")).alias("assistant"),
    )


#: Characters that a serialised exchange has at least.
LEAST_EXCHANGE = 36


def elide_middle(arcs: DataFrame, messages: DataFrame, budget: int = K.ARC_BUDGET_CHARS) -> DataFrame:
    """Keep the most exchanges whose serialised digest fits, from both ends: adds exchange_count and elided.

    Only as many exchanges from either end as could fit the budget at their least size are looked at.
    """
    ends = max(1, -(-budget // LEAST_EXCHANGE))
    one = F.to_json(F.struct(F.col("msg_index").alias("index"), "user", "assistant"))
    sized = arcs.withColumn("size", F.length(one) + 1)
    head = top_n(sized, ["file_path"], [F.col("turn")], ends, rank="place")
    tail = top_n(sized, ["file_path"], [F.desc("turn")], ends, rank="place")
    cumulative = Window.partitionBy("file_path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = head.select("file_path", "place", F.sum("size").over(cumulative).alias("head_size"))
    tails = tail.select("file_path", "place", F.sum("size").over(cumulative).alias("tail_size"))
    counts = arcs.groupBy("file_path").agg(F.count(F.lit(1)).alias("exchange_count")).join(
        messages.groupBy("file_path").agg(F.count(F.lit(1)).alias("message_count")), "file_path"
    )
    choices = counts.select(
        "*", F.explode(F.sequence(F.lit(1), F.least(F.col("exchange_count"), F.lit(2 * ends)).cast("int"))).alias("k")
    ).withColumn("nh", F.ceil(F.col("k") / 2).cast("int")).withColumn("nt", F.floor(F.col("k") / 2).cast("int"))
    shell = F.to_json(F.struct(
        F.col("message_count").alias("messageCount"), F.col("exchange_count").alias("exchangeCount"),
        F.array().cast("array<int>").alias("exchanges"), (F.col("exchange_count") - F.col("k")).alias("elided"),
    ))
    total = F.length(shell) + F.col("head_size") + F.coalesce("tail_size", F.lit(0)) - 1
    best = (
        choices.join(heads.withColumnRenamed("place", "nh"), ["file_path", "nh"])
        .join(tails.withColumnRenamed("place", "nt"), ["file_path", "nt"], "left")
        .where((total <= budget) | (F.col("k") == 1))
        .groupBy("file_path", "exchange_count")
        .agg(F.max("k").alias("k"))
    )
    kept = (
        head.select("file_path", "turn", "msg_index", "user", "assistant", F.col("place").alias("h"), F.lit(None).cast("int").alias("t"))
        .unionByName(tail.select("file_path", "turn", "msg_index", "user", "assistant", F.lit(None).cast("int").alias("h"), F.col("place").alias("t")))
        .groupBy("file_path", "turn")
        .agg(F.first("msg_index").alias("msg_index"), F.first("user").alias("user"), F.first("assistant").alias("assistant"), F.min("h").alias("h"), F.min("t").alias("t"))
        .join(best, "file_path")
        .where((F.col("h") <= F.ceil(F.col("k") / 2)) | (F.col("t") <= F.floor(F.col("k") / 2)))
    )
    return kept.select(
        "file_path", "msg_index", "user", "assistant", "exchange_count", (F.col("exchange_count") - F.col("k")).alias("elided")
    )


# --- pages -------------------------------------------------------------------------------


def page_messages(messages: DataFrame, page_size: int, page: int | None = None) -> DataFrame:
    """Messages with their page number; a page is an index range, so one page prunes to a filter."""
    out = messages.withColumn("page", F.floor(F.col("msg_index") / page_size).cast("long"))
    return out if page is None else out.where(F.col("msg_index").between(page * page_size, (page + 1) * page_size - 1))


def page_text(documents: DataFrame, size: int, id_column: str = "id") -> DataFrame:
    """Documents cut into pages by character offset, each with the next offset (null at the end).

    Pages are cut in the row, so a document's text is not copied into every page row before the cut.
    """
    total = F.length("content")
    offsets = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(size))
    pages = F.transform(offsets, lambda o: F.struct(o.alias("offset"), F.substring("content", o + 1, F.lit(size)).alias("text")))
    return documents.select(id_column, total.alias("total"), F.inline(pages)).select(
        id_column, "offset", "text", "total", F.when(F.col("offset") + size < F.col("total"), F.col("offset") + size).alias("next_offset")
    )


def page_events(lines: DataFrame, limit: int = 20, chars: int = K.EVENT_PAGE_CHARS) -> DataFrame:
    """Page table over all sessions: file_path, page, line_no, char_offset, size, complete.

    A page holds at most ``limit`` records and ``chars`` characters; a longer record continues on the next
    page. Only line numbers and lengths are walked, as a sorted stream with constant state per file.
    """
    if not 1 <= limit <= K.EVENT_PAGE_RECORDS:
        raise ValueError("limit must be between 1 and 100")
    narrow = lines.where(F.trim("value") != "").select("file_path", "line_no", F.length("value").alias("size"))

    def walk(batches):
        current, page, used, left = None, 0, 0, chars
        for pdf in batches:
            out = []
            for file, line, size in zip(pdf["file_path"], pdf["line_no"], pdf["size"]):
                if file != current:
                    current, page, used, left = file, 0, 0, chars
                start = 0
                while True:
                    if used >= limit or left <= 0:
                        page, used, left = page + 1, 0, chars
                    take = min(left, size - start)
                    out.append((file, page, line, start, take, start + take >= size))
                    used, left, start = used + 1, left - take, start + take
                    if start >= size:
                        break
            import pandas as pd

            yield pd.DataFrame(out, columns=["file_path", "page", "line_no", "char_offset", "size", "complete"])

    return narrow.repartition("file_path").sortWithinPartitions("file_path", "line_no").mapInPandas(
        walk, "file_path string, page long, line_no long, char_offset long, size long, complete boolean"
    )


def content_version(lines: DataFrame) -> DataFrame:
    """A fingerprint per file that changes with any record; combined before the shuffle."""
    records = lines.where(F.trim("value") != "")
    return records.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("total"),
        F.concat_ws("-", F.hex(F.bit_xor(F.xxhash64("line_no", "value"))), F.hex(F.bit_xor(F.hash("line_no", "value").cast("long")))).alias("version"),
    )


def budgeted(records: DataFrame, order: Sequence[str], key: str, block: str, budget: int = K.DECISION_PAGE_CHARS) -> DataFrame:
    """Leading records per key whose serialised sizes fit the budget together."""
    sized = records.withColumn("size", F.length(F.to_json(F.struct(*[F.col(c) for c in records.columns if c != block]))))
    walked = running(sized, [key], block, list(order), sums={"upto": F.col("size")})
    return walked.where(F.col("upto") <= budget).drop("size", "upto")
