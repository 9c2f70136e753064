"""Account- and device-partitioned tables: snapshots, versions, chunks, searches, federation, sync, decisions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .blocks import top_n
from .search import parse_query, pattern_of, scan_bm25
from .sessions import under_path

OWNER = ("user_id", "device_id", "key")


# --- snapshots --------------------------------------------------------------------


def read_snapshots(spark, path: str, user: str, columns: Sequence[str] = ("device_id", "key", "hash", "harness", "kind", "cwd", "date")) -> DataFrame:
    """One account's snapshots for list queries: the account is a partition, content is never read."""
    return spark.read.parquet(path).where(F.col("user_id") == user).select("user_id", *columns)


def server_projection(sessions: DataFrame) -> DataFrame:
    """Summary columns of a snapshot, as list queries show them."""
    return sessions.select(
        "file_path", F.col("custom_title").alias("title"), F.col("first_prompt").alias("opening"), "date", "created_at", "closing_user", "closing_assistant",
        "branch", F.col("files_touched").alias("files"), "commands", "errored", "message_count",
    )


def snapshot_key(kind: Column, harness: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", kind, harness, path), 256)


def save_snapshots(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current table, new versions, conflicts) after an optimistic update.

    ``incoming`` has user_id, device_id, key, hash, previous_hash and content. An unchanged hash is a no-op; a
    previous hash that is not the stored one is a conflict.
    """
    old = current.select(*OWNER, F.col("hash").alias("stored"))
    joined = incoming.join(old, list(OWNER), "left")
    moved = joined.where(F.col("stored").isNull() | (F.col("stored") != F.col("hash")))
    agrees = F.col("stored").eqNullSafe(F.col("previous_hash"))
    columns = [*OWNER, "hash", "content"]
    saved = moved.where(agrees).select(*columns)
    table = current.select(*columns).join(saved.select(*OWNER), list(OWNER), "left_anti").unionByName(saved)
    return table, saved.select(*OWNER, "hash", "content"), moved.where(~agrees).select(*OWNER, "hash", "previous_hash", "stored")


def search_chunks_of(messages: DataFrame, keys: Sequence[str] = OWNER) -> DataFrame:
    """Overlapping chunks of each message: keys, msg_index, chunk, role, text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(K.CHUNK_STRIDE))
    return messages.where(F.length("text") > 0).select(*keys, "msg_index", "role", "text", F.posexplode(starts).alias("chunk", "start")).select(
        *keys, "msg_index", "chunk", "role", F.substring("text", F.col("start") + 1, F.lit(K.CHUNK_SIZE)).alias("text")
    )


def snapshot_predicates(
    snapshots: DataFrame, device: str | None = None, exclude_device: str | None = None, tool: str | None = None,
    project: str | None = None, after: date | None = None, before: date | None = None, errored: bool = False, files: Sequence[str] = (),
) -> DataFrame:
    out = snapshots
    if exclude_device:
        out = out.where(F.col("device_id") != exclude_device)
    if device:
        out = out.where(F.col("device_id") == device)
    if tool:
        out = out.where(F.col("harness") == tool)
    if project:
        out = out.where(F.col("cwd") == project)
    if after:
        out = out.where(F.col("date") >= F.lit(after))
    if before:
        out = out.where(F.col("date") <= F.lit(before))
    if errored:
        out = out.where("errored")
    for f in files:
        out = out.where(F.exists("files", lambda x: F.contains(x, F.lit(f))))
    return out


def search_chunks(chunks: DataFrame, query: str, keys: Sequence[str] = OWNER, limit: int = 20) -> DataFrame:
    """Snapshots with a chunk that holds every term (unstemmed), ranked by their best chunk within each account."""
    keys = list(keys)
    terms = sorted({t for p in parse_query(query) for t in p})
    if not terms:
        raise ValueError("empty query")
    spaced = T.spaced_terms(F.col("text"))
    every = F.lit(True)
    for t in terms:
        every = every & spaced.contains(f" {t} ")
    ids = [*keys, "msg_index", "chunk"]
    matching = chunks.where(every)
    ranks = scan_bm25(chunks, [[t] for t in terms], {"text": 1.0}, ids).join(matching.select(*ids), ids, "left_semi")
    best = ranks.groupBy(*keys).agg(F.min("rank").alias("rank"))
    return top_n(best, ["user_id"], [F.col("rank"), *[F.col(k) for k in keys]], limit, rank="place")


def chunk_hits(chunks: DataFrame, query: str, keys: Sequence[str] = OWNER) -> DataFrame:
    """First three distinct messages of every snapshot that match the query."""
    keys = list(keys)
    spaced = T.spaced_terms(F.col("text"))
    every = F.lit(True)
    for t in sorted({t for p in parse_query(query) for t in p}):
        every = every & spaced.contains(f" {t} ")
    found = chunks.where((F.col("msg_index") >= 0) & every)
    first = found.groupBy(*keys, "msg_index").agg(F.min_by(F.struct("role", F.substring("text", 1, 500).alias("snippet")), "chunk").alias("c"))
    return top_n(first, keys, [F.col("msg_index")], K.HITS_PER_SESSION).select(*keys, "msg_index", "c.role", "c.snippet")


def tenant_pattern_totals(messages: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True, keys: Sequence[str] = OWNER) -> DataFrame:
    """Per account: distinct matching messages and snapshots."""
    hits = messages.where(F.col("msg_index") >= 0).where(F.col("text").rlike(pattern_of(pattern, regex, ignore_case)))
    per = hits.groupBy(*keys).agg(F.countDistinct("msg_index").alias("n"))
    return per.groupBy("user_id").agg(F.sum("n").alias("total_hits"), F.count(F.lit(1)).alias("total_sessions"))


def tenant_activity(snapshots: DataFrame) -> DataFrame:
    """The activity digest per account and device of origin."""
    from .sessions import activity_digest

    return activity_digest(snapshots, ["user_id", "device_id", "created_at", "cwd"])


# --- federation and sync ------------------------------------------------------------


def interleave(local: DataFrame, remote: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Local and remote results alternate, local first; only the leading rows of either side take part."""

    def ranked(df: DataFrame, side: int) -> DataFrame:
        lead = df.orderBy(*order).limit(limit)
        return lead.withColumn("__r", F.row_number().over(Window.orderBy(*order))).withColumn("__s", F.lit(side))

    both = ranked(local, 0).unionByName(ranked(remote, 1), allowMissingColumns=True)
    return both.orderBy("__r", "__s").limit(limit).withColumn("remote", F.col("__s") == 1).drop("__r", "__s")


def merge_activity(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Day and project totals of both sides added up."""
    both = local.unionByName(remote, allowMissingColumns=True)
    return both.groupBy("created_at", "cwd").agg(F.sum("sessions").alias("sessions"), F.sum("messages").alias("messages"))


def sync_diff(local: DataFrame, remote: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """What to do with every key: upload, skip (remote or checkpoint has this hash) or remote-only."""
    r = remote.select("key", F.col("hash").alias("remote_hash"))
    c = checkpoint.select("key", F.col("hash").alias("sent_hash"))
    joined = local.select("key", "hash").join(r, "key", "full_outer").join(c, "key", "left")
    action = F.when(F.col("hash").isNull(), "remote-only").when(
        F.coalesce(F.col("remote_hash") == F.col("hash"), F.lit(False)) | F.coalesce((F.col("sent_hash") == F.col("hash")) & F.col("remote_hash").isNotNull(), F.lit(False)), "skip"
    ).otherwise("upload")
    return joined.select("key", action.alias("action"), F.col("remote_hash").alias("previous_hash"))


# --- decisions --------------------------------------------------------------------------


def validate_decisions(decisions: DataFrame, messages: DataFrame, sessions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Decisions with id, ``problem`` (null when accepted) checked in one batch.

    Every citation must quote a message of an indexed session of the project, one of them a human turn; a
    superseded decision must exist, belong to the project, not be younger, and have one successor.
    """
    content = F.struct("project", "title", "decision", "rationale", "decided_at", "supersedes", "evidence")
    named = decisions.withColumn("id", F.substring(F.sha2(F.to_json(content), 256), 1, 32)).dropDuplicates(["id"])
    cited = named.select("id", "project", F.explode("evidence").alias("e")).select(
        "id", "project", F.col("e.file_path").alias("file_path"), F.col("e.message_index").cast("long").alias("msg_index"), F.col("e.quote").alias("quote")
    )
    placed = cited.join(sessions.select("file_path", "cwd"), "file_path", "left").join(
        messages.select("file_path", "msg_index", "role", "genuine", "text"), ["file_path", "msg_index"], "left"
    )
    in_project = F.coalesce(under_path(F.col("cwd"), F.col("project")), F.lit(False))
    quoted = F.coalesce(F.contains("text", "quote"), F.lit(False))
    checks = placed.groupBy("id").agg(
        F.min(in_project).alias("in_project"), F.min(quoted).alias("quoted"),
        F.max(F.coalesce((F.col("role") == "user") & F.col("genuine") & quoted, F.lit(False))).alias("human"),
    )
    pool = named.select("id", "project", "decided_at")
    if known is not None:
        pool = pool.unionByName(known.select("id", "project", "decided_at"))
    target = pool.select(F.col("id").alias("supersedes"), F.col("project").alias("t_project"), F.col("decided_at").alias("t_day"))
    successor = named.where("supersedes is not null").groupBy("supersedes").agg(F.min("id").alias("first_successor"))
    joined = named.join(checks, "id", "left").join(target, "supersedes", "left").join(successor, "supersedes", "left")
    bad_target = F.col("supersedes").isNotNull() & (
        F.col("t_project").isNull() | (F.col("t_project") != F.col("project")) | (F.col("t_day") > F.col("decided_at"))
    )
    problem = (
        F.when(~F.coalesce("in_project", F.lit(False)), "session outside the project")
        .when(~F.coalesce("quoted", F.lit(False)), "quote not found")
        .when(~F.coalesce("human", F.lit(False)), "no human turn cited")
        .when(bad_target, "superseded decision does not fit")
        .when(F.col("supersedes").isNotNull() & (F.col("first_successor") != F.col("id")), "already superseded")
    )
    return joined.select(*[c for c in named.columns], problem.alias("problem"))


def decision_status(accepted: DataFrame) -> DataFrame:
    """``status``: superseded when another decision names it."""
    replaced = accepted.where("supersedes is not null").select(F.col("supersedes").alias("id"), F.lit(True).alias("replaced")).distinct()
    return accepted.join(replaced, "id", "left").withColumn(
        "status", F.when(F.coalesce("replaced", F.lit(False)), "superseded").otherwise("accepted")
    ).drop("replaced")


def list_decisions(accepted: DataFrame, project: str, query: str = "", limit: int = 25, offset: int = 0) -> DataFrame:
    """Newest first within a project, filtered by a substring of the body."""
    body = F.lower(F.to_json(F.struct("title", "decision", "rationale")))
    found = decision_status(accepted).where((F.col("project") == project) & body.contains(query.lower()))
    return found.orderBy(F.desc("decided_at"), "id").offset(offset).limit(limit)
