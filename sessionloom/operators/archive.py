"""Archive and incremental maintenance: inventories, objects, manifests, compaction, index rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import variant as V


# --- inventories ----------------------------------------------------------------


def inventory_diff(discovered: DataFrame, indexed: DataFrame, ignored: DataFrame) -> DataFrame:
    """State of every path: removed, ignored, unchanged, changed or new. Inputs: path, mtime_ms, size."""
    i = indexed.select("path", F.col("mtime_ms").alias("i_mtime"), F.col("size").alias("i_size"))
    g = ignored.select("path", F.col("mtime_ms").alias("g_mtime"), F.col("size").alias("g_size"))
    joined = discovered.join(i, "path", "full_outer").join(g, "path", "left")

    def same(m: str, s: str) -> Column:
        return F.coalesce((F.col("mtime_ms") == F.col(m)) & (F.col("size") == F.col(s)), F.lit(False))

    state = (
        F.when(F.col("size").isNull(), "removed")
        .when(same("i_mtime", "i_size"), "unchanged")
        .when(same("g_mtime", "g_size"), "ignored")
        .when(F.col("i_mtime").isNotNull(), "changed")
        .otherwise("new")
    )
    return joined.select("path", state.alias("state"), "mtime_ms", "size")


def changed_files(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("state").isin("changed", "new")).select("path", "mtime_ms", "size")


def live_or_archived_files(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Discovered files plus archived paths whose source is gone."""
    gone = archived.join(live.select("path"), "path", "left_anti").select("path", "tool", "mtime_ms", "size", F.lit(True).alias("archived_only"))
    return live.select("path", "tool", "mtime_ms", "size", F.lit(False).alias("archived_only")).unionByName(gone)


def prune_removed(table: DataFrame, removed: DataFrame, key: str = "file_path") -> DataFrame:
    return table.join(removed.select(F.col("path").alias(key)), key, "left_anti")


def reject_inventory(candidates: DataFrame, usable: DataFrame, ignored: DataFrame) -> DataFrame:
    """Ignored files after a run: earlier entries that were not retried, plus candidates that gave no session."""
    failed = candidates.join(usable.select(F.col("file_path").alias("path")), "path", "left_anti").select("path", "mtime_ms", "size")
    kept = ignored.join(candidates.select("path"), "path", "left_anti").select("path", "mtime_ms", "size")
    return kept.unionByName(failed)


def live_or_archived_lines(live: DataFrame, archived: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines of every session: the archive where it matches the live file or the live file is missing.

    ``live``, ``archived``: file_path, line_no, value. ``entries``: file_path, live_mtime, live_size, mtime_ms, size.
    """
    fresh = F.coalesce((F.col("live_mtime") == F.col("mtime_ms")) & (F.col("live_size") == F.col("size")), F.lit(False))
    choice = entries.select("file_path", (fresh | F.col("live_mtime").isNull()).alias("from_archive"))
    a = archived.join(choice.where("from_archive").select("file_path"), "file_path", "left_semi")
    b = live.join(choice.where("from_archive").select("file_path"), "file_path", "left_anti")
    return a.unionByName(b)


# --- objects and manifests ------------------------------------------------------------


def store_objects(existing: DataFrame, contents: DataFrame) -> DataFrame:
    """New content-addressed objects: hash, content, bytes. Equal contents share one object."""
    hashed = contents.select(F.sha2("content", 256).alias("hash"), "content")
    fresh = hashed.join(existing.select("hash"), "hash", "left_anti")
    return fresh.groupBy("hash").agg(F.first("content").alias("content")).withColumn("bytes", F.octet_length("content").cast("long"))


def object_collisions(existing: DataFrame, contents: DataFrame) -> DataFrame:
    """Stored objects whose content does not have its name's hash, or differs from new content of that name."""
    return existing.where(F.sha2("content", 256) != F.col("hash")).select("hash")


def publish_manifest(manifest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest entry per path; a snapshot with unchanged mtime and size adds nothing.

    Both have path, mtime_ms, size, archived_at, object_key.
    """
    columns = ["path", "mtime_ms", "size", "archived_at", "object_key"]
    old = manifest.select("path", F.col("mtime_ms").alias("m"), F.col("size").alias("s"))
    changed = snapshots.select(*columns).join(old, "path", "left").where(
        F.col("m").isNull() | (F.col("m") != F.col("mtime_ms")) | (F.col("s") != F.col("size"))
    ).select(*columns)
    both = manifest.select(*columns).unionByName(changed)
    row = F.struct(*[c for c in columns if c != "path"])
    return both.groupBy("path").agg(F.max_by(row, F.struct("archived_at", "mtime_ms")).alias("r")).select("path", "r.*")


def garbage(objects: DataFrame, manifest: DataFrame, now_ms: int) -> DataFrame:
    """Objects nothing refers to that are older than the grace period."""
    old = objects.where(F.col("modified_ms") < now_ms - K.OBJECT_GRACE_SECONDS * 1000)
    return old.join(manifest.select(F.col("object_key").alias("hash")), "hash", "left_anti")


def migrate_entries(manifest: DataFrame, version: int) -> DataFrame:
    """Entries of an older storage version that still have to be converted."""
    return manifest.where(F.coalesce("storage_version", F.lit(0)) < version)


def archive_status(manifest: DataFrame, objects: DataFrame, live: DataFrame) -> DataFrame:
    """Per harness: sessions, bytes (a shared object counts once), sessions whose source is gone."""
    sized = manifest.select("path", "tool", "object_key").join(
        objects.select(F.col("hash").alias("object_key"), "bytes"), "object_key", "left"
    ).join(live.select("path", F.lit(True).alias("live")), "path", "left")
    per_object = sized.groupBy("object_key", "bytes", "tool").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(F.when(F.col("live").isNull(), 1).otherwise(0)).alias("archived_only"), F.min("path").alias("first")
    )
    owner = per_object.groupBy("object_key").agg(F.min_by("tool", "first").alias("owner"))
    counted = per_object.join(owner, "object_key", "left")
    return counted.groupBy("tool").agg(
        F.sum("sessions").alias("sessions"),
        F.sum(F.when(F.col("tool") == F.col("owner"), F.coalesce("bytes", F.lit(0))).otherwise(0)).alias("bytes"),
        F.sum("archived_only").alias("archived_only"),
    )


def inspect_archive(manifest: DataFrame, summaries: DataFrame, live: DataFrame, target: str | None = None) -> DataFrame:
    """Archived sessions with live state and accounting; a target picks by path, else by session id."""
    rows = manifest
    if target is not None:
        hit = F.when(F.col("path") == target, 0).when(F.col("session_id") == target, 1)
        rows = manifest.withColumn("hit", hit).where("hit is not null").orderBy("hit", "path").limit(1).drop("hit")
    return rows.join(live.select("path", F.lit(True).alias("live")), "path", "left").withColumn(
        "live", F.coalesce("live", F.lit(False))
    ).join(summaries, "object_key", "left")


def archive_documents(stored: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored documents after archiving: changed or new contents replace, others stay. Adds id and ``written``."""
    incoming = documents.select(
        F.sha2(F.concat_ws("\u0000", "harness", "path"), 256).alias("id"), "harness", "kind", "path", "content", F.sha2("content", 256).alias("sha256")
    )
    known = stored.select("id", F.col("sha256").alias("old_sha"))
    fresh = incoming.join(known, "id", "left").where(F.col("old_sha").isNull() | (F.col("old_sha") != F.col("sha256"))).drop("old_sha")
    kept = stored.select(*fresh.columns).join(fresh.select("id"), "id", "left_anti")
    return kept.withColumn("written", F.lit(False)).unionByName(fresh.withColumn("written", F.lit(True)))


def read_archived_documents(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rejects): the id must name the document and the checksum its content."""
    sound = (F.sha2("content", 256) == F.col("sha256")) & (F.sha2(F.concat_ws("\u0000", "harness", "path"), 256) == F.col("id"))
    return stored.where(sound), stored.where(~F.coalesce(sound, F.lit(False)))


# --- compaction --------------------------------------------------------------------------


def compact_records(records: DataFrame) -> DataFrame:
    """Each record with ``action`` keep, drop or unknown and the projected text to store.

    Conversation and tool evidence stays, known bookkeeping and reasoning go, anything unrecognised is kept whole.
    """
    v, kind = F.col("v"), V.any_text(F.col("v"), "$.type")
    p_kind = V.any_text(v, "$.payload.type")
    metadata_event = p_kind.isin(*K.COMPACT_EVENT_METADATA) | (
        (p_kind == "item_completed") & (V.any_text(v, "$.payload.item.type") == "Reasoning")
    )
    keep = kind.isin("user", "assistant", "message", "session_meta", "session", "custom-title", "compacted") | (
        (kind == "response_item") & ~F.coalesce(p_kind == "reasoning", F.lit(False))
    ) | ((kind == "event_msg") & ~F.coalesce(metadata_event, F.lit(False)))
    known = keep | kind.isin("response_item", "event_msg", *K.COMPACT_METADATA_TYPES)
    action = F.when(F.coalesce(keep, F.lit(False)), "keep").when(F.coalesce(known, F.lit(False)), "drop").otherwise("unknown")
    staged = records.withColumn("kind", kind).withColumn("action", action).where("action <> 'drop'").withColumn(
        "blocks", V.array(v, "$.message.content")
    )
    hidden = F.filter("blocks", lambda b: ~F.coalesce(V.any_text(b, "$.type").isin("thinking", "redacted_thinking"), F.lit(False)))
    content = F.when(F.col("blocks").isNotNull(), F.to_variant_object(hidden)).otherwise(V.get(v, "$.message.content"))

    def pick(*names: str) -> list[Column]:
        return [V.get(v, f"$.{n}").alias(n) for n in names]

    envelope = ("type", "timestamp", "sessionId", "cwd", "gitBranch", "isSidechain", "isCompactSummary", "promptSource", "isApiErrorMessage")
    talk = F.to_json(F.struct(*pick(*envelope), F.struct(V.get(v, "$.message.role").alias("role"), content.alias("content"), V.get(v, "$.message.id").alias("id")).alias("message")))
    plain_message = F.to_json(F.struct(*pick(*envelope, "message")))
    meta = F.to_json(F.struct(*pick("type", "timestamp"), F.struct(*[V.get(v, f"$.payload.{n}").alias(n) for n in ("id", "cwd", "git")]).alias("payload")))
    value = (
        F.when(F.col("action") == "unknown", F.to_json(v))
        .when(F.col("kind").isin("user", "assistant", "message"), F.when(V.text(v, "$.message").isNotNull(), plain_message).otherwise(talk))
        .when(F.col("kind") == "session_meta", meta)
        .when(F.col("kind") == "session", F.to_json(F.struct(*pick("type", "sessionId", "cwd", "timestamp", "subagentText"))))
        .when(F.col("kind") == "custom-title", F.to_json(F.struct(*pick("type", "customTitle"))))
        .when(F.col("kind") == "compacted", F.to_json(F.struct(*pick("type", "timestamp", "message"))))
        .otherwise(F.to_json(F.struct(*pick("type", "timestamp", "payload"))))
    )
    return staged.select("file_path", "tool", "line_no", "action", value.alias("value"))


def compaction_counts(records: DataFrame, compacted: DataFrame) -> DataFrame:
    total = records.groupBy("file_path").agg(F.count(F.lit(1)).alias("source_records"))
    kept = compacted.groupBy("file_path").agg(F.count(F.lit(1)).alias("kept"), F.sum((F.col("action") == "unknown").cast("int")).alias("unclassified_records"))
    return total.join(kept, "file_path", "left").select(
        "file_path", "source_records", (F.col("source_records") - F.coalesce("kept", F.lit(0))).alias("removed_records"),
        F.coalesce("unclassified_records", F.lit(0)).alias("unclassified_records"),
    )


def compaction_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages that compaction changed, lost or added; empty when it is sound."""
    columns = ["file_path", "msg_index", "role", "text", "genuine"]
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))


def archive_accounting(base: DataFrame, events: DataFrame) -> DataFrame:
    """Per session: tokens, recorded and estimated cost, models without an own price, elapsed time."""
    own = F.col("price_key").isNotNull() & F.col("priced_as").isNull()
    per_model = base.groupBy("tool", "session_id", "model").agg(
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write", "recorded_nano", "cost_nano", "open_tokens")],
        F.max(own).alias("own"), F.sum("messages").alias("messages"),
    )
    money = per_model.groupBy("tool", "session_id").agg(
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write", "recorded_nano")],
        F.sum(F.when(F.col("own"), F.col("cost_nano") - F.col("recorded_nano")).otherwise(0)).alias("estimated_nano"),
        F.sum(F.when(~F.col("own") & (F.col("open_tokens") > 0), 1).otherwise(0)).alias("unpriced_models"),
    )
    ms = F.unix_millis("ts")
    span = events.groupBy("tool", "session_id").agg((F.max(ms) - F.min(ms)).alias("elapsed_ms"))
    return money.join(span, ["tool", "session_id"])


# --- index writes -------------------------------------------------------------------------


def replace_rows(table: DataFrame, fresh: DataFrame, key: str = "file_path") -> DataFrame:
    """The table after replacing all rows of the keys in ``fresh``."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*table.columns))


def write_session_index(sessions: DataFrame, messages: DataFrame, path: str, previous: str | None = None, keys: int = 64) -> None:
    """Write the index, sessions by month of creation and messages by key range, to a new folder.

    With ``previous``, an index written earlier, all its rows of other files stay and those of the given files are
    replaced. Nothing is overwritten in place: the folder is the current index once the call has returned, and a stop
    before that leaves the previous one whole.
    """
    spark = sessions.sparkSession
    for name, fresh, part in (
        ("sessions", sessions, F.date_format("created_at", "yyyy-MM")), ("messages", messages, F.pmod(F.xxhash64("file_path"), F.lit(keys)).cast("string")),
    ):
        whole = fresh
        if previous is not None:
            old = spark.read.schema(fresh.schema).parquet(f"{previous}/{name}").select(*fresh.columns)
            gone = sessions.select("file_path").unionByName(messages.select("file_path")).distinct()
            whole = old.join(gone, "file_path", "left_anti").unionByName(fresh)
        whole.withColumn("part", part).write.partitionBy("part").parquet(f"{path}/{name}")


def cache_parse(parsed: DataFrame, scanned: DataFrame, fresh: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Parsed-file cache after a run: fresh results replace, entries of vanished files below the roots go."""
    below = F.lit(False)
    for r in roots:
        below = below | F.col("path").startswith(r.rstrip("/") + "/")
    vanished = parsed.where(below).select("path").distinct().join(scanned.select("path"), "path", "left_anti")
    kept = parsed.join(vanished, "path", "left_anti")
    return replace_rows(kept, fresh, "path")


def archive_summaries(lines: DataFrame, record_type: str = "archive_summary", version: int = 1) -> DataFrame:
    """Accounting records among the last two lines of each object; other types and versions are skipped."""
    from .blocks import top_n

    last = top_n(lines.select("hash", "line_no", "value"), ["hash"], [F.desc("line_no")], 2)
    v = F.try_parse_json("value")
    hit = (V.any_text(v, "$.type") == record_type) & (V.whole(v, "$.version") == version)
    return last.where(hit).groupBy("hash").agg(F.max_by("value", "line_no").alias("summary"))


def decision_markdown(decisions: DataFrame) -> DataFrame:
    """One text per decision, named by date and id."""
    nl = "\n"
    evidence = F.array_join(
        F.transform(
            "evidence",
            lambda e: F.concat(
                F.lit("- message "), e["message_index"].cast("string"), F.lit(nl + "  Source: "), e["file_path"], F.lit(nl + nl),
                F.array_join(F.transform(F.split(e["quote"], nl), lambda q: F.concat(F.lit("> "), q)), nl),
            ),
        ),
        nl,
    )
    body = F.concat(
        F.lit("# "), "title", F.lit(nl + nl + "Status: "), "status", F.lit(nl + "Date: "), F.col("decided_at").cast("string"), F.lit(nl + "ID: "), "id",
        F.lit(nl + "Project: "), "project", F.lit(nl), F.when(F.col("supersedes").isNotNull(), F.concat(F.lit("Supersedes: "), "supersedes", F.lit(nl))).otherwise(""),
        F.lit(nl + "## Decision" + nl + nl), "decision", F.lit(nl + nl + "## Rationale" + nl + nl), "rationale", F.lit(nl + nl + "## Evidence" + nl + nl), evidence,
    )
    return decisions.select(F.concat(F.col("decided_at").cast("string"), F.lit("-"), "id", F.lit(".md")).alias("name"), body.alias("text"))


def export_decisions(decisions: DataFrame, path: str) -> None:
    """Never overwrites: an existing folder is an error."""
    decision_markdown(decisions).write.mode("error").json(path)


