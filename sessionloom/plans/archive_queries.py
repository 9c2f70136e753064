"""Archive, incremental maintenance, tenants, sync and decisions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import bindings as B
from ..context import cut
from ..operators import archive as A
from ..operators import tenants as N
from ..operators import transcripts as X
from ..sources.lines import parse_lines
from . import review_queries  # noqa: F401  (shared SQL)
from .registry import cte, query, sql
from .search_queries import bm25_sql
from .session_queries import _lines
from .usage_queries import _base_df, _usage


def _docs(spark, d):
    return B.table(spark, d, "documents").select(
        F.col("doc_id"), F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("harness"),
        F.col("lang").alias("kind"), F.col("text").alias("content"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ms"),
    )


cte("docs", "SELECT doc_id, '/docs/' || doc_id || '.md' AS path, source AS harness, lang AS kind, text AS content, n_chars AS size, doc_id * 1000 AS mtime_ms FROM documents")


def _inventories(spark, d):
    docs = _docs(spark, d).select("doc_id", "path", "mtime_ms", "size")
    indexed = docs.where("doc_id % 5 <> 0").withColumn("mtime_ms", F.col("mtime_ms") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return docs.where("doc_id % 11 <> 0").drop("doc_id"), indexed.drop("doc_id"), docs.where("doc_id % 10 = 0").drop("doc_id")


@query(
    "inventory_diff",
    sql(
        """SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'unchanged' WHEN doc_id % 10 = 0 THEN 'ignored' WHEN doc_id % 5 <> 0 THEN 'changed' ELSE 'new' END AS state
 FROM docs WHERE doc_id % 11 <> 0 OR doc_id % 5 <> 0""",
        "docs",
    ),
)
def _(spark, d):
    return A.inventory_diff(*_inventories(spark, d)).select("path", "state")


@query("changed_files", sql("SELECT path FROM docs WHERE doc_id % 11 <> 0 AND NOT (doc_id % 5 <> 0 AND doc_id % 7 <> 0) AND doc_id % 10 <> 0", "docs"))
def _(spark, d):
    return A.changed_files(A.inventory_diff(*_inventories(spark, d))).select("path")


@query("live_or_archived_files", sql("SELECT path, doc_id % 4 = 0 AS archived_only FROM docs WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0", "docs"))
def _(spark, d):
    docs = _docs(spark, d).withColumn("tool", F.col("harness"))
    return A.live_or_archived_files(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 3 = 0")).select("path", "archived_only")


@query("prune_removed", sql("SELECT path FROM docs WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0", "docs"))
def _(spark, d):
    discovered, indexed, ignored = _inventories(spark, d)
    diff = A.inventory_diff(discovered, indexed, ignored)
    return A.prune_removed(indexed, diff.where("state = 'removed'"), "path").select("path")


@query("reject_inventory", sql("SELECT path FROM docs WHERE doc_id % 11 <> 0 AND NOT (doc_id % 5 <> 0 AND doc_id % 7 <> 0) AND doc_id % 10 <> 0 AND doc_id % 3 = 0 UNION ALL SELECT path FROM docs WHERE doc_id % 10 = 0", "docs"))
def _(spark, d):
    discovered, indexed, ignored = _inventories(spark, d)
    todo = A.changed_files(A.inventory_diff(discovered, indexed, ignored))
    usable = _docs(spark, d).where("doc_id % 3 <> 0").select(F.col("path").alias("file_path"))
    return A.reject_inventory(todo, usable, ignored).select("path")


@query("live_or_archived_lines", sql("SELECT path AS file_path, CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 1 THEN 'archived' ELSE 'live' END AS origin FROM docs WHERE doc_id % 4 <> 0 OR doc_id % 2 = 0 ", "docs"))
def _(spark, d):
    docs = _docs(spark, d)
    line = lambda df, o: df.select(F.col("path").alias("file_path"), F.lit(0).cast("long").alias("line_no"), F.lit(o).alias("value"))
    entries = docs.where("doc_id % 4 = 0 or doc_id % 6 = 1").select(
        F.col("path").alias("file_path"), F.when(F.col("doc_id") % 4 != 0, F.col("mtime_ms")).alias("live_mtime"), F.col("size").alias("live_size"), "mtime_ms", "size"
    )
    out = A.live_or_archived_lines(line(docs.where("doc_id % 4 <> 0"), "live"), line(docs, "archived"), entries)
    return out.select("file_path", F.col("value").alias("origin"))


@query("store_objects", sql("SELECT sha256(content) AS hash, any_value(strlen(content)) AS bytes FROM docs GROUP BY 1 HAVING NOT bool_or(doc_id % 10 = 3)", "docs"))
def _(spark, d):
    docs = _docs(spark, d)
    existing = docs.where("doc_id % 10 = 3").select(F.sha2("content", 256).alias("hash"))
    return A.store_objects(existing, docs).select("hash", "bytes")


cte(
    "snaps",
    "SELECT doc_id, path, mtime_ms + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS mtime_ms, size, 200 AS archived_at, 'n' || doc_id AS object_key FROM docs WHERE doc_id % 2 = 0",
    "docs",
)


@query(
    "publish_manifest",
    sql(
        """SELECT path, CASE WHEN s.path IS NOT NULL AND (m.path IS NULL OR s.mtime_ms <> m.mtime_ms) THEN s.object_key ELSE m.object_key END AS object_key FROM
 (SELECT path, mtime_ms, 'o' || doc_id AS object_key FROM docs WHERE doc_id % 4 <> 2) m FULL JOIN snaps s USING (path)""",
        "docs", "snaps",
    ),
)
def _(spark, d):
    docs = _docs(spark, d)
    key = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("object_key")
    manifest = docs.where("doc_id % 4 <> 2").select("path", "mtime_ms", "size", F.lit(100).alias("archived_at"), key("o"))
    snaps = docs.where("doc_id % 2 = 0").select(
        "path", (F.col("mtime_ms") + F.when(F.col("doc_id") % 3 == 0, 5).otherwise(0)).alias("mtime_ms"), "size", F.lit(200).alias("archived_at"), key("n")
    )
    return A.publish_manifest(manifest, snaps).select("path", "object_key")


@query("garbage", sql("SELECT 'o' || doc_id AS hash FROM docs WHERE doc_id % 3 <> 0 AND mtime_ms < 500000 - 60000", "docs"))
def _(spark, d):
    docs = _docs(spark, d)
    name = F.concat(F.lit("o"), F.col("doc_id").cast("string"))
    objects = docs.select(name.alias("hash"), F.col("mtime_ms").alias("modified_ms"))
    return A.garbage(objects, docs.where("doc_id % 3 = 0").select(name.alias("object_key")), 500_000).select("hash")


@query("migrate_entries", sql("SELECT path FROM docs WHERE doc_id % 4 < 2", "docs"))
def _(spark, d):
    m = _docs(spark, d).withColumn("storage_version", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4))
    return A.migrate_entries(m, 2).select("path")


@query(
    "archive_status",
    sql(
        """SELECT harness AS tool, count(*) AS sessions, CAST(sum(CASE WHEN owner = harness AND rn = 1 THEN strlen(content) ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (WHERE doc_id % 6 = 0) AS archived_only FROM (
 SELECT *, first_value(harness) OVER (PARTITION BY sha256(content) ORDER BY path) AS owner, row_number() OVER (PARTITION BY sha256(content), harness ORDER BY path) AS rn FROM docs) GROUP BY 1""",
        "docs",
    ),
)
def _(spark, d):
    docs = _docs(spark, d)
    empty = docs.select(F.lit("").alias("hash")).where("false")
    manifest = docs.select("path", F.col("harness").alias("tool"), F.sha2("content", 256).alias("object_key"))
    return A.archive_status(manifest, A.store_objects(empty, docs), docs.where("doc_id % 6 <> 0"))


@query("inspect_archive", sql("SELECT path, doc_id % 6 <> 0 AS live, CASE WHEN doc_id % 2 = 0 THEN size END AS source_bytes FROM docs", "docs"))
def _(spark, d):
    docs = _docs(spark, d)
    key = F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("object_key")
    summaries = docs.where("doc_id % 2 = 0").select(key, F.col("size").alias("source_bytes"))
    return A.inspect_archive(docs.select("path", key), summaries, docs.where("doc_id % 6 <> 0")).select("path", "live", "source_bytes")


@query(
    "archive_documents",
    sql("SELECT sha256(harness || chr(0) || path) AS id, sha256(content) AS sha256, doc_id % 5 = 0 OR doc_id % 3 = 0 AS written FROM docs", "docs"),
)
def _(spark, d):
    docs = _docs(spark, d)
    empty = docs.select(*[F.lit("").alias(c) for c in ("id", "harness", "kind", "path", "content", "sha256")]).where("false")
    old = docs.where("doc_id % 5 <> 0").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    stored = A.archive_documents(empty, old).drop("written")
    return A.archive_documents(stored, docs).select("id", "sha256", "written")


@query("archive_rejects", sql("SELECT path FROM docs WHERE doc_id % 9 = 0", "docs"))
def _(spark, d):
    docs = _docs(spark, d)
    stored = docs.select(
        F.sha2(F.concat_ws("\u0000", "harness", "path"), 256).alias("id"), "harness", "path", "content",
        F.when(F.col("doc_id") % 9 == 0, F.lit("bad")).otherwise(F.sha2("content", 256)).alias("sha256"),
    )
    return A.read_archived_documents(stored)[1].select("path")


@query(
    "replace_rows",
    sql("SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM docs WHERE doc_id % 4 = 0 OR doc_id % 3 = 0", "docs"),
)
def _(spark, d):
    docs = _docs(spark, d)
    row = lambda cond, o: docs.where(cond).select(F.col("path").alias("file_path"), F.lit(o).alias("origin"))
    return A.replace_rows(row("doc_id % 3 = 0", "old"), row("doc_id % 4 = 0", "new")).select(F.col("file_path").alias("path"), "origin")


@query("cache_parse", sql("SELECT path, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM docs WHERE doc_id % 5 <> 0 OR doc_id % 4 = 0", "docs"))
def _(spark, d):
    docs = _docs(spark, d)
    row = lambda df, n: df.select("path", F.lit(n).alias("version"))
    return A.cache_parse(row(docs, 1), docs.where("doc_id % 5 <> 0"), row(docs.where("doc_id % 4 = 0"), 2), ["/docs"])


@query(
    "compact_records",
    sql(
        """SELECT tool, count(*) AS kept, CAST(sum(CASE WHEN tool = 'codex' AND role = 'assistant' AND kind <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS commands FROM (
 SELECT tool, role, kind FROM conv UNION ALL SELECT tool, 'extra', 0 FROM conv WHERE tool = 'codex' AND role <> 'system' UNION ALL SELECT tool, 'head', 0 FROM (SELECT DISTINCT tool, conv_id FROM conv)) GROUP BY 1""",
        "conv",
    ),
)
def _(spark, d):
    c = A.compact_records(parse_lines(_lines(spark, d)))
    return c.groupBy("tool").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.get_json_object("value", "$.payload.type").eqNullSafe("exec_command_end").cast("int")).alias("commands")
    )


@query("compaction_invariant", sql("SELECT count(*) AS messages, CAST(0 AS BIGINT) AS differences FROM msgs", "msgs"))
def _(spark, d):
    records = parse_lines(cut(_lines(spark, d)))
    before = cut(X.extract_messages(X.extract_lines(records)))
    after = X.extract_messages(X.extract_lines(parse_lines(A.compact_records(records).drop("action"))))
    diff = A.compaction_differences(before, cut(after))
    return before.agg(F.count(F.lit(1)).alias("messages")).join(diff.agg(F.count(F.lit(1)).alias("differences")))


@query(
    "archive_accounting",
    sql(
        """SELECT b.tool, b.session_id, input, output, recorded_nano, estimated_nano, elapsed_ms FROM (SELECT tool, session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
   CAST(coalesce(sum(cost_nano) FILTER (WHERE price_key IS NOT NULL AND priced_as IS NULL), 0) AS BIGINT) AS own_nano FROM base GROUP BY 1, 2) b
 JOIN (SELECT tool, session_id, max(epoch_ms(ts)) - min(epoch_ms(ts)) AS elapsed_ms, CAST(coalesce(sum(CAST(floor(cost_usd * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)), 0) AS BIGINT) AS recorded_nano,
   CAST(coalesce(sum(CAST(floor(cost_usd * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)) FILTER (WHERE model IN ('claude-opus-4-8','claude-haiku-4-5-20251001','gpt-5.4','anthropic/claude-sonnet-4-6','gpt-5.5')), 0) AS BIGINT) AS own_recorded
   FROM usage GROUP BY 1, 2) u ON u.tool = b.tool AND u.session_id = b.session_id, LATERAL (SELECT own_nano - own_recorded AS estimated_nano)""",
        "base", "usage",
    ),
)
def _(spark, d):
    return A.archive_accounting(_base_df(spark, d), _usage(spark, d)).select("tool", "session_id", "input", "output", "recorded_nano", "estimated_nano", "elapsed_ms")


# --- tenants -----------------------------------------------------------------------
def _owned(df):
    n = F.regexp_extract("file_path", r"s(\d+)\.jsonl$", 1).cast("long")
    return df.withColumn("user_id", F.concat(F.lit("u"), (n % 4).cast("string"))).withColumn("device_id", F.concat(F.lit("d"), (n % 8).cast("string"))).withColumn("key", F.col("file_path"))


_OWN = "'u' || (CAST(regexp_extract(file_path, 's(\\d+)\\.jsonl$', 1) AS BIGINT) % 4) AS user_id, 'd' || (CAST(regexp_extract(file_path, 's(\\d+)\\.jsonl$', 1) AS BIGINT) % 8) AS device_id"
cte("owned_docs", "SELECT 'u' || (doc_id % 4) AS user_id, 'd' || (doc_id % 8) AS device_id, path AS key, doc_id, content FROM docs", "docs")
cte(
    "chunks",
    "SELECT user_id, device_id, key, doc_id AS msg_index, CAST(o // 15000 AS INTEGER) AS chunk, substr(content, CAST(o AS INTEGER) + 1, 16000) AS text FROM (SELECT *, unnest(range(0, greatest(length(content), 1), 15000)) AS o FROM owned_docs WHERE length(content) > 0)",
    "owned_docs",
)


def _chunks(spark, d):
    docs = _docs(spark, d).select(
        F.concat(F.lit("u"), (F.col("doc_id") % 4).cast("string")).alias("user_id"), F.concat(F.lit("d"), (F.col("doc_id") % 8).cast("string")).alias("device_id"),
        F.col("path").alias("key"), F.col("doc_id").alias("msg_index"), F.lit("user").alias("role"), F.col("content").alias("text"),
    )
    return N.search_chunks_of(docs)


@query("search_chunks_of", sql("SELECT key, chunk, length(text) AS size, md5(text) AS digest FROM chunks", "chunks"))
def _(spark, d):
    return _chunks(spark, d).select("key", "chunk", F.length("text").cast("long").alias("size"), F.md5("text").alias("digest"))


cte("chunk_rank", bm25_sql("chunks", "user_id, device_id, key, chunk", {"text": 1.0}, [["of"], ["the"]]), "chunks")


@query(
    "search_chunks",
    sql(
        """SELECT user_id, key, CAST(place AS INTEGER) AS place FROM (SELECT user_id, device_id, key, row_number() OVER (PARTITION BY user_id ORDER BY min(rank), device_id, key) AS place FROM chunk_rank
 WHERE (key, chunk) IN (SELECT key, chunk FROM chunks WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])of([^\\p{L}\\p{N}]|$)') AND regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)')) GROUP BY 1, 2, 3) WHERE place <= 20""",
        "chunk_rank", "chunks",
    ),
)
def _(spark, d):
    return N.search_chunks(_chunks(spark, d), "of the").select("user_id", "key", "place")


@query("chunk_hits", sql("SELECT key, doc_id AS msg_index FROM owned_docs WHERE key IN (SELECT key FROM chunks WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])erst([^\\p{L}\\p{N}]|$)'))", "owned_docs", "chunks"))
def _(spark, d):
    return N.chunk_hits(_chunks(spark, d), "erst").select("key", "msg_index")


@query(
    "tenant_pattern_totals",
    sql("SELECT user_id, count(*) AS total_hits, count(DISTINCT key) AS total_sessions FROM owned_docs WHERE regexp_matches(content, '(?i)h[ae]\\w+ea\\b') GROUP BY 1", "owned_docs"),
)
def _(spark, d):
    m = _docs(spark, d).select(F.concat(F.lit("u"), (F.col("doc_id") % 4).cast("string")).alias("user_id"), F.lit("d").alias("device_id"), F.col("path").alias("key"), F.col("doc_id").alias("msg_index"), F.col("content").alias("text"))
    return N.tenant_pattern_totals(m, r"h[ae]\w+ea\b", regex=True)


@query("tenant_activity", sql(f"SELECT user_id, device_id, strftime(created_at, '%Y-%m-%d') AS created_at, cwd, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages FROM (SELECT *, {_OWN} FROM sess) GROUP BY 1, 2, 3, 4", "sess"))
def _(spark, d):
    a = N.tenant_activity(_owned(B.session_index(spark, d)))
    return a.select("user_id", "device_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), "cwd", "sessions", "messages")


@query("snapshot_predicates", sql(f"SELECT file_path FROM (SELECT *, {_OWN} FROM sess) WHERE device_id <> 'd3' AND tool = 'opencode' AND date >= DATE '2024-01-02' AND contains(files_touched, 'src/')", "sess"))
def _(spark, d):
    s = _owned(B.session_index(spark, d)).withColumn("harness", F.col("tool")).withColumn("files", F.col("files_touched"))
    return N.snapshot_predicates(s, exclude_device="d3", tool="opencode", after=date(2024, 1, 2), files=("src/",)).select("file_path")


def _saves(spark, d):
    docs = _docs(spark, d)
    base = docs.select("doc_id", F.lit("u").alias("user_id"), F.lit("d").alias("device_id"), F.col("path").alias("key"), F.sha2("content", 256).alias("hash"), "content")
    current = base.where("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("hash")))
    previous = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit("lost"))).when(F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit("old")).otherwise(F.lit("other")))
    return N.save_snapshots(current.drop("doc_id"), base.withColumn("previous_hash", previous).drop("doc_id"))


@query("save_snapshots", sql("SELECT path AS key, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 AND doc_id % 2 = 1 THEN 'old' ELSE sha256(content) END AS hash FROM docs WHERE doc_id % 3 <> 0 OR doc_id % 2 = 1", "docs"))
def _(spark, d):
    return _saves(spark, d)[0].select("key", "hash")


@query("snapshot_versions", sql("SELECT path AS key FROM docs WHERE (doc_id % 3 = 0 AND doc_id % 2 = 1) OR (doc_id % 3 <> 0 AND doc_id % 5 = 0 AND doc_id % 2 = 0)", "docs"))
def _(spark, d):
    return _saves(spark, d)[1].select("key")


@query("snapshot_conflicts", sql("SELECT path AS key FROM docs WHERE (doc_id % 3 = 0 AND doc_id % 2 = 0) OR (doc_id % 3 <> 0 AND doc_id % 5 = 0 AND doc_id % 2 = 1)", "docs"))
def _(spark, d):
    return _saves(spark, d)[2].select("key")


@query(
    "interleave",
    sql(
        """SELECT doc_id, remote FROM (SELECT doc_id, remote, row_number() OVER (PARTITION BY remote ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT doc_id, n_chars, doc_id % 3 = 0 AS remote FROM documents)) ORDER BY r, remote LIMIT 25"""
    ),
)
def _(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", "n_chars")
    return N.interleave(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), [F.desc("n_chars"), F.col("doc_id")], 25).select("doc_id", "remote")


@query("merge_activity", sql("SELECT strftime(created_at, '%Y-%m-%d') AS created_at, cwd, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages FROM sess GROUP BY 1, 2", "sess"))
def _(spark, d):
    s = B.session_index(spark, d)
    part = lambda c: s.where(c).groupBy("created_at", "cwd").agg(F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"))
    return N.merge_activity(part("tool = 'claude'"), part("tool <> 'claude'")).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query(
    "sync_diff",
    sql("SELECT path AS key, CASE WHEN doc_id % 4 = 0 THEN 'remote-only' WHEN doc_id % 6 < 3 AND NOT (doc_id % 5 = 0 AND doc_id % 7 <> 0) THEN 'skip' ELSE 'upload' END AS action FROM docs WHERE doc_id % 4 <> 0 OR doc_id % 6 < 3", "docs"),
)
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("path").alias("key"), F.sha2("content", 256).alias("hash"))
    remote = docs.where("doc_id % 6 < 3").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("hash")))
    return N.sync_diff(docs.where("doc_id % 4 <> 0"), remote, docs.where("doc_id % 7 = 0")).select("key", "action")


# --- decisions ------------------------------------------------------------------------
def _decisions(spark, d):
    """The opening turn of every session as a decision; some quotes are wrong and some projects foreign."""
    m = B.message_rows(spark, d).where("msg_index = 0")
    s = B.session_index(spark, d).select("file_path", "cwd")
    n = F.regexp_extract("file_path", r"s(\d+)\.jsonl$", 1).cast("long")
    quote = F.when(n % 5 == 0, F.lit("\u0001 nothing like this")).otherwise(F.substring("text", 1, 12))
    return m.join(s, "file_path").select(
        F.when(n % 7 == 0, F.lit("/elsewhere")).otherwise(F.col("cwd")).alias("project"), F.concat(F.lit("D "), n.cast("string")).alias("title"),
        F.lit("do it").alias("decision"), F.lit("").alias("rationale"), F.to_date(F.lit("2024-01-10")).alias("decided_at"), F.lit(None).cast("string").alias("supersedes"),
        F.array(F.struct("file_path", F.col("msg_index").cast("int").alias("message_index"), quote.alias("quote"))).alias("evidence"),
    )


@query(
    "validate_decisions",
    sql(
        """SELECT 'D ' || n AS title, CASE WHEN n % 7 = 0 THEN 'session outside the project' WHEN n % 5 = 0 THEN 'quote not found' WHEN role <> 'user' OR NOT genuine THEN 'no human turn cited' END AS problem
 FROM (SELECT *, CAST(regexp_extract(file_path, 's(\\d+)\\.jsonl$', 1) AS BIGINT) AS n FROM msgs WHERE msg_index = 0)""",
        "msgs",
    ),
)
def _(spark, d):
    return N.validate_decisions(_decisions(spark, d), B.message_rows(spark, d), B.session_index(spark, d)).select("title", "problem")


@query("decision_status", sql("SELECT doc_id AS id, CASE WHEN doc_id + 1 IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 1) THEN 'superseded' ELSE 'accepted' END AS status FROM documents"))
def _(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") - 1).alias("supersedes"))
    return N.decision_status(docs).select("id", "status")


@query("decision_markdown", sql("SELECT '2024-01-10-' || substr(sha256('D' || file_path), 1, 32) || '.md' AS name FROM msgs WHERE msg_index = 0", "msgs"))
def _(spark, d):
    acc = _decisions(spark, d).withColumn("id", F.substring(F.sha2(F.concat(F.lit("D"), F.col("evidence")[0]["file_path"]), 256), 1, 32))
    return A.decision_markdown(N.decision_status(acc)).select("name")


@query("list_decisions", sql("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src1' AND contains(lower(text), 'the') ORDER BY id LIMIT 25 OFFSET 5"))
def _(spark, d):
    docs = B.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("project"), F.lit("t").alias("title"), F.col("text").alias("decision"), F.lit("").alias("rationale"),
        F.to_date(F.lit("2024-01-01")).alias("decided_at"), F.lit(None).cast("string").alias("supersedes"),
    )
    return N.list_decisions(docs, "src1", "THE", 25, 5).select("id")


