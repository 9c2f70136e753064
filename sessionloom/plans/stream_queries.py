"""Streaming jobs drained over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import bindings as B
from ..context import shared_dir, utc
from ..operators.usage import usage_identity
from ..streaming import jobs as J
from . import source_queries  # noqa: F401  (shared SQL)
from .registry import query, sql
from .source_queries import _rollout_counts


def _events(spark, d):
    e = J.landed(utc(spark), d, "events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.floor("value").cast("long").alias("tokens"))


@query("stream_tumbling", sql("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS messages, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2"))
def _(spark, d):
    out = J.to_table(J.tumbling(_events(spark, d), "1 day", "event_type"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "messages", "tokens")


@query(
    "stream_sliding",
    sql("SELECT strftime(CAST(ts AS DATE) - CAST(i AS INTEGER), '%Y-%m-%d') AS first_day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events, range(0, 7) t(i) GROUP BY 1"),
)
def _(spark, d):
    out = J.to_table(J.sliding(_events(spark, d)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("first_day"), "tokens")


@query(
    "stream_session_windows",
    sql(
        """SELECT user_id, epoch_ms(min(ts)) AS start_ms, count(*) AS replies FROM (SELECT *, sum(CASE WHEN ts - p <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT user_id, date_trunc('millisecond', ts) AS ts, lag(date_trunc('millisecond', ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, run"""
    ),
)
def _(spark, d):
    e = _events(spark, d).withColumn("ts", F.date_trunc("MILLISECOND", "ts"))
    out = J.to_table(J.session_windows(e, "user_id"), "complete")
    return out.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "replies")


@query("stream_late_rows", sql("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 2 DAY"))
def _(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = e.agg(F.max("ts").cast("string").alias("newest")).first()["newest"]
    return J.late_rows(e, newest).select("event_id")


@query("stream_counters", sql("SELECT CAST(l_orderkey AS VARCHAR) AS file_path, n AS line_no, CAST(CASE WHEN p IS NULL OR ti < p THEN ti ELSE ti - p END AS BIGINT) AS delta FROM (SELECT *, lag(ti) OVER (PARTITION BY l_orderkey ORDER BY n) AS p FROM counts) WHERE p IS NULL OR ti <> p", "counts"))
def _(spark, d):
    path = f"{shared_dir(spark)}/sessionloom/counts-{uuid.uuid4().hex}"
    _rollout_counts(utc(spark), d).select(
        F.col("l_orderkey").cast("string").alias("file_path"), F.col("n").cast("long").alias("line_no"), F.col("ti").alias("total")
    ).write.parquet(f"{path}/counts.parquet")
    stream = spark.readStream.schema("file_path string, line_no long, total long").parquet(f"{path}/counts.parquet")
    return J.to_table(J.stateful_counters(stream))


@query(
    "stream_loops",
    sql(
        """WITH p AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, epoch_us(ts) // 1000 AS ms, event_type = 'signup' AS turn FROM events),
 q AS (SELECT *, max(CASE WHEN turn THEN ms END) OVER (PARTITION BY session_id ORDER BY ms, turn DESC ROWS UNBOUNDED PRECEDING) AS spoken,
  max(CASE WHEN NOT turn THEN ms END) OVER (PARTITION BY session_id ORDER BY ms, turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
 r AS (SELECT session_id, ms, sum(CASE WHEN before IS NULL OR ms - before > 1800000 OR spoken > before THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ms, before NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM q WHERE NOT turn)
 SELECT session_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS steps FROM r GROUP BY session_id, run"""
    ),
)
def _(spark, d):
    """The events in one batch, then a closing row, so that no run stays open."""
    folder = f"{shared_dir(utc(spark))}/sessionloom/loops-{uuid.uuid4().hex}"
    e = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    points = e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), "ts", F.unix_millis("ts").alias("at_ms"),
        (F.col("event_type") == "signup").cast("int").alias("turn"),
    )
    closing = points.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select(
        F.lit("end").alias("session_id"), "ts", F.unix_millis("ts").alias("at_ms"), F.lit(1).alias("turn")
    )
    for rows in (points, closing):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(points.schema).parquet(f"{folder}/in").withWatermark("ts", "2 days")
        out = J.to_table(J.stateful_loops(stream), path=f"{folder}/out", checkpoint=f"{folder}/checkpoint")
    return out


@query(
    "stream_usage_upsert",
    sql(
        """SELECT id, arg_min(tool, seq) AS tool, arg_min(session_id, seq) AS session_id, arg_min(model, seq) AS model, epoch_ms(arg_min(ts, seq)) AS ms,
 coalesce(arg_max(project_path, seq) FILTER (coalesce(project_path, '') <> ''), '') AS project, arg_max(input, seq) AS input, arg_max(output, seq) AS output,
 arg_max(cache_read, seq) AS cache_read, arg_max(cache_write, seq) AS cache_write FROM identified GROUP BY id""",
        "identified",
    ),
)
def _(spark, d):
    """In two calls of several micro-batches; the second one goes on where the first one ended."""
    path = f"{shared_dir(spark)}/sessionloom/usage-{uuid.uuid4().hex}"
    events = usage_identity(B.usage_raw(spark, d)).withColumn("project", F.coalesce("project_path", F.lit("")))
    columns = ("id", "seq", "tool", "session_id", "project", "model", "ts", "input", "output", "cache_read", "cache_write")
    schema = "id string, seq long, tool string, session_id string, project string, model string, ts timestamp, input long, output long, cache_read long, cache_write long"
    for part in (0, 1):
        events.where(F.col("seq") % 2 == part).select(*columns).repartition(4, "seq").write.mode("append").parquet(f"{path}/in")
        J.stream_usage_upsert(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), f"{path}/out")
    return J.combined_usage(J.batches(spark, f"{path}/out", J.STORED_SCHEMA)).select(
        "id", "tool", "session_id", "model", F.unix_millis("ts").alias("ms"), "project", "input", "output", "cache_read", "cache_write"
    )


@query("stream_sync", sql("SELECT 'k' || (doc_id % 500) AS key, arg_max(sha256(text), doc_id) AS hash FROM documents GROUP BY 1"))
def _(spark, d):
    """In two calls on one table."""
    docs = B.table(utc(spark), d, "documents").select(
        F.concat(F.lit("k"), (F.col("doc_id") % 500).cast("string")).alias("key"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("seq")
    )
    path = f"{shared_dir(spark)}/sessionloom/remote-{uuid.uuid4().hex}"
    for part in (0, 1):
        docs.where(F.col("seq") % 2 == part).write.mode("append").parquet(f"{path}/in")
        J.stream_sync(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), f"{path}/out")
    return J.latest_hashes(J.batches(spark, f"{path}/out", J.SNAPSHOT_SCHEMA)).select("key", "hash")
