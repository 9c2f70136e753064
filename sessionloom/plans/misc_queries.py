"""Remaining operators: price lists, intents, filters, projections, evidence."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import text as T
from ..functions.dates import ymd
from ..operators import archive as A
from ..operators import facets, report, usage
from ..operators import tenants as N
from ..sources import pricing as P
from . import stream_queries  # noqa: F401  (shared SQL)
from .registry import cte, query, sql
from .session_queries import _s
from .usage_queries import NOW, _base_df, _usage
from .why import why


@query(
    "load_pricing",
    sql("SELECT 'm' || p_partkey AS model, p_retailprice / 1000 AS input, p_size::DOUBLE AS output, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE END AS cache_read FROM part WHERE p_partkey % 7 <> 0"),
)
def _(spark, d):
    n = F.col("p_partkey")
    entry = F.struct(
        (F.col("p_retailprice") / 1000).alias("input_cost_per_token"), F.when(n % 7 != 0, F.col("p_size")).alias("output_cost_per_token"),
        F.when(n % 3 == 0, F.lit("0.5").cast("string")).alias("x"),
    )
    good = F.regexp_replace(F.to_json(entry), '"x":"0.5"', '"cache_read_input_token_cost":0.5')
    bad = F.when(n % 3 == 1, F.regexp_replace(good, "}$", ',"cache_read_input_token_cost":"none"}')).otherwise(good)
    texts = B.table(spark, d, "part").select(F.concat(F.lit('{"m'), n.cast("string"), F.lit('":'), bad, F.lit("}")).alias("value"))
    return P.parse_price_json(texts).select("model", "input", "output", "cache_read")


@query("merge_prices", sql("SELECT 'm' || p_partkey AS model, CASE WHEN p_partkey % 4 = 0 THEN 9.0::DOUBLE WHEN p_partkey % 2 = 0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS input, p_partkey % 2 = 0 AS is_override FROM part"))
def _(spark, d):
    n = F.col("p_partkey")

    def layer(cond: str, price: float):
        name = F.concat(F.lit("m"), n.cast("string")).alias("model")
        return B.table(spark, d, "part").where(cond).select(name, *[F.lit(price).alias(r) for r in P.RATES])

    return P.merge_prices(layer("p_partkey % 4 = 0", 9.0), layer("p_partkey % 2 = 0", 5.0), layer("true", 1.0)).select("model", "input", "is_override")


@query("filter_usage", sql(f"SELECT seq FROM usage WHERE ts <= TIMESTAMP '{NOW}' AND tool = 'claude-code' AND model = 'gpt-5.4' AND input + output + cache_read + cache_write > 0", "usage"))
def _(spark, d):
    u = usage.normalise_project(_usage(spark, d))
    return usage.filter_usage(u, NOW, harness="claude", model="gpt-5.4").select("seq")


@query("in_range_local", sql("SELECT project, CAST(sum(tokens) AS BIGINT) AS tokens FROM base_local WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' GROUP BY 1", "base_local"))
def _(spark, d):
    r = report.in_range_local(_base_df(spark, d, "America/Bogota"), date(2024, 1, 5), date(2024, 1, 10))
    return r.groupBy("project").agg(F.sum("tokens").alias("tokens"))


@query("lookup_intents", sql("SELECT CASE WHEN tool = 'claude' THEN 'claude-code' ELSE tool END AS tool, session_id, coalesce(nullif(trim(custom_title), ''), nullif(trim(first_prompt), '')) AS intent FROM sess", "sess"))
def _(spark, d):
    return facets.lookup_intents(_s(spark, d))


@query("archive_summaries", sql("SELECT 'o' || doc_id AS hash, n_chars AS source_bytes FROM documents WHERE doc_id % 4 < 2"))
def _(spark, d):
    n = F.col("doc_id")
    body = F.to_json(F.struct(F.lit("archive_summary").alias("type"), F.when(n % 4 == 3, 2).otherwise(1).alias("version"), F.col("n_chars").alias("sourceBytes")))
    other = F.lit('{"type":"user"}')
    lines = B.table(spark, d, "documents").select(
        F.concat(F.lit("o"), n.cast("string")).alias("hash"),
        F.posexplode(F.when(n % 4 == 2, F.array(body, other, other)).when(n % 4 == 1, F.array(other, body, other)).otherwise(F.array(other, other, body))).alias("line_no", "value"),
    )
    return A.archive_summaries(lines).select("hash", F.get_json_object("summary", "$.sourceBytes").cast("long").alias("source_bytes"))


@query("server_projection", sql("SELECT file_path, custom_title AS title, first_prompt AS opening, branch, error_count > 0 AS errored, message_count FROM sess", "sess"))
def _(spark, d):
    return N.server_projection(_s(spark, d)).select("file_path", "title", "opening", "branch", "errored", "message_count")


@query(
    "number_formats",
    sql(
        """SELECT o_orderkey, CASE WHEN v >= 1000000000 THEN printf('%.1f', v / 1e9::DOUBLE) || 'B' WHEN v >= 1000000 THEN printf('%.1f', v / 1e6::DOUBLE) || 'M' WHEN v >= 1000 THEN printf('%.1f', v / 1e3::DOUBLE) || 'K' ELSE v::VARCHAR END AS tokens,
 CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END AS hour FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) // 2 * 2 * (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 4096 END) + 1 AS v, o_orderkey % 24 AS h FROM orders)"""
    ),
)
def _(spark, d):
    v = F.floor(F.floor("o_totalprice") / 2).cast("long") * 2 * F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(4096) + 1
    return B.table(spark, d, "orders").select("o_orderkey", T.format_tokens(v).alias("tokens"), T.hour_label(F.col("o_orderkey") % 24).alias("hour"))


@query("short_path", sql("SELECT doc_id, source || '/' || doc_id || '.md' AS short FROM documents"))
def _(spark, d):
    path = F.concat(F.lit("/a/b/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return B.table(spark, d, "documents").select("doc_id", T.short_path(path).alias("short"))


cte("sess_work", "SELECT cwd AS repo, file_path AS session_key, epoch_ms(started_at) AS start_ms, epoch_ms(ended_at) AS end_ms, list_distinct(string_split(files_touched || ',' || files_read, ',')) AS files FROM sess", "sess")
cte(
    "sess_commits",
    "SELECT cwd AS repo, 'k' || conv_id AS sha, epoch_ms(ended_at) + (conv_id % 5) * 1800000 AS at_ms, ['src/f2.py', 'src/f3.py'] AS files FROM sess",
    "sess",
)


def _why(spark, d):
    s = _s(spark, d)
    n = F.regexp_extract("file_path", r"s(\d+)\.jsonl$", 1).cast("long")
    end = F.unix_millis("ended_at")
    work = s.select(F.col("cwd").alias("repo"), F.col("file_path").alias("session_key"), F.unix_millis("started_at").alias("start_ms"), end.alias("end_ms"), F.array_union("files_touched", "files_read").alias("files"))
    commits = s.select(
        F.col("cwd").alias("repo"), F.concat(F.lit("k"), n.cast("string")).alias("sha"), (end + (n % 5) * 1_800_000).alias("at_ms"),
        F.array(F.lit("src/f2.py"), F.lit("src/f3.py")).alias("files"), F.lit("that the eron").alias("subject"),
    )
    return why(commits, work, s, B.message_rows(spark, d), ["repo"])


@query(
    "why_evidence",
    sql(
        """SELECT sha, session_key, confidence, CAST(place AS INTEGER) AS place FROM (SELECT c.repo, sha, session_key, CASE WHEN n > 0 THEN 'files+time' ELSE 'time-only' END AS confidence,
 row_number() OVER (PARTITION BY c.repo, sha ORDER BY n * 10.0::DOUBLE - abs(at_ms - end_ms)::DOUBLE / 3600000.0::DOUBLE DESC, start_ms DESC, session_key) AS place
 FROM sess_commits c JOIN sess_work w ON w.repo = c.repo AND start_ms <= at_ms AND at_ms <= end_ms + 7200000, LATERAL (SELECT len(list_intersect(c.files, w.files)) AS n)) WHERE place <= 5""",
        "sess_commits", "sess_work",
    ),
)
def _(spark, d):
    return _why(spark, d)["evidence"].select("sha", "session_key", "confidence", "place")


@query("why_excerpts")
def _(spark, d):
    return _why(spark, d)["excerpts"]


@query(
    "read_documents_page",
    sql("SELECT doc_id, CAST(o AS INTEGER) AS \"offset\", substr(text, o + 1, 1000) AS text, CASE WHEN o + 1000 < length(text) THEN CAST(o + 1000 AS INTEGER) END AS next_offset FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS o FROM documents)"),
)
def _(spark, d):
    from ..operators.sessions import page_text

    docs = B.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return page_text(docs, 1000, "doc_id").select("doc_id", "offset", "text", "next_offset")


@query("dense_weeks", sql("SELECT strftime(week, '%Y-%m-%d') AS week FROM weekly", "weekly"))
def _(spark, d):
    days = report.daily_rollup(_base_df(spark, d)).where("grain = 'day'")
    from ..functions.dates import week_ending

    return report.dense_weeks(days.select(week_ending(F.col("day")).alias("week"))).select(ymd(F.col("week")).alias("week"))
