"""Queries over usage events: summaries, prices, the daily report and its facets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.dates import choose_range, local_date, ymd
from ..operators import facets, pricing, report, usage
from ..sources.pricing import resolve_models
from .registry import cte, query, sql

NOW = "2024-01-25 12:00:00"
TODAY = date(2024, 1, 25)
ZONE = "America/Bogota"  # five hours behind UTC all year

PROJECT_SQL = """CASE WHEN {n} = 0 THEN NULL WHEN {n} = 1 THEN '/tmp/scratch'
 WHEN {n} = 2 THEN '/Users/ana/Developer/p2/sub' ELSE '/srv/work/p' || ({n}) END"""

cte(
    "events_k",
    """SELECT event_id AS seq, date_trunc('millisecond', ts) AS ts, user_id, value,
  coalesce(CAST(props->>'$.k' AS BIGINT), 0) AS k,
  CASE event_type WHEN 'click' THEN 'claude-code' WHEN 'view' THEN 'codex' WHEN 'purchase' THEN 'opencode'
       WHEN 'error' THEN 'cursor' ELSE 'antigravity' END AS tool FROM events""",
)
cte(
    "usage_raw",
    f"""SELECT seq, tool,
  CASE tool WHEN 'claude-code' THEN 'anthropic' WHEN 'codex' THEN 'openai' ELSE 'openrouter' END AS provider,
  (['claude-opus-4-8','claude-haiku-4-5-20251001','gpt-5.4','anthropic/claude-sonnet-4-6','claude-opus-9','mystery-1','gpt-5.5','<synthetic>'])[k % 8 + 1] AS model,
  ts, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
  {PROJECT_SQL.format(n='user_id % 12')} AS project_path,
  CASE WHEN k = 13 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) * 100 END AS input,
  CASE WHEN k = 13 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) * 10 END AS output,
  CASE WHEN k = 13 THEN 0 ELSE k * 1000 END AS cache_read,
  CASE WHEN k = 13 THEN 0 ELSE k * 100 END AS cache_write,
  CASE WHEN k = 13 THEN 0 WHEN k % 3 = 0 THEN k * 50 ELSE 0 END AS cache_write_1h,
  CASE WHEN tool = 'opencode' AND k % 4 = 1 THEN value / 100.0 END AS cost_usd,
  CASE WHEN k % 10 = 0 THEN 'fast' WHEN k % 10 < 5 THEN 'standard' END AS speed,
  CASE WHEN k % 7 = 0 THEN 'a' || user_id || '-' || (k % 3) END AS agent_id,
  CASE WHEN k % 7 = 0 THEN (['explore','review','plan'])[k % 3 + 1] END AS agent_type,
  CASE WHEN k % 6 <> 0 THEN 'b' || (user_id % 3) END AS branch,
  CASE WHEN k % 5 <> 0 THEN 'r' || (CASE WHEN seq % 10 = 9 THEN seq - 1 ELSE seq END) END AS dedup_key
FROM events_k""",
    "events_k",
)
cte(
    "usage",
    """SELECT first_seq AS seq, * EXCLUDE (seq, rn, first_seq) FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(dedup_key, 'seq' || seq)
     ORDER BY input + output + cache_read + cache_write DESC, coalesce(cost_usd, 0) DESC,
              CASE WHEN speed = 'fast' THEN 0 ELSE 1 END, seq) AS rn,
    min(seq) OVER (PARTITION BY coalesce(dedup_key, 'seq' || seq)) AS first_seq FROM usage_raw) WHERE rn = 1""",
    "usage_raw",
)
cte(
    "prices",
    """SELECT * FROM (VALUES
 ('claude-opus-4-8',5e-6,25e-6,0.5e-6,6.25e-6,NULL,NULL,NULL,NULL),('claude-opus-4-7',5e-6,25e-6,0.5e-6,6.25e-6,NULL,NULL,NULL,NULL),
 ('claude-opus-4-6',5e-6,25e-6,0.5e-6,6.25e-6,NULL,NULL,NULL,NULL),('claude-opus-4-5',5e-6,25e-6,0.5e-6,6.25e-6,NULL,NULL,NULL,NULL),
 ('claude-opus-4',15e-6,75e-6,1.5e-6,18.75e-6,NULL,NULL,NULL,NULL),('claude-sonnet-4-6',3e-6,15e-6,0.3e-6,3.75e-6,NULL,NULL,NULL,NULL),
 ('claude-haiku-4-5',1e-6,5e-6,0.1e-6,1.25e-6,NULL,NULL,NULL,NULL),('claude-fable-5',10e-6,50e-6,1e-6,12.5e-6,NULL,NULL,NULL,NULL),
 ('gpt-5.5',5e-6,30e-6,0.5e-6,5e-6,10e-6,45e-6,1e-6,NULL),('gpt-5.4',2.5e-6,15e-6,0.25e-6,2.5e-6,NULL,NULL,NULL,NULL))
 AS t(price_key, r_in, r_out, r_read, r_write, a_in, a_out, a_read, a_write)""",
)
# Independent price match: containment of key in model or model in key, raw and normalised.
_CONTAINS = """(len(list_filter(range(1, len({v}) + 1), lambda i: substr({v}, i, len({k})) = {k}
   AND (i = 1 OR NOT regexp_matches(substr({v}, i - 1, 1), '[A-Za-z0-9]'))
   AND (i + len({k}) > len({v}) OR NOT regexp_matches(substr({v}, i + len({k}), 1), '[A-Za-z0-9]'))
   AND NOT (regexp_matches({k}, '[0-9]$') AND regexp_matches(substr({v}, i + len({k})), '^[-.][0-9]+')
        AND NOT regexp_matches(substr({v}, i + len({k})), '^[-.][0-9]{{8}}([^0-9A-Za-z]|$)')))) > 0)"""
cte(
    "resolved",
    f"""SELECT m.model, coalesce(d.price_key, f.price_key) AS price_key,
   CASE WHEN d.price_key IS NULL THEN f.price_key END AS priced_as, p.* EXCLUDE (price_key),
   CASE WHEN m.model LIKE '%claude-opus-4-8%' THEN 2.0 ELSE 1.0 END::DOUBLE AS fast
 FROM (SELECT DISTINCT model, lower(regexp_replace(model, '[.@]', '-', 'g')) AS nm FROM usage_raw) m
 LEFT JOIN (SELECT model, price_key FROM (SELECT m.model, p.price_key,
     row_number() OVER (PARTITION BY m.model ORDER BY (m.model = p.price_key) DESC, len(p.price_key) DESC, p.price_key) rn
   FROM (SELECT DISTINCT model, lower(regexp_replace(model, '[.@]', '-', 'g')) AS nm FROM usage_raw) m,
        (SELECT price_key, lower(regexp_replace(price_key, '[.@]', '-', 'g')) AS nk FROM prices) p
   WHERE {_CONTAINS.format(v='m.model', k='p.price_key')} OR {_CONTAINS.format(v='p.price_key', k='m.model')}
      OR {_CONTAINS.format(v='m.nm', k='p.nk')} OR {_CONTAINS.format(v='p.nk', k='m.nm')}) WHERE rn = 1) d ON d.model = m.model
 LEFT JOIN (VALUES ('claude-opus', 'claude-opus-4-8'), ('claude-fable', 'claude-fable-5'), ('claude-sonnet', 'claude-sonnet-4-6'),
    ('claude-haiku', 'claude-haiku-4-5'), ('gpt-5', 'gpt-5.5')) f(stem, price_key) ON d.price_key IS NULL AND contains(m.nm, f.stem)
 LEFT JOIN prices p ON p.price_key = coalesce(d.price_key, f.price_key)""",
    "usage_raw", "prices",
)


def _cost_expr(prefix: str = "") -> str:
    def part(name: str, base: str, above: str) -> str:
        return f"(t_{name} - o_{name}) * {base} + o_{name} * coalesce({above}, {base})"

    return " + ".join(
        [
            "CAST(0.0 AS DOUBLE)",
            part("input", "r_in", "a_in"), part("output", "r_out", "a_out"),
            part("read", "coalesce(r_read, r_in * 0.1::DOUBLE)", "a_read"),
            part("w5", "coalesce(r_write, r_in * 1.25::DOUBLE)", "a_write"),
            part("w1", "(r_in * 2.0::DOUBLE)", "(a_in * 2.0::DOUBLE)"),
        ]
    ).replace("CAST(0.0 AS DOUBLE) + ", "")


def _base(day: str) -> str:
    over = "greatest({c} - 200000, 0)"
    counters = {
        "input": "input", "output": "output", "read": "cache_read",
        "w5": "greatest(cache_write - cache_write_1h, 0)", "w1": "cache_write_1h",
    }
    sums = ", ".join(
        f"CAST(sum(CASE WHEN cost_usd IS NULL THEN {c} ELSE 0 END) AS BIGINT) AS t_{n}, "
        f"CAST(sum(CASE WHEN cost_usd IS NULL THEN {over.format(c=c)} ELSE 0 END) AS BIGINT) AS o_{n}"
        for n, c in counters.items()
    )
    return f"""SELECT g.day, g.hour, g.tool, g.provider, g.model, g.speed, g.session_id, g.project, g.branch, g.agent_id, g.agent_type,
  messages, input, output, cache_read, cache_write, input + output + cache_read + cache_write AS tokens,
  recorded + coalesce(CAST(floor(({_cost_expr()}) * (CASE WHEN g.speed = 'fast' THEN coalesce(fast, 1.0) ELSE 1.0 END)::DOUBLE * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT), 0) AS cost_nano,
  coalesce(greatest(CAST(floor((((cache_read - read_over) * r_in + read_over * coalesce(a_in, r_in))
     - ((cache_read - read_over) * coalesce(r_read, r_in * 0.1::DOUBLE) + read_over * coalesce(a_read, coalesce(r_read, r_in * 0.1::DOUBLE))))
     * (CASE WHEN g.speed = 'fast' THEN coalesce(fast, 1.0) ELSE 1.0 END)::DOUBLE * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT), 0), 0) AS saved_nano,
  r.price_key, r.priced_as, t_input + t_output + t_read + t_w5 + t_w1 AS open_tokens
FROM (SELECT CAST({day} AS DATE) AS day, CAST(hour({day}) AS BIGINT) AS hour, tool, provider, model, coalesce(speed, 'standard') AS speed, session_id,
    CASE WHEN project_path IS NULL THEN 'unknown' WHEN project_path LIKE '/Users/%' THEN 'p2' ELSE regexp_extract(project_path, '([^/]+)$', 1) END AS project,
    branch, agent_id, agent_type, count(*) AS messages, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
    CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
    CAST(sum(greatest(cache_read - 200000, 0)) AS BIGINT) AS read_over,
    CAST(coalesce(sum(CAST(floor(cost_usd * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)), 0) AS BIGINT) AS recorded, {sums}
  FROM usage GROUP BY ALL) g LEFT JOIN (SELECT model, price_key, priced_as, fast, r_in::DOUBLE r_in, r_out::DOUBLE r_out, r_read::DOUBLE r_read,
     r_write::DOUBLE r_write, a_in::DOUBLE a_in, a_out::DOUBLE a_out, a_read::DOUBLE a_read, a_write::DOUBLE a_write FROM resolved) r ON r.model = g.model"""


cte("base", _base("ts"), "usage", "resolved")
cte("base_local", _base("(ts - INTERVAL 5 HOUR)"), "usage", "resolved")
CENTS = "CAST(floor(CAST(sum(cost_nano) AS BIGINT)::DOUBLE / 1e7::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
USD = "floor(CAST({x} AS BIGINT)::DOUBLE / 1e7::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"
_ROLL = "CAST(sum(tokens) AS BIGINT) AS tokens, " + CENTS + " AS cost_cents, count(DISTINCT tool || '|' || session_id) AS sessions, CAST(sum(messages) AS BIGINT) AS messages"
_NULLS = {"tool": "NULL::VARCHAR", "provider": "NULL::VARCHAR", "model": "NULL::VARCHAR", "project": "NULL::VARCHAR", "hour": "NULL::BIGINT"}


def _rollup(source: str) -> str:
    parts = []
    for grain, keys in report.GRAINS.items():
        cols = ", ".join(f"{c if c in keys else n} AS {c}" for c, n in _NULLS.items())
        group = ", ".join(["day", *keys])
        inner = f"SELECT '{grain}' AS grain, day, {cols}, {_ROLL} FROM {source} b GROUP BY {group}"
        parts.append(inner)
    return " UNION ALL ".join(parts)


cte("rollup", _rollup("base"), "base")
cte("rollup_local", _rollup("base_local"), "base_local")
cte(
    "top_level",
    """SELECT grain, tool, provider, model, project, hour, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_cents) AS BIGINT) AS cost_cents,
 CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(messages) AS BIGINT) AS messages FROM rollup GROUP BY ALL""",
    "rollup",
)
cte(
    "prs",
    """SELECT 'https://git.example/r/pull/' || o_orderkey AS url, 'r' || (o_custkey % 20) AS repo, o_orderkey AS number,
 CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END AS state,
 coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions,
 DATE '2023-12-20' + CAST(o_orderkey % 45 AS INTEGER) AS created_day,
 CASE WHEN o_orderstatus = 'F' THEN DATE '2023-12-20' + CAST(o_orderkey % 45 AS INTEGER) + CAST(o_orderkey % 5 AS INTEGER) END AS merged_day
 FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions, count(*) AS deletions FROM lineitem GROUP BY 1) l
 ON l_orderkey = o_orderkey""",
)
WEEK = "CAST({d} AS DATE) + CAST((7 - dayofweek({d})) % 7 AS INTEGER)"
cte(
    "counted",
    f"""SELECT *, coalesce(project_path, 'unknown') AS project, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day,
 input + output + cache_read + cache_write AS tokens FROM usage
 WHERE ts <= TIMESTAMP '{NOW}' AND input + output + cache_read + cache_write > 0""",
    "usage",
)


def _usage(spark, d):
    return usage.dedupe_usage(B.usage_raw(spark, d))


def _base_df(spark, d, tz="UTC"):
    raw = B.usage_raw(spark, d)
    return pricing.cost_base(usage.dedupe_usage(raw), B.prices(spark), tz, models=raw)


def _counted(spark, d):
    return usage.filter_usage(usage.normalise_project(_usage(spark, d)), NOW)


_USAGE_OUT = (
    "seq, tool, provider, model, session_id, project_path, input, output, cache_read, cache_write, cache_write_1h, cost_usd, speed, "
    "agent_id, agent_type, branch, dedup_key"
)


@query("dedupe_usage", sql(f"SELECT {_USAGE_OUT} FROM usage", "usage"))
def _(spark, d):
    return _usage(spark, d).select(*[c.strip() for c in _USAGE_OUT.split(",")])


@query(
    "dedupe_usage_order",
    sql(
        """WITH c AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'hot' WHEN event_id % 11 = 0 THEN NULL ELSE 'k' || (event_id % 97) END AS key,
  100 + CASE WHEN event_id % 97 > 60 AND event_id % 7 = 0 THEN 1 ELSE 0 END AS v, (event_id * 7919 % 1000) / 8.0 AS c, event_id % 4 = 1 AND event_id % 97 < 80 AS f FROM events)
 SELECT min(seq) AS seq, 'e' || list_reduce(list({'seq': seq, 'v': v, 'c': c, 'f': f} ORDER BY seq),
  lambda a, b: CASE WHEN b.v > a.v OR (b.v = a.v AND (b.c > a.c OR (b.f AND NOT a.f))) THEN b ELSE a END).seq AS survivor FROM c WHERE key IS NOT NULL GROUP BY key
 UNION ALL SELECT seq, 'e' || seq FROM c WHERE key IS NULL"""
    ),
)
def _(spark, d):
    """Copies of equal volume that disagree in cost and speed; one response holds a third of all events."""
    seq = F.col("seq")
    speed = F.when((seq % 4 == 1) & (seq % 97 < 80), "fast").when(seq % 2 == 0, "standard")
    zero = F.lit(0).cast("long")
    events = B.usage_raw(spark, d).withColumns({
        "dedup_key": F.when(seq % 3 == 0, "hot").when(seq % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (seq % 97).cast("string"))),
        "input": F.lit(100).cast("long") + ((seq % 97 > 60) & (seq % 7 == 0)).cast("long"), "output": zero, "cache_read": zero, "cache_write": zero,
        "cost_usd": (seq * 7919 % 1000) / F.lit(8.0), "speed": speed, "session_id": F.concat(F.lit("e"), seq.cast("string")),
    })
    return usage.dedupe_usage(events).select("seq", F.col("session_id").alias("survivor"))


cte(
    "identified",
    """SELECT *, sha256(CASE WHEN dedup_key IS NOT NULL THEN tool || ':' || dedup_key ELSE
 fp || ':' || (row_number() OVER (PARTITION BY fp ORDER BY seq) - 1) END) AS id FROM (
 SELECT *, '["' || tool || '","' || session_id || '","' || model || '","' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z",{"input":' || input ||
   ',"output":' || output || ',"cacheRead":' || cache_read || ',"cacheWrite":' || cache_write || '}]' AS fp FROM usage_raw)""",
    "usage_raw",
)


@query("usage_identity", sql("SELECT seq, id FROM identified", "identified"))
def _(spark, d):
    return usage.usage_identity(B.usage_raw(spark, d)).select("seq", "id")


@query(
    "upsert_usage",
    sql(
        """, ids AS (SELECT coalesce(tool || ':' || dedup_key, 'k' || seq) AS id, * FROM usage_raw),
 old AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) rn FROM ids WHERE seq % 3 <> 0 AND seq % 10 <> 9) WHERE rn = 1),
 new AS (SELECT id, max_by(input, seq) input, max_by(output, seq) output, max_by(cache_read, seq) cache_read, max_by(cache_write, seq) cache_write,
   max_by(project_path, seq) FILTER (WHERE project_path IS NOT NULL) AS project, max_by(session_id, seq) session_id FROM ids WHERE seq % 3 = 0 OR seq % 10 = 9 GROUP BY id)
 SELECT id, coalesce(old.session_id, new.session_id) AS session_id, coalesce(new.project, old.project_path, '') AS project,
  coalesce(new.input, old.input) AS input, coalesce(new.output, old.output) AS output, coalesce(new.cache_read, old.cache_read) AS cache_read,
  coalesce(new.cache_write, old.cache_write) AS cache_write,
  coalesce(old.id IS NULL OR new.input <> old.input OR new.output <> old.output OR new.cache_read <> old.cache_read OR new.cache_write <> old.cache_write
   OR (new.project IS NOT NULL AND new.project <> coalesce(old.project_path, '')), false) AS changed
 FROM (SELECT * FROM old) old FULL JOIN new USING (id)""".replace(", ids AS", "SELECT * FROM (WITH ids AS", 1)
        + ")",
        "usage_raw",
    ),
)
def _(spark, d):
    events = B.usage_raw(spark, d).withColumn(
        "id", F.coalesce(F.concat("tool", F.lit(":"), "dedup_key"), F.concat(F.lit("k"), F.col("seq").cast("string")))
    ).withColumn("project", F.coalesce("project_path", F.lit("")))
    later = (F.col("seq") % 3 == 0) | (F.col("seq") % 10 == 9)
    empty = events.select(*usage.STORED).where("false")
    stored = usage.upsert_usage(empty, events.where(~later))
    out = usage.upsert_usage(stored, events.where(later))
    return out.select("id", "session_id", "project", "input", "output", "cache_read", "cache_write", "changed")


@query(
    "usage_periods",
    sql(
        """SELECT unnest(['today','7d','30d','365d','all']) AS period, unnest(['2024-01-25','2024-01-19','2023-12-27','2023-01-26',NULL]) AS from_day,
 unnest([a,b,c,e,f]) AS tokens FROM (SELECT CAST(coalesce(sum(tokens) FILTER (WHERE day >= DATE '2024-01-25'), 0) AS BIGINT) a,
 CAST(coalesce(sum(tokens) FILTER (WHERE day >= DATE '2024-01-19'), 0) AS BIGINT) b, CAST(coalesce(sum(tokens) FILTER (WHERE day >= DATE '2023-12-27'), 0) AS BIGINT) c,
 CAST(coalesce(sum(tokens) FILTER (WHERE day >= DATE '2023-01-26'), 0) AS BIGINT) e, CAST(coalesce(sum(tokens), 0) AS BIGINT) f FROM counted)""",
        "counted",
    ),
)
def _(spark, d):
    return usage.usage_periods(_counted(spark, d), TODAY, ZONE)


def _groups_oracle(key: str) -> str:
    return sql(
        f"""SELECT {key} AS key, CAST(sum(tokens) AS BIGINT) AS tokens, any_value(n) AS total_groups, any_value(n) > 50 AS truncated
 FROM counted, (SELECT count(DISTINCT {key}) AS n FROM counted WHERE day >= DATE '2023-12-27') WHERE day >= DATE '2023-12-27'
 GROUP BY 1 ORDER BY tokens DESC, key LIMIT 50""",
        "counted",
    )


for _name, _key in {
    "day": "strftime(day, '%Y-%m-%d')", "project": "project", "harness": "tool", "model": "model", "task": "tool || ':' || session_id",
}.items():

    def _run(spark, d, group=_name):
        return usage.usage_groups(usage.in_period(_counted(spark, d), TODAY, "30d", ZONE), group, 50, ZONE)

    query(f"usage_by_{_name}", _groups_oracle(_key))(_run)


@query(
    "usage_overview",
    sql(
        """SELECT count(DISTINCT tool || ':' || session_id) AS sessions, count(DISTINCT day) AS active_days, CAST(sum(input) AS BIGINT) AS input,
 CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
 (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT tool AS t FROM counted)) AS measured_harnesses,
 (SELECT model FROM counted GROUP BY model ORDER BY sum(tokens) DESC, model LIMIT 1) AS top_model,
 (SELECT strftime(day, '%Y-%m-%d') FROM counted GROUP BY day ORDER BY sum(tokens) DESC, day LIMIT 1) AS most_active_day FROM counted""",
        "counted",
    ),
)
def _(spark, d):
    return usage.usage_overview(_counted(spark, d), ZONE)


@query("usage_daily", sql("SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(tokens) AS BIGINT) AS tokens FROM counted GROUP BY 1", "counted"))
def _(spark, d):
    return usage.usage_daily(_counted(spark, d), ZONE).select(ymd(F.col("day")).alias("day"), "tokens")


cte("project_days", "SELECT DISTINCT project, day FROM counted WHERE tool = 'codex' AND model = 'gpt-5.4'", "counted")
cte(
    "project_runs",
    "SELECT project, min(day) AS f, max(day) AS t, count(*) AS n FROM (SELECT project, day, day - CAST(row_number() OVER (PARTITION BY project ORDER BY day) AS INTEGER) AS a FROM project_days) GROUP BY project, a",
    "project_days",
)


def _project_days(spark, d):
    c = _counted(spark, d).where("tool = 'codex' and model = 'gpt-5.4'")
    return c.select("project", local_date(F.col("ts"), ZONE).alias("day"))


@query(
    "usage_streaks",
    sql(
        """SELECT project, coalesce(max(CASE WHEN f <= DATE '2024-01-25' AND t >= DATE '2024-01-24' THEN n END), 0) AS current_days, max(n) AS longest_days,
 CAST(sum(n) AS BIGINT) AS active_days FROM project_runs GROUP BY project""",
        "project_runs",
    ),
)
def _(spark, d):
    return usage.streaks(_project_days(spark, d), TODAY, ["project"])


@query(
    "report_streaks",
    sql(
        """SELECT project, coalesce(max(CASE WHEN f <= DATE '2024-01-25' AND t >= DATE '2024-01-25' THEN n END), 0) AS current_days, max(n) AS longest_days,
 CAST(sum(n) AS BIGINT) AS active_days FROM project_runs GROUP BY project""",
        "project_runs",
    ),
)
def _(spark, d):
    return usage.streaks(_project_days(spark, d), TODAY, ["project"], may_end_yesterday=False)


@query(
    "longest_streak",
    sql(
        """SELECT project, n AS days, strftime(f, '%Y-%m-%d') AS from_day, strftime(t, '%Y-%m-%d') AS to_day FROM
 (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, f) rn FROM project_runs) WHERE rn = 1""",
        "project_runs",
    ),
)
def _(spark, d):
    out = usage.longest_streak(_project_days(spark, d), ["project"])
    return out.select("project", "days", ymd(F.col("from_day")).alias("from_day"), ymd(F.col("to_day")).alias("to_day"))


@query(
    "longest_gap",
    sql(
        """SELECT project, days, strftime(f, '%Y-%m-%d') AS from_day, strftime(t, '%Y-%m-%d') AS to_day FROM (
 SELECT *, row_number() OVER (PARTITION BY project ORDER BY days DESC, f) rn FROM (SELECT project, CAST(day - p - 1 AS BIGINT) AS days, p + 1 AS f, day - 1 AS t FROM
 (SELECT project, day, lag(day) OVER (PARTITION BY project ORDER BY day) AS p FROM project_days) WHERE day - p - 1 > 0)) WHERE rn = 1""",
        "project_days",
    ),
)
def _(spark, d):
    out = usage.longest_gap(_project_days(spark, d), ["project"])
    return out.select("project", "days", ymd(F.col("from_day")).alias("from_day"), ymd(F.col("to_day")).alias("to_day"))


@query(
    "resolve_models",
    sql("SELECT model, price_key, priced_as, r_in::DOUBLE AS input, r_out::DOUBLE AS output, fast AS fast_multiplier FROM resolved", "resolved"),
)
def _(spark, d):
    return resolve_models(B.usage_raw(spark, d).select("model"), B.prices(spark)).select(
        "model", "price_key", "priced_as", "input", "output", "fast_multiplier"
    )


@query(
    "event_cost",
    sql(
        """SELECT seq, coalesce(CAST(floor(cost_usd * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT), CAST(floor(c * (CASE WHEN speed = 'fast' THEN fast ELSE 1.0 END)::DOUBLE * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT), 0) AS cost_nano
 FROM (SELECT seq, cost_usd, speed, fast, """
        + _cost_expr()
        + """ AS c FROM (SELECT u.seq, u.cost_usd, u.speed, r.fast, r_in::DOUBLE r_in, r_out::DOUBLE r_out, r_read::DOUBLE r_read, r_write::DOUBLE r_write,
   a_in::DOUBLE a_in, a_out::DOUBLE a_out, a_read::DOUBLE a_read, a_write::DOUBLE a_write,
   input t_input, greatest(input - 200000, 0) o_input, output t_output, greatest(output - 200000, 0) o_output, cache_read t_read, greatest(cache_read - 200000, 0) o_read,
   greatest(cache_write - cache_write_1h, 0) t_w5, greatest(greatest(cache_write - cache_write_1h, 0) - 200000, 0) o_w5, cache_write_1h t_w1, greatest(cache_write_1h - 200000, 0) o_w1
   FROM usage u LEFT JOIN resolved r ON r.model = u.model))""",
        "usage", "resolved",
    ),
)
def _(spark, d):
    events = _usage(spark, d)
    return pricing.event_cost(events, resolve_models(events.select("model"), B.prices(spark))).select("seq", "cost_nano")


@query(
    "cost_by_model",
    sql(f"SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, {USD.format(x='sum(cost_nano)')} AS cost_usd FROM base GROUP BY model", "base"),
)
def _(spark, d):
    return pricing.cost_by(_base_df(spark, d), "model")


@query(
    "pricing_warnings",
    sql("SELECT model, priced_as, CAST(sum(open_tokens) AS BIGINT) AS tokens FROM base WHERE price_key IS NULL OR priced_as IS NOT NULL GROUP BY ALL HAVING sum(open_tokens) > 0", "base"),
)
def _(spark, d):
    return pricing.pricing_warnings(_base_df(spark, d))


_ROLL_OUT = "grain, strftime(day, '%Y-%m-%d') AS day, tool, provider, model, project, hour, tokens, cost_cents, sessions, messages"


@query("daily_rollup", sql(f"SELECT {_ROLL_OUT} FROM rollup_local", "rollup_local"))
def _(spark, d):
    return report.daily_rollup(_base_df(spark, d, ZONE)).withColumn("day", ymd(F.col("day")))


@query(
    "daily_entries",
    sql(
        """SELECT strftime(d.day, '%Y-%m-%d') AS day, d.tokens, d.cost_cents, d.sessions, d.messages,
 (SELECT string_agg(coalesce(h.messages, 0)::VARCHAR, ',' ORDER BY x) FROM range(0, 24) t(x) LEFT JOIN (SELECT * FROM rollup WHERE grain = 'hour') h ON h.hour = x AND h.day = d.day) AS hours,
 (SELECT string_agg(tool || '=' || t.sessions, ',' ORDER BY tool) FROM rollup t WHERE t.grain = 'tool' AND t.day = d.day) AS tools,
 (SELECT string_agg(provider || '=' || t.cost_cents, ',' ORDER BY provider) FROM rollup t WHERE t.grain = 'provider' AND t.day = d.day) AS providers
 FROM rollup d WHERE d.grain = 'day'""",
        "rollup",
    ),
)
def _(spark, d):
    e = report.daily_entries(report.daily_rollup(_base_df(spark, d)))

    def flat(column, field):
        return F.array_join(F.transform(F.map_entries(column), lambda p: F.concat(p["key"], F.lit("="), p["value"][field].cast("string"))), ",")

    return e.select(
        ymd(F.col("day")).alias("day"), "tokens", "cost_cents", "sessions", "messages",
        F.array_join(F.transform("hour_counts", lambda x: x.cast("string")), ",").alias("hours"),
        flat("by_tool", "sessions").alias("tools"), flat("by_provider", "cost_cents").alias("providers"),
    )


@query("top_level_breakdowns", sql("SELECT * FROM top_level", "top_level"))
def _(spark, d):
    return report.top_level(report.daily_rollup(_base_df(spark, d)))


def _split_rollup(spark, d):
    roll = report.daily_rollup(_base_df(spark, d))
    prior = roll.where("day <= date'2024-01-20'").withColumn("tokens", F.col("tokens") + 1)
    return prior, roll.where("day > date'2024-01-15'")


@query(
    "merge_daily",
    sql(f"SELECT {_ROLL_OUT.replace('tokens', 'tokens + CASE WHEN day > DATE $$2024-01-15$$ THEN 0 ELSE 1 END AS tokens')} FROM rollup", "rollup"),
)
def _(spark, d):
    return report.merge_daily(*_split_rollup(spark, d)).withColumn("day", ymd(F.col("day")))


@query(
    "subtract_excluded",
    sql(
        """SELECT grain, strftime(r.day, '%Y-%m-%d') AS day, tool, provider, model, project, hour, CASE WHEN grain = 'day' THEN tokens - coalesce(dt, 0) ELSE tokens END AS tokens,
 CASE WHEN grain = 'day' THEN cost_cents - coalesce(dc, 0) ELSE cost_cents END AS cost_cents, CASE WHEN grain = 'day' THEN sessions - coalesce(ds, 0) ELSE sessions END AS sessions, messages
 FROM rollup r LEFT JOIN (SELECT day, CAST(sum(tokens) AS BIGINT) dt, CAST(sum(cost_cents) AS BIGINT) dc, CAST(sum(sessions) AS BIGINT) ds FROM rollup
   WHERE grain = 'project' AND (project IN ('scratch', 'p3') OR project LIKE 'p1%') GROUP BY day) x ON x.day = r.day
 WHERE grain <> 'project' OR NOT (project IN ('scratch', 'p3') OR project LIKE 'p1%')""",
        "rollup",
    ),
)
def _(spark, d):
    kept = report.label_kept(F.col("project"), exclude=("scratch", "p3"), exclude_prefixes=("p1",))
    return report.subtract_excluded(report.daily_rollup(_base_df(spark, d)), kept).withColumn("day", ymd(F.col("day")))


@query("allow_deny_labels", sql("SELECT project, CAST(sum(tokens) AS BIGINT) AS tokens FROM base WHERE (project IN ('p3', 'unknown') OR project LIKE 'p1%') AND project <> 'p11' GROUP BY 1", "base"))
def _(spark, d):
    kept = report.keep_labels(_base_df(spark, d), "project", ("p3", "unknown"), ("p1",), ("p11",))
    return kept.groupBy("project").agg(F.sum("tokens").alias("tokens"))


@query("peak_hour", sql("SELECT hour AS peak_hour FROM top_level WHERE grain = 'hour' ORDER BY messages DESC, hour LIMIT 1", "top_level"))
def _(spark, d):
    return report.peak_hour(report.top_level(report.daily_rollup(_base_df(spark, d))))


@query("favorite_model", sql("SELECT tool, provider, model, messages FROM top_level WHERE grain = 'model' ORDER BY messages DESC, tool || '|' || provider || '|' || model LIMIT 1", "top_level"))
def _(spark, d):
    return report.favorite_model(report.top_level(report.daily_rollup(_base_df(spark, d))))


@query("report_summary", sql("SELECT CAST(sum(cost_cents) AS BIGINT) AS cost_cents, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(messages) AS BIGINT) AS messages, count(*) AS active_days FROM rollup WHERE grain = 'day'", "rollup"))
def _(spark, d):
    return report.summary(report.daily_rollup(_base_df(spark, d)))


cte(
    "weekly",
    f"""SELECT w.week, coalesce(u.tokens, 0) AS tokens, coalesce(u.cost_cents, 0) AS cost_cents, coalesce(u.sessions, 0) AS sessions, coalesce(u.messages, 0) AS messages,
 coalesce(n, 0) AS prs_merged, coalesce(a, 0) AS additions, coalesce(x, 0) AS deletions FROM
 (SELECT CAST(unnest(generate_series(min(wk), max(wk), INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT {WEEK.format(d='day')} AS wk FROM rollup WHERE grain = 'day')) w
 LEFT JOIN (SELECT {WEEK.format(d='day')} AS week, CAST(sum(tokens) AS BIGINT) tokens, CAST(sum(cost_cents) AS BIGINT) cost_cents, CAST(sum(sessions) AS BIGINT) sessions,
   CAST(sum(messages) AS BIGINT) messages FROM rollup WHERE grain = 'day' GROUP BY 1) u USING (week)
 LEFT JOIN (SELECT {WEEK.format(d='merged_day')} AS week, count(*) n, CAST(sum(additions) AS BIGINT) a, CAST(sum(deletions) AS BIGINT) x FROM prs WHERE state = 'merged' GROUP BY 1) p USING (week)""",
    "rollup", "prs",
)


@query("weekly_insights", sql("SELECT * REPLACE (strftime(week, '%Y-%m-%d') AS week) FROM weekly", "weekly"))
def _(spark, d):
    return report.weekly_insights(report.daily_rollup(_base_df(spark, d)), B.pull_requests(spark, d)).withColumn("week", ymd(F.col("week")))


@query("weekly_by_tool", sql(f"SELECT strftime({WEEK.format(d='day')}, '%Y-%m-%d') AS week, tool, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM rollup WHERE grain = 'tool' GROUP BY 1, 2", "rollup"))
def _(spark, d):
    return report.weekly_by_tool(report.daily_rollup(_base_df(spark, d))).withColumn("week", ymd(F.col("week")))


@query("weekday_counts", sql("SELECT CAST(dayofweek(day) AS BIGINT) AS weekday, CAST(sum(messages) AS BIGINT) AS messages FROM rollup WHERE grain = 'day' GROUP BY 1", "rollup"))
def _(spark, d):
    return report.weekday_counts(report.daily_rollup(_base_df(spark, d)))


@query(
    "weekly_highlights",
    sql(
        f"""SELECT strftime(week, '%Y-%m-%d') AS week, url, change, CASE WHEN week = DATE '2024-01-14' THEN 'kept note' END AS summary FROM
 (SELECT {WEEK.format(d='coalesce(merged_day, created_day)')} AS week, url, additions + deletions AS change FROM prs) WHERE week >= DATE '2024-01-01'""",
        "prs",
    ),
)
def _(spark, d):
    prior = spark.sql("SELECT date'2024-01-14' AS week, 'kept note' AS summary")
    return report.weekly_highlights(B.pull_requests(spark, d), date(2024, 1, 1), prior).withColumn("week", ymd(F.col("week")))


@query(
    "report_derived",
    sql(
        """SELECT strftime(rf, '%Y-%m-%d') AS record_from, span AS record_days, total / (span / 30.44::DOUBLE) AS cents_per_month, last4, prev4,
 CASE WHEN prev4 > 0 THEN last4::DOUBLE / prev4 END AS trend, last4::DOUBLE / total AS share_last4, total / messages AS cents_per_message,
 total / ns AS cents_per_session, total / nd AS cents_per_day, messages::DOUBLE / nd AS messages_per_day, tokens::DOUBLE / nd AS tokens_per_day FROM
 (SELECT CAST(sum(cost_cents) AS DOUBLE) total, CAST(sum(messages) AS BIGINT) messages, CAST(sum(tokens) AS BIGINT) tokens, count(*) nd,
   min(day) FILTER (WHERE cost_cents > 0) rf, CAST(greatest(DATE '2024-01-30' - min(day) FILTER (WHERE cost_cents > 0) + 1, 1) AS BIGINT) span FROM rollup WHERE grain = 'day'),
 (SELECT CAST(sum(cost_cents) FILTER (WHERE r <= 4) AS BIGINT) last4, CAST(coalesce(sum(cost_cents) FILTER (WHERE r > 4 AND r <= 8), 0) AS BIGINT) prev4 FROM
   (SELECT cost_cents, row_number() OVER (ORDER BY week DESC) r FROM weekly)), (SELECT count(*) ns FROM (SELECT DISTINCT tool, session_id FROM base))""",
        "weekly", "base",
    ),
)
def _(spark, d):
    base = _base_df(spark, d)
    roll = report.daily_rollup(base)
    return report.report_derived(roll, report.weekly_insights(roll, B.pull_requests(spark, d)), base.select("tool", "session_id").distinct(), date(2024, 1, 30))


@query(
    "calendar_heat",
    sql(
        """SELECT strftime(c.day, '%Y-%m-%d') AS day, CAST(dayofweek(c.day) AS BIGINT) AS weekday,
 CAST(CASE WHEN NOT inside THEN -1 WHEN coalesce(cost_cents, 0) = 0 THEN 0 WHEN cost_cents < 1000 THEN 1 WHEN cost_cents < 5000 THEN 2 WHEN cost_cents < 15000 THEN 3 ELSE 4 END AS BIGINT) AS cost_level,
 CAST(CASE WHEN NOT inside OR coalesce(tokens, 0) = 0 THEN -1 ELSE least(3, floor(tokens / peak * 4)) END AS BIGINT) AS quartile,
 CAST(CASE WHEN NOT inside THEN -1 WHEN coalesce(tokens, 0) = 0 THEN 0 ELSE least(4, 1 + floor(sqrt(tokens / peak) * 3.99::DOUBLE)) END AS BIGINT) AS strip_level FROM
 (SELECT CAST(x AS DATE) AS day, CAST(x AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-29' AS inside FROM (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-02-03', INTERVAL 1 DAY)) AS x)) c
 LEFT JOIN (SELECT day, tokens, cost_cents FROM rollup WHERE grain = 'day') r ON r.day = c.day,
 (SELECT CAST(max(tokens) AS DOUBLE) AS peak FROM rollup WHERE grain = 'day' AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-29')""",
        "rollup",
    ),
)
def _(spark, d):
    daily = report.daily_rollup(_base_df(spark, d)).where("grain = 'day'").select("day", "tokens", "cost_cents")
    return report.calendar_heat(daily, date(2024, 1, 3), date(2024, 1, 29)).withColumn("day", ymd(F.col("day")))


@query(
    "report_shape",
    sql("SELECT strftime(day, '%Y-%m-%d') AS date, tokens, cost_cents / 100.0::DOUBLE AS cost_usd, sessions, messages FROM rollup WHERE grain = 'day'", "rollup"),
)
def _(spark, d):
    return report.report_shape(report.daily_entries(report.daily_rollup(_base_df(spark, d)))).select("date", "tokens", "cost_usd", "sessions", "messages")


# --- facets -------------------------------------------------------------------
@query(
    "cache_stats",
    sql(
        f"""SELECT input AS input_tokens, output AS output_tokens, cw AS cache_write_tokens, cr AS cache_read_tokens,
 floor(cr / (cr + input + cw) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS hit_rate, {USD.format(x='saved')} AS saved_usd FROM
 (SELECT CAST(sum(input) AS BIGINT) input, CAST(sum(output) AS BIGINT) output, CAST(sum(cache_write) AS BIGINT) cw, CAST(sum(cache_read) AS BIGINT) cr, CAST(sum(saved_nano) AS BIGINT) saved FROM base)""",
        "base",
    ),
)
def _(spark, d):
    return facets.cache_stats(_base_df(spark, d))


@query(
    "subagent_types",
    sql(
        f"""SELECT agent_type, CAST(sum(tokens) AS BIGINT) AS tokens, {USD.format(x='sum(cost_nano)')} AS cost_usd, count(DISTINCT agent_id) AS dispatches, CAST(sum(messages) AS BIGINT) AS messages,
 floor(CAST(sum(cost_nano) AS BIGINT)::DOUBLE / 1e9::DOUBLE / count(DISTINCT agent_id) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS cost_per_dispatch_usd FROM base WHERE agent_id IS NOT NULL GROUP BY 1""",
        "base",
    ),
)
def _(spark, d):
    return facets.subagent_types(_base_df(spark, d))


@query(
    "subagent_totals",
    sql(
        f"""SELECT {USD.format(x='sub')} AS cost_usd, tokens, dispatches, floor(sub::DOUBLE / total * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS share_of_cost FROM
 (SELECT CAST(sum(cost_nano) AS BIGINT) total, CAST(sum(cost_nano) FILTER (WHERE agent_id IS NOT NULL) AS BIGINT) sub, CAST(sum(tokens) FILTER (WHERE agent_id IS NOT NULL) AS BIGINT) tokens, count(DISTINCT agent_id) dispatches FROM base)""",
        "base",
    ),
)
def _(spark, d):
    return facets.subagent_totals(_base_df(spark, d))


@query(
    "top_dispatches",
    sql(f"SELECT agent_id, min(agent_type) AS agent_type, min(project) AS project, strftime(min(day), '%Y-%m-%d') AS day, CAST(sum(tokens) AS BIGINT) AS tokens, {CENTS} AS cost_cents, CAST(sum(messages) AS BIGINT) AS messages FROM base WHERE agent_id IS NOT NULL GROUP BY agent_id ORDER BY cost_cents DESC, agent_id LIMIT 20", "base"),
)
def _(spark, d):
    return facets.top_dispatches(_base_df(spark, d)).withColumn("day", ymd(F.col("day")))


cte(
    "session_costs",
    f"""SELECT s.tool, s.session_id, b.branch, project, day, tokens, messages, cost_cents, subagent_cents FROM
 (SELECT tool, session_id, min(project) AS project, min(day) AS day, CAST(sum(tokens) AS BIGINT) tokens, CAST(sum(messages) AS BIGINT) messages, {CENTS} AS cost_cents,
   {CENTS.replace('sum(cost_nano)', 'sum(CASE WHEN agent_id IS NOT NULL THEN cost_nano ELSE 0 END)')} AS subagent_cents FROM base GROUP BY 1, 2) s
 LEFT JOIN (SELECT tool, session_id, branch FROM (SELECT tool, session_id, branch, row_number() OVER (PARTITION BY tool, session_id ORDER BY sum(cost_nano) DESC, branch) rn FROM base
   WHERE branch IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1) b ON b.tool = s.tool AND b.session_id = s.session_id""",
    "base",
)


@query("session_costs", sql("SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM session_costs", "session_costs"))
def _(spark, d):
    return facets.session_costs(_base_df(spark, d)).withColumn("day", ymd(F.col("day")))


@query(
    "top_sessions",
    sql("SELECT tool, session_id, branch, cost_cents, messages, (SELECT count(*) FROM session_costs) AS total_sessions FROM session_costs ORDER BY cost_cents DESC, session_id, tool LIMIT 15", "session_costs"),
)
def _(spark, d):
    return facets.top_sessions(facets.session_costs(_base_df(spark, d))).select("tool", "session_id", "branch", "cost_cents", "messages", "total_sessions")


@query(
    "cost_distribution",
    sql(
        """SELECT count(*) AS count, CAST(quantile_disc(cost_cents, 0.5) AS BIGINT) AS median_cents, CAST(quantile_disc(cost_cents, 0.9) AS BIGINT) AS p90_cents, max(cost_cents) AS max_cents,
 CAST(floor(CAST(sum(cost_cents) AS BIGINT)::DOUBLE / count(*) + 0.5::DOUBLE) AS BIGINT) AS mean_cents FROM session_costs""",
        "session_costs",
    ),
)
def _(spark, d):
    return facets.cost_distribution(facets.session_costs(_base_df(spark, d)))


cte("mix", f"SELECT {WEEK.format(d='day')} AS week, model, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM base GROUP BY 1, 2", "base")


@query("model_mix", sql("SELECT strftime(week, '%Y-%m-%d') AS week, model, cost_nano FROM mix", "mix"))
def _(spark, d):
    return facets.model_mix(_base_df(spark, d)).withColumn("week", ymd(F.col("week")))


@query("model_order", sql("SELECT model, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, CAST(row_number() OVER (ORDER BY sum(cost_nano) DESC, model) AS INTEGER) AS place FROM base GROUP BY model", "base"))
def _(spark, d):
    return facets.model_order(_base_df(spark, d))


@query(
    "pool_tail_series",
    sql(
        """SELECT strftime(week, '%Y-%m-%d') AS week, CASE WHEN place <= 5 THEN model ELSE 'other' END AS series, CAST(sum(cost_nano) AS BIGINT) AS cost_nano FROM mix
 JOIN (SELECT model, row_number() OVER (ORDER BY sum(cost_nano) DESC, model) AS place FROM base GROUP BY model) USING (model) GROUP BY ALL""",
        "mix", "base",
    ),
)
def _(spark, d):
    base = _base_df(spark, d)
    return facets.pool_tail(facets.model_mix(base), facets.model_order(base)).withColumn("week", ymd(F.col("week")))


@query(
    "burn_rate",
    sql(
        f"""SELECT CAST(31 AS BIGINT) AS period_days, CAST(25 AS BIGINT) AS elapsed_days, {USD.format(x='spent')} AS spent_usd,
 floor(spent::DOUBLE / 1e9::DOUBLE / 25.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS daily_mean_usd,
 floor(spent::DOUBLE / 1e9::DOUBLE / 25.0::DOUBLE * 31.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS projected_usd, true AS in_progress, {USD.format(x='prior')} AS prior_usd,
 CASE WHEN prior <> 0 THEN floor((spent::DOUBLE / 1e9::DOUBLE - {USD.format(x='prior')}) / ({USD.format(x='prior')}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS change
 FROM (SELECT CAST(coalesce(sum(cost_nano) FILTER (WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-25'), 0) AS BIGINT) spent,
  CAST(coalesce(sum(cost_nano) FILTER (WHERE day >= DATE '2023-12-07' AND day < DATE '2024-01-01'), 0) AS BIGINT) prior FROM base)""",
        "base",
    ),
)
def _(spark, d):
    first, last, runs_to = choose_range(TODAY, preset="this-month")
    return facets.burn_rate(_base_df(spark, d), first, last, TODAY, runs_to)
