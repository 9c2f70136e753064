"""Content statistics, year in review and commit correlation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import bindings as B
from .. import constants as K
from ..functions.dates import ymd
from ..operators import content as C
from ..operators import correlate as W
from ..operators import review as R
from . import search_queries  # noqa: F401  (shared SQL)
from .registry import CTES, cte, query, sql
from .search_queries import _seen
from .rhythm_queries import CANON
from .usage_queries import _base_df

SAID = (("article", "user", ("the ", "that ")), ("answer", "assistant", ("tion.",)), ("never", "user", ("request interrupted",)))
cte("period", "SELECT * FROM sess WHERE created_at BETWEEN DATE '2024-01-02' AND DATE '2024-06-30' AND message_count > 0", "sess")


def _period(spark, d):
    return C.content_period(B.session_index(spark, d), date(2024, 1, 2), date(2024, 6, 30))


@query("content_period", sql("SELECT file_path FROM period WHERE tool = 'claude'", "period"))
def _(spark, d):
    return C.content_period(B.session_index(spark, d), date(2024, 1, 2), date(2024, 6, 30), "claude-code").select("file_path")


@query(
    "phrase_counts",
    sql(
        """SELECT phrase, role, count FROM (SELECT unnest(['article','answer','never']) AS phrase, unnest(['user','assistant','user']) AS role, unnest([a, b, c]) AS count FROM (
 SELECT count(*) FILTER (WHERE role = 'user' AND (contains(lower(text), 'the ') OR contains(lower(text), 'that '))) AS a, count(*) FILTER (WHERE role = 'assistant' AND contains(lower(text), 'tion.')) AS b,
 count(*) FILTER (WHERE role = 'user' AND contains(lower(text), 'request interrupted')) AS c FROM seen))""",
        "seen",
    ),
)
def _(spark, d):
    return C.phrase_counts(_seen(spark, d), phrases=SAID)


_PHRASE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS phrase, '{r}' AS role, count(*) FILTER (WHERE role = '{r}' AND (" + " OR ".join(f"contains(lower(text), '{p}')" for p in ps) + ")) AS count FROM seen"
    for n, r, ps in K.PHRASES
)


@query("review_phrases", sql(_PHRASE_SQL, "seen"))
def _(spark, d):
    return C.phrase_counts(_seen(spark, d))


@query("monologue", sql("SELECT role, CAST(floor(sum(length(text))::DOUBLE / count(*) + 0.5) AS BIGINT) AS average, max(length(text)) AS longest FROM seen GROUP BY 1", "seen"))
def _(spark, d):
    return C.monologue(_seen(spark, d))


_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(K.STOP_WORDS)) + ")"
cte(
    "words",
    f"""SELECT word, count(DISTINCT file_path || '#' || msg_index) AS count, count(DISTINCT file_path) AS sessions FROM (
 SELECT file_path, msg_index, regexp_replace(w, '[''-]', '', 'g') AS word FROM (SELECT file_path, msg_index, unnest(regexp_extract_all(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '<[^>\\n]{{1,80}}>', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '[\\w.-]{{1,256}}/[\\w./-]{{1,512}}', ' ', 'g'), '[a-z][a-z''-]{{3,}}')) AS w
  FROM seen WHERE role = 'user')) WHERE length(word) >= 4 AND word NOT IN {_STOP} GROUP BY 1""",
    "seen",
)


@query("word_counts", sql("SELECT * FROM words", "words"))
def _(spark, d):
    return C.word_counts(_seen(spark, d))


@query("mine_words", sql("SELECT * FROM words WHERE count >= 10 AND sessions >= 5 ORDER BY count DESC, sessions DESC, word LIMIT 5", "words"))
def _(spark, d):
    return C.mine_words(_seen(spark, d))


cte("doc_seen", "SELECT source AS file_path, doc_id AS msg_index, 'user' AS role, text FROM documents")
cte("doc_words", CTES["words"][1].replace("FROM seen", "FROM doc_seen"), "doc_seen")


@query("word_of_year", sql("SELECT * FROM (SELECT * FROM doc_words ORDER BY count DESC, sessions DESC, word LIMIT 1) WHERE count >= 25 AND sessions >= 8", "doc_words"))
def _(spark, d):
    # one account: the documents of the corpus, by source
    docs = B.table(spark, d, "documents")
    talk = docs.select(F.col("source").alias("file_path"), F.col("doc_id").alias("msg_index"), F.lit("user").alias("role"), "text")
    return R.word_of_year(C.word_counts(talk))


@query(
    "session_totals",
    sql(
        """SELECT (SELECT count(*) FROM period) AS sessions, (SELECT count(*) FROM period WHERE message_count <= 2) AS drive_bys, (SELECT count(*) FROM period WHERE error_count > 0) AS sessions_errored,
 (SELECT CAST(sum(error_count) AS BIGINT) FROM period) AS total_errors, wd AS cursed_weekday, n AS cursed_count FROM (SELECT CAST(dayofweek(created_at) AS BIGINT) AS wd, CAST(sum(error_count) AS BIGINT) AS n FROM period GROUP BY 1 ORDER BY n DESC, wd LIMIT 1)""",
        "period",
    ),
)
def _(spark, d):
    return C.session_totals(_period(spark, d))


@query("top_files", sql("SELECT f AS name, count(*) AS sessions FROM (SELECT DISTINCT file_path, unnest(string_split(files_touched, ',')) AS f FROM period WHERE files_touched <> '') GROUP BY 1 ORDER BY sessions DESC, name LIMIT 5", "period"))
def _(spark, d):
    return C.top_files(_period(spark, d))


@query(
    "top_commands",
    sql("SELECT name, count(*) AS sessions FROM (SELECT DISTINCT file_path, CASE c WHEN 'git status -sb' THEN 'git status' ELSE c END AS name FROM (SELECT file_path, unnest(string_split(commands, ',')) AS c FROM period WHERE commands <> '') WHERE c <> 'ls -la') GROUP BY 1 ORDER BY sessions DESC, name LIMIT 5", "period"),
)
def _(spark, d):
    return C.top_commands(_period(spark, d))


@query(
    "abandoned_project",
    sql("SELECT regexp_extract(cwd, '([^/]+)$', 1) AS name, count(*) AS sessions, strftime(max(date), '%Y-%m-%d') AS last_seen FROM sess GROUP BY 1 HAVING count(*) >= 10 AND max(date) < DATE '2024-12-31' - 90 ORDER BY sessions DESC, name LIMIT 1", "sess"),
)
def _(spark, d):
    out = C.abandoned_project(B.session_index(spark, d), date(2024, 12, 31))
    return out.select("name", "sessions", ymd(F.col("last_seen")).alias("last_seen"))


@query("depth_median", sql("SELECT quantile_cont(message_count::DOUBLE, 0.5) AS depth_median FROM period WHERE message_count > 2", "period"))
def _(spark, d):
    return C.depth_median(_period(spark, d))


@query("session_of_year", sql("SELECT file_path, regexp_extract(cwd, '([^/]+)$', 1) AS project, message_count, n_touched AS files_touched FROM scored WHERE NOT trivia ORDER BY significance DESC, created_at, file_path LIMIT 1", "scored"))
def _(spark, d):
    return C.session_of_year(B.session_index(spark, d)).select("file_path", "project", "message_count", "files_touched")


# --- year tables -----------------------------------------------------------------
@query(
    "top_projects",
    sql("SELECT project, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nano) AS BIGINT) AS cost_nano, count(DISTINCT tool || session_id) AS sessions, sum(tokens)::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM base) AS share FROM base GROUP BY 1 ORDER BY tokens DESC, project LIMIT 5", "base"),
)
def _(spark, d):
    return R.top_projects(_base_df(spark, d))


@query(
    "top_models",
    sql(f"SELECT {CANON} AS name, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, sum(messages)::DOUBLE / (SELECT sum(messages)::DOUBLE FROM base) AS share FROM base WHERE model NOT LIKE '<%' GROUP BY 1 ORDER BY messages DESC, name LIMIT 5", "base"),
)
def _(spark, d):
    return R.top_models(_base_df(spark, d))


@query("tool_shares", sql("SELECT tool, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT session_id) AS sessions, sum(tokens)::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM base) AS share FROM base GROUP BY 1", "base"))
def _(spark, d):
    return R.tool_shares(_base_df(spark, d))


@query(
    "biggest_day",
    sql(
        """SELECT strftime(day, '%Y-%m-%d') AS day, tokens, messages, (SELECT quantile_cont(tokens::DOUBLE, 0.5) FROM x) AS median_tokens, (SELECT quantile_cont(messages::DOUBLE, 0.5) FROM x) AS median_messages
 FROM (SELECT day, tokens, messages FROM rollup WHERE grain = 'day') ORDER BY tokens DESC, day LIMIT 1""".replace("FROM x)", "FROM rollup WHERE grain = 'day')"),
        "rollup",
    ),
)
def _(spark, d):
    return R.biggest_day(_base_df(spark, d)).withColumn("day", ymd(F.col("day")))


@query("focus_share", sql("SELECT tool, max(t)::DOUBLE / sum(t)::DOUBLE AS focus_share FROM (SELECT tool, project, sum(tokens)::DOUBLE AS t FROM base GROUP BY 1, 2) GROUP BY 1", "base"))
def _(spark, d):
    return R.focus_share(_base_df(spark, d), ["tool"])


cte("account_tokens", "SELECT regexp_extract(session_id, '^(u[0-9]+)', 1) AS account, CAST(sum(tokens) AS BIGINT) AS tokens FROM base GROUP BY 1", "base")
_UNIT_VALUES = ", ".join(f"({i}, '{n}', '{k}', {s!r}::DOUBLE, '{label}')" for i, (n, k, s, label) in enumerate(K.EQUIVALENCE_UNITS))
_RATIO = "CASE WHEN {x} >= 10 THEN format('{{:,}}', CAST(floor({x} + 0.5) AS BIGINT)) ELSE regexp_replace(printf('%.1f', {x}), '\\.0$', '') END"
cte(
    "options",
    f"""SELECT account, place, unit, CASE WHEN kind = 'span' THEN CASE WHEN h < 48 THEN CAST(floor(h + 0.5) AS BIGINT) || ' hrs' WHEN h / 24.0::DOUBLE < 365 THEN CAST(floor(h / 24.0::DOUBLE + 0.5) AS BIGINT) || ' days'
   ELSE {_RATIO.format(x='(h / 24.0::DOUBLE / 365.0::DOUBLE)')} || ' yrs' END ELSE {_RATIO.format(x='r')} END AS value, label FROM (
 SELECT *, tokens::DOUBLE * 0.75::DOUBLE / size / 60.0::DOUBLE AS h, CASE kind WHEN 'words' THEN tokens::DOUBLE / (size / 0.75::DOUBLE) WHEN 'lines' THEN tokens::DOUBLE / (size * 9.0::DOUBLE) END AS r
 FROM account_tokens, (VALUES {_UNIT_VALUES}) u(place, unit, kind, size, label) WHERE tokens > 0) WHERE CASE WHEN kind = 'span' THEN h >= 24 ELSE r BETWEEN 1.5 AND 999 END""",
    "account_tokens",
)


def _accounts(spark, d):
    base = _base_df(spark, d)
    return base.groupBy(F.regexp_extract("session_id", "^(u[0-9]+)", 1).alias("account")).agg(F.sum("tokens").alias("tokens"))


@query("equivalences", sql("SELECT account, CAST(place AS BIGINT) AS place, unit, value, label FROM options", "options"))
def _(spark, d):
    return R.equivalences(_accounts(spark, d), "account")


@query("pick_equivalence")
def _(spark, d):
    return R.pick_equivalence(_accounts(spark, d), "account", F.concat(F.lit("2024|"), "account"))


@query(
    "cost_equivalence",
    sql(
        """SELECT o_custkey, CASE WHEN u / 1999 >= 1.5 THEN 'about ' || (CASE WHEN u / 1999 >= 10 THEN format('{:,}', CAST(floor(u / 1999 + 0.5) AS BIGINT)) ELSE printf('%.1f', u / 1999) END) || ' MacBook Airs'
 WHEN u / 249 >= 1.5 THEN 'about ' || (CASE WHEN u / 249 >= 10 THEN format('{:,}', CAST(floor(u / 249 + 0.5) AS BIGINT)) ELSE printf('%.1f', u / 249) END) || ' pairs of AirPods Pro'
 WHEN u / 6 >= 1.5 THEN 'about ' || (CASE WHEN u / 6 >= 10 THEN format('{:,}', CAST(floor(u / 6 + 0.5) AS BIGINT)) ELSE printf('%.1f', u / 6) END) || ' oat-milk lattes' END AS text
 FROM (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT)::DOUBLE AS u FROM orders GROUP BY 1)"""
    ),
)
def _(spark, d):
    o = B.table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice").cast("long")).cast("double").alias("u"))
    return o.select("o_custkey", R.cost_equivalence(F.col("u")).alias("text"))


_K = "coalesce(CAST(props->>'$.k' AS BIGINT), 0)"
cte(
    "metrics",
    "SELECT user_id AS account, "
    + ", ".join(f"count(*) FILTER (WHERE {_K} % 20 = {i}) AS \"{n}\"" for i, (n, _, _) in enumerate(K.PHRASES))
    + f""", count(*) FILTER (WHERE event_type = 'error') AS total_errors, count(*) FILTER (WHERE event_type = 'view') AS indexed_sessions, count(*) FILTER (WHERE {_K} % 9 = 0) AS user_avg,
 count(*) FILTER (WHERE {_K} % 9 = 1) AS assistant_avg, count(*) FILTER (WHERE hour(ts) <= 4) AS nights, count(*) FILTER (WHERE {_K} % 3 = 0) AS drive_bys, count(*) FILTER (WHERE {_K} % 40 = 7) AS abandoned_sessions,
 count(*) AS activity, count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS weekend, count(*) FILTER (WHERE {_K} % 6 = 0) AS active_days, count(*) FILTER (WHERE {_K} % 12 = 5) AS models_tried,
 100 * count(*) FILTER (WHERE {_K} % 4 = 0) AS longest_user, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS cost_usd, (count(*) FILTER (WHERE {_K} % 10 <> 3))::DOUBLE / count(*) AS cache_hit_rate,
 count(DISTINCT CAST(ts AS DATE)) AS distinct_sessions, (count(*) FILTER (WHERE hour(ts) >= 18))::DOUBLE / count(*) AS night_share, (count(*) FILTER (WHERE event_type = 'click'))::DOUBLE / count(*) AS focus_share,
 CASE WHEN user_id % 3 <> 0 THEN count(*)::DOUBLE END AS depth_median FROM events GROUP BY user_id""",
)


def _sat(x: str, mid: float) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - exp(-({x})::DOUBLE / {float(mid)}::DOUBLE) END)"


_CARDS = [
    ("friction", "interrupts", "interrupts > 0", f"0.15 + 0.8 * {_sat('interrupts', 150)}"), ("friction", "errors", "total_errors > 0", f"0.1 + 0.75 * {_sat('total_errors', 800)}"),
    ("friction", "actually", "actually >= 10", f"0.1 + 0.7 * {_sat('actually', 200)}"), ("friction", "noWait", '"noWait" >= 3', f"0.2 + 0.6 * {_sat('\"noWait\"', 30)}"),
    ("friction", "swears", "swears >= 5", f"0.2 + 0.6 * {_sat('swears', 60)}"), ("friction", "stillBroken", '"stillBroken" >= 3', f"0.2 + 0.65 * {_sat('\"stillBroken\"', 60)}"),
    ("relationship", "absolutelyRight", "indexed_sessions > 0", f"CASE WHEN \"absolutelyRight\" > 0 THEN 0.62 + 0.33 * {_sat('\"absolutelyRight\"', 40)} ELSE 0.45 END"),
    ("relationship", "apologies", '"userSorry" + "assistantApology" >= 5', f"0.25 + 0.55 * {_sat('\"userSorry\" + \"assistantApology\"', 40)} + CASE WHEN \"userSorry\" > \"assistantApology\" THEN 0.1 ELSE 0 END"),
    ("relationship", "please", "please + thanks >= 20", f"0.2 + 0.5 * {_sat('please + thanks', 250)}"), ("relationship", "monologue", "assistant_avg > 0", "0.55"),
    ("relationship", "areYouSure", '"areYouSure" >= 3', f"0.3 + 0.5 * {_sat('\"areYouSure\"', 25)}"), ("relationship", "hallucinate", "hallucinate >= 2", f"0.4 + 0.45 * {_sat('hallucinate', 12)}"),
    ("relationship", "perfectExclaim", '"perfectExclaim" >= 10', f"0.2 + 0.5 * {_sat('\"perfectExclaim\"', 150)}"), ("lies", "quickQuestion", '"quickQuestion" >= 3', f"0.25 + 0.6 * {_sat('\"quickQuestion\"', 40)}"),
    ("lies", "shouldWork", '"shouldWork" >= 5', f"0.2 + 0.6 * {_sat('\"shouldWork\"', 40)}"), ("lies", "oneMoreThing", '"oneMoreThing" >= 3', f"0.2 + 0.55 * {_sat('\"oneMoreThing\"', 40)}"),
    ("bloopers", "nights", "nights >= 5", f"0.2 + 0.75 * {_sat('nights', 30)}"), ("bloopers", "driveBys", "drive_bys >= 20 AND drive_bys::DOUBLE / greatest(indexed_sessions, 1) >= 0.15", f"0.2 + 0.6 * {_sat('drive_bys', 800)}"),
    ("bloopers", "abandoned", "abandoned_sessions > 0", f"0.3 + 0.4 * {_sat('abandoned_sessions', 30)}"), ("bloopers", "ultrathink", "ultrathink >= 3", f"0.45 + 0.4 * {_sat('ultrathink', 15)}"),
    ("bloopers", "longestUser", "longest_user >= 2000", f"0.2 + 0.5 * {_sat('longest_user', 12000)}"), ("bloopers", "weekend", "activity >= 200 AND weekend::DOUBLE / activity >= 0.2", "0.15 + weekend::DOUBLE / activity"),
    ("bloopers", "burn", "cost_usd > 0 AND active_days > 0", f"0.35 + 0.5 * {_sat('cost_usd::DOUBLE / active_days', 40)}"), ("relationship", "models", "models_tried >= 4", f"0.35 + 0.4 * {_sat('models_tried', 12)}"),
    ("bloopers", "cache", "cache_hit_rate >= 0.8", "0.25 + 0.45 * cache_hit_rate"),
]
cte("candidates", " UNION ALL ".join(f"SELECT account, '{t}' AS theme, '{n}' AS stat, CAST({s} AS DOUBLE) AS score FROM metrics WHERE {c}" for t, n, c, s in _CARDS), "metrics")


@query("fun_candidates", sql("SELECT account, theme, stat, round(score, 9) AS score FROM candidates", "candidates"))
def _(spark, d):
    return R.fun_candidates(B.account_metrics(spark, d), "account").select("account", "theme", "stat", F.round("score", 9).alias("score"))


@query(
    "fun_cards",
    sql(
        """SELECT account, theme, stat, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY account, theme ORDER BY round(score, 9) DESC, stat) AS place, max(score) OVER (PARTITION BY account, theme) AS lead
 FROM candidates WHERE round(score, 9) >= 0.3) WHERE place <= 3 AND lead >= 0.4""",
        "candidates",
    ),
)
def _(spark, d):
    c = R.fun_candidates(B.account_metrics(spark, d), "account").withColumn("score", F.round("score", 9))
    return R.fun_cards(c, "account").select("account", "theme", "stat", "place")


_ARCH = ", ".join(f"('{a}', '{n}')" for a, n in K.ARCHETYPES)


@query(
    "personas",
    sql(
        f"""SELECT account, m.axes, persona FROM (SELECT account, (CASE WHEN night_share >= 0.25 THEN 'night' ELSE 'day' END) || '|' || (CASE WHEN focus_share >= 0.4 THEN 'focus' ELSE 'multi' END) || '|' ||
 (CASE WHEN depth_median >= 40 OR depth_median IS NULL THEN 'deep' ELSE 'quick' END) AS axes FROM metrics WHERE distinct_sessions >= 10) m JOIN (VALUES {_ARCH}) a(axes, persona) ON a.axes = m.axes""",
        "metrics",
    ),
)
def _(spark, d):
    return R.personas(B.account_metrics(spark, d), "account")


# --- correlation -------------------------------------------------------------------
cte(
    "commits",
    f"SELECT user_id // 10 AS repo, 'c' || event_id AS sha, epoch_ms(date_trunc('millisecond', ts)) AS at_ms, ['f' || ({_K} % 20), 'f' || (({_K} + 7) % 20)] AS files FROM events WHERE event_type = 'purchase'",
)
cte(
    "work",
    f"""SELECT user_id // 10 AS repo, user_id || '-' || (ms // 43200000) AS session_key, min(ms) AS start_ms, max(ms) AS end_ms, list(DISTINCT 'f' || (k % 20)) AS files
 FROM (SELECT user_id, epoch_ms(date_trunc('millisecond', ts)) AS ms, {_K} AS k FROM events WHERE event_type <> 'purchase') GROUP BY 1, 2""",
)
cte(
    "pairs",
    """SELECT c.repo, sha, session_key, start_ms, end_ms, at_ms, len(list_intersect(c.files, w.files)) AS n, len(list_intersect(c.files, w.files)) * 10.0::DOUBLE - abs(at_ms - end_ms)::DOUBLE / 3600000.0::DOUBLE AS score
 FROM commits c JOIN work w ON w.repo = c.repo AND start_ms <= at_ms AND at_ms <= end_ms + 7200000""",
    "commits", "work",
)


@query(
    "correlate_commits",
    sql("SELECT repo, sha, session_key, CASE WHEN n > 0 THEN 'files+time' ELSE 'time-only' END AS confidence, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY score DESC, start_ms DESC, session_key) AS place FROM pairs) WHERE place <= 5", "pairs"),
)
def _(spark, d):
    out = W.correlate_commits(B.commits(spark, d), B.work(spark, d), ["repo"])
    return out.select("repo", "sha", "session_key", "confidence", "place")


@query("commit_file_overlap", sql("SELECT repo, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY score DESC, start_ms DESC, session_key) AS place FROM pairs) WHERE place <= 5 GROUP BY 1", "pairs"))
def _(spark, d):
    out = W.correlate_commits(B.commits(spark, d), B.work(spark, d), ["repo"])
    return out.groupBy("repo").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.size("overlapping_files").cast("long")).alias("shared"))


@query(
    "unlanded_attempts",
    sql(
        """SELECT repo, session_key, file FROM (SELECT DISTINCT repo, session_key, start_ms, end_ms, unnest(files) AS file FROM work WHERE end_ms + 7200000 <= epoch_ms(TIMESTAMP '2024-01-29')) w
 WHERE NOT EXISTS (SELECT 1 FROM commits c WHERE c.repo = w.repo AND list_contains(c.files, w.file) AND c.at_ms BETWEEN w.start_ms AND w.end_ms + 7200000)""",
        "work", "commits",
    ),
)
def _(spark, d):
    return W.unlanded_attempts(B.work(spark, d), B.commits(spark, d), 1_706_486_400_000, ["repo"]).select("repo", "session_key", "file")


@query("latest_commit_per_file", sql("SELECT repo, file, max_by(sha, (at_ms, sha)) AS sha FROM (SELECT repo, sha, at_ms, unnest(files) AS file FROM commits) GROUP BY 1, 2", "commits"))
def _(spark, d):
    return W.latest_commit_per_file(B.commits(spark, d), ["repo"])


@query("date_window", sql("SELECT file_path FROM sess WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-06'", "sess"))
def _(spark, d):
    return W.date_window(B.session_index(spark, d), F.lit(date(2024, 1, 5))).select("file_path")


@query("touching_file", sql("SELECT file_path FROM sess WHERE contains(files_touched, 'f3.py')", "sess"))
def _(spark, d):
    return W.touching_file(B.session_index(spark, d), "f3.py").select("file_path")


@query("to_repo_relative", sql("SELECT file_path, CASE cwd WHEN '/srv/work/p2' THEN substr(file_path, 7) ELSE substr(file_path, 2) END AS rel FROM sess WHERE file_path LIKE '/data/%'", "sess"))
def _(spark, d):
    s = B.session_index(spark, d)
    roots = F.when(F.col("cwd") == "/srv/work/p2", F.array(F.lit("/"), F.lit("/data"))).otherwise(F.array(F.lit("")))
    return s.select("file_path", W.to_repo_relative(F.col("file_path"), roots).alias("rel"))
