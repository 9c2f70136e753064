"""Operators against brute force on small, awkward inputs."""

from __future__ import annotations

import json
import math
import random
import re
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import dates, porter
from sessionloom.functions import text as T
from sessionloom.operators import archive, blocks, correlate, pricing, rhythm, search, sessions, tenants
from sessionloom.streaming import jobs as J
from sessionloom.operators import transcripts as X
from sessionloom.operators import usage as U
from sessionloom.sources import lines as L
from sessionloom.sources import native, usage
from sessionloom.sources.pricing import merge_prices, override_prices, parse_price_json, resolve_models


def test_running_matches_plain_window_across_blocks(spark):
    rng = random.Random(1)
    rows = [("k" if rng.random() < 0.6 else f"x{i % 3}", i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("b", F.floor(F.col("i") / 7))
    out = blocks.running(df, ["k"], "b", ["i"], sums={"s": F.lit(1)}, lasts={"l": F.col("v")}, lags={"g": F.col("v")}).collect()
    seen: dict = {}
    want = {}
    for k, i, v in rows:
        n, last, prev = seen.get(k, (0, None, None))
        last = v if v is not None else last
        want[i] = (n + 1, last, prev)
        seen[k] = (n + 1, last, v)
    assert {r.i: (r.s, r.l, r.g) for r in out} == want


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_ranked_values_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(0, 50_000) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v long")
    r = blocks.ranked_values(df, ["k"], "v", {"p50": blocks.nearest_rank(50), "p90": blocks.nearest_rank(90)}, 100).first()
    s = sorted(values)
    assert (r.p50, r.p90) == (s[max(0, math.ceil(0.5 * n) - 1)], s[max(0, math.ceil(0.9 * n) - 1)])
    m = blocks.exact_median(df, [], "v", 100).first()
    assert m.median == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_spread_join_splits_heavy_keys(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99)], "k string, i long")
    side = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v long")
    out = blocks.spread_join(big, side, ["k"], F.col("i"), per_split=10).collect()
    assert sorted((r.k, r.i, r.v) for r in out) == sorted([("hot", i, 1) for i in range(50)] + [("cold", 99, 2)])


def test_asof_ties_put_the_right_row_first(spark):
    left = spark.createDataFrame([("a", 10), ("a", 5), ("a", 7_200_000)], "k string, at long")
    right = spark.createDataFrame([("a", 10), ("a", 7)], "k string, t long")
    got = {r.at: r.o for r in blocks.asof_previous(left, right, ["k"], "at", "t", F.col("t"), "o").collect()}
    assert got == {10: 10, 5: None, 7_200_000: 10}
    after = {r.at: r.o for r in blocks.asof_next(left, right, ["k"], "at", "t", F.col("t"), "o").collect()}
    assert after == {10: 10, 5: 7, 7_200_000: None}


def _brute_runs(events, turns, gap=1_800_000):
    out, run, prev = [], [], None
    for at in sorted(events):
        human = prev is not None and any(prev < t <= at for t in turns)
        if run and (at - prev > gap or human):
            out.append(run)
            run = []
        run.append(at)
        prev = at
    return sorted((r[0], r[-1], len(r), max((t for t in turns if t <= r[0]), default=None)) for r in [*out, run] if r)


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    events = [rng.randrange(0, 40) * 600_000 + rng.choice([0, 0, 1, 1_799_999]) for _ in range(60)]
    events += [0, 1_800_000, 3_600_001]  # exactly at the gap stays together, one millisecond more splits
    turns = sorted({rng.randrange(0, 60) * 600_000 for _ in range(6)} | {events[0]})
    e = spark.createDataFrame([("s", a, 1) for a in events], "k string, at_ms long, tokens long")
    t = spark.createDataFrame([("s", a, "go") for a in turns], "k string, at_ms long, text string")
    for use, human in ((None, []), (t, turns)):
        got = sorted((r.start_ms, r.end_ms, r.steps, r.trigger_ms) for r in rhythm.runs(e, ["k"], use).collect())
        assert got == _brute_runs(events, human)


def test_read_lines_numbers_split_files(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(text) + "\n")
    (tmp_path / "b.jsonl").write_text("only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows = L.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.file_path.rsplit("/", 1)[-1], r.line_no): r.value for r in rows}
    assert got == {**{("a.jsonl", i): t for i, t in enumerate(text)}, ("b.jsonl", 0): "only"}


def test_parse_lines_rejects(spark):
    df = spark.createDataFrame([("f", "claude", i, s) for i, s in enumerate(['{"type":"user"}', "", "nope", "3", "[1]", "null"])], "file_path string, tool string, line_no long, value string")
    assert L.parse_lines(df).count() == 1
    assert {r.value for r in L.rejected_lines(df).collect()} == {"nope", "3", "[1]", "null"}


def _lines(spark, tool, records):
    return L.parse_lines(spark.createDataFrame([("/p/s1.jsonl", tool, i, json.dumps(r)) for i, r in enumerate(records)], "file_path string, tool string, line_no long, value string"))


def test_genuine_turns_and_folded_calls(spark):
    user = lambda text, **k: {"type": "user", "sessionId": "s", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": text}, **k}
    call = {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Bash", "input": {"command": " git  status "}}]}}
    x = X.extract_lines(_lines(spark, "claude", [
        call, user("typed", promptSource="typed"), user("null source", promptSource=None), user("old log"), user("Base directory for this skill: x"),
        user("sum", isCompactSummary=True), user("<system-reminder>only</system-reminder>"), call,
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "name": "Read", "input": {"n": 1, "file_path": "f.py"}}]}},
    ]))
    numbered = X.numbered_rows(x)
    got = [(r.msg_index, r.text, r.genuine) for r in X.messages_of(numbered).orderBy("msg_index").collect()]
    assert got == [(0, "typed", True), (1, "null source", False), (2, "old log", True), (3, "Base directory for this skill: x", False), (4, "sum", False), (5, "a b", True)]
    calls = sorted((r.msg_index, r.name, r.summary) for r in X.fold_tool_calls(numbered).collect())
    assert calls == [(0, "Bash", "git status"), (4, "Bash", "git status"), (5, "Read", "f.py")]


def _brute_match(records):
    counts: dict = {}
    for r in records:
        if r[0] == "response":
            per = counts.setdefault(r[1], {})
            per[r[2]] = per.get(r[2], 0) + 1
    out = []
    for r in records:
        if r[0] != "event":
            continue
        per = counts.get(r[1], {})
        wanted = list(per) if r[2] is None else [r[2], None]
        hit = next((t for t in wanted if per.get(t, 0) > 0), "none")
        if hit != "none":
            per[hit] -= 1
        out.append(hit != "none")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rollout_matching_is_greedy_by_turn(spark, seed):
    rng = random.Random(seed)
    turns = [None] if seed == 0 else [None, "t1", "t2"]
    spec = [(rng.choice(["response", "event"]), rng.choice(["a", "b"]), rng.choice(turns)) for _ in range(40)]
    records = [{"type": "session_meta", "payload": {"id": "s"}}]
    for part, text, turn in spec:
        extra = {} if turn is None else {"turn_id": turn}
        if part == "response":
            records.append({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}], **extra}})
        else:
            records.append({"type": "event_msg", "payload": {"type": "user_message", "message": text, **extra}})
    out = X.match_rollout_events(X.extract_lines(_lines(spark, "codex", records))).collect()
    assert [r.matched for r in sorted(out, key=lambda r: r.line_no)] == _brute_match(spec)


def test_prices_resolve_by_boundary_version_date_and_family(spark):
    prices = merge_prices(overrides=override_prices(spark))
    ids = ["claude-opus-4-8", "claude-opus-4-20250514", "claude-opus-4-9", "x/claude-haiku-4.5", "claude-haiku-4-5-20251001", "gpt-4o", "gpt-5.9", "opus", "gpt-5.5-codex", ""]
    got = {r.model: (r.price_key, r.priced_as) for r in resolve_models(spark.createDataFrame([(i,) for i in ids], "model string"), prices).collect()}
    assert got["claude-opus-4-8"] == ("claude-opus-4-8", None)
    assert got["claude-opus-4-20250514"] == ("claude-opus-4", None)
    assert got["claude-opus-4-9"] == ("claude-opus-4-8", "claude-opus-4-8")
    assert got["x/claude-haiku-4.5"] == ("claude-haiku-4-5", None)
    assert got["claude-haiku-4-5-20251001"] == ("claude-haiku-4-5", None)
    assert got["gpt-4o"] == (None, None)
    assert got["gpt-5.9"] == ("gpt-5.5", "gpt-5.5")
    assert got["gpt-5.5-codex"] == ("gpt-5.5", None)
    assert got[""] == (None, None)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Copies and priced slices are dealt by their number, and neither result depends on it."""
    from sessionloom import bindings as B

    raw = B.usage_raw(spark, "/root/testdata/sf0.001").where("seq < 400")

    def results():
        held = U.dedupe_usage(raw)
        return held, pricing.cost_base(held, B.prices(spark), models=raw)

    before = [sorted(map(str, x.collect())) for x in results()]
    monkeypatch.setattr(blocks, "TASK_ROWS", 100)
    held, base = results()
    assert [sorted(map(str, x.collect())) for x in (held, base)] == before
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [seq" in plan(held) and ", 4" in plan(held)
    assert plan(base).count("RepartitionByExpression") > plan(held).count("RepartitionByExpression")


def test_projects_are_looked_up_without_sorting_events(spark):
    events = spark.createDataFrame([("/a/b/c",), ("/a/b",), ("/x",), ("",), (None,)], "project_path string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = U.normalise_project(events, spark.createDataFrame([("/a",), ("/a/b",)], "root string"))
        assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["project"] for r in found.collect()) == ["/a/b", "/a/b", "/x", "unknown", "unknown"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_aggregated_cost_equals_event_cost(spark):
    rows = [(i, "claude-code", "anthropic", "m", f"2024-01-01 00:0{i % 10}:00", "s", None, 150_000 * (i % 3), 10, 250_000 * (i % 2), 100 * i, 40 * i, None, None, None, None, None, None) for i in range(30)]
    schema = "seq long, tool string, provider string, model string, ts string, session_id string, project_path string, input long, output long, cache_read long, cache_write long, cache_write_1h long, cost_usd double, speed string, agent_id string, agent_type string, branch string, dedup_key string"
    e = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    from sessionloom.sources.pricing import price_rows

    p = merge_prices(live=price_rows(spark, [{"model": "m", "input": 2e-6, "output": 3e-6, "input_above": 4e-6}]))
    whole = pricing.cost_base(e, p).agg(F.sum("cost_nano")).first()[0]
    single = pricing.event_cost(e, resolve_models(e.select("model"), p)).agg(F.sum("cost_nano")).first()[0]
    want = 0.0
    for r in rows:
        i, o, cr, cw, c1 = r[7], r[8], r[9], r[10], r[11]
        want += min(i, 200_000) * 2e-6 + max(i - 200_000, 0) * 4e-6 + o * 3e-6 + cr * 2e-7 + (cw - c1) * 2.5e-6 + c1 * 4e-6
    assert abs(whole / 1e9 - want) < 1e-6 and abs(single / 1e9 - want) < 1e-6


def test_price_json_skips_specs_and_malformed_rates(spark):
    text = json.dumps({"spec": {"input_cost_per_token": "x"}, "ok": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2, "cache_read_input_token_cost": "bad"}})
    assert [(r.model, r.input, r.output, r.cache_read) for r in parse_price_json(spark.createDataFrame([(text,)], "value string")).collect()] == [("ok", 1e-6, 2.0, None)]


def test_upsert_is_idempotent(spark):
    schema = "seq long, id string, tool string, session_id string, project string, model string, ts timestamp, input long, output long, cache_read long, cache_write long"
    rows = [(1, "a", "t", "s", "", "m", None, 1, 1, 1, 1), (2, "a", "t", "s", "/p", "m", None, 2, 1, 1, 1), (3, "b", "t", "s", "", "m", None, 5, 0, 0, 0)]
    inc = spark.createDataFrame(rows, schema)
    empty = inc.select(*U.STORED).where("false")
    once = U.upsert_usage(empty, inc)
    assert {(r.id, r.project, r.input, r.changed) for r in once.collect()} == {("a", "/p", 2, True), ("b", "", 5, True)}
    again = U.upsert_usage(once.drop("changed"), inc)
    assert not any(r.changed for r in again.collect())


def test_streak_rules(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3, 8, 9)], "day date")
    assert tuple(U.streaks(days, date(2024, 1, 10)).first()) == (2, 3, 5)
    assert tuple(U.streaks(days, date(2024, 1, 10), may_end_yesterday=False).first()) == (0, 3, 5)
    assert tuple(U.longest_gap(days).first()) == (4, date(2024, 1, 4), date(2024, 1, 7))


def test_periods():
    today = date(2024, 3, 13)  # a Wednesday
    assert dates.resolve_period("this-week", today) == (date(2024, 3, 11), today)
    assert dates.period_runs_to("this-week", today) == date(2024, 3, 17)
    assert dates.resolve_period("last-month", today) == (date(2024, 2, 1), date(2024, 2, 29))
    assert dates.resolve_period("month", today, "2023-02") == (date(2023, 2, 1), date(2023, 2, 28))
    assert dates.previous_window_start(date(2024, 3, 1), date(2024, 3, 10)) == date(2024, 2, 20)
    assert dates.choose_range(today, preset="today", days=3) == (today, today, None)
    assert dates.days_ago(today, 7) == date(2024, 3, 7)


def test_stemmer_and_terms(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file", "happy": "happi", "adoption": "adopt", "controlling": "control", "generalizations": "gener", "oscillators": "oscil", "sky": "sky"}
    assert {w: porter.stem(w) for w in pairs} == pairs
    assert search.parse_query('fix "react@19" café fix') == [["fix"], ["react", "19"], ["cafe"]]
    row = spark.range(1).select(
        search.phrase_count(T.spaced_terms(F.lit("A a, a! b")), ["a"]).alias("x"), search.phrase_count(T.spaced_terms(F.lit("a a a b")), ["a", "a"]).alias("y"),
        T.count_terms(T.spaced_terms(F.lit("Élan vital"))).alias("n"), T.count_terms(T.spaced_terms(F.lit(" -- "))).alias("z"), T.fnv1a(F.lit("foobar")).alias("h"),
    ).first()
    assert tuple(row) == (3, 2, 2, 0, 0xBF9CF968)


def test_grep_folds_unicode_and_escapes(spark):
    m = spark.createDataFrame([("f", 0, "user", "CAFÉ a.b"), ("f", 1, "user", "axb"), ("f", -1, "user", "a.b")], "file_path string, msg_index long, role string, text string")
    assert [r.msg_index for r in search.grep_matches(m, "café").collect()] == [0]
    assert [r.msg_index for r in search.grep_matches(m, "a.b").collect()] == [0]
    assert sorted(r.msg_index for r in search.grep_matches(m, "a.b", regex=True).collect()) == [0, 1]
    with pytest.raises(Exception):
        search.grep_matches(m, "(", regex=True)


GOLDEN = [
    ("s1", "Move the billing tables to a new database schema", "alter table invoices", "db/migrate.sql"),
    ("s2", "Why does the login page flash white on reload", "npm run dev", "web/login.tsx"),
    ("s3", "Speed up the nightly export job", "make export", "jobs/export.py"),
    ("s4", "Upgrade to react@19 and fix the tests", "npm install react@19", "package.json"),
    ("s5", "Write release notes for the spring version", "git log", "CHANGES.md"),
]


def test_golden_ranking(spark):
    s = spark.createDataFrame(
        [(i, i, "claude", date(2024, 1, 1), "", p, [c], [f], []) for i, p, c, f in GOLDEN],
        "file_path string, session_id string, tool string, date date, custom_title string, first_prompt string, commands array<string>, files_touched array<string>, files_read array<string>",
    )
    m = spark.createDataFrame([(i, 0, "user", p) for i, p, _, _ in GOLDEN], "file_path string, msg_index long, role string, text string")
    labels = [("billing database schema", "s1"), ("login.tsx flash", "s2"), ("nightly export", "s3"), ("react@19", "s4"), ("release notes", "s5"), ("kubernetes ingress", None)]
    results, expected = [], []
    for n, (q, want) in enumerate(labels):
        found = [r.file_path for r in search.search_sessions(s, m, q, limit=5).collect()]
        results += [(n, k + 1, f) for k, f in enumerate(found)]
        expected.append((n, want, want is None))
    out = search.search_eval(
        spark.createDataFrame(results, "query_id int, rank int, id string"), spark.createDataFrame(expected, "query_id int, id string, negative boolean")
    ).first()
    assert out.recall >= 0.9 and out.mrr >= 0.7 and out.abstention == 1.0


def test_page_events_split_long_records(spark):
    rng = random.Random(3)
    rows = [("f", i, "x" * rng.choice([5, 30, 95])) for i in range(40)]
    got = sessions.page_events(spark.createDataFrame(rows, "file_path string, line_no long, value string"), limit=4, chars=100).orderBy("line_no", "char_offset").collect()
    want, page, used, left = [], 0, 0, 100
    for _, line, text in rows:
        start = 0
        while start < len(text):
            if used >= 4 or left <= 0:
                page, used, left = page + 1, 0, 100
            take = min(left, len(text) - start)
            want.append((page, line, start, take))
            used, left, start = used + 1, left - take, start + take
    assert [(r.page, r.line_no, r.char_offset, r.size) for r in got] == want


def test_undated_sessions_pass_lower_bounds_only(spark):
    s = spark.createDataFrame([("a", None), ("b", date(2024, 1, 5))], "file_path string, date date")
    assert sessions.filter_sessions(s, after=date(2024, 1, 1)).count() == 2
    assert [r.file_path for r in sessions.filter_sessions(s, before=date(2024, 2, 1)).collect()] == ["b"]


def test_relative_paths_use_longest_root(spark):
    row = spark.range(1).select(*[
        correlate.to_repo_relative(F.lit(p), F.array(F.lit("/w"), F.lit("/w/repo"))).alias(n) for n, p in (("a", "/w/repo/x.py"), ("b", "/w/y"), ("c", "z"), ("d", "/other"), ("e", "/w/repository/q"))
    ]).first()
    assert tuple(row) == ("x.py", "y", "z", "/other", "repository/q")


def test_compaction_keeps_unknown_and_drops_bookkeeping(spark):
    records = _lines(spark, "claude", [
        {"type": "progress"}, {"type": "mystery", "a": 1}, {"type": "event_msg", "payload": {"type": "token_count"}}, {"type": "response_item", "payload": {"type": "reasoning"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "h"}, {"type": "text", "text": "kept"}]}, "extra": 1},
    ])
    got = {r.line_no: (r.action, json.loads(r.value)) for r in archive.compact_records(records).collect()}
    assert set(got) == {1, 4} and got[1] == ("unknown", {"type": "mystery", "a": 1})
    assert got[4][1] == {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "kept"}]}}


def test_subagent_text_and_child_ids(spark):
    m = spark.createDataFrame([("/p/a/subagents/agent-1.jsonl", 0, "user", "look", True), ("/p/a.jsonl", 0, "user", "hi", True)], "file_path string, msg_index long, role string, text string, genuine boolean")
    rows = {(r.file_path, r.msg_index, r.text) for r in X.indexed_messages(m).collect()}
    assert ("/p/a.jsonl", -1, "look") in rows
    more = m.unionByName(spark.createDataFrame([("/p/a/subagents/agent-1.jsonl", 2, "user", "again", True), ("/p/a/subagents/agent-0.jsonl", 5, "user", "first", False), ("/p/a/subagents/agent-0.jsonl", 6, "assistant", "no", True)], m.schema))
    stored = L.parse_lines(spark.createDataFrame([("/p/b", 1, '{"type":"session","subagentText":"kept"}')], "file_path string, line_no long, value string"))
    folded = {(r.file_path, r.msg_index, r.text) for r in X.fold_subagent_text(more, stored).collect()}
    assert folded == {("/p/a.jsonl", -1, "first\nlook\nagain"), ("/p/b", -1, "kept")}
    sid = spark.range(1).select(X.child_session_id(F.lit("/p/a/subagents/agent-1.jsonl"), F.lit("s"))).first()[0]
    assert sid == "s/subagents/agent-1"


def test_cyclic_blob_graph_terminates(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("s", "b", "gone"), ("t", "x", "y")], "store string, parent string, child string")
    blobs = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "x"), ("t", "y")], "store string, id string")
    reached, incomplete = native.reachable_messages(edges, blobs, spark.createDataFrame([("s", "a"), ("t", "x")], "store string, id string"))
    assert sorted((r.store, r.id) for r in reached.collect()) == [("s", "a"), ("s", "b"), ("t", "x"), ("t", "y")]
    assert [r.store for r in incomplete.collect()] == ["s"]


def test_strong_agent_names_win(spark):
    events = spark.createDataFrame([("x",), ("y",), ("acompact-1",), ("z",), (None,)], "agent_id string")
    names = spark.createDataFrame([("x", "weak", False, "a", 1), ("x", "strong", True, "b", 0), ("y", "only", False, "a", 2)], "agent_id string, type string, strong boolean, file_path string, line_no long")
    got = {r.agent_id: r.agent_type for r in usage.resolve_agents(events, names).collect()}
    assert got == {"x": "strong", "y": "only", "acompact-1": "auto-compact", "z": "unknown", None: None}


def test_decision_supersession(spark):
    ev = [("f", 0, "yes")]
    schema = "project string, title string, decision string, rationale string, decided_at date, supersedes string, evidence array<struct<file_path:string,message_index:int,quote:string>>"
    m = spark.createDataFrame([("f", 0, "user", True, "oh yes")], "file_path string, msg_index long, role string, genuine boolean, text string")
    s = spark.createDataFrame([("f", "/p/sub")], "file_path string, cwd string")
    known = spark.createDataFrame([("k1", "/p", date(2024, 1, 5)), ("k2", "/q", date(2024, 1, 1))], "id string, project string, decided_at date")
    d = spark.createDataFrame([("/p", t, "d", "", date(2024, 1, day), sup, ev) for t, day, sup in (("ok", 6, "k1"), ("young", 4, "k1"), ("foreign", 6, "k2"), ("plain", 1, None))], schema)
    got = {r.title: r.problem for r in tenants.validate_decisions(d, m, s, known).collect()}
    assert got["plain"] is None and got["foreign"] == got["young"] == "superseded decision does not fit"


def test_index_write_keeps_other_files_of_a_partition(spark, tmp_path):
    s = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 1, 2)), ("c", date(2024, 2, 1))], "file_path string, created_at date")
    m = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("b", 0, "y"), ("c", 0, "z")], "file_path string, msg_index long, text string")
    archive.write_session_index(s, m, str(tmp_path / "1"), keys=1)
    changed = spark.createDataFrame([("a", 0, "new")], m.schema)
    archive.write_session_index(s.where("file_path = 'a'"), changed, str(tmp_path / "2"), previous=str(tmp_path / "1"), keys=1)
    assert sorted(r.file_path for r in spark.read.parquet(str(tmp_path / "2/sessions")).collect()) == ["a", "b", "c"]
    assert sorted((r.file_path, r.text) for r in spark.read.parquet(str(tmp_path / "2/messages")).collect()) == [("a", "new"), ("b", "y"), ("c", "z")]


def _stored(spark, rows):
    schema = "id string, seq long, tool string, session_id string, project string, model string, ts timestamp, input long, output long, cache_read long, cache_write long"
    return spark.createDataFrame([(i, q, t, "s", p, "m", None, n, 0, 0, 0) for i, q, t, p, n in rows], schema)


def test_repeated_and_reordered_batches_change_nothing(spark, tmp_path):
    from sessionloom.streaming import jobs as J

    def put(rows, path, batch):
        whole = _stored(spark, rows).withColumn("first_seq", F.col("seq")).withColumn("project_seq", F.col("seq"))
        J.append_batch(J.combined_usage(whole), path, batch)

    first, second = [("a", 1, "t", "p", 1), ("b", 2, "t", "", 1)], [("a", 3, "u", "", 9), ("c", 4, "t", "q", 1)]
    results = []
    for name, order in (("x", [(0, first), (1, second), (1, second), (0, first)]), ("y", [(0, second), (1, first)])):
        path = str(tmp_path / name)
        J.start_table(spark, path, J.STORED_SCHEMA)
        assert J.combined_usage(J.batches(spark, path, J.STORED_SCHEMA)).count() == 0
        for batch, rows in order:
            put(rows, path, batch)
        results.append({(r.id, r.tool, r.project, r.input) for r in J.combined_usage(J.batches(spark, path, J.STORED_SCHEMA)).collect()})
    assert results[0] == results[1] == {("a", "t", "p", 9), ("b", "t", "", 1), ("c", "t", "q", 1)}


def test_no_machine_local_folder_on_a_cluster():
    from sessionloom.context import shared_dir

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf({"spark.master": master})

    assert shared_dir(Session("local[4]")).startswith("/tmp/")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(Session(master))


def test_wide_budget_elides_nothing(spark):
    arcs = spark.range(0, 1000).select(
        F.lit("f").alias("file_path"), (F.col("id") + 1).alias("turn"), (2 * F.col("id")).alias("msg_index"), F.lit("u").alias("user"), F.lit("a").alias("assistant")
    )
    messages = arcs.select("file_path", "msg_index")
    assert sessions.elide_middle(arcs, messages, budget=100_000).count() == 1000
    few = sessions.elide_middle(arcs, messages, budget=2_000)
    assert 0 < few.count() < 60


def test_deep_stores_are_followed_to_the_end(spark):
    edges = spark.range(0, 12).select(F.lit("s").alias("store"), F.col("id").cast("string").alias("parent"), (F.col("id") + 1).cast("string").alias("child"))
    blobs = spark.range(0, 12).select(F.lit("s").alias("store"), F.col("id").cast("string").alias("id"))
    reached, incomplete = native.reachable_messages(edges, blobs, spark.createDataFrame([("s", "0")], "store string, id string"))
    assert reached.count() == 12 and incomplete.count() == 1


def test_twins_with_and_without_key_are_numbered_together(spark):
    rows = [(1, "k", "t"), (2, None, "t"), (3, None, "t")]
    events = spark.createDataFrame(rows, "seq long, dedup_key string, tool string").selectExpr(
        "*", "'s' AS session_id", "'m' AS model", "timestamp '2024-01-01' AS ts", "1L AS input", "2L AS output", "0L AS cache_read", "0L AS cache_write"
    )
    found = {r.seq: r.id for r in U.usage_identity(events).collect()}
    import hashlib

    text = '["t","s","m","2024-01-01T00:00:00.000Z",{"input":1,"output":2,"cacheRead":0,"cacheWrite":0}]'
    assert found[1] == hashlib.sha256(b"t:k").hexdigest()
    assert [found[i] for i in (2, 3)] == [hashlib.sha256(f"{text}:{n}".encode()).hexdigest() for n in (1, 2)]


def test_closed_stream_loops_agree_with_batch(spark, tmp_path):
    from sessionloom.streaming import jobs as J

    rng = random.Random(5)
    at = sorted(86_400_000 + rng.randrange(0, 200) * 300_000 for _ in range(120))  # above the initial watermark
    rows = [("s", a, int(rng.random() < 0.1)) for a in at]
    df = spark.createDataFrame(rows, "session_id string, at_ms long, turn int").dropDuplicates(["at_ms", "turn"])
    df.withColumn("ts", F.timestamp_millis("at_ms")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, at_ms long, turn int, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    got = {(r.start_ms, r.end_ms, r.steps) for r in J.to_table(J.stateful_loops(stream)).collect()}
    kept = [tuple(r) for r in df.collect()]
    want = {(a, b, n) for a, b, n, _ in _brute_runs([a for _, a, t in kept if not t], [a for _, a, t in kept if t])}
    assert got <= want and len(want - got) <= 1


def test_stream_import_of_landed_files(spark, tmp_path):
    from sessionloom.streaming import jobs as J

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"s{i}.jsonl").write_text('{"type":"user"}\n' * (i + 1))
    seen = []
    J.stream_import(J.landed_lines(spark, str(tmp_path / "in"), 1), lambda batch, n: seen.append((n, batch.count())))
    assert sorted(c for _, c in seen) == [1, 2, 3]


def test_ranking_matches_inflected_words(spark):
    texts = [("f", 0, "user", "running tests again"), ("f", 1, "assistant", "the runner rested"), ("g", 0, "user", "nothing here"), ("g", 1, "user", "she runs a tested test")]
    m = spark.createDataFrame(texts, "file_path string, msg_index long, role string, text string")
    found = search.rank_messages(m, search.parse_query("test"))
    assert {(r.file_path, r.msg_index) for r in found.collect()} == {("f", 0), ("g", 1)}
    phrase = search.scan_bm25(m, [["run", "tests"]], {"text": 1.0}, ["file_path", "msg_index"], stemmed=True)
    assert {(r.file_path, r.msg_index) for r in phrase.collect()} == {("f", 0)}
    assert search.rank_messages(m, search.parse_query("absent")).count() == 0
    twice = search.scan_bm25(m.where("msg_index = 1"), [["test", "test"]], {"text": 1.0}, ["file_path"], stemmed=True)
    assert [r.file_path for r in twice.collect()] == ["g"]


def test_query_without_words_lists_recent_sessions(spark):
    rows = [("a", "s", "claude", date(2024, 1, 1), "", "x"), ("b", "t", "codex", date(2024, 3, 1), "", "x"), ("c", "u", "claude", date(2024, 2, 1), "", "x")]
    s = spark.createDataFrame(rows, "file_path string, session_id string, tool string, date date, custom_title string, first_prompt string")
    assert [r.file_path for r in search.search_sessions(s, None, ' "" ', limit=2).collect()] == ["b", "c"]
    assert [r.file_path for r in search.search_sessions(s, None, "", kept=s.where("tool = 'claude'")).collect()] == ["c", "a"]


def test_why_excerpts_rank_by_stems(spark):
    from sessionloom.plans import why as W

    said = ["parser parses", "parsing the parser of parsers", "unrelated words here", "more unrelated words", "tests", "other text with other words"]
    m = spark.createDataFrame([("f", i, "user", t) for i, t in enumerate(said)] + [("g", 0, "user", "parser")], "file_path string, msg_index long, role string, text string")
    commits = spark.createDataFrame([("k", "fix parser", ["src/parse.py"])], "sha string, subject string, files array<string>")
    pairs = spark.createDataFrame([("k", "f")], "sha string, session_key string")
    stems = [[porter.stem(t) for t in text.split()] for text in [*said, "parser"]]
    wanted, average = {porter.stem(t) for t in ("fix", "parser", "parse", "py")}, sum(map(len, stems)) / len(stems)
    rank = {}
    for i, words in enumerate(stems[:-1]):
        for term in wanted & set(words):
            df = sum(term in w for w in stems)
            idf, tf = max(math.log((len(stems) - df + 0.5) / (df + 0.5)), 1e-6), words.count(term)
            rank[i] = rank.get(i, 0) - idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
    found = W.excerpts(pairs, commits, m).collect()
    assert {r.msg_index: round(r["rank"], 9) for r in found} == {i: round(v, 9) for i, v in rank.items()}


def test_search_index(spark, tmp_path):
    from sessionloom.operators import search_index as I

    path = str(tmp_path / "index")
    fields = "file_path string, session_id string, tool string, date date, custom_title string, first_prompt string, commands array<string>, files_touched array<string>, files_read array<string>"

    def session(name, prompt, commands=()):
        return (name, name, "claude", None, None, prompt, list(commands), ["src/a.py"], [])

    def put(segment, sessions, messages):
        I.write_segment(path, segment, spark.createDataFrame(sessions, fields), spark.createDataFrame(messages, "file_path string, msg_index int, role string, text string"))

    long = " ".join(f"w{i}" for i in range(60)) + " refactoring the parser " + " ".join(f"v{i}" for i in range(60))
    put(0, [session("a", "git"), session("b", "old words about zebras"), session("c", None, ["status"])], [("a", 0, "user", long), ("a", 1, "assistant", "parsers parse"), ("a", -1, "user", "parser zebra"), ("b", 0, "user", "zebra zebra")])
    put(1, [session("b", "new words", ["git status"])], [("b", 0, "user", None), ("b", 1, "assistant", "nothing of the kind")])
    assert not I.search(spark, path, "zebra old").where("file_path = 'b'").count()  # replaced
    found = {r["file_path"]: r for r in I.search(spark, path, "parser").collect()}
    assert set(found) == {"a"} and [h["msg_index"] for h in found["a"]["hits"]] == [0, 1] or [h["msg_index"] for h in found["a"]["hits"]] == [1, 0]
    cut = next(h["snippet"] for h in found["a"]["hits"] if h["msg_index"] == 0)
    assert cut.startswith("…w54 ") and "refactoring the parser" in cut and cut.endswith("…") and len(cut.split()) == 32
    # A phrase stays within one column: "git" heads a and "status" is a command of c, only b has both in a row.
    assert [r["file_path"] for r in I.search(spark, path, "git-status").collect()] == ["b"]
    assert [r["snippet"] for r in I.search(spark, path, "git-status").collect()] == ["new words"]
    before = sorted(map(str, I.search(spark, path, "parser git status words").collect()))
    put(1, [session("b", "new words", ["git status"])], [("b", 0, "user", None), ("b", 1, "assistant", "nothing of the kind")])
    assert sorted(map(str, I.search(spark, path, "parser git status words").collect())) == before  # a repeated import
    assert len(I.search(spark, path, "", limit=2).collect()) == 2 and I.search(spark, path, "unheard").count() == 0
    kept = spark.createDataFrame([("c",)], "file_path string")
    assert [r["file_path"] for r in I.search(spark, path, "status src", kept=kept).collect()] == ["c"]


def test_search_index_blocks(spark, tmp_path, monkeypatch):
    """The same ranks from one row of postings or many."""
    from sessionloom.operators import search_index as I

    fields = "file_path string, session_id string, tool string, date date, custom_title string, first_prompt string, commands array<string>, files_touched array<string>, files_read array<string>"
    sessions = spark.createDataFrame([(f"s{i}", f"s{i}", "codex", None, f"title {i % 5}", "same words", [], [], []) for i in range(30)], fields)
    messages = spark.createDataFrame([(f"s{i}", k, "user", "the words " * (i % 4 + k)) for i in range(30) for k in range(3)], "file_path string, msg_index int, role string, text string")
    out = []
    for block in (4096, 4):
        monkeypatch.setattr(I, "BLOCK", block)
        I.write_segment(str(tmp_path / str(block)), 0, sessions, messages)
        out.append([(r["file_path"], round(r["rank"], 9), r["hits"]) for r in I.search(spark, str(tmp_path / str(block)), "the-words title 3").collect()])
    assert out[0] == out[1] and len(out[0]) == 30
    blocks = spark.read.parquet(str(tmp_path / "4" / "postings"))
    assert blocks.where("stem = 'word'").count() > 5 and blocks.agg({"n": "max"}).first()[0] <= 4


def test_copies_fold_in_order(spark):
    """Random copies, cut into stretches at many places, against the plain fold."""
    import random

    from sessionloom.operators import usage

    rng = random.Random(11)
    rows, want = [], {}
    for key in range(60):
        held = None
        for at in range(rng.randint(1, 60)):
            copy = (f"k{key}", key * 1000 + at, float(rng.choice([0, 1, 2, 3, 5, 8])), int(rng.random() < 0.3))
            rows.append(copy)
            if held is None or copy[2] > held[2] or (copy[3] and not held[3]):
                held = copy
        want[held[0]] = held[1]
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = usage.last_held(spark.createDataFrame(rows, "__key string, seq long, cost double, fast int")).collect()
        assert {r["__key"]: r["seq"] for r in found} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_follow_lines(spark):
    from sessionloom.sources.usage import position

    rows = spark.createDataFrame([(f"/p/{f}", n) for f in "abc" for n in (1, 2, 70000, 3_000_000_000)], "file_path string, line_no long")
    found = rows.select("file_path", "line_no", position().alias("seq")).orderBy("seq").collect()
    assert [r["line_no"] for r in found] == [1, 2, 70000, 3_000_000_000] * 3 and len({r["seq"] for r in found}) == 12


def _sync(spark, path, rows, **kw):
    spark.createDataFrame(rows, "key string, hash string, seq long").write.mode("append").parquet(f"{path}/in")
    J.stream_sync(spark.readStream.schema("key string, hash string, seq long").parquet(f"{path}/in"), f"{path}/out", **kw)
    return {r["key"]: r["hash"] for r in J.latest_hashes(J.batches(spark, f"{path}/out", J.SNAPSHOT_SCHEMA)).collect()}


def test_sync_keeps_what_earlier_calls_sent(spark, tmp_path):
    path = str(tmp_path)
    assert _sync(spark, path, [("k1", "a", 1), ("k2", "b", 2)]) == {"k1": "a", "k2": "b"}
    assert _sync(spark, path, [("k3", "c", 3), ("k1", "a", 4), ("k2", "old", 1)]) == {"k1": "a", "k2": "b", "k3": "c"}
    sent = J.batches(spark, f"{path}/out", J.SNAPSHOT_SCHEMA)
    assert sent.count() == 3  # neither the same hash nor the older row is sent
    assert _sync(spark, path, [("k1", "z", 9)]) == {"k1": "z", "k2": "b", "k3": "c"}
    with pytest.raises(ValueError):  # a new checkpoint would replace batch 0
        _sync(spark, path, [("k4", "d", 10)], checkpoint=f"{path}/other")
    assert {r["key"] for r in J.batches(spark, f"{path}/out", J.SNAPSHOT_SCHEMA).collect()} == {"k1", "k2", "k3"}


def test_stream_on_a_compacted_table(spark, tmp_path):
    path = str(tmp_path)
    _sync(spark, path, [("k1", "a", 1), ("k2", "b", 2)])
    moved = f"{path}/moved"
    J.compact(J.latest_hashes(J.batches(spark, f"{path}/out", J.SNAPSHOT_SCHEMA)), f"{moved}/out")
    assert _sync(spark, moved, [("k3", "c", 3)]) == {"k1": "a", "k2": "b", "k3": "c"}


def test_repeated_batch_and_second_upsert(spark, tmp_path):
    schema = "id string, seq long, tool string, session_id string, project string, model string, ts timestamp, input long, output long, cache_read long, cache_write long"
    row = lambda i, seq, n: (i, seq, "t", "s", "", "m", None, n, 0, 0, 0)
    path = str(tmp_path)
    for rows in ([row("a", 1, 10), row("b", 2, 20)], [row("a", 3, 30), row("c", 4, 40)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/in")
        J.stream_usage_upsert(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/out")
    table = lambda: {r["id"]: r["input"] for r in J.combined_usage(J.batches(spark, f"{path}/out", J.STORED_SCHEMA)).collect()}
    assert table() == {"a": 30, "b": 20, "c": 40}
    again = J.batches(spark, f"{path}/out", J.STORED_SCHEMA).where("batch_id = 1").drop("batch_id").collect()
    J.append_batch(spark.createDataFrame(again, J.STORED_SCHEMA), f"{path}/out", 1)  # a batch written twice after a failure
    assert table() == {"a": 30, "b": 20, "c": 40}


def _drained(spark, name, batches, schema, job, tmp_path):
    folder = tmp_path / name
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        out = J.to_table(job(spark.readStream.schema(schema).parquet(str(folder / "in"))), path=str(folder / "out"))
    return out


def test_stream_counters_share_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "BUCKETS", 3)
    rng = random.Random(3)
    batches, state, want = [], {}, []
    for b in range(3):
        rows = [(k if k != "k0" else None, b * 10 + n, rng.choice([0, 5, 5, 9])) for k in (f"k{i}" for i in range(20)) for n in range(6) if rng.random() < 0.7]
        batches.append(rng.sample(rows, len(rows)))
        for k, n, total in rows:
            last = state.get(k)
            if last != total:
                want.append((str(k), n, total if last is None or total < last else total - last))
            state[k] = total
    out = _drained(spark, "counters", batches, "file_path string, line_no long, total long", J.stateful_counters, tmp_path)
    assert sorted((str(r.file_path), r.line_no, r.delta) for r in out.collect()) == sorted(want)


def test_stream_loops_share_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "BUCKETS", 3)
    rng, minute = random.Random(4), 60_000
    sessions = {f"s{i}": sorted(rng.sample(range(2000, 3500), 40)) for i in range(12)}
    rows = [(s, m * minute, int(rng.random() < 0.15)) for s, at in sessions.items() for m in at]
    last = [("end", 9000 * minute, 1)]
    batches = [[r for r in rows if r[1] < 2500 * minute], [r for r in rows if r[1] >= 2500 * minute], last]
    schema = "session_id string, at_ms long, turn int, ts timestamp"
    timed = [[(*r, datetime.fromtimestamp(r[1] / 1000, UTC)) for r in b] for b in batches]
    out = _drained(spark, "loops", timed, schema, lambda s: J.stateful_loops(s.withWatermark("ts", "10 minutes")), tmp_path)
    want = {
        (s, a, b, n) for s in sessions
        for a, b, n, _ in _brute_runs([m for k, m, t in rows if k == s and not t], [m for k, m, t in rows if k == s and t])
    }
    assert {(r.session_id, r.start_ms, r.end_ms, r.steps) for r in out.collect()} == want


def test_stream_states_do_not_grow_in_number_with_the_keys(spark, tmp_path):
    counts = spark.readStream.schema("file_path string, line_no long, total long").parquet(str(tmp_path))
    points = spark.readStream.schema("session_id string, at_ms long, turn int, ts timestamp").parquet(str(tmp_path)).withWatermark("ts", "1 minute")
    for out in (J.stateful_counters(counts), J.stateful_loops(points)):
        assert ", [bucket#" in out._jdf.queryExecution().analyzed().toString()


def test_a_filter_does_not_parse_a_line_again(spark):
    lines = spark.createDataFrame([("f", 1, '{"type":"x"}'), ("f", 2, "[1]"), ("f", 3, "bad"), ("f", 4, "{}")], "file_path string, line_no long, value string")
    parsed = L.parse_lines(lines)
    assert sorted(r.line_no for r in parsed.collect()) == [1, 4]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_postings_are_made_inside_their_rows(spark):
    """No shuffle for rows with keys of their own; rows that share their keys are merged, as are null keys."""
    words = ["ab", "Ab", "é", "x1", "zz"]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["", "?!", None]
    own = [(i, t, t and t[::-1]) for i, t in enumerate(texts)]
    for rows in (own, own + [(3, "zz other zz", None), (None, "ab", ""), (None, "ab", "zz")]):
        want = {}
        for key, *columns in rows:
            for col, text in zip("ab", columns):
                for at, term in enumerate(re.findall(r"[^\W_]+", (text or "").lower().replace("é", "e"))):
                    want.setdefault((term, key, col), []).append(at)
        out = search.build_postings(spark.createDataFrame(rows, "id long, a string, b string"), ["a", "b"], ["id"], stemmed=False)
        got = [((r.term, r.id, r.col), r.positions) for r in out.collect()]
        assert len(got) == len(want) and dict(got) == {k: sorted(v) for k, v in want.items()}
        assert all(r.tf == len(r.positions) for r in out.collect())
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (rows is not own)


def test_postings_query_reads_texts_once_for_lengths(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["postings_bm25"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "regexp" not in plan


def test_search_eval_query(spark, tmp_path):
    """Against a plain count over short and empty texts; the texts are read before, once, and not for the three figures."""
    import __spark_entry__ as entry

    rng = random.Random(8)
    docs = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 30]))) for _ in range(60)] + [None]
    items = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 3, 4, 6]))) for _ in range(40)] + ["a b c d", "d c b a e"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    recall, mrr, abstention = [], [], []
    for item in items:
        q, scored, expected = item.split()[:4], [], set()
        for i, text in enumerate(docs):
            t = (text or "").split()
            if " ".join(q) in {" ".join(t[k : k + 4]) for k in range(max(len(t) - 3, 1))}:
                expected.add(i)
            if len(set(q) & set(t)) == 4:
                scored.append((-sum(t.count(w) for w in q) / len(t), i))
        ranked = [i for _, i in sorted(scored)[:50]]
        if expected:
            recall.append(len(expected & set(ranked[:5])) / min(len(expected), 5))
            mrr.append(max([1 / (k + 1) for k, i in enumerate(ranked) if i in expected], default=0.0))
        else:
            abstention.append(float(not ranked))
    found = entry.queries()["search_eval"](spark, str(tmp_path))
    mean = lambda v: sum(v) / len(v)
    assert tuple(found.first()) == pytest.approx((mean(recall), mean(mrr), mean(abstention)))
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()


_CODEX = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens", "total_tokens")


def _codex_records(rng, n):
    """Rollout records with members of wrong types, repeated and shrinking totals, and receipts that cover counts."""
    odd = ["7", True, None, [1], {"a": 1}, 2.9, 10**12]
    number = lambda: rng.choice(odd) if rng.random() < 0.1 else rng.randrange(4) * 10
    use = lambda: rng.choice([None, "x", 5, []]) if rng.random() < 0.1 else {k: number() for k in _CODEX if rng.random() < 0.7}
    text = lambda *names: rng.choice(odd) if rng.random() < 0.1 else rng.choice(names)
    stamp = lambda: text(*[f"2024-01-01T00:0{i}:00.000Z" for i in range(4)])
    out, past = [], [{k: 10 for k in _CODEX}]
    for i in range(n):
        kind = rng.choices(["session_meta", "turn_context", "token_usage_record", "event_msg", "other", 5], [1, 1, 4, 8, 1, 1])[0]
        again = rng.choice(past) if rng.random() < 0.4 else use()
        past.append(again)
        payload = {
            "session_meta": {"id": text("s", "t"), "cwd": text("/a", "/b")}, "turn_context": {"model": text("m", "n")},
            "token_usage_record": {"response_id": text(f"r{i}"), "usage": use(), "thread_token_usage": again},
            "event_msg": {"type": text("token_count", "token_count", "agent_message"), "info": rng.choice([None, 3, {}]) if rng.random() < 0.1 else {"total_token_usage": again} | ({"last_token_usage": use()} if rng.random() < 0.3 else {})},
        }.get(kind, {})
        out.append({"type": kind, "timestamp": stamp(), "payload": payload if rng.random() < 0.95 else rng.choice(odd)})
    start = [{"type": "session_meta", "timestamp": "", "payload": {"id": "s"}}, {"type": "turn_context", "payload": {"model": "m"}}]
    return out[:3] + start + out[3:]


def _codex_by_hand(records):
    text = lambda x: x if isinstance(x, str) else None
    member = lambda x, k: x.get(k) if isinstance(x, dict) else None
    key = lambda u: tuple(u[k] or 0 for k in _CODEX[:4])

    def counters(u):
        return {k: int(u[k]) if isinstance(u.get(k), int | float) and not isinstance(u.get(k), bool) else None for k in _CODEX} if isinstance(u, dict) else None

    meta = model = previous = None
    counts, receipts = [], []
    for r in records:
        p, stamp = r["payload"], text(r.get("timestamp"))
        if r["type"] == "session_meta" and text(member(p, "id")) is not None:
            meta = p["id"], text(p.get("cwd"))
        if r["type"] == "turn_context" and text(member(p, "model")) is not None:
            model = p["model"]
        if meta is None or model is None or stamp is None:
            continue
        if r["type"] == "token_usage_record" and text(member(p, "response_id")) is not None and isinstance(p.get("usage"), dict):
            receipts.append((stamp, meta, model, counters(p["usage"]), counters(p.get("thread_token_usage")), p["response_id"]))
        info = member(p, "info") if r["type"] == "event_msg" and member(p, "type") == "token_count" else None
        if isinstance(info, dict):
            totals, usage, before = counters(info.get("total_token_usage")), counters(info.get("last_token_usage")), previous
            previous = totals or previous
            if totals and totals == before:
                continue
            reset = totals and before and (totals["input_tokens"] or 0) < (before["input_tokens"] or 0)
            if usage is None and totals:
                usage = {k: None if totals[k] is None else max(totals[k] - (0 if reset or not before else before[k] or 0), 0) for k in _CODEX}
            if usage is not None:
                counts.append((stamp, meta, model, usage, totals))
    by_total = {key(t) for _, _, _, _, t, _ in receipts if t}
    by_time = {(s, key(u)) for s, _, _, u, _, _ in receipts}
    out = [(s, m, n, u, f"codex:response:{i}", u["cache_write_input_tokens"] or 0) for s, m, n, u, _, i in receipts]
    for s, m, n, u, t in counts:
        if not (t and key(t) in by_total) and (s, key(u)) not in by_time:
            signature = json.dumps({k: x for k, x in (t or u).items() if x is not None}, separators=(",", ":"))
            out.append((s, m, n, u, f"codex:{m[0]}:{s}:{signature}", 0))
    z = lambda u, k: u[k] or 0
    return sorted((m[0], m[1] or "", n, max(z(u, "input_tokens") - z(u, "cached_input_tokens"), 0), z(u, "output_tokens"), z(u, "cached_input_tokens"), w, d) for _, m, n, u, d, w in out)


def _codex_lines(spark, files):
    rows = [(name, i, json.dumps(r)) for name, records in files.items() for i, r in enumerate(records)]
    return L.parse_lines(spark.createDataFrame(rows, "file_path string, line_no long, value string"))


@pytest.mark.parametrize("block", [blocks.LINE_BLOCK, 40, 7])
def test_rollout_usage_matches_a_walk_in_files_of_one_block_and_of_many(spark, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(blocks, "LINE_BLOCK", block)
    monkeypatch.setattr(blocks, "TASK_ROWS", 50)
    files = {f"f{i}": _codex_records(rng, (5, 30, 90)[i % 3]) for i in range(9)}
    out = usage.usage_codex(_codex_lines(spark, files)).collect()
    got = sorted((r.session_id, r.project_path or "", r.model, r.input, r.output, r.cache_read, r.cache_write, r.dedup_key) for r in out)
    assert len(got) > 50 and got == sorted(row for records in files.values() for row in _codex_by_hand(records))


def test_rollout_usage_of_short_files_reads_its_lines_once_and_joins_nothing(spark):
    records = _codex_lines(spark, {"f": _codex_records(random.Random(1), 20)})
    plan = usage.usage_codex(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    code = usage._rollout_parts(records)._jdf.queryExecution().debug().codegenToSeq()
    assert all(code.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(code.size()))
