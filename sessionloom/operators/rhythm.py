"""When work happens: sittings, autonomous loops, heat map, nights, model adoption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import local_clock, local_date, local_hour, local_minute, weekday, ymd
from ..functions.text import canonical_model, clean_prompt, is_real_model, resolve_project
from .blocks import exact_median, hour_block, top_n


def not_junk_cwd(cwd: Column) -> Column:
    """Working directories of probes and scratch runs are out; an unknown one stays."""
    junk = F.lit(False)
    for s in K.JUNK_SUBSTRINGS:
        junk = junk | cwd.contains(s)
    for s in K.JUNK_PREFIXES:
        junk = junk | cwd.startswith(s)
    for s in K.JUNK_SUFFIXES:
        junk = junk | cwd.endswith(s)
    return ~F.coalesce(junk, F.lit(False))


def runs(
    events: DataFrame, keys: Sequence[str], turns: DataFrame | None = None, gap_ms: int = K.SITTING_GAP_MS
) -> DataFrame:
    """Stretches of events without a pause above ``gap_ms`` and without a human turn in between.

    ``events``: keys, at_ms, tokens. ``turns``: keys, at_ms, text; a turn at the instant of an event comes
    before it. Output per run: keys, start_ms, end_ms, steps, tokens, and the latest turn at or before the
    start (trigger_ms, trigger_text).

    Rows of one instant are combined first. Each key is then cut into hours; runs are formed inside the
    hours in parallel and only one summary row per hour is walked in order, so a session that holds a large
    share of all events is still spread over many tasks.
    """
    keys = list(keys)
    points = events.select(
        *keys, "at_ms", "tokens", F.lit(1).cast("long").alias("steps"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("turn")
    )
    if turns is not None:
        points = points.unionByName(
            turns.select(
                *keys, "at_ms", F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("steps"), "text", F.lit(1).alias("turn")
            )
        )
    instants = points.groupBy(*keys, "at_ms").agg(
        F.sum("tokens").alias("tokens"), F.sum("steps").alias("steps"), F.max("turn").alias("turn"), F.min("text").alias("text")
    ).withColumn("block", hour_block(F.col("at_ms")))

    inside = Window.partitionBy(*keys, "block").orderBy("at_ms")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event_ms = F.when(F.col("steps") > 0, F.col("at_ms"))
    turn = F.when(F.col("turn") == 1, F.struct(F.col("at_ms").alias("ms"), F.col("text").alias("text")))
    marked = instants.select(
        "*",
        F.last(event_ms, ignorenulls=True).over(before).alias("prev"),
        F.last(turn, ignorenulls=True).over(upto).alias("spoken"),
    )
    opens = F.col("prev").isNull() | (F.col("at_ms") - F.col("prev") > gap_ms) | F.coalesce(
        F.col("spoken.ms") > F.col("prev"), F.lit(False)
    )
    numbered = marked.withColumn(
        "local_run", F.sum(F.when((F.col("steps") > 0) & opens, 1).otherwise(0)).over(upto)
    )
    pieces = numbered.where("steps > 0").groupBy(*keys, "block", "local_run").agg(
        F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"), F.sum("steps").alias("steps"),
        F.sum("tokens").alias("tokens"), F.min_by("spoken", "at_ms").alias("spoken"),
    )
    # One row per key and hour: what the next hour needs to know.
    hours = numbered.groupBy(*keys, "block").agg(
        F.min(event_ms).alias("first_ms"),
        F.max(event_ms).alias("last_ms"),
        F.max(turn).alias("last_turn"),
        F.min_by("spoken", event_ms).alias("first_spoken"),
        F.max("local_run").alias("n_runs"),
    )
    in_order = Window.partitionBy(*keys).orderBy("block")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(
        "*",
        F.last("last_ms", ignorenulls=True).over(earlier).alias("carry_ms"),
        F.last("last_turn", ignorenulls=True).over(earlier).alias("carry_turn"),
    ).withColumn(
        "continues",
        F.coalesce(
            (F.col("first_ms") - F.col("carry_ms") <= gap_ms)
            & ~F.coalesce(F.coalesce("first_spoken", "carry_turn")["ms"] > F.col("carry_ms"), F.lit(False)),
            F.lit(False),
        ),
    )
    head = F.when(
        (F.col("n_runs") > 1) | ((F.col("n_runs") == 1) & ~F.col("continues")), F.struct("block", F.col("n_runs").alias("local_run"))
    )
    heads = carried.select(
        *keys, "block", "continues", "carry_turn", F.last(head, ignorenulls=True).over(earlier).alias("open_head")
    )
    joined = pieces.join(heads, [*keys, "block"])
    chain = F.when((F.col("local_run") == 1) & F.col("continues"), F.col("open_head")).otherwise(F.struct("block", "local_run"))
    return (
        joined.withColumn("chain", chain)
        .withColumn("trigger", F.coalesce("spoken", "carry_turn"))
        .groupBy(*keys, "chain")
        .agg(
            F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("steps").alias("steps"),
            F.sum("tokens").alias("tokens"), F.min_by("trigger", "start_ms").alias("trigger"),
        )
        .select(
            *keys, "start_ms", "end_ms", "steps", "tokens",
            F.col("trigger.ms").alias("trigger_ms"), F.col("trigger.text").alias("trigger_text"),
        )
    )


def sittings(events: DataFrame, keys: Sequence[str] = ("tool", "session_id")) -> DataFrame:
    """Continuous stretches per session: keys, start_ms, end_ms, replies, duration_ms."""
    timed = events.select(*keys, F.unix_millis("ts").alias("at_ms"), F.lit(0).cast("long").alias("tokens"))
    return runs(timed, keys).select(
        *keys, "start_ms", "end_ms", F.col("steps").alias("replies"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms")
    )


def session_projects(events: DataFrame) -> DataFrame:
    """First known working directory of each session, as project name."""
    return events.groupBy("tool", "session_id").agg(
        F.min_by("project_path", F.when(F.col("project_path").isNotNull(), F.col("seq"))).alias("project_path"),
        F.count(F.lit(1)).alias("replies"),
    ).select("tool", "session_id", resolve_project(F.col("project_path")).alias("project"), "replies")


def longest_sitting(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """The longest sitting (ties: earlier start, then key) with its project and local day."""
    best = sittings(events).orderBy(F.desc("duration_ms"), "start_ms", "tool", "session_id").limit(1)
    return best.join(session_projects(events), ["tool", "session_id"]).select(
        "tool", "session_id", "duration_ms", best["replies"],
        ymd(local_date(F.timestamp_millis("start_ms"), tz)).alias("date"), "project",
    )


def autonomous_loops(events: DataFrame, turns: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Runs of assistant work between human turns, timed from the prompt when it is close enough.

    Sessions without a human turn and events in probe directories do not take part.
    """
    keys = list(keys)
    spoken = turns.select(*keys).distinct()
    playing = events.where(not_junk_cwd(F.col("project_path"))).join(spoken, keys, "left_semi")
    found = runs(playing, keys, turns)
    anchor = F.when(F.col("start_ms") - F.col("trigger_ms") <= K.SITTING_GAP_MS, F.col("trigger_ms")).otherwise(F.col("start_ms"))
    return found.select(
        *keys, "start_ms", "end_ms", "steps", "tokens", "trigger_text",
        anchor.alias("anchor_ms"), (F.col("end_ms") - anchor).alias("duration_ms"),
    )


def loop_summary(loops: DataFrame, tz: str = "UTC", keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The longest loop, the number of loops and their median length."""
    longest = loops.orderBy(F.desc("duration_ms"), "start_ms", *keys).limit(1)
    stats = exact_median(loops, [], "duration_ms", 3_600_000)
    at = F.timestamp_millis("anchor_ms")
    return longest.join(stats).select(
        *keys, "duration_ms", "steps", "tokens", ymd(local_date(at, tz)).alias("date"), local_clock(at, tz).alias("start_clock"),
        clean_prompt(F.col("trigger_text")).alias("prompt"), F.col("n").alias("count"), F.col("median").alias("median_ms"),
    )


def heat_map(events: DataFrame, tz: str = "UTC", keys: Sequence[str] = ()) -> DataFrame:
    """Events per weekday (0 = Sunday) and hour."""
    return events.groupBy(
        *keys, weekday(local_date(F.col("ts"), tz)).alias("weekday"), local_hour(F.col("ts"), tz).alias("hour")
    ).agg(F.count(F.lit(1)).alias("messages"))


def rhythm(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Marginal peak hour and weekday, nights with work past midnight, latest small-hours moment, night share."""
    slots = events.groupBy(
        local_date(F.col("ts"), tz).alias("day"), local_hour(F.col("ts"), tz).alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"), F.max(local_minute(F.col("ts"), tz)).alias("minute"))
    hours = slots.groupBy("hour").agg(F.sum("n").alias("n"))
    days = slots.groupBy(weekday(F.col("day")).alias("weekday")).agg(F.sum("n").alias("n"))
    night = F.col("hour") <= 4
    late = F.when(night, F.struct(F.col("hour") * 60 + F.col("minute"), -F.unix_date("day")))
    moment = F.max_by(F.struct("day", "hour", "minute"), late)
    return (
        slots.agg(
            F.countDistinct(F.when(night, F.col("day"))).alias("nights"),
            moment.alias("m"),
            (F.sum(F.when((F.col("hour") >= 22) | (F.col("hour") <= 5), F.col("n")).otherwise(0)) / F.sum("n")).alias("night_share"),
        )
        .join(hours.agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour")))
        .join(days.agg(F.max_by("weekday", F.struct("n", -F.col("weekday"))).alias("peak_weekday")))
        .select(
            "peak_hour", "peak_weekday", "nights", ymd(F.col("m.day")).alias("latest_date"),
            (F.col("m.hour") * 60 + F.col("m.minute")).alias("latest_minute"), "night_share",
        )
    )


def distinct_session_counts(events: DataFrame) -> DataFrame:
    """True distinct sessions by tool and by project: kind, name, sessions."""
    sessions = session_projects(events)
    pairs = F.array(
        F.struct(F.lit("tool").alias("kind"), F.col("tool").alias("name")), F.struct(F.lit("project").alias("kind"), F.col("project").alias("name"))
    )
    return sessions.select(F.inline(pairs)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("sessions"))


def median_replies(events: DataFrame) -> DataFrame:
    return exact_median(session_projects(events), [], "replies").select(F.col("n").alias("sessions"), F.col("median").alias("median_replies"))


def model_adoption(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per canonical model: first day seen and first day it led the day's messages (ties: smaller name)."""
    per_day = (
        events.where(is_real_model(F.col("model")))
        .groupBy(canonical_model(F.col("model")).alias("model"), local_date(F.col("ts"), tz).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    leaders = top_n(per_day, ["day"], [F.desc("n"), F.col("model")], 1).groupBy("model").agg(F.min("day").alias("first_top_day"))
    seen = per_day.groupBy("model").agg(F.min("day").alias("first_seen"))
    return seen.join(leaders, "model", "left")


def event_cache_rate(events: DataFrame) -> DataFrame:
    sums = events.agg(F.sum("cache_read").alias("cache_read"), F.sum(F.col("input") + F.col("cache_read")).alias("readable"))
    return sums.select(
        F.col("cache_read").alias("cache_read_tokens"),
        F.when(F.col("readable") > 0, F.col("cache_read") / F.col("readable")).alias("cache_hit_rate"),
    )
