"""Which sessions stand behind which commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import basename, resume_command
from .blocks import asof_next, top_n


def to_repo_relative(path: Column, roots: Column) -> Column:
    """``path`` without the longest root above it; relative paths and outsiders stay as they are."""
    fitting = F.filter(roots, lambda r: (path == r) | F.startswith(path, F.concat(r, F.lit("/"))))
    longest = F.element_at(F.array_sort(F.transform(fitting, lambda r: F.struct(-F.length(r), r.alias("r")))), 1)["r"]
    rest = F.when(path == longest, F.lit("")).otherwise(F.substring(path, F.length(longest) + 2, F.length(path)))
    return F.when(~path.startswith("/") | (F.size(fitting) == 0), path).otherwise(rest)


def windows(sessions: DataFrame) -> DataFrame:
    """start_ms and end_ms of each session: its instants, else the bounds of its last day."""
    day = F.unix_millis(F.col("date").cast("timestamp"))
    return sessions.withColumn("start_ms", F.coalesce(F.unix_millis("started_at"), day)).withColumn(
        "end_ms", F.coalesce(F.unix_millis("ended_at"), day + K.DAY_MS - 1)
    )


def date_window(sessions: DataFrame, day: Column, before: int = 2, after: int = 1) -> DataFrame:
    """Sessions last active from two days before a commit's day to one day after it."""
    return sessions.where(F.col("date").between(F.date_sub(day, before), F.date_add(day, after)))


def correlate_commits(commits: DataFrame, work: DataFrame, keys: Sequence[str] = (), limit: int = K.SESSIONS_PER_COMMIT) -> DataFrame:
    """Best sessions of every commit.

    ``commits``: keys, sha, at_ms, files. ``work``: keys, session_key, start_ms, end_ms, files. A session fits
    when the commit lies between its start and two hours after its end. Windows are cut into hours, so the
    range condition becomes an equi-join; score is ten per shared file minus the hours between session end
    and commit.
    """
    keys = list(keys)
    hour = K.HOUR_MS
    slots = work.select(
        *keys, "session_key", "start_ms", "end_ms", F.col("files").alias("work_files"),
        F.explode(F.sequence(F.floor(F.col("start_ms") / hour), F.floor((F.col("end_ms") + K.COMMIT_SLACK_MS) / hour))).alias("slot"),
    )
    placed = commits.select(*keys, "sha", "at_ms", "files", F.floor(F.col("at_ms") / hour).alias("slot"))
    pairs = placed.join(slots, [*keys, "slot"]).where(
        (F.col("start_ms") <= F.col("at_ms")) & (F.col("at_ms") <= F.col("end_ms") + K.COMMIT_SLACK_MS)
    )
    overlap = F.array_intersect("files", "work_files")
    scored = pairs.select(
        *keys, "sha", "at_ms", "session_key", "start_ms", "end_ms", overlap.alias("overlapping_files"),
        (F.size(overlap) * F.lit(10.0) - F.abs(F.col("at_ms") - F.col("end_ms")) / F.lit(float(hour))).alias("score"),
        F.when(F.size(overlap) > 0, F.lit("files+time")).otherwise(F.lit("time-only")).alias("confidence"),
    )
    order = [F.desc("score"), F.desc("start_ms"), F.col("session_key")]
    return top_n(scored, [*keys, "sha"], order, limit, rank="place")


def unlanded_attempts(work: DataFrame, commits: DataFrame, now_ms: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per touched file, sessions that ended over two hours ago and whose window holds no commit of that file.

    The next commit at or after the session's start decides it, so no pairs are built.
    """
    keys = list(keys)
    touched = work.where(F.col("end_ms") + K.COMMIT_SLACK_MS <= now_ms).select(
        *keys, "session_key", "start_ms", "end_ms", F.explode(F.array_distinct("files")).alias("file")
    )
    landed = commits.select(*keys, F.explode("files").alias("file"), "at_ms")
    nearest = asof_next(touched, landed, [*keys, "file"], "start_ms", "at_ms", F.col("at_ms"), "next_ms")
    return nearest.where(F.col("next_ms").isNull() | (F.col("next_ms") > F.col("end_ms") + K.COMMIT_SLACK_MS)).drop("next_ms")


def touching_file(sessions: DataFrame, fragment: str) -> DataFrame:
    return sessions.where(F.exists("files_touched", lambda f: F.contains(f, F.lit(fragment))))


def latest_commit_per_file(commits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return commits.select(*keys, "sha", "at_ms", F.explode("files").alias("file")).groupBy(*keys, "file").agg(
        F.max_by("sha", F.struct("at_ms", "sha")).alias("sha")
    )


def evidence(ranked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ranked pairs with what a reader needs: headline, harness, resume command, file names."""
    shown = sessions.select(
        F.col("file_path").alias("session_key"), "tool", "session_id", "cwd",
        F.coalesce(F.nullif("custom_title", F.lit("")), F.col("first_prompt")).alias("headline"),
    )
    return ranked.join(shown, "session_key").select(
        "sha", "place", "session_key", "tool", "session_id", "headline", "confidence",
        F.transform("overlapping_files", basename).alias("file_names"),
        resume_command(F.col("tool"), F.col("cwd"), F.col("session_id")).alias("resume_command"),
    )
