"""Year-in-review content: phrases, words, tables over sessions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..context import rows
from ..functions import scoring as S
from ..functions import text as T
from ..functions.dates import weekday
from .blocks import exact_median
from .rhythm import not_junk_cwd


def content_period(sessions: DataFrame, first: date, last: date, tool: str | None = None) -> DataFrame:
    """Dated, non-empty sessions of people, created within the period."""
    out = sessions.where(
        F.col("created_at").between(F.lit(first), F.lit(last)) & (F.col("message_count") > 0) & not_junk_cwd(F.col("cwd"))
    )
    return out if tool is None else out.where(F.col("tool") == K.INDEX_TOOL.get(tool, tool))


def phrase_flags(text: Column, role: Column, phrases: Sequence[tuple] = K.PHRASES) -> list[Column]:
    low = F.lower(text)
    out = []
    for name, owner, patterns in phrases:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | low.contains(p)
        out.append(((role == owner) & hit).cast("int").alias(name))
    return out


def phrase_counts(messages: DataFrame, keys: Sequence[str] = (), phrases: Sequence[tuple] = K.PHRASES) -> DataFrame:
    """Messages containing each phrase, all phrases in one pass: keys, phrase, role, count."""
    keys = list(keys)
    flags = messages.where("msg_index >= 0").select(*keys, *phrase_flags(F.col("text"), F.col("role"), phrases))
    sums = flags.groupBy(*keys).agg(*[F.sum(n).alias(n) for n, _, _ in phrases])
    cells = [F.struct(F.lit(n).alias("phrase"), F.lit(r).alias("role"), F.coalesce(n, F.lit(0)).alias("count")) for n, r, _ in phrases]
    return sums.select(*keys, F.inline(F.array(*cells)))


def monologue(messages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average (rounded) and longest message per role."""
    sized = messages.where("msg_index >= 0").select(*keys, "role", F.length("text").alias("n"))
    sums = sized.groupBy(*keys, "role").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"), F.max("n").alias("longest"))
    return sums.select(*keys, "role", F.floor(F.col("s") / F.col("c") + 0.5).cast("long").alias("average"), F.col("longest").cast("long").alias("longest"))


def word_counts(messages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Own vocabulary of the user turns: messages and sessions per word, common words removed."""
    keys = list(keys)
    spark = messages.sparkSession
    stop = rows(spark, "word", [(w,) for w in sorted(K.STOP_WORDS)])
    words = messages.where("role = 'user' and msg_index >= 0").select(*keys, "file_path", F.explode(T.mining_words(F.col("text"))).alias("word"))
    per_file = words.join(stop, "word", "left_anti").groupBy(*keys, "word", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(*keys, "word").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("sessions"))


def mine_words(messages: DataFrame, limit: int = K.WORD_TOP, min_count: int = K.WORD_MIN_COUNT, min_sessions: int = K.WORD_MIN_SESSIONS) -> DataFrame:
    spread = word_counts(messages).where((F.col("count") >= min_count) & (F.col("sessions") >= min_sessions))
    return spread.orderBy(F.desc("count"), F.desc("sessions"), "word").limit(limit)


def session_totals(sessions: DataFrame) -> DataFrame:
    """Drive-bys, errors and the weekday with the most of them."""
    by_day = sessions.groupBy(weekday(F.col("created_at")).alias("weekday")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("message_count") <= 2).cast("int")).alias("short"),
        F.sum(F.col("errored").cast("int")).alias("errored"), F.sum("error_count").alias("errors"),
    )
    worst = F.max_by(F.struct("weekday", "errors"), F.struct("errors", -F.col("weekday")))
    return by_day.agg(
        F.sum("n").alias("sessions"), F.sum("short").alias("drive_bys"), F.sum("errored").alias("sessions_errored"),
        F.sum("errors").alias("total_errors"), worst.alias("w"),
    ).select(
        "sessions", "drive_bys", "sessions_errored", "total_errors",
        F.when(F.col("w.errors") > 0, F.col("w.weekday")).alias("cursed_weekday"),
        F.when(F.col("w.errors") > 0, F.col("w.errors")).otherwise(F.lit(0)).cast("long").alias("cursed_count"),
    )


def top_files(sessions: DataFrame, limit: int = 5) -> DataFrame:
    files = sessions.select(F.explode(F.array_distinct("files_touched")).alias("file"))
    counts = files.groupBy("file").agg(F.count(F.lit(1)).alias("sessions"))
    return counts.orderBy(F.desc("sessions"), "file").limit(limit).select(T.short_path(F.col("file")).alias("name"), "sessions")


def top_commands(sessions: DataFrame, limit: int = 5) -> DataFrame:
    """Command families by sessions, everyday plumbing removed."""
    families = sessions.select(F.explode(F.array_distinct(F.transform("commands", T.command_family))).alias("name"))
    own = families.where((F.col("name") != "") & ~F.split("name", " ")[0].isin(*K.PLUMBING_COMMANDS))
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "name").limit(limit)


def abandoned_project(sessions: DataFrame, period_to: date, days: int = K.ABANDONED_DAYS, least: int = K.ABANDONED_SESSIONS) -> DataFrame:
    """The most used project that has been silent since before the cutoff (ties: smaller name)."""
    cutoff = period_to - timedelta(days=days)
    used = sessions.groupBy(T.resolve_project(F.col("cwd")).alias("name")).agg(
        F.count(F.lit(1)).alias("sessions"), F.max("date").alias("last_seen")
    )
    return used.where((F.col("sessions") >= least) & (F.col("last_seen") < F.lit(cutoff))).orderBy(F.desc("sessions"), "name").limit(1)


def depth_median(sessions: DataFrame) -> DataFrame:
    """Median length of sessions with more than two messages."""
    return exact_median(sessions.where("message_count > 2"), [], "message_count").select(F.col("median").alias("depth_median"))


def session_of_year(sessions: DataFrame) -> DataFrame:
    """The non-trivial session with the highest significance (ties: earlier, then smaller path)."""
    files, closing = F.size("files_touched"), S.closing_text()
    scored = sessions.where(~S.is_trivia(F.col("message_count"), files, closing)).withColumn(
        "score", S.significance(F.col("message_count"), files, closing)
    )
    title = T.clean_title(F.coalesce(F.nullif("custom_title", F.lit("")), F.nullif("first_prompt", F.lit("")), F.lit("untitled")))
    return scored.orderBy(F.desc("score"), "created_at", "file_path").limit(1).select(
        "file_path", title.alias("title"), T.resolve_project(F.col("cwd")).alias("project"), "created_at", "message_count",
        files.cast("long").alias("files_touched"), T.has_artifact(closing).alias("shipped"),
    )
