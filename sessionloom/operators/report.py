"""The daily usage report. All inputs derive from ``pricing.cost_base``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import day_span, week_ending, weekday
from ..functions.money import cents, safe_div

GRAINS = {
    "day": (),
    "tool": ("tool",),
    "provider": ("provider",),
    "model": ("tool", "provider", "model"),
    "project": ("project",),
    "hour": ("hour",),
}
ROLLUP_COLUMNS = ("grain", "day", "tool", "provider", "model", "project", "hour", "tokens", "cost_cents", "sessions", "messages")


def keep_labels(
    df: DataFrame,
    column: str,
    include: Iterable[str] = (),
    include_prefixes: Iterable[str] = (),
    exclude: Iterable[str] = (),
    exclude_prefixes: Iterable[str] = (),
) -> DataFrame:
    """Exact and prefix allow list, then deny list, on one label column."""
    return df.where(label_kept(F.col(column), include, include_prefixes, exclude, exclude_prefixes))


def label_kept(
    label: Column,
    include: Iterable[str] = (),
    include_prefixes: Iterable[str] = (),
    exclude: Iterable[str] = (),
    exclude_prefixes: Iterable[str] = (),
) -> Column:
    def any_of(names: Iterable[str], prefixes: Iterable[str]) -> Column:
        hit = label.isin(*list(names)) if list(names) else F.lit(False)
        for p in prefixes:
            hit = hit | label.startswith(p)
        return hit

    include, include_prefixes = list(include), list(include_prefixes)
    allowed = any_of(include, include_prefixes) if include or include_prefixes else F.lit(True)
    return allowed & ~any_of(list(exclude), list(exclude_prefixes))


def in_range_local(base: DataFrame, first: date | None = None, last: date | None = None, project: str | None = None) -> DataFrame:
    out = base
    if first:
        out = out.where(F.col("day") >= F.lit(first))
    if last:
        out = out.where(F.col("day") <= F.lit(last))
    if project:
        out = out.where(F.col("project") == project)
    return out


def daily_rollup(base: DataFrame) -> DataFrame:
    """Six grains of every local day in one pass: tokens, cost in cents, distinct sessions, messages."""
    dims = [F.col(c) for c in ("day", "tool", "provider", "model", "project", "hour")]
    sets = [[F.col("day"), *[F.col(c) for c in g]] for g in GRAINS.values()]
    session = F.concat_ws("|", "session_tool", "session_id")
    grouped = base.withColumn("session_tool", F.col("tool")).groupingSets(sets, *dims).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("cost_nano").alias("cost_nano"),
        F.countDistinct(session).alias("sessions"),
        F.sum("messages").alias("messages"),
        *[F.grouping(c).alias(f"__g_{c}") for c in ("tool", "provider", "model", "project", "hour")],
    )
    grain = (
        F.when(F.col("__g_model") == 0, "model")
        .when(F.col("__g_tool") == 0, "tool")
        .when(F.col("__g_provider") == 0, "provider")
        .when(F.col("__g_project") == 0, "project")
        .when(F.col("__g_hour") == 0, "hour")
        .otherwise("day")
    )
    return grouped.select(
        grain.alias("grain"), "day", "tool", "provider", "model", "project", "hour",
        "tokens", cents(F.col("cost_nano")).alias("cost_cents"), "sessions", "messages",
    )


def daily_entries(rollup: DataFrame) -> DataFrame:
    """One nested row per day: 24-hour histogram and maps by harness and provider.

    Models and projects have no fixed number, so they stay as rows of the rollup.
    """

    def entry(grain: str, key: Column, *fields: str) -> Column:
        value = F.struct(*[F.col(measures[f]).alias(f) for f in fields])
        pairs = F.collect_list(F.when(F.col("grain") == grain, F.struct(key.alias("k"), value.alias("v"))))
        return F.map_from_entries(F.array_sort(pairs))

    by_hour = F.map_from_entries(F.collect_list(F.when(F.col("grain") == "hour", F.struct("hour", F.col("__n")))))
    whole = F.col("grain") == "day"
    bounded = rollup.where(F.col("grain").isin("day", "hour", "tool", "provider"))
    # names of their own, so that the new columns do not shadow the inputs
    measures = {"tokens": "__t", "cost_cents": "__c", "sessions": "__s", "messages": "__n"}
    bounded = bounded.withColumnsRenamed(measures)
    return bounded.groupBy("day").agg(
        *[F.max(F.when(whole, F.col(c))).alias(name) for name, c in measures.items()],
        F.transform(
            F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at(by_hour, h.cast("long")), F.lit(0))
        ).alias("hour_counts"),
        entry("tool", F.col("tool"), "tokens", "cost_cents", "sessions", "messages").alias("by_tool"),
        entry("provider", F.col("provider"), "tokens", "cost_cents").alias("by_provider"),
    )


def merge_daily(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Prior and fresh rollups by date; a fresh day replaces the prior one."""
    return prior.join(fresh.select("day").distinct(), "day", "left_anti").unionByName(fresh)


def subtract_excluded(prior: DataFrame, kept: Column) -> DataFrame:
    """Remove excluded projects from prior days: project rows go, day totals shrink, other splits stay."""
    dropped = prior.where((F.col("grain") == "project") & ~kept).groupBy("day").agg(
        F.sum("tokens").alias("dt"), F.sum("cost_cents").alias("dc"), F.sum("sessions").alias("ds")
    )
    keep = prior.where((F.col("grain") != "project") | kept)
    whole = F.col("grain") == "day"

    def less(column: str, drop: str) -> Column:
        return F.when(whole, F.col(column) - F.coalesce(drop, F.lit(0))).otherwise(F.col(column)).alias(column)

    return keep.join(dropped, "day", "left").select(
        "grain", "day", "tool", "provider", "model", "project", "hour",
        less("tokens", "dt"), less("cost_cents", "dc"), less("sessions", "ds"), "messages",
    )


def top_level(rollup: DataFrame) -> DataFrame:
    """Re-sum the days per grain. Sessions are a sum of days, so one crossing midnight counts twice."""
    return rollup.groupBy("grain", "tool", "provider", "model", "project", "hour").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost_cents").alias("cost_cents"),
        F.sum("sessions").alias("sessions"), F.sum("messages").alias("messages"),
    )


def peak_hour(top: DataFrame) -> DataFrame:
    """First hour with the most messages (0 when there is none)."""
    hours = top.where("grain = 'hour'")
    return hours.agg(F.coalesce(F.max_by("hour", F.struct("messages", -F.col("hour"))), F.lit(0)).alias("peak_hour"))


def favorite_model(top: DataFrame) -> DataFrame:
    """Model with the most messages; ties by tool, provider and id."""
    key = F.concat_ws("|", "tool", "provider", "model")
    return top.where("grain = 'model'").orderBy(F.desc("messages"), key).limit(1).select("tool", "provider", "model", "messages")


def summary(rollup: DataFrame) -> DataFrame:
    days = rollup.where("grain = 'day'")
    return days.agg(
        F.sum("cost_cents").alias("cost_cents"), F.sum("tokens").alias("tokens"), F.sum("sessions").alias("sessions"),
        F.sum("messages").alias("messages"), F.count(F.lit(1)).alias("active_days"),
    )


def dense_weeks(weeks: DataFrame, column: str = "week") -> DataFrame:
    """Every week ending between the first and the last one present."""
    return weeks.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null").select(
        F.explode(F.expr("sequence(a, b, interval 7 days)")).alias(column)
    )


def weekly_insights(rollup: DataFrame, prs: DataFrame) -> DataFrame:
    """Dense weeks with usage sums and merged pull requests; requests outside the range do not add weeks."""
    days = rollup.where("grain = 'day'").withColumn("week", week_ending(F.col("day")))
    usage = days.groupBy("week").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost_cents").alias("cost_cents"),
        F.sum("sessions").alias("sessions"), F.sum("messages").alias("messages"),
    )
    merged = (
        prs.where("state = 'merged' and merged_day is not null")
        .groupBy(week_ending(F.col("merged_day")).alias("week"))
        .agg(F.count(F.lit(1)).alias("prs_merged"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    )
    measures = ("tokens", "cost_cents", "sessions", "messages", "prs_merged", "additions", "deletions")
    return (
        dense_weeks(usage)
        .join(usage, "week", "left")
        .join(merged, "week", "left")
        .select("week", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures])
    )


def weekly_by_tool(rollup: DataFrame) -> DataFrame:
    return rollup.where("grain = 'tool'").groupBy(week_ending(F.col("day")).alias("week"), "tool").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost_cents").alias("cost_cents")
    )


def weekday_counts(rollup: DataFrame) -> DataFrame:
    return rollup.where("grain = 'day'").groupBy(weekday(F.col("day")).alias("weekday")).agg(F.sum("messages").alias("messages"))


def weekly_highlights(prs: DataFrame, period_from: date, prior: DataFrame | None = None) -> DataFrame:
    """Pull requests by week, newest week first and largest change first; earlier summaries carry over."""
    rows = prs.select(
        week_ending(F.coalesce("merged_day", "created_day")).alias("week"),
        "url", (F.col("additions") + F.col("deletions")).alias("change"),
    ).where(F.col("week") >= F.lit(period_from))
    if prior is None:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    else:
        rows = rows.join(prior.where("summary is not null").select("week", "summary"), "week", "left")
    return rows.orderBy(F.desc("week"), F.desc("change"), "url")


def report_derived(rollup: DataFrame, weekly: DataFrame, sessions: DataFrame, period_to: date) -> DataFrame:
    """One row of derived rates: record span, cost per month, four-week trend, per-unit costs (in cents)."""
    days = rollup.where("grain = 'day'")
    totals = days.agg(
        F.sum("cost_cents").alias("total"), F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("active_days"),
        F.coalesce(F.min(F.when(F.col("cost_cents") > 0, F.col("day"))), F.min("day")).alias("record_from"),
    )
    latest = Window.orderBy(F.desc("week"))
    recent = weekly.select("cost_cents", F.row_number().over(latest).alias("r")).agg(
        F.sum(F.when(F.col("r") <= 4, F.col("cost_cents"))).alias("last4"),
        F.coalesce(F.sum(F.when((F.col("r") > 4) & (F.col("r") <= 8), F.col("cost_cents"))), F.lit(0)).alias("prev4"),
    )
    counted = sessions.agg(F.count(F.lit(1)).alias("distinct_sessions"))
    span = F.greatest(day_span(F.col("record_from"), F.lit(period_to)), F.lit(1))
    total = F.col("total").cast("double")
    return totals.join(recent).join(counted).select(
        F.date_format("record_from", "yyyy-MM-dd").alias("record_from"),
        span.cast("long").alias("record_days"),
        safe_div(total, span / F.lit(30.44)).alias("cents_per_month"),
        "last4", "prev4",
        F.when(F.col("prev4") > 0, F.col("last4") / F.col("prev4")).alias("trend"),
        safe_div(F.col("last4").cast("double"), total).alias("share_last4"),
        safe_div(total, F.col("messages")).alias("cents_per_message"),
        safe_div(total, F.col("distinct_sessions")).alias("cents_per_session"),
        safe_div(total, F.col("active_days")).alias("cents_per_day"),
        safe_div(F.col("messages").cast("double"), F.col("active_days")).alias("messages_per_day"),
        safe_div(F.col("tokens").cast("double"), F.col("active_days")).alias("tokens_per_day"),
    )


def calendar_heat(daily: DataFrame, first: date, last: date) -> DataFrame:
    """Sunday-first calendar of whole weeks: cost level, quartile of the busiest day, square-root strip level.

    ``daily`` has day, tokens, cost_cents. Days outside [first, last] have level -1.
    """
    start = first - timedelta(days=(first.weekday() + 1) % 7)
    end = last + timedelta(days=(5 - last.weekday()) % 7)
    spark = daily.sparkSession
    days = spark.range(0, (end - start).days + 1, 1, 1).select(F.expr(f"date_add(date'{start.isoformat()}', cast(id as int))").alias("day"))
    peak = daily.where(F.col("day").between(F.lit(first), F.lit(last))).agg(F.greatest(F.max("tokens"), F.lit(1)).alias("peak"))
    cost = F.coalesce("cost_cents", F.lit(0))
    tokens = F.coalesce("tokens", F.lit(0))
    inside = F.col("day").between(F.lit(first), F.lit(last))
    level = F.when(cost == 0, 0).when(cost < 1000, 1).when(cost < 5000, 2).when(cost < 15000, 3).otherwise(4)
    quartile = F.when(tokens == 0, -1).otherwise(F.least(F.floor(tokens / F.col("peak") * 4), F.lit(3)))
    strip = F.when(tokens == 0, 0).otherwise(F.least(F.lit(4), F.floor(F.sqrt(tokens / F.col("peak")) * 3.99) + 1))
    return (
        days.join(daily, "day", "left")
        .join(F.broadcast(peak))  # one row
        .select(
            "day", weekday(F.col("day")).alias("weekday"),
            F.when(inside, level).otherwise(-1).cast("long").alias("cost_level"),
            F.when(inside, quartile).otherwise(-1).cast("long").alias("quartile"),
            F.when(inside, strip).otherwise(-1).cast("long").alias("strip_level"),
        )
    )


def report_shape(entries: DataFrame) -> DataFrame:
    """Public columns of the daily rows, costs in dollars."""
    return entries.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), "tokens", (F.col("cost_cents") / F.lit(100.0)).alias("cost_usd"),
        "sessions", "messages", "hour_counts", "by_tool", "by_provider",
    )


def write_report(rollup: DataFrame, path: str) -> None:
    """Daily rows as JSON plus the open-ended grains (models, projects) as rows next to them."""
    report_shape(daily_entries(rollup)).write.mode("overwrite").json(f"{path}/daily")
    rollup.where(F.col("grain").isin("model", "project")).write.mode("overwrite").json(f"{path}/breakdowns")
