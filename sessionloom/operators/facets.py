"""Report facets over the priced base: cache, subagents, sessions, distribution, model mix, pace."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import week_ending
from ..functions.money import cents, round2, round4, usd2
from .blocks import nearest_rank, ranked_values, top_n
from .report import dense_weeks


def cache_stats(base: DataFrame) -> DataFrame:
    sums = base.agg(*[F.sum(c).alias(c) for c in ("input", "output", "cache_write", "cache_read", "saved_nano")])
    prompt = F.col("cache_read") + F.col("input") + F.col("cache_write")
    return sums.select(
        F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"),
        F.col("cache_write").alias("cache_write_tokens"), F.col("cache_read").alias("cache_read_tokens"),
        F.when(prompt > 0, round4(F.col("cache_read") / prompt)).otherwise(F.lit(0.0)).alias("hit_rate"),
        usd2(F.col("saved_nano")).alias("saved_usd"),
    )


def subagent_types(base: DataFrame) -> DataFrame:
    agents = base.where("agent_id is not null")
    by_dispatch = agents.groupBy("agent_type", "agent_id").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"), F.sum("messages").alias("messages")
    )
    return by_dispatch.groupBy("agent_type").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"),
        F.count(F.lit(1)).alias("dispatches"), F.sum("messages").alias("messages"),
    ).select(
        "agent_type", "tokens", usd2(F.col("cost_nano")).alias("cost_usd"), "dispatches", "messages",
        round2(F.col("cost_nano") / F.lit(1e9) / F.greatest(F.col("dispatches"), F.lit(1))).alias("cost_per_dispatch_usd"),
    )


def subagent_totals(base: DataFrame) -> DataFrame:
    agent = F.col("agent_id").isNotNull()
    sums = base.groupBy("agent_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano")).agg(
        F.sum("cost_nano").alias("total_nano"),
        F.coalesce(F.sum(F.when(agent, F.col("cost_nano"))), F.lit(0)).alias("sub_nano"),
        F.coalesce(F.sum(F.when(agent, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.count("agent_id").alias("dispatches"),
    )
    share = F.when(F.col("total_nano") > 0, round4(F.col("sub_nano") / F.col("total_nano"))).otherwise(F.lit(0.0))
    return sums.select(usd2(F.col("sub_nano")).alias("cost_usd"), "tokens", "dispatches", share.alias("share_of_cost"))


def top_dispatches(base: DataFrame, n: int = K.TOP_DISPATCHES) -> DataFrame:
    """Costliest dispatches, dated by their first day; type and project of the smallest name."""
    per = base.where("agent_id is not null").groupBy("agent_id").agg(
        F.min("agent_type").alias("agent_type"), F.min("project").alias("project"), F.min("day").alias("day"),
        F.sum("tokens").alias("tokens"), cents(F.sum("cost_nano")).alias("cost_cents"), F.sum("messages").alias("messages"),
    )
    return per.orderBy(F.desc("cost_cents"), "agent_id").limit(n)


def session_costs(base: DataFrame) -> DataFrame:
    """Every session: tokens, cost, messages, subagent share, first day, costliest branch (ties: smaller name)."""
    per_branch = base.groupBy("tool", "session_id", "branch").agg(
        F.sum("cost_nano").alias("cost_nano"), F.sum("tokens").alias("tokens"), F.sum("messages").alias("messages"),
        F.sum(F.when(F.col("agent_id").isNotNull(), F.col("cost_nano")).otherwise(0)).alias("sub_nano"),
        F.min("day").alias("day"), F.min_by("project", F.struct("day", "hour")).alias("project"),
    )
    branch_cost = F.when(F.col("branch").isNotNull(), F.col("cost_nano"))
    per_session = per_branch.groupBy("tool", "session_id").agg(
        F.min_by("branch", F.when(branch_cost.isNotNull(), F.struct(-F.col("cost_nano"), "branch"))).alias("branch"),
        F.min_by("project", F.struct("day", "project")).alias("project"),
        F.min("day").alias("day"), F.sum("tokens").alias("tokens"), F.sum("messages").alias("messages"),
        cents(F.sum("cost_nano")).alias("cost_cents"), cents(F.sum("sub_nano")).alias("subagent_cents"),
    )
    return per_session


def top_sessions(sessions: DataFrame, n: int = K.TOP_SESSIONS, intents: DataFrame | None = None) -> DataFrame:
    top = sessions.orderBy(F.desc("cost_cents"), "session_id", "tool").limit(n)
    total = sessions.agg(F.count(F.lit(1)).alias("total_sessions"))
    top = top.join(F.broadcast(total))  # one row
    if intents is None:
        return top.withColumn("intent", F.lit(None).cast("string"))
    return top.join(intents, ["tool", "session_id"], "left")


def lookup_intents(index: DataFrame) -> DataFrame:
    """Title or opening prompt per usage session; of several index rows the longest session wins."""
    tool = F.when(F.col("tool") == "claude", F.lit("claude-code")).otherwise(F.col("tool"))
    title = F.coalesce(F.nullif(F.trim("custom_title"), F.lit("")), F.nullif(F.trim("first_prompt"), F.lit("")))
    return index.select(tool.alias("tool"), "session_id", title.alias("intent"), "message_count", "file_path").groupBy(
        "tool", "session_id"
    ).agg(F.max_by("intent", F.struct("message_count", "file_path")).alias("intent"))


def cost_distribution(sessions: DataFrame) -> DataFrame:
    """Count, nearest-rank median and 90th percentile, maximum and mean of the session costs in cents."""
    ranks = ranked_values(sessions, [], "cost_cents", {"median_cents": nearest_rank(50), "p90_cents": nearest_rank(90)})
    rest = sessions.agg(F.max("cost_cents").alias("max_cents"), F.sum("cost_cents").alias("sum_cents"), F.count(F.lit(1)).alias("count"))
    return ranks.join(rest).select(
        "count", "median_cents", "p90_cents", "max_cents", F.floor(F.col("sum_cents") / F.col("count") + 0.5).cast("long").alias("mean_cents")
    )


def model_mix(base: DataFrame) -> DataFrame:
    """Weekly cost per model; weeks without usage appear with a null model."""
    weekly = base.groupBy(week_ending(F.col("day")).alias("week"), "model").agg(F.sum("cost_nano").alias("cost_nano"))
    return dense_weeks(weekly).join(weekly, "week", "left").select("week", "model", F.coalesce("cost_nano", F.lit(0)).alias("cost_nano"))


def model_order(base: DataFrame) -> DataFrame:
    totals = base.groupBy("model").agg(F.sum("cost_nano").alias("cost_nano"))
    return totals.select("model", "cost_nano", F.row_number().over(Window.orderBy(F.desc("cost_nano"), "model")).alias("place"))


def pool_tail(mix: DataFrame, order: DataFrame, n: int = K.MODEL_SERIES) -> DataFrame:
    """Weekly series of the ``n`` costliest models, everything else pooled as ``other``."""
    leaders = order.where(F.col("place") <= n).select("model", F.lit(True).alias("leads"))
    named = mix.where("model is not null").join(leaders, "model", "left")
    key = F.when(F.col("leads"), F.col("model")).otherwise(F.lit("other"))
    return named.groupBy("week", key.alias("series")).agg(F.sum("cost_nano").alias("cost_nano"))


def burn_rate(base: DataFrame, first: date, last: date, today: date, runs_to: date | None = None) -> DataFrame:
    """Pace within the period, straight-line projection while it runs, and change against the window before."""
    end = runs_to or last
    period_days = max(1, (end - first).days + 1)
    running = first <= today < end
    elapsed = max(1, (today - first).days + 1) if running else period_days
    from ..functions.dates import previous_window_start

    before = previous_window_start(first, last)
    day = F.col("day")
    sums = base.agg(
        F.coalesce(F.sum(F.when(day.between(F.lit(first), F.lit(last)), F.col("cost_nano"))), F.lit(0)).alias("spent"),
        F.coalesce(F.sum(F.when((day >= F.lit(before)) & (day < F.lit(first)), F.col("cost_nano"))), F.lit(0)).alias("prior"),
    )
    spent = F.col("spent") / F.lit(1e9)
    mean = spent / F.lit(float(elapsed))
    prior = usd2(F.col("prior"))
    return sums.select(
        F.lit(period_days).cast("long").alias("period_days"),
        F.lit(elapsed).cast("long").alias("elapsed_days"),
        usd2(F.col("spent")).alias("spent_usd"),
        round2(mean).alias("daily_mean_usd"),
        round2(mean * F.lit(float(period_days)) if running else spent).alias("projected_usd"),
        F.lit(running).alias("in_progress"),
        prior.alias("prior_usd"),
        F.when(prior != 0, round4((spent - prior) / prior)).alias("change"),
    )


def report_facets(base: DataFrame) -> dict[str, DataFrame]:
    """All facets over one priced base (persist it when several are collected)."""
    sessions = session_costs(base)
    mix, order = model_mix(base), model_order(base)
    return {
        "cache": cache_stats(base),
        "subagent_types": subagent_types(base),
        "subagent_totals": subagent_totals(base),
        "top_dispatches": top_dispatches(base),
        "sessions": top_sessions(sessions),
        "distribution": cost_distribution(sessions),
        "model_mix": mix,
        "model_order": order,
    }
