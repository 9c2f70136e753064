"""Costs: tiered token prices, evaluated on pre-aggregated counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import local_date, local_hour
from ..functions.money import nano, usd2
from ..functions.text import resolve_project
from ..sources.pricing import resolve_models
from .blocks import dealt

COUNTERS = ("input", "output", "cache_read", "write_5m", "write_1h")


def _over(tokens: Column) -> Column:
    return F.greatest(tokens - F.lit(K.TIER_THRESHOLD), F.lit(0)).cast("long")


def _rates() -> dict[str, tuple[Column, Column]]:
    """Base rate and rate above the threshold for each counter (the base rate where none is set)."""
    base = {
        "input": F.col("input_rate"),
        "output": F.col("output_rate"),
        "cache_read": F.coalesce(F.col("cache_read_rate"), F.col("input_rate") * F.lit(K.CACHE_READ_RATIO)),
        "write_5m": F.coalesce(F.col("cache_write_rate"), F.col("input_rate") * F.lit(K.CACHE_WRITE_RATIO)),
        "write_1h": F.col("input_rate") * F.lit(K.CACHE_WRITE_1H_RATIO),
    }
    above = {
        "input": F.col("input_above"),
        "output": F.col("output_above"),
        "cache_read": F.col("cache_read_above"),
        "write_5m": F.col("cache_write_above"),
        "write_1h": F.col("input_above") * F.lit(K.CACHE_WRITE_1H_RATIO),
    }
    return {c: (base[c], F.coalesce(above[c], base[c])) for c in COUNTERS}


def _with_rates(df: DataFrame, resolved: DataFrame) -> DataFrame:
    rates = resolved.select(
        "model", "price_key", "priced_as", "fast_multiplier",
        F.col("input").alias("input_rate"), F.col("output").alias("output_rate"),
        F.col("cache_read").alias("cache_read_rate"), F.col("cache_write").alias("cache_write_rate"),
        "input_above", "output_above", "cache_read_above", "cache_write_above",
    )
    return df.join(rates, "model", "left")


def event_cost(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Cost of every event: the recorded cost where one exists, else the tiered price (null rates cost 0)."""
    counters = {
        "input": F.col("input"), "output": F.col("output"), "cache_read": F.col("cache_read"),
        "write_5m": F.greatest(F.col("cache_write") - F.col("cache_write_1h"), F.lit(0)), "write_1h": F.col("cache_write_1h"),
    }
    total = F.lit(0.0)
    for name, (base, above) in _rates().items():
        over = _over(counters[name])
        total = total + (counters[name] - over) * base + over * above
    multiplier = F.when(F.col("speed") == "fast", F.col("fast_multiplier")).otherwise(F.lit(1.0))
    priced = _with_rates(events, resolved)
    return priced.select(
        *events.columns,
        "priced_as",
        F.coalesce(nano(F.col("cost_usd")), nano(total * multiplier), F.lit(0)).cast("long").alias("cost_nano"),
    )


BASE_KEYS = (
    "day", "hour", "tool", "provider", "model", "speed", "session_id", "project", "branch", "agent_id", "agent_type",
)


def cost_base(
    events: DataFrame,
    prices: DataFrame,
    tz: str = "UTC",
    keys: Sequence[str] = BASE_KEYS,
    models: DataFrame | None = None,
) -> DataFrame:
    """One pre-aggregated, priced row per session-hour slice; every report figure is a sum over it.

    The tier split is linear once each event is cut at the threshold, so prices are applied to summed
    counters: events are combined before the first shuffle and never joined one by one. ``models`` may name
    a cheaper source of the model ids and the number of ``events`` (any superset will do).
    """
    slim = events.select(
        local_date("ts", tz).alias("day"),
        local_hour("ts", tz).alias("hour"),
        "tool", "provider", "model",
        F.coalesce("speed", F.lit("standard")).alias("speed"),
        "session_id",
        resolve_project(F.col("project_path")).alias("project"),
        "branch", "agent_id", "agent_type",
        F.col("cost_usd").isNull().alias("unpriced"),
        nano(F.col("cost_usd")).alias("recorded"),
        "input", "output", "cache_read", "cache_write",
        F.greatest(F.col("cache_write") - F.col("cache_write_1h"), F.lit(0)).cast("long").alias("write_5m"),
        F.col("cache_write_1h").alias("write_1h"),
    )

    def open_sum(column: Column, name: str) -> Column:
        return F.sum(F.when(F.col("unpriced"), column).otherwise(F.lit(0))).alias(name)

    grouped = slim.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("input").alias("input"),
        F.sum("output").alias("output"),
        F.sum("cache_read").alias("cache_read"),
        F.sum("cache_write").alias("cache_write"),
        F.sum(_over(F.col("cache_read"))).alias("read_over"),
        F.coalesce(F.sum("recorded"), F.lit(0)).alias("recorded"),
        *[open_sum(F.col(c), f"t_{c}") for c in COUNTERS],
        *[open_sum(_over(F.col(c)), f"o_{c}") for c in COUNTERS],
    )
    known = events if models is None else models
    resolved = resolve_models(known.select("model"), prices)
    # There are no more slices than events; what is made of them in the same stage takes memory by the slice.
    rated = dealt(_with_rates(grouped, resolved), keys, known.count())
    rates = _rates()
    total = F.lit(0.0)
    for c, (base, above) in rates.items():
        total = total + (F.col(f"t_{c}") - F.col(f"o_{c}")) * base + F.col(f"o_{c}") * above
    multiplier = F.when(F.col("speed") == "fast", F.col("fast_multiplier")).otherwise(F.lit(1.0))
    read_base, read_above = rates["cache_read"]
    in_base, in_above = rates["input"]
    low = F.col("cache_read") - F.col("read_over")
    saved = (low * in_base + F.col("read_over") * in_above) - (low * read_base + F.col("read_over") * read_above)
    return rated.select(
        *keys,
        "messages", "input", "output", "cache_read", "cache_write",
        (F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tokens"),
        (F.col("recorded") + F.coalesce(nano(total * multiplier), F.lit(0))).cast("long").alias("cost_nano"),
        F.coalesce(F.greatest(nano(saved * multiplier), F.lit(0)), F.lit(0)).cast("long").alias("saved_nano"),
        "price_key", "priced_as",
        F.col("recorded").alias("recorded_nano"),
        (F.col("t_input") + F.col("t_output") + F.col("t_cache_read") + F.col("t_write_5m") + F.col("t_write_1h")).alias("open_tokens"),
    )


def pricing_warnings(base: DataFrame) -> DataFrame:
    """Tokens per model without a price of its own; ``priced_as`` names the family rate that was used."""
    own = F.col("price_key").isNotNull() & F.col("priced_as").isNull()
    return (
        base.where(~own)
        .groupBy("model", "priced_as")
        .agg(F.sum("open_tokens").alias("tokens"))
        .where("tokens > 0")
    )


def cost_by(base: DataFrame, *keys: str) -> DataFrame:
    return base.groupBy(*keys).agg(
        F.sum("tokens").alias("tokens"), F.sum("messages").alias("messages"), F.sum("cost_nano").alias("cost_nano")
    ).withColumn("cost_usd", usd2(F.col("cost_nano")))
