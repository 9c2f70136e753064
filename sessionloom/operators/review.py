"""Year in review: tables, scored cards, personas and comparisons, for every account at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..context import rows
from ..functions.money import saturation
from ..functions.text import canonical_model, fnv1a, is_real_model
from .blocks import top_n


# --- yearly tables -----------------------------------------------------------------


def top_projects(base: DataFrame, limit: int = 5) -> DataFrame:
    """Projects by tokens with true distinct sessions and share; by sessions when nothing was metered."""
    per = base.groupBy("project", "tool", "session_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"))
    sums = per.groupBy("project").agg(F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"), F.count(F.lit(1)).alias("sessions"))
    total = sums.agg(F.sum("tokens").alias("total"))
    ranked = sums.join(F.broadcast(total))  # one row
    measure = F.when(F.col("total") > 0, F.col("tokens")).otherwise(F.col("sessions"))
    return ranked.orderBy(F.desc(measure), "project").limit(limit).select(
        "project", "tokens", "cost_nano", "sessions", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(F.lit(0.0)).alias("share")
    )


def top_models(base: DataFrame, limit: int = 5) -> DataFrame:
    """Models merged by canonical name, by messages; share of all messages."""
    per = base.groupBy("model").agg(F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"))
    total = per.agg(F.sum("messages").alias("total"))
    merged = per.where(is_real_model(F.col("model"))).groupBy(canonical_model(F.col("model")).alias("name")).agg(
        F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens")
    )
    return merged.join(F.broadcast(total)).orderBy(F.desc("messages"), "name").limit(limit).select(
        "name", "messages", "tokens", (F.col("messages") / F.col("total")).alias("share")
    )


def tool_shares(base: DataFrame) -> DataFrame:
    per = base.groupBy("tool", "session_id").agg(F.sum("tokens").alias("tokens")).groupBy("tool").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("sessions")
    )
    total = per.agg(F.sum("tokens").alias("tt"), F.sum("sessions").alias("ts"))
    share = F.when(F.col("tt") > 0, F.col("tokens") / F.col("tt")).when(F.col("ts") > 0, F.col("sessions") / F.col("ts")).otherwise(F.lit(0.0))
    return per.join(F.broadcast(total)).select("tool", "tokens", "sessions", share.alias("share"))


def biggest_day(base: DataFrame) -> DataFrame:
    """The day with the most tokens (messages when nothing was metered) next to the median day."""
    days = base.groupBy("day").agg(F.sum("tokens").alias("tokens"), F.sum("messages").alias("messages"))
    stats = days.agg(
        F.sum("tokens").alias("total"), F.percentile("tokens", F.lit(0.5)).alias("median_tokens"), F.percentile("messages", F.lit(0.5)).alias("median_messages")
    )
    joined = days.join(F.broadcast(stats))
    measure = F.when(F.col("total") > 0, F.col("tokens")).otherwise(F.col("messages"))
    return joined.orderBy(F.desc(measure), "day").limit(1).select("day", "tokens", "messages", "median_tokens", "median_messages")


def focus_share(base: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the leading project: tokens where metered, else sessions."""
    keys = list(keys)
    per = base.groupBy(*keys, "project", "tool", "session_id").agg(F.sum("tokens").alias("tokens")).groupBy(*keys, "project").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("sessions")
    )
    return per.groupBy(*keys).agg(
        F.when(F.sum("tokens") > 0, F.max("tokens") / F.sum("tokens")).otherwise(F.max("sessions") / F.sum("sessions")).alias("focus_share")
    )


# --- comparisons ----------------------------------------------------------------------


def _units(spark) -> DataFrame:
    data = [(i, n, k, s, label) for i, (n, k, s, label) in enumerate(K.EQUIVALENCE_UNITS)]
    return rows(spark, "place, unit, kind, size, label", data)


def ratio_text(x: Column) -> Column:
    one = F.format_string("%.1f", x)
    return F.when(x >= 10, F.format_number(F.floor(x + 0.5), 0)).otherwise(F.regexp_replace(one, r"\.0$", ""))


def equivalences(totals: DataFrame, account: str, tokens: str = "tokens") -> DataFrame:
    """Each account's tokens restated in every unit that gives a readable number: account, place, unit, value, label."""
    spark = totals.sparkSession
    units = F.broadcast(_units(spark))  # fifteen rows
    n = F.col(tokens).cast("double")
    per_unit = F.when(F.col("kind") == "words", n / (F.col("size") / F.lit(K.WORDS_PER_TOKEN))).when(
        F.col("kind") == "lines", n / (F.col("size") * F.lit(K.TOKENS_PER_LINE))
    )
    hours = n * F.lit(K.WORDS_PER_TOKEN) / F.col("size") / F.lit(60.0)
    days = hours / F.lit(24.0)
    span = (
        F.when(hours < 48, F.concat(F.floor(hours + 0.5).cast("string"), F.lit(" hrs")))
        .when(days < 365, F.concat(F.floor(days + 0.5).cast("string"), F.lit(" days")))
        .otherwise(F.concat(ratio_text(days / F.lit(365.0)), F.lit(" yrs")))
    )
    readable = F.when(F.col("kind") == "span", hours >= K.EQUIVALENCE_MIN_HOURS).otherwise(
        per_unit.between(K.EQUIVALENCE_MIN, K.EQUIVALENCE_MAX)
    )
    return totals.where(n > 0).join(units).where(readable).select(
        account, "place", "unit", F.when(F.col("kind") == "span", span).otherwise(ratio_text(per_unit)).alias("value"), "label"
    )


def pick_equivalence(totals: DataFrame, account: str, seed: Column, tokens: str = "tokens") -> DataFrame:
    """One comparison per account, chosen by a hash of the seed so that it never changes between runs."""
    options = equivalences(totals, account, tokens)
    w = Window.partitionBy(account)
    numbered = options.withColumn("i", F.row_number().over(w.orderBy("place")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    seeded = numbered.join(totals.select(account, seed.alias("seed")), account)
    return seeded.where(F.col("i") == F.pmod(fnv1a(F.col("seed")), F.col("n"))).select(account, "unit", "value", "label")


def cost_equivalence(usd: Column) -> Column:
    out = F.lit(None).cast("string")
    for unit, name in reversed(K.COST_UNITS):
        x = usd / F.lit(unit)
        text = F.when(x >= 10, F.format_number(F.floor(x + 0.5), 0)).otherwise(F.format_string("%.1f", x))
        out = F.when(x >= K.EQUIVALENCE_MIN, F.concat(F.lit("about "), text, F.lit(f" {name}"))).otherwise(out)
    return out


# --- cards -------------------------------------------------------------------------------


def _candidates() -> list[tuple[str, str, Column, Column, Column]]:
    """theme, stat, condition, score, headline value; inputs are one wide row of counts per account."""
    c = F.col

    def scaled(base: float, weight: float, value: Column, mid: float) -> Column:
        return F.lit(base) + F.lit(weight) * saturation(value, mid)

    apologies = c("userSorry") + c("assistantApology")
    flip = F.when(c("userSorry") > c("assistantApology"), F.lit(0.1)).otherwise(F.lit(0.0))
    polite = c("please") + c("thanks")
    weekend = F.when(c("activity") > 0, c("weekend") / c("activity")).otherwise(F.lit(0.0))
    per_day = F.when(c("active_days") > 0, c("cost_usd") / c("active_days")).otherwise(F.lit(0.0))
    content = c("indexed_sessions") > 0
    return [
        ("friction", "interrupts", c("interrupts") > 0, scaled(0.15, 0.8, c("interrupts"), 150), c("interrupts")),
        ("friction", "errors", c("total_errors") > 0, scaled(0.1, 0.75, c("total_errors"), 800), c("total_errors")),
        ("friction", "actually", c("actually") >= 10, scaled(0.1, 0.7, c("actually"), 200), c("actually")),
        ("friction", "noWait", c("noWait") >= 3, scaled(0.2, 0.6, c("noWait"), 30), c("noWait")),
        ("friction", "swears", c("swears") >= 5, scaled(0.2, 0.6, c("swears"), 60), c("swears")),
        ("friction", "stillBroken", c("stillBroken") >= 3, scaled(0.2, 0.65, c("stillBroken"), 60), c("stillBroken")),
        ("relationship", "absolutelyRight", content,
         F.when(c("absolutelyRight") > 0, scaled(0.62, 0.33, c("absolutelyRight"), 40)).otherwise(F.lit(0.45)), c("absolutelyRight")),
        ("relationship", "apologies", apologies >= 5, scaled(0.25, 0.55, apologies, 40) + flip, apologies),
        ("relationship", "please", polite >= 20, scaled(0.2, 0.5, polite, 250), c("please")),
        ("relationship", "monologue", c("assistant_avg") > 0, F.lit(0.55), c("user_avg")),
        ("relationship", "areYouSure", c("areYouSure") >= 3, scaled(0.3, 0.5, c("areYouSure"), 25), c("areYouSure")),
        ("relationship", "hallucinate", c("hallucinate") >= 2, scaled(0.4, 0.45, c("hallucinate"), 12), c("hallucinate")),
        ("relationship", "perfectExclaim", c("perfectExclaim") >= 10, scaled(0.2, 0.5, c("perfectExclaim"), 150), c("perfectExclaim")),
        ("lies", "quickQuestion", c("quickQuestion") >= 3, scaled(0.25, 0.6, c("quickQuestion"), 40), c("quickQuestion")),
        ("lies", "shouldWork", c("shouldWork") >= 5, scaled(0.2, 0.6, c("shouldWork"), 40), c("shouldWork")),
        ("lies", "oneMoreThing", c("oneMoreThing") >= 3, scaled(0.2, 0.55, c("oneMoreThing"), 40), c("oneMoreThing")),
        ("bloopers", "nights", c("nights") >= 5, scaled(0.2, 0.75, c("nights"), 30), c("nights")),
        ("bloopers", "driveBys", (c("drive_bys") >= 20) & (c("drive_bys") / F.greatest(c("indexed_sessions"), F.lit(1)) >= 0.15),
         scaled(0.2, 0.6, c("drive_bys"), 800), c("drive_bys")),
        ("bloopers", "abandoned", c("abandoned_sessions") > 0, scaled(0.3, 0.4, c("abandoned_sessions"), 30), c("abandoned_sessions")),
        ("bloopers", "ultrathink", c("ultrathink") >= 3, scaled(0.45, 0.4, c("ultrathink"), 15), c("ultrathink")),
        ("bloopers", "longestUser", c("longest_user") >= 2000, scaled(0.2, 0.5, c("longest_user"), 12_000), c("longest_user")),
        ("bloopers", "weekend", (c("activity") >= 200) & (weekend >= 0.2), F.lit(0.15) + weekend, F.floor(weekend * 100 + 0.5)),
        ("bloopers", "burn", (c("cost_usd") > 0) & (c("active_days") > 0), scaled(0.35, 0.5, per_day, 40), F.floor(per_day + 0.5)),
        ("relationship", "models", c("models_tried") >= 4, scaled(0.35, 0.4, c("models_tried"), 12), c("models_tried")),
        ("bloopers", "cache", c("cache_hit_rate") >= 0.8, F.lit(0.25) + F.lit(0.45) * c("cache_hit_rate"), F.floor(c("cache_hit_rate") * 100 + 0.5)),
    ]


COUNT_COLUMNS = (
    *[name for name, _, _ in K.PHRASES], "total_errors", "indexed_sessions", "user_avg", "assistant_avg", "longest_user", "nights",
    "drive_bys", "abandoned_sessions", "activity", "weekend", "cost_usd", "active_days", "models_tried",
)


def fun_candidates(metrics: DataFrame, account: str) -> DataFrame:
    """All candidate stats that apply: account, theme, stat, score, value."""
    filled = metrics.fillna(0, subset=[c for c in COUNT_COLUMNS if c in metrics.columns])
    cells = [
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(theme).alias("theme"), F.lit(stat).alias("stat"), score.cast("double").alias("score"), value.cast("long").alias("value")))
        for theme, stat, cond, score, value in _candidates()
    ]
    present = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return filled.select(account, F.inline(present))


def fun_cards(candidates: DataFrame, account: str) -> DataFrame:
    """Up to three stats per theme; a theme shows only when its lead is strong enough."""
    pool = candidates.where(F.col("score") >= K.CARD_STAT)
    ranked = top_n(pool, [account, "theme"], [F.desc("score"), F.col("stat")], K.CARD_STATS, rank="place")
    lead = F.max("score").over(Window.partitionBy(account, "theme"))
    return ranked.withColumn("lead", lead).where(F.col("lead") >= K.CARD_LEAD).drop("lead")


def word_of_year(words: DataFrame, account: Sequence[str] = ()) -> DataFrame:
    """Leading word of each account when it is frequent and spread enough."""
    keys = list(account)
    best = F.min_by(F.struct("word", "count", "sessions"), F.struct(-F.col("count"), -F.col("sessions"), F.col("word")))
    return words.groupBy(*keys).agg(best.alias("w")).select(*keys, "w.*").where(
        (F.col("count") >= K.WORD_OF_YEAR_COUNT) & (F.col("sessions") >= K.WORD_OF_YEAR_SESSIONS)
    )


def personas(metrics: DataFrame, account: str) -> DataFrame:
    """Three median-split habits name one of eight archetypes.

    ``metrics``: account, distinct_sessions, night_share, focus_share, depth_median, median_replies.
    """
    deep = F.when(F.col("depth_median").isNotNull(), F.col("depth_median") >= K.DEPTH_THRESHOLD).otherwise(F.col("median_replies") >= 20)
    axis = F.concat_ws(
        "|",
        F.when(F.col("night_share") >= K.NIGHT_THRESHOLD, "night").otherwise("day"),
        F.when(F.col("focus_share") >= K.FOCUS_THRESHOLD, "focus").otherwise("multi"),
        F.when(deep, "deep").otherwise("quick"),
    )
    names = rows(metrics.sparkSession, "axes, persona", list(K.ARCHETYPES))
    return metrics.where(F.col("distinct_sessions") >= K.PERSONA_MIN_SESSIONS).withColumn("axes", axis).join(F.broadcast(names), "axes").select(account, "axes", "persona")
