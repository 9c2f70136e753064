"""Usage events: deduplication, identity, upsert, summaries, streaks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_ms, local_date
from .blocks import dealt, running

PERIODS = ("today", "7d", "30d", "365d", "all")


def volume() -> Column:
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")


def dedupe_usage(events: DataFrame) -> DataFrame:
    """One event per dedup key; keyless events pass. The survivor takes the position (``seq``) of the first copy.

    Copies replace the one held in the order of ``seq``: by a larger volume, at equal volume by a larger cost, and a fast
    copy replaces one that isn't, whatever it costs. Where the copies of the largest volume are all fast or all not, that is
    the first one of the largest cost. Otherwise the order decides, see ``last_held``. Copies are combined before the
    shuffle, so a key that repeats very often never gathers in one task; this sorts the rows of a
    task, so large splits are dealt first.
    """
    fields = [c for c in events.columns if c != "seq"]
    cost, fast = F.coalesce("cost_usd", F.lit(0.0)), (F.coalesce("speed", F.lit("")) == "fast").cast("int")
    named = events.where("dedup_key is not null").withColumnRenamed("dedup_key", "__key")
    keyed = dealt(named, ["seq"], events.count()).groupBy("__key").agg(
        F.min("seq").alias("seq"),
        F.max_by(F.struct(*[F.col(c) if c != "dedup_key" else F.col("__key").alias(c) for c in fields]), F.struct(volume(), cost, fast, -F.col("seq"))).alias("e"),
    )
    copies = named.select("__key", "seq", volume().alias("volume"), cost.alias("cost"), fast.alias("fast"))
    mixed = (
        copies.groupBy("__key")
        .agg(F.max(F.struct("volume", "fast")).alias("f"), F.max(F.struct("volume", (1 - F.col("fast")).alias("slow"))).alias("s"))
        .where("f.fast = 1 and s.slow = 1")
        .select("__key", F.col("f.volume").alias("volume"))
    )
    held = last_held(copies.join(mixed, ["__key", "volume"]).select("__key", "seq", "cost", "fast"))
    ordered = named.join(held, ["__key", "seq"]).select("__key", F.struct(*[F.col(c) if c != "dedup_key" else F.col("__key").alias(c) for c in fields]).alias("__e"))
    single = ordered.groupBy("__key").agg(F.any_value("__e").alias("__e"))
    settled = keyed.join(single, "__key", "left").select("seq", F.coalesce("__e", "e").alias("e")).select("seq", "e.*")
    return events.where("dedup_key is null").select("seq", *fields).unionByName(settled).select(*events.columns)


_PASSED = "array<struct<below: double, cost: double, fast: int, seq: bigint>>"


class _Passage:
    """What a stretch of copies makes of any copy held before it.

    ``slow`` and ``fast`` are for a held copy of that speed: in ascending order, a held cost below ``below`` ends as that
    copy of the stretch; a cost below none of them is still held. Steps with one outcome are one, so a passage stays
    short whatever the length of the stretch.
    """

    def __init__(self) -> None:
        self.slow: list[tuple] = []
        self.fast: list[tuple] = []
        self.top, self.closed = float("-inf"), False

    def add(self, copy: tuple[float, int, int]) -> None:
        cost, fast, _ = copy
        self.slow = self._stepped(self.slow, copy)
        self.fast = self._stepped(self.fast, copy)
        if not self.closed:
            below = float("inf") if fast else cost
            if fast or cost > self.top:
                self._put(self.slow, below, copy)
            self.closed = bool(fast)
        if cost > self.top:
            self._put(self.fast, cost, copy)
            self.top = cost

    def _stepped(self, steps: list[tuple], copy: tuple[float, int, int]) -> list[tuple]:
        out: list[tuple] = []
        for below, held in steps:
            self._put(out, below, copy if copy[0] > held[0] or (copy[1] and not held[1]) else held)
        return out

    @staticmethod
    def _put(steps: list[tuple], below: float, held: tuple) -> None:
        if steps and steps[-1][1] == held:
            steps.pop()
        steps.append((below, held))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One passage for each key of a sorted partition; only the last one is open at any time."""

    def table(done: list[tuple]) -> pa.RecordBatch:
        steps = pa.list_(pa.struct([("below", pa.float64()), ("cost", pa.float64()), ("fast", pa.int32()), ("seq", pa.int64())]))
        rows = [[[(b, *c) for b, c in p] for p in (now.slow, now.fast)] for _, _, now in done]
        as_dicts = lambda lists: [[dict(zip(("below", "cost", "fast", "seq"), x, strict=True)) for x in one] for one in lists]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in done], pa.string()), pa.array([f for _, f, _ in done], pa.int64()), *[pa.array(as_dicts([r[i] for r in rows]), steps) for i in (0, 1)]],
            ["__key", "first", "slow", "fast"],
        )

    key, first, now, done = None, 0, _Passage(), []
    for batch in batches:
        for k, seq, cost, fast in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if k != key:
                if key is not None:
                    done.append((key, first, now))
                key, first, now = k, seq, _Passage()
            now.add((cost, fast, seq))
        if done:
            yield table(done)
            done = []
    if key is not None:
        yield table([(key, first, now)])


def last_held(copies: DataFrame) -> DataFrame:
    """``__key, seq`` of the copy that is held after all copies of a key (``__key, seq, cost, fast``) in the order of ``seq``.

    A copy replaces the held one if it costs more, or is fast where that one isn't. This has no largest element: a fast
    copy replaces a dearer slow one, which replaces a fast one of a cost between. So the order is cut into stretches by
    ranges of key and position, each stretch is reduced to its passage, and a key's passages are walked in order.
    """
    dealt = copies.select(F.col("__key"), "seq", "cost", "fast").repartitionByRange("__key", "seq").sortWithinPartitions("__key", "seq")
    passages = dealt.mapInArrow(_passages, f"__key string, first bigint, slow {_PASSED}, fast {_PASSED}")
    listed = passages.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("first", "slow", "fast"))).alias("p"))
    nothing = F.struct(F.lit(float("-inf")).alias("cost"), F.lit(0).alias("fast"), F.lit(None).cast("bigint").alias("seq"))

    def step(held: Column, p: Column) -> Column:
        steps = F.when(held["fast"] == 1, p["fast"]).otherwise(p["slow"])
        after = F.try_element_at(F.filter(steps, lambda s: held["cost"] < s["below"]), F.lit(1))
        return F.when(after.isNull(), held).otherwise(F.struct(after["cost"].alias("cost"), after["fast"].alias("fast"), after["seq"].alias("seq")))

    return listed.select("__key", F.aggregate("p", nothing, step)["seq"].alias("seq"))


def usage_identity(events: DataFrame) -> DataFrame:
    """``id`` = sha256 of tool and dedup key, or of the event's own fingerprint and its occurrence number.

    Occurrences count all events of a fingerprint, those with a dedup key too.
    """
    texts = F.to_json(F.array("tool", "session_id", "model", iso_ms(F.col("ts"))))
    counters = F.to_json(
        F.struct("input", "output", F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite"))
    )
    fingerprint = F.concat(F.substring(texts, F.lit(1), F.length(texts) - 1), F.lit(","), counters, F.lit("]"))
    prepared = events.withColumn("__fp", fingerprint).withColumn("__block", F.shiftright("seq", 16))
    numbered = running(prepared, ["__fp"], "__block", ["seq"], sums={"__n": F.lit(1)})
    own = F.concat("__fp", F.lit(":"), (F.col("__n") - 1).cast("string"))
    return numbered.select(*events.columns, F.sha2(F.coalesce(F.concat("tool", F.lit(":"), "dedup_key"), own), 256).alias("id"))


STORED = ("id", "tool", "session_id", "project", "model", "ts", "input", "output", "cache_read", "cache_write")


def upsert_usage(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored table after an idempotent upsert.

    ``incoming`` carries ``seq``; the last record per id wins, an empty project never replaces one.
    ``changed`` marks rows that were added or altered.
    """
    row = F.struct(*[F.col(c) for c in STORED if c not in ("id", "project")])
    latest = (
        incoming.withColumn("__p", F.nullif(F.coalesce("project", F.lit("")), F.lit("")))
        .groupBy("id")
        .agg(F.max_by(row, "seq").alias("e"), F.max_by("__p", F.when(F.col("__p").isNotNull(), F.col("seq"))).alias("project"))
        .select("id", "e.*", "project")
    )
    old, new = stored.select(*STORED).alias("o"), latest.alias("n")
    joined = old.join(new, "id", "full_outer")
    counters = ("input", "output", "cache_read", "cache_write")
    fresh = F.col("o.tool").isNull()
    counter_change = F.lit(False)
    for c in counters:
        counter_change = counter_change | (F.col(f"n.{c}") != F.col(f"o.{c}"))
    project_change = F.col("n.project").isNotNull() & (F.col("n.project") != F.col("o.project"))
    return joined.select(
        "id",
        *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("tool", "session_id", "model", "ts")],
        F.coalesce(F.col("n.project"), F.col("o.project"), F.lit("")).alias("project"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in counters],
        F.coalesce(fresh | counter_change | project_change, F.lit(False)).alias("changed"),
    )


def normalise_project(events: DataFrame, roots: DataFrame | None = None, column: str = "project_path") -> DataFrame:
    """``project``: the longest repository root above the path, else the path, else ``unknown``.

    Each path is expanded to its own ancestors, which turns the prefix test into an equi-join on the
    distinct paths. Events are looked up in these and not sorted: all events of one path are one task's.
    """
    path = F.nullif(F.coalesce(column, F.lit("")), F.lit(""))
    if roots is None:
        return events.withColumn("project", F.coalesce(path, F.lit("unknown")))
    distinct = events.select(path.alias("__path")).where("__path is not null").distinct()
    parts = F.split("__path", "/")
    ancestors = distinct.select(
        "__path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root")
    )
    best = (
        ancestors.join(roots.select("root").distinct(), "root")
        .groupBy("__path")
        .agg(F.max_by("root", F.length("root")).alias("__root"))
    )
    return (
        events.withColumn("__path", path)
        .join(best.hint("shuffle_hash"), "__path", "left")
        .withColumn("project", F.coalesce("__root", "__path", F.lit("unknown")))
        .drop("__path", "__root")
    )


def filter_usage(
    events: DataFrame,
    now: str,
    harness: str | None = None,
    model: str | None = None,
    task: str | None = None,
    project: str | None = None,
) -> DataFrame:
    """Rows that count: not after ``now``, matching every given filter, with at least one token."""
    out = events.where((F.col("ts") <= F.lit(now).cast("timestamp")) & (volume() > 0))
    if harness:
        out = out.where(F.col("tool") == ("claude-code" if harness == "claude" else harness))
    if model:
        out = out.where(F.col("model") == model)
    if task:
        out = out.where((F.col("session_id") == task) | (F.concat_ws(":", "tool", "session_id") == task))
    if project:
        out = out.where(F.col("project") == project)
    return out


def period_starts(today: date) -> dict[str, date | None]:
    return {
        "today": today,
        "7d": today - timedelta(days=6),
        "30d": today - timedelta(days=29),
        "365d": today - timedelta(days=364),
        "all": None,
    }


def usage_periods(counted: DataFrame, today: date, tz: str = "UTC") -> DataFrame:
    """Token totals of the nested calendar windows, one scan: period, from_day, tokens."""
    day = local_date(F.col("ts"), tz)
    starts = period_starts(today)
    totals = counted.agg(
        *[
            F.coalesce(F.sum(F.when(day >= F.lit(start), volume()) if start else volume()), F.lit(0)).alias(f"p{i}")
            for i, start in enumerate(starts.values())
        ]
    )
    cells = [
        F.struct(F.lit(n).alias("period"), F.lit(s.isoformat() if s else None).cast("string").alias("from_day"), F.col(f"p{i}").alias("tokens"))
        for i, (n, s) in enumerate(starts.items())
    ]
    return totals.select(F.inline(F.array(*cells)))


GROUP_KEYS = {
    "project": lambda: F.col("project"),
    "harness": lambda: F.col("tool"),
    "model": lambda: F.col("model"),
    "task": lambda: F.concat_ws(":", "tool", "session_id"),
}


def in_period(counted: DataFrame, today: date, period: str = "all", tz: str = "UTC") -> DataFrame:
    start = period_starts(today)[period]
    return counted if start is None else counted.where(local_date(F.col("ts"), tz) >= F.lit(start))


def usage_groups(counted: DataFrame, group: str, limit: int = 50, tz: str = "UTC") -> DataFrame:
    """Largest groups by tokens (ties: smaller key) with the true group count and a truncation flag."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    key = F.date_format(local_date(F.col("ts"), tz), "yyyy-MM-dd") if group == "day" else GROUP_KEYS[group]()
    groups = counted.groupBy(key.alias("key")).agg(F.sum(volume()).alias("tokens"))
    total = groups.agg(F.count(F.lit(1)).alias("total_groups"))
    top = groups.orderBy(F.desc("tokens"), "key").limit(limit)
    return top.join(F.broadcast(total)).select(  # one-row total
        "key", "tokens", "total_groups", (F.col("total_groups") > limit).alias("truncated")
    )


def usage_daily(counted: DataFrame, tz: str = "UTC") -> DataFrame:
    return counted.groupBy(local_date(F.col("ts"), tz).alias("day")).agg(F.sum(volume()).alias("tokens"))


def usage_overview(counted: DataFrame, tz: str = "UTC") -> DataFrame:
    """One row: distinct sessions, active days, counter breakdown, top model, busiest day (ties: smaller key)."""
    slim = counted.select(
        local_date(F.col("ts"), tz).alias("day"), "model", "tool", "session_id", "input", "output", "cache_read", "cache_write", volume().alias("tokens")
    )
    by_slice = slim.groupBy("day", "model", "tool", "session_id").agg(
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write", "tokens")]
    )
    totals = by_slice.agg(
        F.countDistinct("tool", "session_id").alias("sessions"),
        F.countDistinct("day").alias("active_days"),
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")],
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("measured_harnesses"),
    )
    return totals.join(arg_max(by_slice, "model", "tokens", "top_model")).join(
        arg_max(by_slice, "day", "tokens", "most_active_day")
    ).withColumn("most_active_day", F.date_format("most_active_day", "yyyy-MM-dd"))


def arg_max(df: DataFrame, key: str, measure: str, out: str) -> DataFrame:
    """Key with the largest total; ties go to the smaller key."""
    sums = df.groupBy(key).agg(F.sum(measure).alias("__m"))
    return sums.orderBy(F.desc("__m"), key).limit(1).select(F.col(key).alias(out))


def islands(days: DataFrame, keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Runs of consecutive days per key: keys, from_day, to_day, days. Input is one row per key and day."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(day) if keys else Window.orderBy(day)
    anchored = days.withColumn("__a", F.date_sub(F.col(day), F.row_number().over(w)))
    return anchored.groupBy(*keys, "__a").agg(
        F.min(day).alias("from_day"), F.max(day).alias("to_day"), F.count(F.lit(1)).alias("days")
    ).drop("__a")


def streaks(active: DataFrame, today: date, keys: Sequence[str] = (), may_end_yesterday: bool = True, day: str = "day") -> DataFrame:
    """Current and longest run of active days. ``may_end_yesterday`` keeps a run alive until tonight."""
    days = active.select(*keys, day).distinct()
    runs = islands(days, keys, day)
    oldest = today - timedelta(days=1) if may_end_yesterday else today
    alive = (F.col("from_day") <= F.lit(today)) & (F.col("to_day") >= F.lit(oldest))
    length = F.datediff(F.least(F.col("to_day"), F.lit(today)), F.col("from_day")) + 1
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(alive, length)), F.lit(0)).cast("long").alias("current_days"),
        F.max("days").alias("longest_days"),
        F.sum("days").alias("active_days"),
    )


def longest_streak(active: DataFrame, keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Longest run with its dates (ties: the earlier run)."""
    runs = islands(active.select(*keys, day).distinct(), keys, day)
    best = F.max_by(F.struct("days", "from_day", "to_day"), F.struct("days", -F.unix_date("from_day"))).alias("b")
    return runs.groupBy(*keys).agg(best).select(*keys, "b.*")


def longest_gap(active: DataFrame, keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Longest silent range strictly between two active days (ties: the earlier one)."""
    keys = list(keys)
    days = active.select(*keys, day).distinct()
    w = Window.partitionBy(*keys).orderBy(day) if keys else Window.orderBy(day)
    gaps = days.withColumn("__prev", F.lag(day).over(w)).select(
        *keys,
        (F.datediff(day, "__prev") - 1).cast("long").alias("days"),
        F.date_add("__prev", 1).alias("from_day"),
        F.date_sub(F.col(day), 1).alias("to_day"),
    ).where("days > 0")
    best = F.max_by(F.struct("days", "from_day", "to_day"), F.struct("days", -F.unix_date("from_day"))).alias("b")
    return gaps.groupBy(*keys).agg(best).select(*keys, "b.*")
