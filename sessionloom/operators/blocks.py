"""Building blocks that stay balanced when one key holds a large share of the rows.

A window partitioned by a hot key would run in one task. The helpers below cut
each key into bounded blocks, work inside the blocks in parallel, summarise the
blocks, and hand each block what came before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BLOCK = 65_536
#: Rows of a task that combines wide rows before a shuffle.
TASK_ROWS = 100_000


def line_block(line_no: Column) -> Column:
    """Block of a dense, unique line number."""
    return F.floor(line_no / F.lit(LINE_BLOCK)).cast("long")


def once(df: DataFrame, kept: Sequence[str], *columns: Column) -> DataFrame:
    """``kept`` and the given columns, each computed one time for a row.

    Spark moves a filter below the projection that makes its columns and computes them there again, for every mention
    of theirs. It moves none below a generator.
    """
    return df.select(*kept, F.struct(*columns).alias("__once")).select(*kept, F.inline(F.array("__once")))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, in tasks of about ``TASK_ROWS``: neither splits nor shuffle sizes decide how many rows a task holds."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def hour_block(ms: Column) -> Column:
    """Block of an instant in epoch milliseconds."""
    return F.floor(ms / F.lit(3_600_000)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    befores: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running aggregates per ``keys`` in ``order``, computed block by block.

    ``block`` must not decrease along ``order``. ``sums`` are inclusive running sums, ``lasts`` the
    latest non-null value at or before the row, ``befores`` the latest before it, ``lags`` the value on the previous row.
    """
    sums, lasts, lags, befores = dict(sums or {}), dict(lasts or {}), dict(lags or {}), dict(befores or {})
    ends = lasts | befores
    keys, order = list(keys), list(order)
    prepared = df.select(
        "*",
        *[c.alias(f"__s_{n}") for n, c in sums.items()],
        *[c.alias(f"__l_{n}") for n, c in ends.items()],
        *[F.struct(c.alias("v")).alias(f"__g_{n}") for n, c in lags.items()],
    )
    position = F.struct(*[F.col(c) for c in order])
    aggregates = (
        [F.sum(f"__s_{n}").alias(f"__cs_{n}") for n in sums]
        + [
            F.max_by(F.col(f"__l_{n}"), F.when(F.col(f"__l_{n}").isNotNull(), position)).alias(f"__cl_{n}")
            for n in ends
        ]
        + [F.max_by(F.col(f"__g_{n}"), position).alias(f"__cg_{n}") for n in lags]
    )
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy(*keys).orderBy(block)
    carried = prepared.groupBy(*keys, block).agg(*aggregates).select(
        *keys,
        block,
        *[F.sum(f"__cs_{n}").over(before).alias(f"__cs_{n}") for n in sums],
        *[F.last(f"__cl_{n}", ignorenulls=True).over(before).alias(f"__cl_{n}") for n in ends],
        *[F.lag(f"__cg_{n}").over(step).alias(f"__cg_{n}") for n in lags],
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = prepared.select(
        *df.columns,
        *[F.sum(f"__s_{n}").over(upto).alias(f"__is_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(upto).alias(f"__il_{n}") for n in lasts],
        *[F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__il_{n}") for n in befores],
        *[F.lag(f"__g_{n}").over(inside).alias(f"__ig_{n}") for n in lags],
    )
    joined = local.join(carried, [*keys, block], "left")
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"__cs_{n}"), F.lit(0)) + F.col(f"__is_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__il_{n}"), F.col(f"__cl_{n}")).alias(n) for n in ends],
        *[F.coalesce(F.col(f"__ig_{n}"), F.col(f"__cg_{n}"))["v"].alias(n) for n in lags],
    )


def ranked_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    width: int = 10_000,
) -> DataFrame:
    """Exact order statistics of a whole-number column.

    ``ranks`` maps an output name to a function from the group size to a 1-based rank. A histogram
    (combined before the shuffle) is cut into value ranges of ``width``; only the range that holds
    a rank is walked. Returns one row per key with ``n`` and one column per rank.
    """
    keys = list(keys)
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("long").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", F.floor(F.col("__v") / F.lit(width)))
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        hist.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__bn"))
        .select(*keys, "__b", "__bn", F.sum("__bn").over(ordered).alias("__cum"), F.sum("__bn").over(whole).alias("__total"))
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("__total")).cast("long").alias("rank")) for n, f in ranks.items()])
    targets = (
        blocks.select(*keys, "__b", "__total", (F.col("__cum") - F.col("__bn")).alias("__before"), "__cum", F.explode(wanted).alias("__t"))
        .where((F.col("__t.rank") > F.col("__before")) & (F.col("__t.rank") <= F.col("__cum")))
    )
    walk = Window.partitionBy(*keys, "__b", "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        targets.select(*keys, "__b", "__total", "__before", F.col("__t.name").alias("__name"), F.col("__t.rank").alias("__rank"))
        .join(hist, [*keys, "__b"])
        .withColumn("__upto", F.sum("__n").over(walk) + F.col("__before"))
        .where(F.col("__upto") >= F.col("__rank"))
    )
    return found.groupBy(*keys).agg(
        F.max("__total").alias("n"),
        *[F.min(F.when(F.col("__name") == n, F.col("__v"))).alias(n) for n in ranks],
    )


def nearest_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.ceil(F.lit(p) * n / F.lit(100)), F.lit(1))


MEDIAN_LOW: Callable[[Column], Column] = lambda n: F.floor((n + 1) / 2)
MEDIAN_HIGH: Callable[[Column], Column] = lambda n: F.floor((n + 2) / 2)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, width: int = 10_000) -> DataFrame:
    """Interpolated median of a whole-number column: keys, n, median DOUBLE."""
    stats = ranked_values(df, keys, value, {"lo": MEDIAN_LOW, "hi": MEDIAN_HIGH}, width)
    return stats.select(*keys, "n", ((F.col("lo") + F.col("hi")) / F.lit(2.0)).alias("median"))


def spread_join(
    big: DataFrame, side: DataFrame, keys: Sequence[str], spread_by: Column, how: str = "inner", per_split: int = 1_000_000
) -> DataFrame:
    """Join ``big`` to ``side`` (one or few rows per key), splitting keys with many rows in ``big``.

    Keys above ``per_split`` rows get one salt per ``per_split`` rows; their ``side`` rows are repeated
    once per salt. The number of such keys is at most rows / ``per_split``.
    """
    keys = list(keys)
    heavy = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > per_split)
        .select(*keys, F.ceil(F.col("__n") / F.lit(per_split)).cast("int").alias("__splits"))
    )
    splits = F.coalesce(F.col("__splits"), F.lit(1))
    left = big.join(heavy, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread_by), splits).cast("int")).drop("__splits")
    right = (
        side.join(heavy, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .withColumn("__salt", F.col("__salt").cast("int"))
        .drop("__splits")
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key; the rank filter is pushed below the shuffle by Spark."""
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def asof_previous(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ms: str, right_ms: str, value: Column, out: str
) -> DataFrame:
    """For each left row, ``value`` of the latest right row at or before it (ties: right first)."""
    keys = list(keys)
    points = left.withColumn("__at", F.col(left_ms)).withColumn("__kind", F.lit(1)).unionByName(
        right.select(*keys, F.col(right_ms).alias("__at"), F.lit(0).alias("__kind"), value.alias("__value")),
        allowMissingColumns=True,
    ).withColumn("__block", hour_block(F.col("__at")))
    return (
        running(points, keys, "__block", ["__at", "__kind"], lasts={out: F.col("__value")})
        .where(F.col("__kind") == 1)
        .drop("__at", "__kind", "__value", "__block")
    )


def asof_next(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ms: str, right_ms: str, value: Column, out: str
) -> DataFrame:
    """For each left row, ``value`` of the earliest right row at or after it."""
    mirrored_left = left.withColumn("__neg", -F.col(left_ms))
    mirrored_right = right.withColumn("__negr", -F.col(right_ms))
    return asof_previous(mirrored_left, mirrored_right, keys, "__neg", "__negr", value, out).drop("__neg")
