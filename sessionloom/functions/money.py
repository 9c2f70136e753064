"""Money and number expressions.

Costs are carried as whole nano-dollars (BIGINT): integer sums do not depend on
the order in which partitions are added, so reruns and retries agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 1e9


def nano(usd: Column) -> Column:
    return F.floor(usd * F.lit(NANO) + F.lit(0.5)).cast("long")


def usd2(cost_nano: Column) -> Column:
    """Nano-dollars to dollars, rounded half up to cents."""
    return F.floor(cost_nano.cast("double") / F.lit(1e7) + F.lit(0.5)) / F.lit(100.0)


def cents(cost_nano: Column) -> Column:
    return F.floor(cost_nano.cast("double") / F.lit(1e7) + F.lit(0.5)).cast("long")


def round2(x: Column) -> Column:
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def round4(x: Column) -> Column:
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def saturation(count: Column, mid: float) -> Column:
    return F.when(count <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.exp(-count.cast("double") / F.lit(float(mid))))
