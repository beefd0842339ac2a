"""Global orders without a global window: ranges of a numeric key with bounds known beforehand.

A row's range follows from its key and literal bounds alone, so it is the same in every copy
of a plan, whether Spark reuses an exchange or not. Sums, counts and last rows of ranges are
at most ``parts`` rows; they come to the driver and return as literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"
MAX_PARTS = 1024


def range_bounds(rows: DataFrame, key: Column, parts: int | None = None) -> list[float]:
    """Rising bounds of about ``parts`` equally full ranges of ``key`` (numeric, or null)."""
    parts = min(MAX_PARTS, parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts < 2:
        return []
    found = rows.agg(F.percentile_approx(key.cast("double"), [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(found or []))


def with_range(rows: DataFrame, key: Column, bounds: list[float]) -> DataFrame:
    """``rows`` with their range: how many bounds lie at or below the key. Equal keys share a range."""
    if not bounds:
        return rows.withColumn(RANGE, F.lit(0))
    return rows.withColumn(RANGE, F.size(F.filter(F.lit(bounds), lambda b: b <= key.cast("double"))))


def _before(ranged: DataFrame, parts: int, value: Column) -> Column:
    """For each row the sum of ``value`` over the ranges before its own."""
    sums = {r[RANGE]: r["v"] for r in ranged.groupBy(RANGE).agg(value.alias("v")).collect()}
    starts, total = [], 0
    for k in range(parts):
        starts.append(total)
        total += sums.get(k) or 0
    return F.get(F.lit(starts).cast("array<bigint>"), F.col(RANGE))


def with_places(rows: DataFrame, key: Column, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with their places (from 0) in the order; ``key`` must not fall along it."""
    bounds = range_bounds(rows, key)
    d = with_range(rows, key, bounds)
    before = _before(d, len(bounds) + 1, F.count("*"))
    w = Window.partitionBy(RANGE).orderBy(*order)
    return d.withColumn(name, before + F.row_number().over(w) - 1).drop(RANGE)


def with_sums_before(rows: DataFrame, key: Column, value: str, *order: str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before them in the order (0 for the first)."""
    bounds = range_bounds(rows, key)
    d = with_range(rows, key, bounds)
    before = _before(d, len(bounds) + 1, F.sum(value))
    w = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(name, before + F.coalesce(F.sum(value).over(w), F.lit(0))).drop(RANGE)


def with_last_before(rows: DataFrame, key: Column, value: Column, pick: Callable[[Column], Column], *order: str, name: str = "_before") -> DataFrame:
    """``rows`` with ``pick`` (F.last or F.max) of ``value`` over all rows before them in the order (null for the first)."""
    bounds = range_bounds(rows, key)
    d = with_range(rows, key, bounds).withColumn("_v", value)
    own = F.max_by("_v", F.struct(*order)) if pick is F.last else F.max("_v")
    ends = d.groupBy(RANGE).agg(own.alias("_end"))  # one row a range
    join = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(RANGE, pick("_end").over(join).alias("_end"))
    w = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", pick("_v").over(w)).join(F.broadcast(ends), RANGE)
    both = F.coalesce("_in", "_end") if pick is F.last else F.greatest("_in", "_end")
    return d.withColumn(name, both).drop(RANGE, "_v", "_in", "_end")
