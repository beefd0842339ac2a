"""Version lookups over rows keyed by (pa, snapshot_id): floors, as-of joins, dense ranges.

Winners are picked on key columns alone and payload is joined back, so that 4 KiB pages do
not travel through aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import snapshot_in_range
from ..schema import FULL
from .ranges import with_last_before

KEY = ("pa", "snapshot_id")


def first_writes(rows: DataFrame, *order: str) -> DataFrame:
    """Of rows with one key the first by ``order`` (first write wins)."""
    w = Window.partitionBy(*KEY).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def floor_at(rows: DataFrame, snapshot_id: int, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Per address the row of its greatest snapshot up to ``snapshot_id`` (keys unique)."""
    d = rows.where(F.col("snapshot_id") <= snapshot_id)
    d = d if lo is None else d.where(F.col("pa") >= lo)
    d = d if hi is None else d.where(F.col("pa") < hi)
    return d.join(d.groupBy("pa").agg(F.max("snapshot_id").alias("snapshot_id")), list(KEY))


def floor_point(rows: DataFrame, pa: int, snapshot_id: int) -> DataFrame:
    """At most one row: the version of ``pa`` as of ``snapshot_id``."""
    return rows.where((F.col("pa") == pa) & (F.col("snapshot_id") <= snapshot_id)).orderBy(F.desc("snapshot_id")).limit(1)


def exact(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(*KEY), list(KEY))


def as_of(probes: DataFrame, rows: DataFrame, *payload: str) -> DataFrame:
    """Each probe (pa, snapshot_id, ...) with ``found_snapshot`` and the payload as of it; misses are null.

    One shuffle by address: facts and probes are merged in snapshot order, facts first.
    """
    extra = [c for c in probes.columns if c not in KEY]
    value = F.struct(F.col("snapshot_id").alias("found_snapshot"), *payload)
    facts = rows.select("pa", "snapshot_id", F.lit(0).alias("_p"), value.alias("_v"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra))
    asked = probes.select("pa", "snapshot_id", F.lit(1).alias("_p"), F.lit(None).cast(facts.schema["_v"].dataType).alias("_v"), *extra)
    w = Window.partitionBy("pa").orderBy("snapshot_id", "_p").rowsBetween(Window.unboundedPreceding, 0)
    d = facts.unionByName(asked).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_p = 1")
    return d.select(*probes.columns, "_v.*")


def dense(found: DataFrame, lo: int, count: int, **defaults: Column) -> DataFrame:
    """A row for each address of lo .. lo+count-1; ``found`` tells hits, misses take the defaults."""
    marked = found.withColumn("_hit", F.lit(True))
    d = found.sparkSession.range(lo, lo + count).withColumnRenamed("id", "pa").join(marked, "pa", "left")
    for name, value in defaults.items():
        d = d.withColumn(name, F.coalesce(F.col(name), value))
    return d.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def validity(rows: DataFrame) -> DataFrame:
    """Each version with ``valid_to``, the next snapshot of its address (null: still valid)."""
    return rows.withColumn("valid_to", F.lead("snapshot_id").over(Window.partitionBy("pa").orderBy("snapshot_id")))


def current_bases(rows: DataFrame) -> DataFrame:
    """Each version with ``current_base``, the newest full one up to it (null: none yet)."""
    w = Window.partitionBy("pa").orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("current_base", F.last(F.when(F.col("kind") == FULL, F.col("snapshot_id")), ignorenulls=True).over(w))


def first_versions(rows: DataFrame) -> DataFrame:
    """The first version of each address."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("pa").orderBy("snapshot_id"))).where("_n = 1").drop("_n")


def dirty_pages(pages: DataFrame, dirty: DataFrame) -> DataFrame:
    """Pages whose address is in ``dirty``."""
    return pages.join(dirty.select("pa"), "pa", "left_semi")


def order_violations(rows: DataFrame, order: str) -> DataFrame:
    """Rows whose snapshot falls, or whose address falls within a snapshot, in arrival order (a number).

    Only rows next to each other matter; see ``ranges`` for how the row before is found.
    """
    d = with_last_before(rows, F.col(order), F.struct("snapshot_id", "pa"), F.last, order)
    s, a = F.col("_before.snapshot_id"), F.col("_before.pa")
    bad = (s > F.col("snapshot_id")) | ((s == F.col("snapshot_id")) & (a > F.col("pa")))
    return d.where(bad).select(*rows.columns)


def accepted_saves(attempts: DataFrame, order: str) -> DataFrame:
    """Attempts to save, with ``accepted``: the id is in range and above all accepted before it.

    Ids out of range never count; of the others the accepted are those above the greatest before.
    """
    valid = snapshot_in_range("snapshot_id")
    d = with_last_before(attempts, F.col(order), F.when(valid, F.col("snapshot_id")), F.max, order)
    return d.withColumn("accepted", F.coalesce(valid & (F.col("_before").isNull() | (F.col("snapshot_id") > F.col("_before"))), F.lit(False))).drop("_before")
