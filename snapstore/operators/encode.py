"""Encoding pages as full, delta or zero chunks, and resolving chunks back to pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import LIMIT, apply_patch, xor_patch
from ..functions.pages import is_zero, zero_page
from ..schema import DEFAULT_THRESHOLD, DELTA, FULL, PATCH, ZERO

ENCODED = f"pa bigint, snapshot_id int, kind tinyint, base_snapshot int, page binary, patch {PATCH}"


def latest_full(chunks: DataFrame) -> DataFrame:
    """(pa, base_snapshot, base_page): each address's newest full chunk.

    Joined by address alone, so that pages in buckets of addresses stay where they are.
    """
    full = chunks.where(F.col("kind") == FULL)
    newest = full.groupBy("pa").agg(F.max("snapshot_id").alias("_newest"))
    d = full.join(newest, "pa").where(F.col("snapshot_id") - F.col("_newest") == 0)  # no equality of columns: that would be a join key
    return d.select("pa", F.col("snapshot_id").alias("base_snapshot"), F.col("page").alias("base_page"))


def encode_batch(pages: DataFrame, bases: DataFrame | None, threshold: int = 0) -> DataFrame:
    """One batch (pa, snapshot_id, page) against the bases known before it.

    All-zero pages are zero chunks. With a base and at most ``threshold`` changed words (0:
    the default) a page is a delta on it, also with none changed. Other pages are full.
    """
    limit = threshold or DEFAULT_THRESHOLD
    d = pages.select("pa", "snapshot_id", "page")
    if bases is None:
        d = d.withColumns({"base_snapshot": F.lit(None).cast("int"), "_patch": F.lit(None).cast(PATCH)})
    else:
        d = d.join(bases, "pa", "left").withColumn("_patch", xor_patch("base_page", "page"))
    d = d.withColumn("kind", F.when(is_zero("page"), ZERO).when(F.size("_patch") <= limit, F.when(F.col("_patch").isNotNull(), DELTA).otherwise(FULL)).otherwise(FULL).cast("tinyint"))
    delta = F.col("kind") == DELTA
    return d.select("pa", "snapshot_id", "kind", F.when(delta, F.col("base_snapshot")).alias("base_snapshot"), F.when(F.col("kind") == FULL, F.col("page")).alias("page"), F.when(delta, F.col("_patch")).alias("patch"))


class Shadow:
    """The latest full page of one address, and the decision about its next page."""

    def __init__(self, threshold: int = 0, snapshot_id: int | None = None, page: bytes | None = None):
        self.limit, self.snapshot_id, self.page = threshold or DEFAULT_THRESHOLD, snapshot_id, page

    def encode(self, snapshot_id: int, page: bytes) -> tuple[int, int | None, bytes | None, list | None]:
        words = np.frombuffer(page, "<i8")
        if not words.any():
            return ZERO, None, None, None
        if self.page is not None:
            x = words ^ np.frombuffer(self.page, "<i8")
            at = np.flatnonzero(x)
            if len(at) <= self.limit:
                return DELTA, self.snapshot_id, None, [{"w": int(w), "x": int(v)} for w, v in zip(at, x[at], strict=True)]
        if self.snapshot_id is None or snapshot_id > self.snapshot_id:
            self.snapshot_id, self.page = snapshot_id, page
        return FULL, None, page, None


def encode_history(pages: DataFrame, threshold: int = 0) -> DataFrame:
    """Many snapshots at once: a fold over each address in snapshot order.

    Rows stream by, sorted by (pa, snapshot_id) within partitions of addresses, so an
    address of any number of versions needs the memory of one page. Results go on in slices.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shadow = None, Shadow(threshold)
        for whole in batches:
            for k in range(0, len(whole), LIMIT):
                batch, out = whole.iloc[k : k + LIMIT], []
                for pa, snapshot_id, page in zip(batch["pa"], batch["snapshot_id"], batch["page"], strict=True):
                    if pa != now:
                        now, shadow = pa, Shadow(threshold)
                    out.append((pa, snapshot_id, *shadow.encode(int(snapshot_id), page)))
                frame = pd.DataFrame(out, columns=["pa", "snapshot_id", "kind", "base_snapshot", "page", "patch"])
                yield frame.astype({"base_snapshot": "Int32"})

    ordered = pages.select("pa", "snapshot_id", "page").repartition("pa").sortWithinPartitions("pa", "snapshot_id")
    return ordered.mapInPandas(fold, ENCODED)


def with_bases(chunks: DataFrame, all_chunks: DataFrame) -> DataFrame:
    """Chunks with ``base_page``, the full page of a delta's base (null: missing or no delta)."""
    full = all_chunks.where(F.col("kind") == FULL).select("pa", F.col("snapshot_id").alias("base_snapshot"), F.col("page").alias("base_page"))
    return chunks.join(full, ["pa", "base_snapshot"], "left")


def _patched(rows: DataFrame) -> DataFrame:
    """(pa, snapshot_id, page) of the rows with ``_own``; full chunks among the rows are bases.

    A delta meets its base in a window of (address, base's snapshot), where the full chunk comes
    first: one shuffle of the rows, none if they lie in buckets of addresses.
    """
    delta = ~F.col("kind").isin(FULL, ZERO)
    w = Window.partitionBy("pa", "_key").orderBy("kind").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_key", F.when(delta, F.col("base_snapshot")).otherwise(F.col("snapshot_id")))
    d = d.withColumn("_base", F.first(F.when(F.col("kind") == FULL, F.col("page")), ignorenulls=True).over(w)).where("_own")
    bad = F.raise_error(F.concat(F.lit("no full base for a delta of page "), F.col("pa").cast("string"))).cast("binary")
    base = F.when(delta, F.coalesce("_base", bad))
    page = F.when(F.col("kind") == ZERO, zero_page()).when(F.col("kind") == FULL, F.col("page")).otherwise(apply_patch(base, F.when(delta, F.col("patch"))))
    return d.select("pa", "snapshot_id", page.alias("page"))


def resolve(chunks: DataFrame, all_chunks: DataFrame) -> DataFrame:
    """(pa, snapshot_id, page): every chunk as its page. A delta without its full base is an error."""
    columns = ("pa", "snapshot_id", "kind", "base_snapshot", "page", "patch")
    rows = chunks.select(*columns, F.lit(True).alias("_own"))
    if all_chunks is not chunks:
        rows = rows.unionByName(all_chunks.where(F.col("kind") == FULL).select(*columns, F.lit(False).alias("_own")))
    return _patched(rows)


def resolve_at(chunks: DataFrame, snapshot_id: int) -> DataFrame:
    """(pa, snapshot_id, page): of each address the page as of the snapshot.

    Rows are dealt by address once; of each, the version as of the snapshot and its base go on.
    """
    d = chunks.where(F.col("snapshot_id") <= snapshot_id).select("pa", "snapshot_id", "kind", "base_snapshot", "page", "patch")
    d = d.withColumn("_top", F.max(F.struct("snapshot_id", F.when(F.col("kind") == DELTA, F.col("base_snapshot")).alias("base"))).over(Window.partitionBy("pa")))
    d = d.withColumn("_own", F.col("snapshot_id") == F.col("_top.snapshot_id"))
    return _patched(d.where(F.col("_own") | (F.col("snapshot_id") == F.col("_top.base"))).drop("_top"))
