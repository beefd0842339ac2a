"""Raw checkpoint files, one per snapshot: count, byte addresses, padding, pages.

A chain is a folder with a file for each snapshot, named by its id, and ``raw-meta``, which
names the greatest.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import byte_address, is_zero, raw_data_offset
from ..operators.ranges import with_places
from ..schema import FULL, PAGE_SIZE
from .scratch import file_path

#: Fixed values of the format.
META, META_LINE = "raw-meta", "current_snap_id={}\n"
SPAN = 4096  # pages that a task reads at once


def export_pages(versions: DataFrame) -> DataFrame:
    """What a chain of exports holds: snapshot 0 without its zero pages, later ones whole."""
    return versions.where((F.col("snapshot_id") > 0) | ~is_zero("page"))


def export_plan(versions: DataFrame) -> DataFrame:
    """Per snapshot: pages, first and last byte address, data offset and file size."""
    d = export_pages(versions).groupBy("snapshot_id").agg(F.count("*").alias("pages"), F.min(byte_address("pa")).alias("first_address"), F.max(byte_address("pa")).alias("last_address"))
    return d.withColumn("data_offset", raw_data_offset("pages")).withColumn("file_size", F.col("data_offset") + F.col("pages") * PAGE_SIZE)


def ordered_dirty_set(versions: DataFrame) -> DataFrame:
    """(snapshot_id, pa, place): each snapshot's addresses in order, counted from 0."""
    d = versions.select("snapshot_id", "pa").distinct()
    d = with_places(d, F.col("snapshot_id").cast("double") * float(1 << 45) + F.col("pa"), "snapshot_id", "pa")
    first = d.groupBy("snapshot_id").agg(F.min("place").alias("_first"))
    return d.join(first, "snapshot_id").select("snapshot_id", "pa", (F.col("place") - F.col("_first")).alias("place"))


def write_raw(versions: DataFrame, folder: str) -> DataFrame:
    """Write a chain to a mounted folder; (snapshot_id, pages) of each file.

    Files get their size and count first. Then each page goes to its own place, whatever
    task has it, so a snapshot with most of the pages is written by many tasks. The folder
    appears under its name when it is whole.
    """
    spark, final = versions.sparkSession, file_path(folder)
    rows = export_pages(versions).select("snapshot_id", "pa", "page")
    plan = {r["snapshot_id"]: (r["pages"], r["data_offset"], r["file_size"]) for r in export_plan(versions).collect()}  # a row a snapshot
    for r in versions.select("snapshot_id").distinct().collect():  # a snapshot of nothing but zero pages has an empty file
        plan.setdefault(r["snapshot_id"], (0, PAGE_SIZE, PAGE_SIZE))
    plan.setdefault(0, (0, PAGE_SIZE, PAGE_SIZE))
    part = f"{final}.part-{uuid.uuid4().hex}"
    os.makedirs(part)
    for snapshot_id, (pages, _, size) in plan.items():
        with open(f"{part}/{snapshot_id}", "wb") as f:
            f.write(struct.pack("<Q", pages))
            f.truncate(size)
    offsets = spark.createDataFrame([(s, p[1]) for s, p in plan.items()], "snapshot_id int, data_offset bigint")
    placed = rows.join(ordered_dirty_set(rows), ["snapshot_id", "pa"]).join(F.broadcast(offsets), "snapshot_id").select("snapshot_id", "pa", "page", "place", "data_offset")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, files = 0, {}
        for batch in batches:
            for snapshot_id, address, page, place, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if snapshot_id not in files:
                    files[snapshot_id] = os.open(f"{part}/{snapshot_id}", os.O_WRONLY)
                os.pwrite(files[snapshot_id], struct.pack("<Q", address * PAGE_SIZE), 8 + 8 * place)
                os.pwrite(files[snapshot_id], page, start + PAGE_SIZE * place)
                n += 1
        for f in files.values():
            os.fsync(f)
            os.close(f)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    written = placed.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
    if written != sum(p[0] for p in plan.values()):
        raise ValueError(f"{written} pages were written")
    top = versions.agg(F.coalesce(F.max("snapshot_id"), F.lit(0))).first()[0]
    with open(f"{part}/{META}", "w") as f:
        f.write(META_LINE.format(top))
    if os.path.exists(final):
        shutil.rmtree(final)
    os.replace(part, final)
    return spark.createDataFrame([(s, p[0]) for s, p in plan.items()], "snapshot_id int, pages bigint")


def chain_top(folder: str) -> int:
    """The greatest snapshot id that a chain's ``raw-meta`` names."""
    with open(f"{file_path(folder)}/{META}") as f:
        return int(f.read().split("=")[1])


def raw_chain(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot_id, pa, page) of all files of a chain, read in spans of pages."""
    import pyarrow as pa

    top = file_path(folder)
    spans = []
    for name in os.listdir(top):
        if name.isdigit():
            with open(f"{top}/{name}", "rb") as f:
                (n,) = struct.unpack("<Q", f.read(8))
            spans += [(int(name), n, k) for k in range(0, n, SPAN)]
    d = spark.createDataFrame(spans, "snapshot_id int, n bigint, first bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for snapshot_id, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                many = min(SPAN, n - first)
                start = -(-(8 + 8 * n) // PAGE_SIZE) * PAGE_SIZE
                with open(f"{top}/{snapshot_id}", "rb") as f:
                    addresses = struct.unpack(f"<{many}Q", os.pread(f.fileno(), 8 * many, 8 + 8 * first))
                    data = os.pread(f.fileno(), PAGE_SIZE * many, start + PAGE_SIZE * first)
                pages = [data[PAGE_SIZE * k : PAGE_SIZE * (k + 1)] for k in range(many)]
                yield pa.RecordBatch.from_arrays([pa.array([snapshot_id] * many, pa.int32()), pa.array([a // PAGE_SIZE for a in addresses], pa.int64()), pa.array(pages, pa.binary())], names=["snapshot_id", "pa", "page"])

    return d.repartition(max(1, min(len(spans), 1000))).mapInArrow(read, "snapshot_id int, pa bigint, page binary")


def export_page(chunks: DataFrame, pa: int, snapshot_id: int, path: str) -> int:
    """Write the page of exactly this full chunk to a file of the driver; its bytes. Other kinds have nothing to export."""
    row = chunks.where((F.col("pa") == pa) & (F.col("snapshot_id") == snapshot_id) & (F.col("kind") == FULL)).select("page").first()
    if row is None:
        raise ValueError("nothing to export: no full chunk")
    with open(f"{file_path(path)}.part", "wb") as f:
        f.write(row["page"])
    os.replace(f"{file_path(path)}.part", file_path(path))
    return len(row["page"])


def read_raw(path: str) -> list[tuple[int, bytes]]:
    """(page address, page) of one file."""
    with open(path, "rb") as f:
        data = f.read()
    (n,) = struct.unpack_from("<Q", data)
    start = -(-(8 + 8 * n) // PAGE_SIZE) * PAGE_SIZE
    return [(a // PAGE_SIZE, data[start + PAGE_SIZE * k : start + PAGE_SIZE * (k + 1)]) for k, a in enumerate(struct.unpack_from(f"<{n}Q", data, 8))]
