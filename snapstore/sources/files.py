"""Stores of record files: one log or index of records, and one blob file a worker with the payloads.

A folder holds ``records.log`` or ``records.idx`` (names and magics are parameters) and
``blobs/worker_<n>.blob``. A full page is a zstd frame in its worker's blob, a delta its patch
of 10 bytes an entry; zero pages have no payload. Reading is a distributed plan: records are
dealt out by worker and offset, so each task reads its blobs forward. Writing is too: each task
writes its piece of the blobs, and where a piece begins follows from the sizes of those before
it; then the pieces are copied to their places, each by a task. A task's memory is one batch.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import LIMIT, decode_patch, decompress_page, inflated, parse_patch, patch_bytes
from ..functions.keys import worker_of
from ..operators import maintain
from ..operators.versions import first_writes
from ..schema import CHUNKS, DELTA, FULL, ZERO
from .records import SCHEMA, RecordFiles, detect_layout
from .scratch import file_path


@dataclass(frozen=True)
class Format:
    """What a family of record files calls its files, and their magics."""

    magics: dict[str, bytes] = field(default_factory=lambda: {"log": b"SNAPLOG\0", "index": b"SNAPIDX\0"})
    names: dict[str, str] = field(default_factory=lambda: {"log": "records.log", "index": "records.idx"})

    def options(self, layout: str) -> dict[str, str]:
        return {"layout": layout} | {f"{k}_magic": m.hex() for k, m in self.magics.items()}


OWN = Format()
PIECE = 1 << 14  # records that a task writes payloads of, about
READ, RECORDS = 1 << 24, 1 << 20  # bytes of blobs, and of records, that a task reads, about


def record_rows(spark: SparkSession, path: str, layout: str, fmt: Format = OWN) -> DataFrame:
    """The records of one file, as ``SCHEMA`` has them."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("page_records").options(path=path, **fmt.options(layout)).load()


def write_records(records: DataFrame, path: str, layout: str, fmt: Format = OWN) -> None:
    """One record file from rows in their order, header last set by the commit; the whole replaces what was there."""
    records.sparkSession.dataSource.register(RecordFiles)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    types = dict(c.split() for c in SCHEMA.split(", "))
    records.select(*(F.col(c).cast(types[c]).alias(c) for c in columns)).write.format("page_records").options(path=path, **fmt.options(layout)).mode("append").save()


def open_files(spark: SparkSession, folder: str, fmt: Format = OWN) -> tuple[str, DataFrame]:
    """The layout and the records of a folder: its index if there is one, else its log."""
    for layout in ("index", "log"):
        path = f"{file_path(folder)}/{fmt.names[layout]}"
        if os.path.exists(path):
            found = detect_layout(path, fmt.magics)
            return found, record_rows(spark, path, found, fmt)
    raise FileNotFoundError(f"no records in {folder}")


def blob_files(spark: SparkSession, folder: str) -> DataFrame:
    """(worker_id, blob_size) of the blob files; other names, and ids over 255, are passed over."""
    top = f"{file_path(folder)}/blobs"
    if not os.path.isdir(top):
        return spark.createDataFrame([], "worker_id smallint, blob_size bigint")
    d = spark.read.format("binaryFile").option("pathGlobFilter", "worker_*.blob").load(f"file://{top}").select("path", "length")
    number = F.regexp_extract("path", r"/worker_([0-9]{1,3})\.blob$", 1)
    return d.where((number != "") & (number.try_cast("int") <= 255)).select(number.cast("smallint").alias("worker_id"), F.col("length").alias("blob_size"))


def with_blob_size(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each record with the size of its worker's blob file (null: there is none)."""
    return records.join(F.broadcast(blobs), "worker_id", "left")  # at most 256 rows


def unused_blobs(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blob files that no record with a payload refers to."""
    used = records.where(F.col("kind") != ZERO).select("worker_id").distinct()
    return blobs.join(used, "worker_id", "left_anti")


def write_files(chunks: DataFrame, folder: str, workers: int = 1, layout: str = "log", fmt: Format = OWN) -> DataFrame:
    """Write chunks as record files; the records that were written, with their places in the blobs."""
    import pyarrow as pa

    spark, top = chunks.sparkSession, file_path(folder)
    os.makedirs(f"{top}/blobs", exist_ok=True)
    types = dict(c.split() for c in SCHEMA.split(", "))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = chunks.select("pa", "snapshot_id", "kind", worker_of("pa", workers).alias("worker_id"), "base_snapshot", "page", "patch")
    keys, run = ("worker_id", "snapshot_id", "pa"), uuid.uuid4().hex
    rows = rows.repartitionByRange(max(1, -(-chunks.count() // PIECE)), *keys).sortWithinPartitions(*keys)
    piece = lambda worker, attempt: f"{top}/blobs/.piece-{run}-{worker}-{attempt}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        compressor, now, f, at = zstandard.ZstdCompressor(level=1), None, None, 0

        def close():
            if f:
                f.flush()
                os.fsync(f.fileno())
                f.close()

        for batch in batches:
            for k in range(0, batch.num_rows, LIMIT):
                some = batch.slice(k, LIMIT)
                out = {c: some.column(some.schema.get_field_index(c)).to_pylist() for c in ("pa", "snapshot_id", "kind", "worker_id", "base_snapshot", "page", "patch")}
                offsets, lengths = [], []
                for kind, worker, page, patch in zip(out["kind"], out["worker_id"], out["page"], out["patch"], strict=True):
                    if worker != now:
                        close()
                        now, at = worker, 0
                        f = open(piece(now, attempt), "wb")
                    data = b"" if kind == ZERO else compressor.compress(page) if kind == FULL else patch_bytes([(e["w"], e["x"]) for e in patch])
                    f.write(data)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                out |= {"offset": offsets, "len": lengths, "seq": [0] * len(offsets)}
                kinds = {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "smallint": pa.int16()}
                columns = [pa.array(out[c], kinds[types[c]]) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(offsets), pa.int32()), pa.array([attempt] * len(offsets))], names=[*names, "part", "attempt"])
        close()

    # written once: the pieces are its side effect, and only those of tasks that are in the table count
    kept = f"{folder}/.records"
    rows.mapInArrow(write, f"{SCHEMA}, part int, attempt bigint").write.mode("overwrite").parquet(kept)
    d = spark.read.schema(f"{SCHEMA}, part int, attempt bigint").parquet(kept)
    starts, copies, ends = [], [], {}
    for r in d.groupBy("worker_id", "part", "attempt").agg(F.max(F.col("offset") + F.col("len")).alias("size")).orderBy("worker_id", "part").collect():  # a row a piece
        w = r["worker_id"]
        starts.append((w, r["part"], ends.setdefault(w, 0)))
        copies.append((piece(w, r["attempt"]), f"{top}/blobs/.worker_{w}-{run}", ends[w]))
        ends[w] += r["size"]
    for w, end in ends.items():
        with open(f"{top}/blobs/.worker_{w}-{run}", "wb") as f:
            f.truncate(end)
    _copy_pieces(spark, copies)
    for w in ends:
        os.replace(f"{top}/blobs/.worker_{w}-{run}", f"{top}/blobs/worker_{w}.blob")
    for name in os.listdir(f"{top}/blobs"):
        if name.startswith(f".piece-{run}-"):
            os.remove(f"{top}/blobs/{name}")
    first = F.broadcast(spark.createDataFrame(starts, "worker_id smallint, part int, start bigint"))
    offset = F.when(F.col("len") > 0, F.col("start") + F.col("offset")).otherwise(0)
    found = d.join(first, ["worker_id", "part"]).withColumn("offset", offset).select(*names)
    order = maintain.log_order(found) if layout == "log" else found.repartitionByRange("pa", "snapshot_id").sortWithinPartitions("pa", "snapshot_id")
    write_records(order, f"{top}/{fmt.names[layout]}", layout, fmt)
    return found


def _copy_pieces(spark: SparkSession, copies: list[tuple[str, str, int]]) -> None:
    """Each piece (path, target, offset) into its place of the target, which has its whole size."""
    import pyarrow as pa

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, target, at = copies[k]
                with open(path, "rb") as f, open(target, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(f, out, 1 << 22)
                    out.flush()
                    os.fsync(out.fileno())
            yield batch

    spark.range(0, len(copies), numPartitions=max(1, len(copies) // 4)).mapInArrow(copy, "id bigint").count()


def _payloads(records: DataFrame, folder: str, fmt: Format) -> DataFrame:
    """Records with ``raw`` (the bytes they refer to) and ``error`` (why there are none)."""
    import pyarrow as pa

    top = f"{file_path(folder)}/blobs"
    size = lambda paths: sum(os.path.getsize(x) for x in paths if os.path.exists(x))
    blobs = [f"{top}/{x}" for x in os.listdir(top)] if os.path.isdir(top) else []
    # by what the payloads take, not by their records, which are a hundredth of it
    parts = max(1, -(-size(blobs) // READ), -(-size(f"{file_path(folder)}/{x}" for x in fmt.names.values()) // RECORDS))
    d = records.repartitionByRange(parts, "worker_id", "offset", "pa").sortWithinPartitions("worker_id", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, size = None, None, 0
        for batch in batches:
            for k in range(0, batch.num_rows, LIMIT):
                some, raw, error = batch.slice(k, LIMIT), [], []
                get = lambda c: some.column(some.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
                for kind, worker, offset, length in zip(get("kind"), get("worker_id"), get("offset"), get("len"), strict=True):
                    if worker != now:
                        if f:
                            f.close()
                        now, path = worker, f"{top}/worker_{worker}.blob"
                        f = open(path, "rb") if os.path.exists(path) else None
                        size = os.path.getsize(path) if f else 0
                    bad = "worker has no blob file" if f is None else "payload outside its file" if kind != ZERO and offset + length > size else None
                    raw.append(os.pread(f.fileno(), length, offset) if bad is None and kind != ZERO else None)
                    error.append(bad)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(raw, pa.binary()), pa.array(error, pa.string())], names=[*some.schema.names, "raw", "error"])
        if f:
            f.close()

    return d.mapInArrow(read, f"{', '.join(f'{n} {t}' for n, t in records.dtypes)}, raw binary, error string")


def load_files(spark: SparkSession, folder: str, fmt: Format = OWN) -> DataFrame:
    """The chunks of a folder of record files, the first write of each key, payloads decoded."""
    layout, records = open_files(spark, folder, fmt)
    records = first_writes(records, "seq") if layout == "log" else records
    d = _payloads(records, folder, fmt)
    wrong = F.raise_error(F.concat("error", F.lit(" at page "), F.col("pa").cast("string"))).cast("binary")
    raw = F.when(F.col("error").isNotNull() & (F.col("kind") != ZERO), wrong).otherwise(F.col("raw"))
    d = d.withColumn("raw", raw)
    page = decompress_page(F.when(F.col("kind") == FULL, F.col("raw")))
    patch = decode_patch(F.when(F.col("kind") == DELTA, F.col("raw")))
    return d.withColumns({"page": page, "patch": patch}).select(*spark.createDataFrame([], CHUNKS).columns)


def payload_error(kind: int, raw: bytes | None) -> str | None:
    """What is wrong with a payload (an empty one passes)."""
    if not raw:
        return None
    try:
        inflated(raw) if kind == FULL else parse_patch(raw)
    except ValueError as e:
        return str(e)
    except Exception:
        return "full page does not inflate"
    return None


def check_files(spark: SparkSession, folder: str, fmt: Format = OWN) -> DataFrame:
    """(pa, snapshot_id, error) of every record of the log that is not whole, or whose base is not."""
    records = record_rows(spark, f"{file_path(folder)}/{fmt.names['log']}", "log", fmt)
    d = _payloads(records, folder, fmt)

    @F.udf("string")
    def wrong(kind, raw):
        return payload_error(kind, None if raw is None else bytes(raw))

    found = F.coalesce("error", F.when(F.col("kind") != ZERO, wrong("kind", "raw")))
    d = d.select("pa", "snapshot_id", "kind", "base_snapshot", F.array_compact(F.array(found)).alias("errors"))
    return maintain.with_base_errors(d)


def truncate_blobs(spark: SparkSession, folder: str, records: DataFrame) -> int:
    """Cut each blob to what the records use and remove unused ones; how many bytes went."""
    top = f"{file_path(folder)}/blobs"
    ends = {r["worker_id"]: r["file_size"] for r in maintain.blob_ends(records).collect()}  # at most 256 rows
    gone = 0
    for r in blob_files(spark, folder).collect():
        path, end = f"{top}/worker_{r['worker_id']}.blob", ends.get(r["worker_id"])
        gone += r["blob_size"] - (end or 0)
        if end is None:
            os.remove(path)
        elif end < r["blob_size"]:
            os.truncate(path, end)
    return gone
