"""Binary record files as a Spark data source: append-ordered logs and fixed-size indexes.

Header (16 bytes): an 8-byte magic, a version byte, the greatest snapshot id (u32), zeros.
Log record: key u64, kind u8, worker u8, offset u64, length u32, and for deltas the base
key u64. Index record (32 bytes): key, base key, offset, length, kind, worker, 2 zero
bytes. All little-endian. The magics are options (``log_magic``, ``index_magic``, hex),
``path`` names the file, ``layout`` is ``log`` or ``index``; an index is cut into ranges of
records, a log is one partition.

Writing needs a mounted folder: each task writes its records, in the order it gets them, to a
part beside the file; the commit puts header and parts together and renames the whole, so
a file is there as it was before or whole. Sort the rows first
(``maintain.log_order`` / ``maintain.index_order``); rows come as ``SCHEMA`` has them, in any
order of columns.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import MAX_SNAPSHOT, SNAPSHOT_BITS
from .scratch import file_path

HEADER = 16
SCHEMA = "seq bigint, pa bigint, snapshot_id int, kind tinyint, worker_id smallint, offset bigint, len bigint, base_snapshot int"
RANGE = 1 << 20
READ = 1 << 22
LOG = np.dtype([("key", "<u8"), ("kind", "u1"), ("worker", "u1"), ("offset", "<u8"), ("len", "<u4"), ("base", "<u8")])
INDEX = np.dtype([("key", "<u8"), ("base", "<u8"), ("offset", "<u8"), ("len", "<u4"), ("kind", "u1"), ("worker", "u1"), ("zero", "<u2")])
SHORT = LOG.itemsize - 8  # a log record without base key


def header(magic: bytes, max_snapshot: int, version: int = 1) -> bytes:
    return magic + struct.pack("<BI3x", version, max_snapshot)


def read_header(data: bytes, magic: bytes) -> int:
    """The greatest snapshot id, after checking magic and version."""
    if len(data) < HEADER or data[:8] != magic:
        raise ValueError("not a record file of this kind")
    version, top = struct.unpack_from("<BI", data, 8)
    if version != 1:
        raise ValueError(f"unknown record file version {version}")
    return top


def detect_layout(path: str, magics: dict[str, bytes]) -> str:
    """Which of the layouts (name: magic) the file's first 8 bytes name."""
    with open(path, "rb") as f:
        first = f.read(8)
    for name, magic in magics.items():
        if first == magic:
            return name
    raise ValueError(f"{path} begins with no known magic")


def update_header(path: str, magic: bytes, max_snapshot: int) -> None:
    """Put another greatest snapshot id into the header of a file, in place."""
    with open(path, "r+b") as f:
        read_header(f.read(HEADER), magic)
        f.seek(9)
        f.write(struct.pack("<I", max_snapshot))


def packed(dtype: np.dtype, pa, snapshot_id, kind, worker, offset, length, base_snapshot) -> np.ndarray:
    """Records of one layout from columns (NumPy arrays; the base counts for deltas only)."""
    out = np.zeros(len(pa), dtype)
    high = np.asarray(pa).astype(np.uint64) << np.uint64(SNAPSHOT_BITS)
    out["key"] = high | np.asarray(snapshot_id).astype(np.uint64)
    out["base"] = np.where(np.asarray(kind) == 1, high | np.asarray(base_snapshot).astype(np.uint64), np.uint64(0))
    out["kind"], out["worker"], out["offset"], out["len"] = kind, worker, offset, length
    return out


def record_bytes(layout: str, *columns) -> bytes:
    """Log or index records, one after the other; log records of other kinds than deltas have no base key."""
    if layout == "index":
        return packed(INDEX, *columns).tobytes()
    made = packed(LOG, *columns)
    raw = made.view(np.uint8).reshape(len(made), LOG.itemsize)
    keep = np.ones(raw.shape, bool)
    keep[made["kind"] != 1, SHORT:] = False
    return raw[keep].tobytes()


def _one(layout: str, pa, snapshot_id, kind, worker, offset, length, base_snapshot) -> bytes:
    return record_bytes(layout, *(np.array([v]) for v in (pa, snapshot_id, kind, worker, offset, length, base_snapshot or 0)))


def log_record(pa: int, snapshot_id: int, kind: int, worker: int = 0, offset: int = 0, length: int = 0, base_snapshot: int | None = None) -> bytes:
    return _one("log", pa, snapshot_id, kind, worker, offset, length, base_snapshot)


def index_record(pa: int, snapshot_id: int, kind: int, worker: int = 0, offset: int = 0, length: int = 0, base_snapshot: int | None = None) -> bytes:
    return _one("index", pa, snapshot_id, kind, worker, offset, length, base_snapshot)


def _batch(seq: int, r: np.ndarray):
    import pyarrow as pa

    kind = r["kind"]
    if len(r) and kind.max() > 2:
        raise ValueError(f"unknown chunk kind {kind.max()}")
    low = lambda k: (k & np.uint64(MAX_SNAPSHOT)).astype(np.int32)
    columns = [
        pa.array(np.arange(seq, seq + len(r))), pa.array((r["key"] >> np.uint64(SNAPSHOT_BITS)).astype(np.int64)), pa.array(low(r["key"])), pa.array(kind.astype(np.int8)),
        pa.array(r["worker"].astype(np.int16)), pa.array(r["offset"].astype(np.int64)), pa.array(r["len"].astype(np.int64)), pa.array(low(r["base"]), mask=kind != 1),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def log_batches(f) -> Iterator[np.ndarray]:
    """Records of a log, read on in pieces; a partial head at the end is a torn tail and left out."""
    rest = b""
    while piece := f.read(READ):
        data = rest + piece
        starts, at, n = [], 0, len(data)
        while at + LOG.itemsize <= n:  # room for either length
            starts.append(at)
            at += LOG.itemsize if data[at + 8] == 1 else SHORT
        yield _gather(data, starts)
        rest = data[at:]
    starts, at = [], 0
    while at + SHORT <= len(rest):
        if rest[at + 8] == 1 and at + LOG.itemsize > len(rest):
            raise ValueError("log ends inside a delta's base key")
        starts.append(at)
        at += LOG.itemsize if rest[at + 8] == 1 else SHORT
    yield _gather(rest + bytes(LOG.itemsize), starts)


def _gather(data: bytes, starts: list[int]) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    at = np.array(starts, np.int64)
    return np.ascontiguousarray(raw[at[:, None] + np.arange(LOG.itemsize)]).view(LOG).ravel() if len(at) else np.empty(0, LOG)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = file_path(options["path"]), options.get("layout", "log")
        self.magic = bytes.fromhex(options[f"{self.layout}_magic"])

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            read_header(f.read(HEADER), self.magic)
        if self.layout == "log":
            return [_Range(0, 0)]
        body = os.path.getsize(self.path) - HEADER
        if body % INDEX.itemsize:
            raise ValueError("index body is no multiple of 32 bytes")
        n = body // INDEX.itemsize
        return [_Range(k, min(n, k + RANGE)) for k in range(0, n, RANGE)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator:
        with open(self.path, "rb") as f:
            if self.layout == "index":
                f.seek(HEADER + part.start * INDEX.itemsize)
                yield _batch(part.start, np.frombuffer(f.read((part.end - part.start) * INDEX.itemsize), INDEX))
                return
            f.seek(HEADER)
            seq = 0
            for found in log_batches(f):
                yield _batch(seq, found)
                seq += len(found)


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int
    max_snapshot: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.layout = file_path(options["path"]), options.get("layout", "log")
        self.magic = bytes.fromhex(options[f"{self.layout}_magic"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, batches) -> _Part:
        from pyspark import TaskContext

        k = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        path, rows, top = f"{self.parts}/{k.partitionId():06d}-{k.taskAttemptId()}", 0, 0
        with open(path, "wb") as f:
            for batch in batches:
                get = lambda name: batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                f.write(record_bytes(self.layout, *map(get, ("pa", "snapshot_id", "kind", "worker_id", "offset", "len", "base_snapshot"))))
                rows += batch.num_rows
                top = max(top, int(get("snapshot_id").max())) if batch.num_rows else top
        return _Part(k.partitionId(), path, rows, top)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        whole = f"{self.parts}.whole"
        with open(whole, "wb") as out:
            out.write(header(self.magic, max((m.max_snapshot for m in parts), default=0)))
            for m in parts:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out, READ)
            out.flush()
            os.fsync(out.fileno())
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class RecordFiles(DataSource):
    """``spark.dataSource.register(RecordFiles)``, then ``spark.read`` / ``write.format("page_records")``."""

    @classmethod
    def name(cls) -> str:
        return "page_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)
