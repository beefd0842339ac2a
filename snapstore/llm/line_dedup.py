"""Exact line deduplication across documents, by sorted hashes, giving keep bitmaps.

A line's key is the line stripped of white space, with A-Z in lower case. Keys of at least
``min_chars`` code points that two or more documents hold lose all their lines but those
in the smallest doc_id. Keys are compared by 128-bit hashes.

Line rows (hash, document, position) are range-partitioned and sorted by all of these, so a
line that a third of all documents share spreads over as many partitions as its rows
fill; each partition streams over its rows and marks those whose hash began with a smaller
document. Only the run that a partition starts with may have begun in an earlier one:
its rows are marked open, and the first document of each such run comes from a table of
at most two rows per partition, which is therefore safe to broadcast.

The marks of a document become one compressed bitmap, one bit per line (1: keep); texts are
never sorted or grouped. Documents without an entry keep every line.

Defined results: a null text has one empty line and stays as it is; a row without doc_id
takes no part and is kept whole; repeated rows (one id, one text) share one bitmap, two
texts under one id are one document whose lines never drop each other; other columns pass
through :func:`apply_bitmaps`, but those named n_lines or n_dropped are replaced; empty
tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_rank import row_ranges
from .common import SPACE, SPACE_BYTES, fresh, materialise, own_columns, shuffle_parts, text_columns

KEY = ("h1", "h2", "doc_id", "pos")
DROPPED, OPEN, LAST = 0, 1, 2


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash, n_lines, pos) of every line whose key is long enough."""
    import pyarrow as pa
    import pyarrow.compute as pc

    src = text_columns(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for a, b in row_ranges(pc.binary_length(batch.column(2)).to_pylist()):
                part = batch.slice(a, b - a)
                rows, pos, n_lines, hashes = [], [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    lines = text.split(b"\n")
                    for i, line in enumerate(lines):
                        key = line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z only
                        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                            rows.append(k)
                            pos.append(i)
                            n_lines.append(len(lines))
                            hashes.append(xxh3_128_digest(key))
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(0).take(rows), part.column(1).take(rows), pa.array(n_lines, pa.int32()), pa.array(pos, pa.int32())], names=["h1", "h2", "doc_id", "text_hash", "n_lines", "pos"])

    return src.mapInArrow(run, "h1 long, h2 long, doc_id long, text_hash long, n_lines int, pos int")


def stream_marks(rows: DataFrame) -> DataFrame:
    """Stream each sorted partition: dropped rows, rows of its first run, and its last run's start."""
    import pyarrow as pa

    schema = T.StructType([*rows.schema.fields, T.StructField("kind", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[int, int] | None = None  # the hash of the partition's first run
        now: tuple[int, int] | None = None  # the hash that streams by, and its first document
        now_doc, last = 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (batch.column(k).to_numpy() for k in range(3))
            start = np.empty(n, bool)
            start[0] = (int(h1[0]), int(h2[0])) != now
            start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            run_doc = np.where(at >= 0, doc[np.maximum(at, 0)], now_doc)
            first = first or (int(h1[0]), int(h2[0]))
            kind = np.where((h1 == first[0]) & (h2 == first[1]), OPEN, np.where(doc > run_doc, DROPPED, -1)).astype(np.int32)
            now, now_doc = (int(h1[-1]), int(h2[-1])), int(run_doc[-1])
            last = batch.slice(n - 1, 1)
            marked = np.flatnonzero(kind >= 0)
            if len(marked):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(marked)).columns, pa.array(kind[marked])], names=schema.names)
        if last is not None:
            columns = list(last.columns)
            columns[2] = pa.array([now_doc], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([LAST], pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep_bitmap) of the documents that lose lines.

    ``text_hash`` is ``xxhash64`` of the text; ``keep_bitmap`` is zlib over bits in line order.
    """
    lines = materialise(line_rows(docs, min_chars), "lines")
    parts = shuffle_parts(docs.sparkSession)
    ordered = lines.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    marks = materialise(stream_marks(ordered), "line-marks")
    # at most two runs a partition: its first and its last
    starts = marks.where(F.col("kind") > DROPPED).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    open_ = marks.where(F.col("kind") == OPEN).join(F.broadcast(starts), ["h1", "h2"]).where("doc_id > first_doc")
    dropped = marks.where(F.col("kind") == DROPPED).select("doc_id", "text_hash", "n_lines", "pos").unionByName(open_.select("doc_id", "text_hash", "n_lines", "pos"))
    by_doc = dropped.groupBy("doc_id", "text_hash", "n_lines").agg(F.collect_set("pos").alias("gone"))

    @F.pandas_udf("binary")
    def bitmap(n_lines, gone):
        out = []
        for n, g in zip(n_lines, gone, strict=True):
            keep = np.ones(n, np.uint8)
            keep[np.asarray(g)] = 0
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        return type(n_lines)(out)

    return by_doc.select("doc_id", "text_hash", F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), bitmap("n_lines", "gone").alias("keep_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``, and columns n_lines and n_dropped."""
    import pyarrow as pa

    own = own_columns(docs, ("n_lines", "n_dropped"))
    id_, hash_, bitmap, text_hash = (fresh(own, c) for c in ("_id", "_hash", "_bitmap", "_text_hash"))
    b = bitmaps.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("keep_bitmap").alias(bitmap))
    d = docs.select(*(docs[c] for c in own), F.xxhash64(docs[text].cast("string")).alias(text_hash))
    d = d.join(b, (d["doc_id"] == b[id_]) & (d[text_hash] == b[hash_]), "left").select(*own, bitmap)
    place = own.index(text)
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            n_lines, n_dropped = [], []
            for k, (t, packed) in enumerate(zip(texts, batch.column(len(own)).to_pylist(), strict=True)):
                n = (t or "").count("\n") + 1
                n_lines.append(n)
                if packed is None:
                    n_dropped.append(0)
                    continue
                keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n)
                texts[k] = "\n".join([line for line, on in zip(t.split("\n"), keep.tolist(), strict=True) if on])
                n_dropped.append(n - int(keep.sum()))
            columns = list(batch.columns[: len(own)])
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    return d.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` without the repeated lines, and columns n_lines (before) and n_dropped."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))


def oracle_sql(min_chars: int = 10) -> str:
    """DuckDB SQL for (doc_id, n_lines, n_dropped, kept_sha256) over a view ``documents``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
l AS (SELECT doc_id, unnest(ls) line, unnest(range(1, len(ls) + 1)) pos FROM d),
k AS (SELECT *, translate(trim(line, {space}), '{upper}', '{upper.lower()}') key FROM l),
f AS (SELECT key, min(doc_id) first_doc FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id > f.first_doc gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) kept_sha256 FROM m GROUP BY doc_id"""
