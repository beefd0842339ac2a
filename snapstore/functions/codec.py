"""Positional XOR patches between pages: sparse (word index, 64-bit xor), zero words left out.

The Arrow forms take whole batches: pages as one matrix of words, patches as flat lists. The
native forms say the same in SQL expressions and serve as a cross-check.
"""

from __future__ import annotations

import struct
from functools import wraps

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAGE_SIZE, WORDS

LIMIT = 1 << 9  # pages that a batch's work takes at once: its memory is theirs, whatever the batch has
ENTRY = struct.Struct("<HQ")
ENTRIES = np.dtype([("w", "<u2"), ("x", "<i8")])
PATCH_TYPE = T.ArrayType(T.StructType([T.StructField("w", T.ShortType()), T.StructField("x", T.LongType())]))


def _in_slices(kind: T.DataType):
    """An Arrow UDF whose function gets ``LIMIT`` rows at a time."""

    def made(f):
        @wraps(f)
        def sliced(*arrays):
            import pyarrow as pa

            if len(arrays[0]) <= LIMIT:
                return f(*arrays)
            return pa.concat_arrays([f(*(a.slice(k, LIMIT) for a in arrays)) for k in range(0, len(arrays[0]), LIMIT)])

        return F.arrow_udf(sliced, kind)

    return made


def _valid(*arrays) -> np.ndarray:
    return np.logical_and.reduce([a.is_valid().to_numpy(zero_copy_only=False) for a in arrays])


def _words(pages, at: np.ndarray) -> np.ndarray:
    """The pages at these places as rows of 512 words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    found = pages.take(pa.array(at))
    if len(found) and not pc.all(pc.equal(pc.binary_length(found), PAGE_SIZE)).as_py():
        raise ValueError(f"pages must have {PAGE_SIZE} bytes")
    return np.frombuffer(b"".join(found.to_pylist()), "<i8").reshape(len(at), WORDS)


def _binary(n: int, at: np.ndarray, lengths: np.ndarray, data: bytes):
    """A binary array of ``n`` places with values of these lengths at ``at``, null elsewhere."""
    import pyarrow as pa

    every, null = np.zeros(n, np.int64), np.ones(n, bool)
    every[at], null[at] = lengths, False
    offsets = np.concatenate([[0], np.cumsum(every)])
    whole = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())


def _patches(n: int, at: np.ndarray, counts: np.ndarray, w: np.ndarray, x: np.ndarray):
    import pyarrow as pa

    every, null = np.zeros(n, np.int32), np.ones(n, bool)
    every[at], null[at] = counts, False
    offsets = np.concatenate([[0], np.cumsum(every)]).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(w.astype(np.int16)), pa.array(x.astype(np.int64))], names=["w", "x"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries, mask=pa.array(null))


def _entries(patches, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and xor of every entry of the patches at these places."""
    import pyarrow as pa

    found = patches.take(pa.array(at))
    flat = found.flatten()
    w, x = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    if len(w) and (w.min() < 0 or w.max() >= WORDS):
        raise ValueError("patch word is outside a page")
    return np.repeat(np.arange(len(at)), found.value_lengths().to_numpy(zero_copy_only=False)), w, x


@_in_slices(PATCH_TYPE)
def xor_patch(base, page):
    """The patch that turns ``base`` into ``page`` (null if either is null)."""
    at = np.flatnonzero(_valid(base, page))
    x = _words(base, at) ^ _words(page, at)
    row, w = np.nonzero(x)
    return _patches(len(base), at, np.bincount(row, minlength=len(at)), w, x[row, w])


@_in_slices(T.IntegerType())
def changed_words(base, page):
    """How many of the 512 words differ (null if either is null)."""
    import pyarrow as pa

    ok = _valid(base, page)
    at, out = np.flatnonzero(ok), np.zeros(len(base), np.int32)
    out[at] = np.count_nonzero(_words(base, at) != _words(page, at), axis=1)
    return pa.array(out, mask=~ok)


@_in_slices(T.BinaryType())
def apply_patch(base, patch):
    """``base`` with the patch applied (null if either is null); a word index over 511 is an error."""
    at = np.flatnonzero(_valid(base, patch))
    words = _words(base, at).copy()
    row, w, x = _entries(patch, at)
    np.bitwise_xor.at(words, (row, w), x)
    return _binary(len(base), at, np.full(len(at), PAGE_SIZE), words.tobytes())


@_in_slices(T.BinaryType())
def encode_patch(patch):
    """Patches as bytes: 10 an entry, little-endian."""
    at = np.flatnonzero(_valid(patch))
    row, w, x = _entries(patch, at)
    out = np.empty(len(w), ENTRIES)
    out["w"], out["x"] = w, x
    return _binary(len(patch), at, np.bincount(row, minlength=len(at)) * ENTRIES.itemsize, out.tobytes())


@_in_slices(PATCH_TYPE)
def decode_patch(blob):
    """Patches from bytes; a length that is no multiple of 10 and a word over 511 are errors."""
    import pyarrow as pa

    at = np.flatnonzero(_valid(blob))
    found = blob.take(pa.array(at)).to_pylist()
    length = np.array([len(b) for b in found], np.int64)
    if (length % ENTRIES.itemsize).any():
        raise ValueError("patch length is no multiple of 10")
    e = np.frombuffer(b"".join(found), ENTRIES)
    if len(e) and e["w"].max() >= WORDS:
        raise ValueError("patch word is outside a page")
    return _patches(len(blob), at, length // ENTRIES.itemsize, e["w"], e["x"])


@_in_slices(T.BinaryType())
def compress_page(page):
    """Pages as zstd frames (null: null)."""
    import pyarrow as pa
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    return pa.array([None if p is None else c.compress(p) for p in page.to_pylist()], pa.binary())


@_in_slices(T.BinaryType())
def decompress_page(blob):
    """Pages from zstd frames; one that does not inflate to a page is an error."""
    import pyarrow as pa

    return pa.array([None if b is None else inflated(b) for b in blob.to_pylist()], pa.binary())


def inflated(blob: bytes) -> bytes:
    import zstandard

    page = zstandard.ZstdDecompressor().decompress(blob, max_output_size=PAGE_SIZE)
    if len(page) != PAGE_SIZE:
        raise ValueError("full page of wrong size")
    return page


def patch_bytes(patch: list[tuple[int, int]]) -> bytes:
    """10 bytes an entry, little-endian."""
    return b"".join(ENTRY.pack(w, x & (1 << 64) - 1) for w, x in patch)


def parse_patch(blob: bytes) -> list[tuple[int, int]]:
    if len(blob) % ENTRY.size:
        raise ValueError("patch length is no multiple of 10")
    found = [(w, x - (1 << 64) if x >> 63 else x) for w, x in ENTRY.iter_unpack(blob)]
    if any(w >= WORDS for w, _ in found):
        raise ValueError("patch word is outside a page")
    return found


def _swapped(h: Column) -> Column:
    return F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2)))


def native_words(page: Column) -> Column:
    """The 512 little-endian words. Bytes are swapped as hex digits, never by ``reverse`` of binary."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.hex(F.substring(page, i * 8 + 1, F.lit(8))))
    return F.transform(digits, lambda h: F.conv(_swapped(h), 16, -10).cast("bigint"))


def native_patch(base: Column, page: Column) -> Column:
    xors = F.zip_with(native_words(base), native_words(page), lambda a, b: a.bitwiseXOR(b))
    return F.filter(F.transform(xors, lambda x, i: F.struct(i.cast("smallint").alias("w"), x.alias("x"))), lambda e: e["x"] != 0)


def native_apply(base: Column, patch: Column) -> Column:
    by_word = F.map_from_entries(F.transform(patch, lambda e: F.struct(e["w"].cast("int"), e["x"])))
    words = F.transform(native_words(base), lambda v, i: v.bitwiseXOR(F.coalesce(F.try_element_at(by_word, i), F.lit(0).cast("bigint"))))
    return F.unhex(F.array_join(F.transform(words, lambda v: _swapped(F.lpad(F.hex(v), 16, "0"))), ""))
