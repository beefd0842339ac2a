"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Pieces are packed by best-fit decreasing. Pieces of one length are interchangeable, and so
are bins of one remaining capacity; so the packing is planned over runs: the counts of
pieces by length (at most ``capacity`` numbers) are all the driver sees, and a segment tree
over remaining capacities gives the tightest open bin for a run in logarithmic time. What
comes out is bin for bin the packing of best-fit decreasing document by document.

A plan is a list of segments (length, ranks, first bin, pieces per bin, offset). A run of
bins is split at most twice per length, and a run that takes pieces keeps less than half of
its free space, so there are at most 4 * capacity * log2(capacity) segments however many
documents there are: small enough to send to every task.

A piece finds its segment by its rank among pieces of its length. The rank is the count in
earlier tasks plus the count earlier in its task, which the tokenising task writes next to
it; so no length, however common, meets in one task. Tokenised pieces (without ids) are
written to the shared folder first: ranks must not change between the two passes.

Defined results: a null text is packed as an empty one (the closing id alone); repeated
rows, also with one id, are packed as rows of their own; further columns stay out; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_rank import MEMO, default_path, row_ranges
from .common import materialise, release_memory, shrunk, text_columns

CLOSING_ID = 0
#: What stands between runs that the library encodes together, and how many those are at most.
MARK, BLOCK = b" \x01 ", 1000
#: Letters that stay letters in NFC and lower case (so no U+0130, nor what combines), then punctuation.
TWO_WORDS = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]*)(?P<marks>[!-/:-@\[-`{-~]*)$"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


class CapacityTree:
    """Segment tree over remaining capacities: which hold open bins, and the least such >= x."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, r: int, on: bool) -> None:
        i = r + self.size
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:  # up to the first right sibling that has any, then down its left edge
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass
class Plan:
    """Segments by (length, first rank); ``bins`` sequences in all."""

    length: np.ndarray
    rank: np.ndarray
    first_bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these ranks among those of their lengths."""
        at = np.searchsorted(self.length << 44 | self.rank, length << 44 | rank, side="right") - 1
        j = rank - self.rank[at]
        return self.first_bin[at] + j // self.per_bin[at], self.offset[at] + j % self.per_bin[at] * length


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over runs of equal lengths (``counts``: pieces by length, 1 to capacity)."""
    tree = CapacityTree(capacity)
    free: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs of bins (first, how many)
    segments: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(r: int, run: tuple[int, int]) -> None:
        if r:
            if not free.setdefault(r, []):
                tree.set(r, True)
            free[r].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r = capacity
                first, many = bins, -(-left // (r // length))
                bins += many
            else:
                first, many = free[r].pop()
                if not free[r]:
                    tree.set(r, False)
            m = r // length
            full = min(many, left // m)
            if full:
                segments.append((length, rank, first, m, capacity - r))
                put(r - m * length, (first, full))
                rank, left = rank + full * m, left - full * m
            if many > full:
                if left:  # fewer than a bin takes: they all go to the next
                    segments.append((length, rank, first + full, left, capacity - r))
                    put(r - left * length, (first + full, 1))
                    full, left = full + 1, 0
                if many > full:
                    put(r, (first + full, many - full))
    s = np.array(sorted(segments), np.int64).reshape(-1, 5)
    return Plan(*(s[:, k] for k in range(5)), bins)


_libraries: dict[str, object] = {}


class TokenIds:
    """Ids by the tokenizers library, each distinct piece of a text once.

    Texts are cut at white space, runs told apart and put back as Arrow arrays. A run of
    Latin letters and then ASCII punctuation is two words to the vocabulary's pattern, which
    the library gets by themselves; any other run it gets whole. It takes BLOCK of them at a
    time: words are told apart by the ids that end one, runs by MARK between them. A block
    whose ids don't show just as many goes to it one by one. The memo belongs to a task;
    over MEMO entries it shrinks to the pieces in use.
    """

    def __init__(self, path: str):
        if path not in _libraries:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            final = np.zeros(library.get_vocab_size() + 1, bool)
            if end := library.model.end_of_word_suffix:
                final[[i for w, i in library.get_vocab(with_added_tokens=False).items() if w.endswith(end)]] = True
            _libraries[path] = (library, final)
        self.library, self.final = _libraries[path]
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.mark = self.encode([MARK])[0]

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, block: list[bytes], words: bool) -> None:
        """Put the ids of these words, or runs, in the memo."""
        ids = np.array(self.encode([(b" " if words else MARK).join(block)])[0], "<u4")
        if words:
            end, skip = np.flatnonzero(self.final[ids]) + 1, 0
        else:
            end, skip = np.append(np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else [], len(ids)).astype(np.int64), 1
        if len(end) != len(block):  # say a run that holds the mark itself
            each = self.encode(block)
            ids, end, skip = np.fromiter(chain.from_iterable(each), "<u4"), np.cumsum([len(i) for i in each]), 0
        flat, start, end = ids.tobytes(), [0, *(4 * (end[:-1] + skip)).tolist()], (4 * end).tolist()
        self.memo.update((w, flat[i:j]) for w, i, j in zip(block, start, end, strict=True))

    def look_up(self, column, words: bool, used: set[bytes]):
        """The ids of each of ``column`` as an Arrow array of bytes."""
        import pyarrow as pa

        coded = column.dictionary_encode()
        pieces = coded.dictionary.cast(pa.large_binary()).to_pylist()
        used.update(pieces)
        new = [w for w in pieces if w not in self.memo]
        for k in range(0, len(new), BLOCK):
            self.learn(new[k : k + BLOCK], words)
        return pa.array(map(self.memo.__getitem__, pieces), pa.large_binary()).take(coded.indices)

    def __call__(self, texts) -> list[bytes]:
        """Ids of each text (a list or an Arrow array of bytes) as unsigned 32-bit integers, little-endian."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))  # white space of ASCII never joins what it separates
        coded = cut.flatten().dictionary_encode()
        runs, used = coded.dictionary, {b""}
        halves = pc.extract_regex(runs, TWO_WORDS)
        two = halves.is_valid()
        letters, marks = halves.filter(two).flatten()
        ids = pc.binary_join_element_wise(self.look_up(pc.ascii_lower(letters), True, used), self.look_up(marks, True, used), pa.scalar(b"", pa.large_binary()))
        ids = pa.concat_arrays([ids, self.look_up(runs.filter(pc.invert(two)), False, used)])
        two = two.to_numpy(zero_copy_only=False)
        place = np.where(two, np.cumsum(two) - 1, two.sum() + np.cumsum(~two) - 1)
        ids = ids.take(pa.array(place[coded.indices.to_numpy()]))
        self.memo = shrunk(self.memo, used, MEMO)
        _, offsets, flat = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[np.asarray(cut.offsets)].tolist()
        return [flat[i:j].to_pybytes() for i, j in zip(ends, ends[1:])]


def tokenised_pieces(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """Rows of PIECES, read back from the shared folder."""
    import pyarrow as pa
    import pyarrow.compute as pc

    src = text_columns(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        token_ids = TokenIds(path)
        try:
            for batch in batches:
                for a, b in row_ranges(pc.binary_length(batch.column(1)).to_pylist()):
                    rows = []
                    doc_ids = batch.column(0).slice(a, b - a).to_pylist()
                    for doc_id, ids in zip(doc_ids, token_ids(batch.column(1).slice(a, b - a)), strict=True):
                        ids = memoryview(ids + closing)
                        for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                            part = ids[4 * at : 4 * (at + capacity)]
                            n = len(part) // 4
                            rows.append((doc_id, k, at, n, zlib.crc32(part), task, seen[n]))
                            seen[n] += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
        finally:
            token_ids.memo = {}
            release_memory()

    return materialise(src.mapInArrow(run, PIECES), "pieces")


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import pyarrow as pa

    pieces = tokenised_pieces(docs, capacity, path or default_path())
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {int(length): int(n) for length, n in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = plan_packing(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
