"""Language-model scores from an n-gram trie in Elias-Fano coded, memory-mapped levels.

Tokens are words with A-Z in lower case, then one end. Counts come from all training
documents. The model interpolates bigrams with unigrams by absolute discounting:

    p(w)     = (c(w) - D1) / N, and D1 * V / N for all unknown words as one symbol
    p(w | u) = (c(u, w) - D2) / c(u) [kept bigrams] + rest(u) * p(w)

where D1 is the share of types seen once, and bigrams seen ``min_count`` times are kept: all,
unless told otherwise. Discounted shares are quantised downwards to 8 bits and rest(u) is what
the quantised ones leave, in 16 bits; so over all words and the unknown symbol the
probabilities after any context sum to 1, but for the 16th bit of the rest. After an unknown
word p(w) counts alone.

Level 1: shards of sorted 64-bit word hashes; a word's id is its rank, so ids are monotone
over the shards. Counts are differences of a monotone list of running sums. Level 2:
shards of contexts, each with sorted context ids, monotone pointers to its run of
successors, and successors made monotone by adding their context's place; a successor is
searched relative to its context.

Counting adds up within a task first and ships sorted, difference-coded, compressed blobs,
one per task and shard, so common words and pairs weigh no more than rare ones. A context
of more than a shard's share of tokens is spread over several shards by its successors.
Shards are written to the shared folder by rename, so a repeated task does no harm, and
mapped by every worker; which were written is recorded, so one that cannot be read is an
error and not an empty one. Only sums per shard and the spread contexts, of which there are
fewer than shards, reach the driver.

Defined results: a null or empty text is one end; repeated rows count and score each by
itself; a null doc_id is held out nowhere; with no training document N = V = 0; an empty table
gives no rows; other columns pass through, but those named n_tokens, n_known, base_score or
score are replaced.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_rank import row_ranges
from .common import fresh, new_path, own_columns, release_memory
from .elias_fano import EliasFano, pack, unpack

END = b""
MEMO = 600_000
FLUSH = 2_000_000
MAX_SHARDS = 1 << 14
_U = np.uint64


# Files of the shared folder, by local path where it is one.


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{os.getpid()}.part", "wb") as f:
            f.write(data)
        os.replace(f.name, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def read_file(uri: str):
    """The file's bytes: mapped if it is local, else read (a store without paths has no mapping)."""
    if path := _local(uri):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_buffer()


def quantise(p: np.ndarray, least: float, bits: int = 8) -> np.ndarray:
    """Probabilities from 10**least to 1 on a logarithmic scale, rounded downwards."""
    top = (1 << bits) - 1
    return np.clip(np.floor(top * (1 - np.log10(p) / least) + 1e-9), 0, top).astype(np.uint8 if bits == 8 else np.uint16)


def levels(least: float, bits: int = 8) -> np.ndarray:
    """What the quantised values stand for."""
    return 10 ** (least * (1 - np.arange(1 << bits) / ((1 << bits) - 1)))


def coded(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences with counts, compressed."""
    import zstandard

    d = np.diff(keys.astype(np.uint64), prepend=_U(0))
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)  # like bytes together
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(keys)], np.int64).tobytes() + planes.tobytes() + counts.astype(np.uint32).tobytes())


def decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64), np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[start], np.add.reduceat(c, start) if len(k) else c


class Gathered:
    """Keys added up in a task and given out as blobs by shard."""

    def __init__(self, shard_of):
        self.shard_of, self.parts, self.size = shard_of, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.size += len(k)
        if self.size > FLUSH:
            k, c = added(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
            self.parts, self.size = [(k, c)], len(k)
            if self.size > FLUSH // 2:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            k, c = added(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
            shard = self.shard_of(k)
            for s in np.unique(shard):
                at = shard == s
                yield int(s), coded(k[at], c[at])
        self.parts, self.size = [], 0


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def chunks(batch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    import pyarrow.compute as pc

    texts = batch.column(column)
    for a, b in row_ranges(pc.binary_length(texts).to_pylist()):
        yield a, b, texts.slice(a, b - a).to_pylist()


@dataclass
class Trie:
    """What workers need to open the model."""

    folder: str
    shards: int
    first_id: list[int] = field(default_factory=list)  # of each level-1 shard, and V at the end
    n_tokens: int = 0
    n_once: int = 0
    least: float = -9.0  # log10 of the least probability that is quantised
    written: frozenset[int] = frozenset()  # the level-2 shards that there are
    hot: dict[int, int] = field(default_factory=dict)  # spread contexts: over how many shards
    hot_rest: dict[int, float] = field(default_factory=dict)

    @property
    def types(self) -> int:
        return self.first_id[-1] if self.first_id else 0

    def level1(self, s: int) -> str:
        return f"{self.folder}/words-{s:05d}.ef"

    def level2(self, s: int) -> str:
        return f"{self.folder}/pairs-{s:05d}.ef"

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - (self.shards - 1).bit_length())).astype(np.int64) if self.shards > 1 else np.zeros(len(hashes), np.int64)

    def pair_shard(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Contexts by range of id; those of more than a shard's share also by successor."""
        shard = u * self.shards // max(self.types, 1)
        if self.hot:
            ids = np.array(sorted(self.hot), np.int64)
            spread = np.array([self.hot[int(i)] for i in ids], np.int64)
            at = np.minimum(np.searchsorted(ids, u), len(ids) - 1)
            mix = (w.astype(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(33)).astype(np.int64)
            shard = np.where(ids[at] == u, (shard + mix % spread[at]) % self.shards, shard)
        return shard


class Words:
    """Ids and counts of words through a memo over the mapped level 1."""

    def __init__(self, trie: Trie):
        self.trie, self.memo = trie, {}
        self.ids, self.counts, self.files = np.empty(0, np.int64), np.empty(0, np.int64), {}

    def shard(self, s: int) -> tuple[EliasFano, EliasFano]:
        if s not in self.files:
            arrays = unpack(read_file(self.trie.level1(s)))
            self.files[s] = EliasFano.of(arrays[:4]), EliasFano.of(arrays[4:])
        return self.files[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = self.trie.word_shard(hashes)
        for s in np.unique(shard).tolist() if self.trie.types else []:
            if self.trie.first_id[s] == self.trie.first_id[s + 1]:
                continue
            words, sums = self.shard(s)
            at = np.flatnonzero(shard == s)
            at = at[np.argsort(hashes[at])]
            i = words.search(hashes[at])
            at, i = at[i >= 0], i[i >= 0]
            ids[at] = i + self.trie.first_id[s]
            counts[at] = (sums.get(i + 1) - sums.get(i)).astype(np.int64)
        return ids, counts

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of all tokens, and the tokens of each text."""
        from xxhash import xxh3_64_intdigest

        cut = [tokens(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.ids, self.counts = {}, np.empty(0, np.int64), np.empty(0, np.int64)
        new = list(set().union(*cut).difference(self.memo))
        if new:
            ids, counts = self.find(np.fromiter(map(xxh3_64_intdigest, new), np.uint64, len(new)))
            self.memo.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        n = np.array([len(w) for w in cut], np.int64)
        slot = np.fromiter((s for words in cut for s in map(self.memo.__getitem__, words)), np.int64, int(n.sum()))
        return self.ids[slot], self.counts[slot], n


def contexts(ids: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """The token before each; an end before the first of a text."""
    u = np.roll(ids, 1)
    u[np.cumsum(n) - n] = end
    return u


def build(docs: DataFrame, min_count: int = 1, discount: float = 0.75) -> Trie:
    """Count all of ``docs`` (doc_id, text) and write the trie's levels to the shared folder."""
    import pyarrow as pa

    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    shards = 1 << max(4, min(MAX_SHARDS, src.rdd.getNumPartitions()) - 1).bit_length()
    trie = Trie(new_path(spark, "lm-trie"), shards)

    def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], names=["shard", "blob"])

    def count_words(batches):
        from xxhash import xxh3_64_intdigest

        memo, held = {}, Gathered(trie.word_shard)
        for batch in batches:
            for _, _, texts in chunks(batch, 0):
                cut = [tokens(t) for t in texts]
                if len(memo) > MEMO:
                    memo.clear()
                memo.update((w, xxh3_64_intdigest(w)) for w in set().union(*cut).difference(memo))
                if found := list(held.add(np.fromiter((h for words in cut for h in map(memo.__getitem__, words)), np.uint64))):
                    yield rows(found)
        if found := list(held.flush()):
            yield rows(found)

    def sum_blobs(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each shard of a partition sorted by shard, added up as its blobs stream by."""
        now, keys, counts = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def total():
            return added(np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now:
                    if now is not None:
                        yield now, *total()
                    now, keys, counts, waiting = s, np.empty(0, np.uint64), np.empty(0, np.int64), []
                waiting.append(decoded(blob))
                if sum(len(w[0]) for w in waiting) > max(len(keys), 200_000):
                    (keys, counts), waiting = total(), []
        if now is not None:
            yield now, *total()

    def write_words(batches):
        for s, keys, counts in sum_blobs(batches):
            sums = np.concatenate([[0], np.cumsum(counts)])
            write_file(trie.level1(s), pack([*EliasFano.build(keys, 1 << 64).arrays(), *EliasFano.build(sums, int(sums[-1]) + 1).arrays()]))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)]), pa.array([int(sums[-1])]), pa.array([int((counts == 1).sum())]), pa.array([int(counts.max())])], names=["shard", "types", "tokens", "once", "most"])

    def find_hot(batches):
        """Ids and counts of the words of more than a shard's share of tokens."""
        words = Words(trie)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                n = trie.first_id[s + 1] - trie.first_id[s]
                for a in range(0, n, 1 << 20):
                    sums = words.shard(s)[1].get(np.arange(a, min(n, a + (1 << 20)) + 1)).astype(np.int64)
                    counts = np.diff(sums)
                    at = np.flatnonzero(counts > trie.n_tokens // trie.shards)
                    yield pa.RecordBatch.from_arrays([pa.array(at + a + trie.first_id[s]), pa.array(counts[at])], names=["u", "n"])

    by_shard = lambda d: d.repartition(shards, "shard").sortWithinPartitions("shard")
    blobs = "shard int, blob binary"
    sums = {r["shard"]: r for r in by_shard(src.mapInArrow(count_words, blobs)).mapInArrow(write_words, "shard int, types long, tokens long, once long, most long").collect()}
    trie.first_id = np.concatenate([[0], np.cumsum([sums[s]["types"] if s in sums else 0 for s in range(shards)])]).tolist()
    trie.n_tokens = sum(r["tokens"] for r in sums.values())
    trie.n_once = sum(r["once"] for r in sums.values())
    trie.least = float(np.log10((min_count - discount) / max((r["most"] for r in sums.values()), default=1))) - 0.1
    for r in spark.range(0, shards, 1, min(shards, 64)).mapInArrow(find_hot, "u long, n long").collect():
        trie.hot[r["u"]] = int(min(-(-r["n"] * shards // trie.n_tokens), shards))

    def count_pairs(batches):
        words = Words(trie)
        v = max(trie.types, 1)
        held = Gathered(lambda k: trie.pair_shard((k // _U(v)).astype(np.int64), (k % _U(v)).astype(np.int64)))
        for batch in batches:
            for _, _, texts in chunks(batch, 0):
                ids, counts, n = words.look_up(texts)
                end = ids[-1]
                u = contexts(ids, n, end)
                often = counts >= min_count  # no other word can be in a kept pair
                before = np.roll(often, 1)
                before[np.cumsum(n) - n] = True
                at = np.flatnonzero(often & before)
                if found := list(held.add(u[at].astype(np.uint64) * _U(v) + ids[at].astype(np.uint64))):
                    yield rows(found)
        if found := list(held.flush()):
            yield rows(found)

    def write_pairs(batches):
        words = Words(trie)
        v = max(trie.types, 1)
        first = np.array(trie.first_id, np.int64)
        for s, keys, counts in sum_blobs(batches):
            keep = counts >= min_count
            keys, counts = keys[keep], counts[keep]
            u, w = (keys // _U(v)).astype(np.int64), (keys % _U(v)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, np.int64)
            own = u[start]
            seen = np.zeros(len(own), np.int64)
            shard = np.searchsorted(first, own, side="right") - 1
            for k in np.unique(shard).tolist():
                at = np.flatnonzero(shard == k)
                _, totals = words.shard(k)
                i = own[at] - first[k]
                seen[at] = (totals.get(i + 1) - totals.get(i)).astype(np.int64)
            place = np.repeat(np.arange(len(own)), np.diff([*start, len(u)]))
            share = quantise((counts - discount) / seen[place], trie.least)
            mass = np.add.reduceat(levels(trie.least)[share], start) if len(u) else np.empty(0)
            rest = quantise(np.maximum(1 - mass, 10**trie.least), trie.least, 16)
            pointers = np.concatenate([start, [len(u)]])
            successors = place.astype(np.uint64) * _U(v) + w.astype(np.uint64)
            lists = [(own, v), (pointers, len(u) + 1), (successors, max(1, len(own)) * v)]
            arrays = [a for values, universe in lists for a in EliasFano.build(values, universe).arrays()]
            write_file(trie.level2(s), pack([*arrays, share, rest]))
            hot = [k for k, i in enumerate(own.tolist()) if i in trie.hot]
            yield pa.RecordBatch.from_arrays([pa.array([s] * (len(hot) + 1), pa.int32()), pa.array([None, *(int(own[k]) for k in hot)], pa.int64()), pa.array([0.0, *(float(mass[k]) for k in hot)])], names=["shard", "u", "mass"])

    found = by_shard(src.mapInArrow(count_pairs, blobs)).mapInArrow(write_pairs, "shard int, u long, mass double").collect()
    trie.written = frozenset(r["shard"] for r in found)
    trie.hot_rest = dict.fromkeys(trie.hot, 1.0)
    for r in found:
        if r["u"] is not None:
            trie.hot_rest[r["u"]] -= r["mass"]
    return trie


class Scorer:
    """Scores of texts; a worker's view of the mapped trie."""

    def __init__(self, trie: Trie):
        self.trie, self.words, self.files = trie, Words(trie), {}
        v = max(trie.types, 1)
        self.d1 = min(0.9, trie.n_once / v) if trie.n_once else 0.5
        self.unknown = self.d1 * trie.types / max(trie.n_tokens, 1) or 1.0
        self.shares, self.rests = levels(trie.least), levels(trie.least, 16)

    def pairs(self, s: int):
        if s not in self.files:
            if s not in self.trie.written:  # no pair fell into this shard
                self.files[s] = None
                return None
            a = unpack(read_file(self.trie.level2(s)))
            self.files[s] = [EliasFano.of(a[k : k + 4]) for k in (0, 4, 8)] + a[12:]
        return self.files[s]

    def discounted(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted shares (0: no kept pair) and rests of distinct pairs; ``w`` is V for the unknown symbol."""
        q, rest = np.zeros(len(u)), np.ones(len(u))
        shard = self.trie.pair_shard(u, w)
        order = np.lexsort((w, u, shard))
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            if (level := self.pairs(int(shard[part[0]]))) is None:
                continue
            own, pointers, successors, prob, left = level
            i = own.search(u[part].astype(np.uint64))
            part, i = part[i >= 0], i[i >= 0]
            rest[part] = self.rests[left[i]]
            j = successors.search(i.astype(np.uint64) * _U(self.trie.types) + w[part].astype(np.uint64))
            inside = (j >= pointers.get(i).astype(np.int64)) & (j < pointers.get(i + 1).astype(np.int64))
            q[part[inside]] = self.shares[prob[j[inside]]]
        if self.trie.hot_rest:
            ids = np.array(sorted(self.trie.hot_rest), np.int64)
            at = np.minimum(np.searchsorted(ids, u), len(ids) - 1)
            rest = np.where(ids[at] == u, np.array([self.trie.hot_rest[int(i)] for i in ids])[at], rest)
        return q, rest

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        t = self.trie
        ids, counts, n = self.words.look_up(texts)
        starts = np.cumsum(n) - n
        base = np.log10((counts + 1) / (t.n_tokens + 1 * (t.types + 1)))
        known = counts > 0
        p = np.where(known, (counts - self.d1) / max(t.n_tokens, 1), self.unknown)
        u = contexts(ids, n, ids[-1])
        at = np.flatnonzero(u >= 0)
        symbols = _U(t.types + 1)
        key = u[at].astype(np.uint64) * symbols + np.where(known[at], ids[at], t.types).astype(np.uint64)
        distinct, back = np.unique(key, return_inverse=True)
        q, rest = self.discounted((distinct // symbols).astype(np.int64), (distinct % symbols).astype(np.int64))
        p[at] = q[back] + rest[back] * p[at]
        return n, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, trie: Trie, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score added."""
    import pyarrow as pa

    added_names = ["n_tokens", "n_known", "base_score", "score"]
    own = own_columns(docs, added_names)
    d = docs.select(*(docs[c] for c in own), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias(fresh(own, "_bytes")))
    schema = T.StructType([*d.schema.fields[:-1], *(T.StructField(c, T.LongType() if c[0] == "n" else T.DoubleType()) for c in added_names)])

    def run(batches):
        scorer = Scorer(trie)
        try:
            for batch in batches:
                for a, b, texts in chunks(batch, len(own)):
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *map(pa.array, scorer.scores(texts))], names=schema.names)
        finally:
            del scorer
            release_memory()

    return d.mapInArrow(run, schema)
