"""BPE encoding and decoding with a contiguous rank array.

The vocabulary file names a normaliser (NFC, white space, lower case), a pattern that cuts
words, a byte alphabet and ranked merges with an end-of-word mark. A short word is held as
one row of contiguous arrays: the ids of its parts (whose order is that of the part
boundaries) and the ranks of the merges of neighbours. Over and over the least rank of
each row is found, that boundary deleted and the two neighbouring ranks refreshed; the
rows of all new words of a chunk of documents go through this together. Words of more
than LONG bytes take a linked list with a heap, which makes the same merges in
logarithmic time each.

Distinct words are encoded once: a memo of the task, which at MEMO entries shrinks to the
words in use, maps the bytes of a white-space-free run to its ids and goes when the task
ends. White space never joins what it separates, so texts are cut there first; the special
tokens hold none.

There is no shuffle: rows stay where they are read, and a long document costs its own
bytes only. Defined results: a null text counts as empty, an empty text has no ids and
decodes to an empty string; special tokens written out in a text become their ids, as the
tokenizers library has it by default; repeated rows are encoded alike; an empty table gives
no rows. :func:`encode` carries other columns along untouched, but replaces those named
n_tokens, ids or decoded.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, own_columns, release_memory, shrunk

SHORT, LONG = (8, 12, 16, 24, 40), 40
WIDTH = [next(w for w in SHORT if n <= w) for n in range(LONG + 1)]
#: White space as the pattern means it.
BLANK = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MEMO = 250_000
CHUNK = 4 << 20
NONE = np.int32(2**31 - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte, by the byte-level BPE convention."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    known = set(plain)
    return [chr(b) if b in known else chr(next(rest)) for b in range(256)]


class RankBpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern.replace(r"^\s", f"^{BLANK}"))
        self.cut_ascii = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9").encode())
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t.encode()
        self.path, self.library = path, None
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.first = np.array([self.vocab[c] for c in alphabet], np.int32)
        self.last = np.array([self.vocab[c + end] for c in alphabet], np.int32)
        pairs = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]], np.int64)
        self.fill_table(pairs)
        self.by_rank = np.append(pairs[:, 2].astype(np.int32), np.int32(-1))
        self.ranks = {(int(a), int(b)): k for k, (a, b, _) in enumerate(pairs)}
        self.memo: dict[bytes, bytes] = {}

    def fill_table(self, pairs: np.ndarray) -> None:
        """An open-addressing table of rank by pair, and a dense one for pairs of bytes."""
        keys = (pairs[:, 0] << 32 | pairs[:, 1]).tolist()
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys, self.home(np.array(keys, np.int64)).tolist(), strict=True)):
            while self.slots[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slots[at], self.slot_rank[at] = key, rank
        inner = self.rank_of(np.repeat(self.first, 256), np.tile(self.first, 256))
        final = self.rank_of(np.repeat(self.first, 256), np.tile(self.last, 256))
        self.byte_rank = np.stack([inner.reshape(256, 256), final.reshape(256, 256)])

    def home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of these pairs, NONE where there is none or where a part is missing (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = self.home(key)
        found = self.slots[at]
        out = np.where(found == key, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):  # the next slots, for the few that met another pair
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of 1 to ``width`` bytes, all rows of one contiguous array at once."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        column = np.arange(width)
        parts = np.where(column < length[:, None] - 1, self.first[flat], np.where(column == length[:, None] - 1, self.last[flat], np.int32(-1)))
        parts = np.concatenate([parts, np.full((n, 1), -1, np.int32)], axis=1)
        ranks = np.full((n, width), NONE, np.int32)
        final = (column[: width - 1] == length[:, None] - 2).astype(np.int64)
        ranks[:, :-1] = np.where(column[: width - 1] < length[:, None] - 1, self.byte_rank[final, flat[:, :-1], flat[:, 1:]], NONE)
        live = np.arange(n)
        done = parts.copy()
        while len(live):
            least = ranks.argmin(axis=1)
            row = np.arange(len(live))
            rank = ranks[row, least]
            open_ = rank != NONE
            if not open_.all():
                done[live[~open_]] = parts[~open_]
                live, parts, ranks, least, rank = live[open_], parts[open_], ranks[open_], least[open_], rank[open_]
                row = np.arange(len(live))
                if not len(live):
                    break
            parts[row, least] = self.by_rank[rank]
            gone = column[None, :] > least[:, None]  # delete the boundary after the merged part
            parts[:, :-1] = np.where(gone, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(gone[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ranks[row, least] = self.rank_of(parts[row, least], parts[row, least + 1])
            before = np.maximum(least - 1, 0)
            ranks[row, before] = np.where(least > 0, self.rank_of(parts[row, before], parts[row, least]), ranks[row, before])
        count = (done >= 0).sum(axis=1)
        flat, end = done[done >= 0].astype("<u4").tobytes(), (np.cumsum(count) * 4).tolist()
        return [flat[i:j] for i, j in zip([0, *end], end)]

    def merge_long(self, word: bytes) -> list[int]:
        ids = [int(self.first[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.by_rank[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def pieces(self, run: bytes) -> list[bytes | int]:
        """What the pattern cuts from a run, as bytes of words and ids of special tokens."""
        if run.isalpha():  # letters of ASCII only
            return [run.lower()]
        if run.isascii() and b"<|" not in run:
            return self.cut_ascii.findall(run.lower())
        found: list[bytes | int] = []
        for k, part in enumerate(self.cut_special.split(run.decode())):
            if k % 2:
                found.append(self.special[part])
                continue
            if any(unicodedata.category(c) == "Cn" for c in part):
                found += self.pieces_of_new(part)
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()  # letter by letter, without final sigma
            found += [w.encode() for w in self.cut.findall(part)]
        return found

    def pieces_of_new(self, part: str) -> list[bytes]:
        """The same cut for code points newer than Python's tables: the library's tables decide."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in cut]

    def learn(self, runs: Iterable[bytes]) -> None:
        """Put the ids of these runs (no white space of ASCII inside) in the memo."""
        cut = [(run, self.pieces(run)) for run in runs]
        made: dict[bytes | int, bytes] = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        rows: dict[int, list[bytes]] = {w: [] for w in SHORT}
        for w in {w for _, pieces in cut for w in pieces if isinstance(w, bytes)}:
            if len(w) > LONG:
                made[w] = np.array(self.merge_long(w), "<u4").tobytes()
            else:
                rows[WIDTH[len(w)]].append(w)
        for width, words in rows.items():
            for k in range(0, len(words), 20_000):
                made.update(zip(words[k : k + 20_000], self.merge_short(words[k : k + 20_000], width), strict=True))
        self.memo.update((run, made[pieces[0]] if len(pieces) == 1 else b"".join(map(made.__getitem__, pieces))) for run, pieces in cut)

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [t.split() for t in texts]  # bytes.split() cuts at ASCII white space only
        words = set().union(*cut)
        self.memo = shrunk(self.memo, words, MEMO)
        if new := words.difference(self.memo):
            self.learn(new)
        return [b"".join(map(self.memo.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        """The tokens joined by blanks: the vocabulary names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, RankBpe] = {}


def loaded(path: str) -> RankBpe:
    if path not in _loaded:
        _loaded[path] = RankBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit).

    ``decoded`` adds the decoding of those ids as a string column of that name.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    path = path or default_path()
    keep = own_columns(docs, (text, "n_tokens", "ids", "decoded"))
    src = docs.select(*(docs[c] for c in keep), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias(fresh(keep, "_text")))
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        try:
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                for a, b in row_ranges(pc.binary_length(column).to_pylist()):
                    texts = column.slice(a, b - a).to_pylist()
                    ids = bpe.encode_batch(texts)
                    out = [c.slice(a, b - a) for c in batch.columns[:-1]]
                    out += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                    if decoded:
                        out.append(pa.array([bpe.decode(i) for i in ids], pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], *(f.name for f in made)])
        finally:
            bpe.memo = {}
            release_memory()

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], *made]))


def row_ranges(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of the binary column ``ids`` (null ids: null)."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text_of(column):
        bpe = loaded(path)
        return column.map(lambda v: bpe.decode(bytes(v)).decode(), na_action="ignore")

    return rows.withColumn("decoded", text_of(F.col(ids)))
