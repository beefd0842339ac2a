"""Document quality from a linear-chain CRF that labels every line good or bad.

A line's features are shares of character classes, word statistics and its closeness to
earlier lines, together with those of the lines before and after it. Two states chain over
the lines of a document; forward-backward gives each line's marginal of being good, and the
length-weighted mean of the marginals, calibrated on the training sample, is the score.

Only documents carry labels. The chain is first trained with each line under its document's
label; then lines of bad documents that it takes for good become good (the worst line of a
bad document stays bad), and it is trained again.

The classifier is fitted on a bounded sample of labelled rows (``sample_rows``), whole
documents whatever their length, whose features alone reach the driver. Scoring is one pass
over whole texts without a shuffle; lines of many documents step through forward-backward
together, long ones in segments.

Defined results: a null or empty text has one empty line and is scored like one; repeated
rows score alike; without labels of both kinds every score is the share of good labels (0
if there are none); a null doc_id is never held out; an empty table gives no rows; other
columns pass through, but those named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Isotonic
from .bpe_rank import row_ranges
from .common import fresh, labelled_sample, own_columns, release_memory, remainder

HELD_OUT_MOD, HELD_OUT = 4, 2
SAMPLE_ROWS = 6_000
GOOD_FROM = 0.7
SEGMENT = 128
COMMON = {w.encode() for w in "the of and to a in is that for it was on as with be by der die und den von zu das mit sich des auf ist im nicht ein la le et les de en un du une que est pour qui dans el y los se del las por con su".split()}
KINDS = ("lower", "upper", "digit", "stop", "bang", "pipe", "symbol", "other_ascii", "space", "high")
KIND_OF = np.full(256, 7, np.uint8)
KIND_OF[ord("a") : ord("z") + 1] = 0
KIND_OF[ord("A") : ord("Z") + 1] = 1
KIND_OF[ord("0") : ord("9") + 1] = 2
KIND_OF[list(b".,;:?")] = 3
KIND_OF[ord("!")], KIND_OF[ord("|")] = 4, 5
KIND_OF[list(b"#*$%&<>")] = 6
KIND_OF[list(b" \t\n\r\x0b\x0c")] = 8
KIND_OF[128:] = 9
OWN = len(KINDS) + 8
N_FEATURES = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines in order, their lengths in bytes, and the lines of each text."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    kind = KIND_OF[data]
    x = np.zeros((len(ends), OWN))
    for k in range(len(KINDS)):
        x[:, k] = np.add.reduceat(kind == k, starts, dtype=np.int64)
    x[:, 8] -= 1  # the line's own end
    x[:, : len(KINDS)] /= np.maximum(length, 1)[:, None]
    last = data[np.maximum(ends - 1, 0)]
    words_of, k = x[:, len(KINDS) :], 0
    words_of[:, 0] = np.log1p(length)
    words_of[:, 1] = np.isin(last, list(b".!?:;\"'")) & (length > 0)
    words_of[:, 2] = (kind[starts] == 1) & (length > 0)
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        lines = text.split(b"\n")
        counts[i] = len(lines)
        for line in lines:
            words = line.split()
            if n := len(words):
                distinct = len(set(words))
                words_of[k, 3:] = (np.log1p(n), distinct / n, sum(map(eq, words, words[1:])) / n, sum(map(COMMON.__contains__, words)) / n, line in seen)
                seen.add(line)
            k += 1
    first = np.zeros(len(ends), bool)
    first[np.cumsum(counts) - counts] = True
    final = np.roll(first, -1)
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[final] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(ends), 1))], axis=1), length, counts


@dataclass
class Chain:
    """Weights of the state ``good`` (``bad`` is the zero state), and scores of state changes."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray  # [from, to] over (bad, good)

    def unary(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return forward_backward(self.unary(x), self.change, counts)[0]


def forward_backward(unary: np.ndarray, change: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of ``good`` for every line, and the summed expected changes.

    Chains are cut into segments of at most SEGMENT lines that step together. A segment's
    lines act on what comes in as one 2 x 2 matrix; the products of these carry the messages
    over the cuts, so nothing is lost there and a long chain takes few steps.
    """
    if not len(counts):
        return np.empty(0), np.zeros((2, 2))
    many = -(-counts // SEGMENT)
    chain_first = np.cumsum(many) - many
    place = np.arange(many.sum()) - np.repeat(chain_first, many)  # of each segment in its chain
    start = np.repeat(np.cumsum(counts) - counts, many) + place * SEGMENT
    n = np.minimum(np.repeat(counts, many) - place * SEGMENT, SEGMENT)
    order = np.argsort(-n, kind="stable")
    start, n, initial = start[order], n[order], place[order] == 0
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    steps = int(n[0])
    live = np.searchsorted(-n, -np.arange(steps), side="left")  # segments of more than t lines
    e = np.exp(change - change.max())
    half = np.clip(unary, -30, 30) / 2
    u = np.exp(np.stack([-half, half], axis=1))

    # messages into and out of each segment
    into, out = np.ones((len(n), 2)), np.ones((len(n), 2))
    if many.max() > 1:
        m = np.broadcast_to(np.eye(2), (len(n), 2, 2)).copy()
        for t in range(steps):
            k = live[t]
            step = m[:k] @ e
            if not t:
                step[initial[:k]] = m[:k][initial[:k]]
            step *= u[start[:k] + t][:, None, :]
            m[:k] = step / step.sum(axis=(1, 2), keepdims=True)
        for j in range(1, int(many.max())):
            at = chain_first[many > j] + j
            v = np.einsum("ki,kij->kj", into[where[at - 1]], m[where[at - 1]])
            into[where[at]] = v / v.sum(axis=1, keepdims=True)
        for j in range(int(many.max()) - 1, 0, -1):
            at = chain_first[many > j] + j
            v = np.einsum("kij,kj->ki", m[where[at]], out[where[at]])
            out[where[at - 1]] = v / v.sum(axis=1, keepdims=True)

    forward, before = np.empty_like(u), np.empty_like(u)  # before: what comes into each line
    for t in range(steps):
        k = live[t]
        at = start[:k] + t
        before[at] = forward[at - 1] if t else into
        a = before[at] @ e
        if not t:
            a[initial[:k]] = 1.0
        a *= u[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    good, expected = np.empty(len(unary)), np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = start[:k] + t
        b = out[:k]
        p = forward[at] * b
        good[at] = p[:, 1] / p.sum(axis=1)
        v = u[at] * b
        pair = before[at][:, :, None] * e[None] * v[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        if not t:
            pair[initial[:k]] = 0
        expected += pair.sum(axis=0)
        b = v @ e.T
        out[:k] = b / b.sum(axis=1, keepdims=True)
    return good, expected


def fit_chain(x: np.ndarray, y: np.ndarray, counts: np.ndarray, steps: int = 120, l2: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam over all lines; ``counts`` cuts them into sequences."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale = 0.0, np.where(scale > 1e-6, scale, 1.0)
    z = (x - mean) / scale
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, expected = forward_backward(z @ theta[:-4], theta[-4:].reshape(2, 2), counts)
        g = np.concatenate([(y - good) @ z, (seen - expected).ravel()]) / len(y) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Chain(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def weighted_quality(good: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of each document's marginals."""
    starts = np.cumsum(counts) - counts
    w = length + 1.0
    q = np.add.reduceat(good * w, starts) / np.add.reduceat(w, starts) if len(starts) else np.empty(0)
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def fit_twice(x: np.ndarray, y_doc: np.ndarray, counts: np.ndarray) -> Chain:
    y = np.repeat(y_doc, counts)
    chain = fit_chain(x, y, counts)
    good = chain.marginals(x, counts)
    relabelled = np.where(y > 0, 1.0, good > 0.5)
    starts = np.cumsum(counts) - counts
    for s, n in zip(starts[y_doc == 0], counts[y_doc == 0], strict=True):
        relabelled[s + int(good[s : s + n].argmin())] = 0
    return fit_chain(x, relabelled, counts)


@dataclass
class QualityModel:
    chain: Chain | None
    calibration: Isotonic | None
    share: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.chain is None:
            return np.full(len(texts), self.share)
        x, length, counts = line_features(texts)
        return self.calibration(weighted_quality(self.chain.marginals(x, counts), length, counts))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 2) -> QualityModel:
    """Fit on rows whose crc32(doc_id) mod 4 is not 2."""
    import pyarrow as pa

    sample = labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT, sample_rows, "quality-sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, length, _ = line_features([text])
                yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([y], pa.int32()), pa.array([x.astype("<f4").tobytes()]), pa.array([length.astype("<i8").tobytes()])], names=["doc_id", "y", "x", "length"])

    rows = sample.select("doc_id", F.col("text").cast("binary").alias("text"), "y").mapInArrow(extract, "doc_id long, y int, x binary, length binary").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(float)
    if len(np.unique(y)) < 2:
        return QualityModel(None, None, float(y.mean()) if len(y) else 0.0)
    lengths = [np.frombuffer(v, "<i8") for v in rows["length"]]
    xs = [np.frombuffer(v, "<f4").reshape(-1, N_FEATURES).astype(float) for v in rows["x"]]
    odds = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    join = lambda pick: (np.concatenate([xs[i] for i in pick]), np.concatenate([lengths[i] for i in pick]), np.array([len(lengths[i]) for i in pick]))
    for f in range(folds):
        use, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        x, _, counts = join(use)
        part, length, part_counts = join(rest)
        odds[rest] = weighted_quality(fit_twice(x, y[use], counts).marginals(part, part_counts), length, part_counts)
    x, _, counts = join(range(len(y)))
    return QualityModel(fit_twice(x, y, counts), Isotonic.fit(odds, y), float(y.mean()))


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (a probability) and ``predicted`` added."""
    import pyarrow as pa
    import pyarrow.compute as pc

    own = own_columns(docs, ("score", "predicted"))
    d = docs.select(*(docs[c] for c in own), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias(fresh(own, "_bytes")))
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                texts = batch.column(len(own))
                for a, b in row_ranges(pc.binary_length(texts).to_pylist()):
                    s = model.scores(texts.slice(a, b - a).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(s), pa.array((s >= GOOD_FROM).astype(np.int32))], names=schema.names)
        finally:
            release_memory()

    return d.mapInArrow(run, schema)
