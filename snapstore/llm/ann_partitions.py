"""Nearest neighbours by inner product over learned partitions.

1. A bounded sample of vectors (``sample``, chosen by a hash of the vector) is joined to its
   neighbours into a graph, which is cut into equally large parts with few cut edges:
   median splits along random directions, then moves that gain edges and keep balance.
2. A small classifier (one hidden layer) learns the parts of a vector's neighbourhood.
3. Every vector is filed under its most probable part; a query looks in its several most
   probable parts, as many as the sample needs for the target recall and at least as many
   as hold enough vectors. What it meets there is scored exactly.

Equal vectors are filed once, with their least ids: of equal vectors only the least
``k + 1`` ids can ever be among a query's nearest, so none is lost, and a vector that a
third of the rows share costs no more than others. Parts are cut into blocks of bounded
size, of vectors and of queries; each pair of blocks is one task's work, and its best rows
are merged per query. The model and the counts of parts are all that is sent to the tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those of another length than most (the longest, if several lengths
are as frequent); repeated rows (one id, one vector) are one row; the rows of a query's
own id are never its neighbours; other columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 6_000
PARTS = 16
BASE_BLOCK, QUERY_BLOCK = 65_536, 4_096


def valid(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, k1, k2): usable vectors as doubles, with a 128-bit key of the vector."""
    d = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    d = d.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)")
    sizes = d.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    d = d.where(F.size("v") == (sizes["n"] if sizes else 0))
    return d.select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v")).select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2"))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest by inner product of each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, passes: int = 12) -> np.ndarray:
    """A part for each row: equally large (within 10 %), few edges between parts."""
    part = np.zeros(len(x), np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                c = x[at] - x[at].mean(axis=0)
                direction = rng.normal(size=x.shape[1])
                for _ in range(8):  # towards the main axis
                    direction = c.T @ (c @ direction)
                    direction /= np.linalg.norm(direction) + 1e-30
                part[at[np.argsort(c @ direction, kind="stable")[len(at) // 2 :]]] = p + size
        size *= 2
    most = int(np.ceil(1.1 * len(x) / parts))
    ends = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], axis=1)
    for _ in range(passes):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (ends[0], part[ends[1]]), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        count, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if count[want[i]] < most:
                count[part[i]] -= 1
                count[want[i]] += 1
                part[i], moved = want[i], moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A softmax over parts with one hidden layer, for vectors scaled to unit length."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40, rate: float = 0.005) -> Router:
    """Adam on the cross-entropy to ``target`` (rows sum to 1)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(size=(d, hidden)) * np.sqrt(2 / d) * 2, np.zeros(hidden), rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            b = order[a : a + 256]
            h = np.maximum(x[b] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - target[b]) / len(b)
            dh = dz @ p[2].T * (h > 0)
            step += 1
            for k, g in enumerate((x[b].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def train(x: np.ndarray, parts: int, recall: float, k: int = 20, seed: int = 5) -> Router:
    """Partition the sample, fit the router and find how many parts a query must probe."""
    rng = np.random.default_rng(seed)
    if parts == 1 or len(x) < 4 * parts:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = min(10, len(x) - 1)
    graph = neighbour_graph(x, near)
    part = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near), part[graph].ravel()), 1.0)
    target[np.arange(len(x)), part] += near / 2
    router = fit_router(x, target / target.sum(axis=1, keepdims=True), rng)
    # in which of a query's parts, by probability, its true neighbours in the sample are filed
    tests = rng.permutation(len(x))[:1000]
    logits = router.logits(x)
    filed = logits.argmax(axis=1)
    s = x[tests] @ x.T
    s[np.arange(len(tests)), tests] = -np.inf
    true = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-logits[tests], axis=1)
    place = np.argsort(order, axis=1)
    met = place[np.arange(len(tests))[:, None], filed[true]]
    shares = np.array([(met < n).mean() for n in range(1, parts + 1)])
    router.probes = int(min(parts, np.searchsorted(shares, recall) + 1))
    return router


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = 0.95, sample: int = SAMPLE, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of ``queries`` (column vec_id) its k nearest found.

    ``parts``: how many partitions, a power of two; more suit vectors that lie in clusters.
    """
    import pandas as pd
    import pyarrow as pa

    usable = valid(rows, vec_id, vector)
    least = Window.partitionBy("k1", "k2").orderBy("vec_id")
    filed = usable.withColumn("_r", F.dense_rank().over(least)).where(F.col("_r") <= k + 1).groupBy("k1", "k2").agg(F.min("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    filed = materialise(filed, "vectors")
    asked = materialise(usable.join(queries.select(F.col(vec_id).cast("long").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct(), "queries")

    n = filed.count()
    kept = filed.where(F.pmod(F.xxhash64("k1", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))).select("k1", "k2", "v").toPandas().sort_values(["k1", "k2"])
    x = np.array(kept["v"].tolist()) if len(kept) else np.ones((1, 1))
    router = train(x, parts, recall, k)
    parts = len(router.b2)

    @F.pandas_udf("int")
    def part_of(v):
        return pd.Series(router.logits(np.array(v.tolist())).argmax(axis=1).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    filed = materialise(filed.withColumn("part", part_of("v")), "filed-vectors")
    counts = np.zeros(parts, np.int64)
    for r in filed.groupBy("part").agg(F.count("*").alias("n")).collect():  # one row a part
        counts[r["part"]] = r["n"]

    @F.pandas_udf("array<int>")
    def probes_of(v):
        order = np.argsort(-router.logits(np.array(v.tolist())), axis=1)
        enough = np.cumsum(counts[order], axis=1) > k
        many = np.maximum(router.probes, np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, parts))
        return pd.Series([o[:m].astype(np.int32).tolist() for o, m in zip(order, many, strict=True)])

    wanted = filed.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "v", F.explode(probes_of("v")).alias("part"))
    wanted = materialise(wanted, "probes")
    q_counts = {r["part"]: r["n"] for r in wanted.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = F.lit([int(max(1, -(-c // BASE_BLOCK))) for c in counts])
    q_blocks = F.lit([int(max(1, -(-q_counts.get(p, 0) // QUERY_BLOCK))) for p in range(parts)])
    every = lambda of: F.explode(F.sequence(F.lit(0), F.get(of, "part") - 1))
    own = lambda of: F.pmod(F.xxhash64("k1", "k2"), F.get(of, "part")).cast("int")
    base = filed.select("part", own(blocks).alias("b"), every(q_blocks).alias("q"), "v", "ids")
    ask = wanted.select("part", own(q_blocks).alias("q"), every(blocks).alias("b"), "k1", "k2", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["k1", "k2", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in names})
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        a, x = matrix(left), matrix(right)
        ids = left.column("ids").combine_chunks()
        begin, many, flat = ids.offsets.to_numpy(), ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
        begin = begin[:-1] - begin[0]
        out = []
        for c in range(0, len(x), 256):
            s = x[c : c + 256] @ a.T
            bar = np.partition(s, max(0, len(a) - k - 1), axis=1)[:, max(0, len(a) - k - 1)]
            slack = 1e-9 * np.linalg.norm(x[c : c + 256], axis=1) * np.linalg.norm(a, axis=1).max()
            row, col = np.nonzero(s >= (bar - slack)[:, None])
            score = np.zeros(len(row))
            for d in range(a.shape[1]):  # in order, as a plain sum goes
                score += x[c + row, d] * a[col, d]
            each = many[col]
            row, score, start = np.repeat(row, each), np.repeat(score, each), np.repeat(begin[col], each)
            vec = flat[start + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)]
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            place = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))
            top = place <= k
            out.append((c + row[top], vec[top], score[top]))
        row, vec, score = (np.concatenate([o[j] for o in out]) for j in range(3))
        return pa.table({"k1": right.column("k1").take(pa.array(row)), "k2": right.column("k2").take(pa.array(row)), "vec_id": pa.array(vec), "score": pa.array(score)})

    keys = ["part", "b", "q"]
    met = base.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(meet, "k1 long, k2 long, vec_id long, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    merged = met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    lists = merged.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("found"))
    answers = asked.join(lists, ["k1", "k2"]).select("query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "f"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
