"""Shards of nearly equal bytes by sampled splitters (native: DataFrame expressions only).

Records are keyed by the hash of their text, then doc_id, then their place in the written
table, so that equal texts lie next to each other and yet no key repeats: a group of copies
that is larger than a range is cut like any other keys.

1. Keys are sampled with probabilities that follow the record's size (plus the mean size, so
   that swarms of tiny records count too).
2. Quantiles of the sample become range boundaries; a range holds ``range_rows`` records on
   average. The sample is some 32 keys per range and all that the driver sees of the keys.
3. Ranges that come out overfull (over twice their share) are sampled again, ever more
   densely, and subdivided, until none is left; a range of one record is never overfull.
4. Records are range-partitioned: each goes to the partition of its range's number. There
   each range is sorted and summed by itself; with the totals of the ranges before, each
   record gets its place in the whole order, in bytes and in rows. The shard is the
   place of the record's middle byte, so shards differ by less than one record.

Groups of equal texts lie together; one that a shard's end falls into is cut there, also if
it is smaller than a shard, as sizes go before groups under this law.

Defined results: a null text has size 1; a null doc_id is a key like any other; repeated
rows are records of their own; further columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_columns

LAW = "bytes"
PER_RANGE = 32
MAX_RANGES = 1 << 14


def _hex(c) -> F.Column:
    return F.lpad(F.hex(c), 16, "0")


def _search(key: F.Column, bounds: list[str]) -> F.Column:
    """How many bounds are <= key: a search over blocks of bounds, then inside one block."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    heads = F.lit([b[0] for b in blocks])
    block = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.get(F.array(*(F.lit(b) for b in blocks)), block - 1), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside).cast("int")


def _sample(rows: DataFrame, chance: F.Column) -> list[tuple[str, float]]:
    """Keys drawn by a hash of the row, with weights for quantiles: what each key stands for."""
    u = F.pmod(F.xxhash64("place", "text_hash", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(u < chance).select("key", (1.0 / F.least(chance, F.lit(1.0)) * F.col("weight")).alias("w")).collect()
    return sorted((r["key"], r["w"]) for r in drawn)


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    total, seen, bounds = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        if seen > 0 and seen >= total * (len(bounds) + 1) / parts and len(bounds) < parts - 1:
            bounds.append(key)
        seen += w
    return bounds


def splitters(rows: DataFrame, parts: int, total_weight: float) -> list[str]:
    """Boundaries of some ``parts`` ranges of about equal weight, none over twice its share."""
    share, density = total_weight / parts, PER_RANGE
    bounds = _quantiles(_sample(rows, F.col("weight") * (PER_RANGE / share)), parts)
    while True:
        sums = rows.groupBy(_search(F.col("key"), bounds).alias("r")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
        over = {x["r"]: x["w"] for x in sums if x["w"] > 2 * share and x["n"] > 1}
        if not over:
            return bounds
        density *= 2  # in the end every key of an overfull range is drawn
        of = _search(F.col("key"), bounds)
        inside = _sample(rows.where(of.isin(list(over))), F.col("weight") * (density / share))
        more: set[str] = set()
        for r, w in over.items():
            low = bounds[r - 1] if r else ""
            high = bounds[r] if r < len(bounds) else "~"
            keys = inside[bisect_left(inside, (low,)) : bisect_left(inside, (high,))]
            found = set(_quantiles(keys, -int(-w // share))) - {low}
            if not found and keys:  # one record outweighs the others: it gets a range of its own
                top = max(range(len(keys)), key=lambda k: keys[k][1])
                found = {k for k, _ in keys[max(1, top) : top + 2]}
            more.update(found)
        bounds = sorted({*bounds, *more})


def shard(docs: DataFrame, n_shards: int = 16, range_rows: int = 20_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``."""
    d = text_columns(docs, text, doc_id)
    binary = F.coalesce("text", F.lit("")).cast("binary")
    d = d.select("doc_id", (F.octet_length(binary) + 1).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"), F.xxhash64(binary).alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    rows = materialise(d, "shard-keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, min(MAX_RANGES, max(4 * n_shards, -(-n // range_rows)), n))
    keyed = rows.withColumns({"key": F.concat(_hex("text_hash"), _hex(F.coalesce("doc_id", F.lit(-1))), _hex("place")), "weight": F.col("size") + F.lit(total / max(n, 1))})
    bounds = splitters(keyed, parts, 2.0 * total) if n else []
    ranged = keyed.withColumn("r", _search(F.col("key"), bounds)).drop("key", "weight")
    sums = {x["r"]: (x["b"], x["c"]) for x in ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect()}
    starts, counts, b0, c0 = [0], [0], 0, 0
    for k in range(len(bounds) + 1):
        starts.append(b0 := b0 + sums.get(k, (0, 0))[0])
        counts.append(c0 := c0 + sums.get(k, (0, 0))[1])
    ranged = ranged.repartitionById(len(bounds) + 1, F.col("r"))  # a partition a range
    signless = lambda c: (c < 0, c)  # noqa: E731  the order of the keys' hexadecimal digits
    inside = Window.partitionBy("r").orderBy(*signless(F.col("text_hash")), *signless(F.coalesce("doc_id", F.lit(-1))), "place")
    big = lambda v: F.lit(v).cast("array<bigint>")
    placed = (
        ranged.withColumns({"before": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "rank": F.row_number().over(inside) - 1})
        .select("doc_id", "size", "text_crc32", (F.get(big(starts), F.col("r")) + F.col("before")).alias("at"), (F.get(big(counts), F.col("r")) + F.col("rank")).alias("rank"))
    )
    middle = F.expr(f"CAST(least({n_shards - 1}, ((2 * at + size) * {n_shards}) div {max(2 * total, 1)}) AS INT)")
    placed = materialise(placed.select("doc_id", "size", "text_crc32", middle.alias("shard"), "rank"), "shards")
    per = {x["shard"]: x["n"] for x in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    first = [sum(per.get(j, 0) for j in range(k)) for k in range(n_shards)]
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.get(big(first), F.col("shard"))).cast("long").alias("slot"))
