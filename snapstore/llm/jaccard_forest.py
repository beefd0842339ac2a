"""Near-duplicate join on word shingles by a MinHash LSH forest with exact verification.

Texts with the same words are first folded into one (``copies``). Each distinct text gets
MinHash values for ``trees`` tries of ``deepest`` values. A trie is its sorted labels: rows
(tree, label, text) are range-partitioned and sorted, so one common label spreads over as
many partitions as it fills. Texts match at the depth of their common prefix.

Prefixes start at full depth and are shortened value by value until a pair at the
similarity threshold is matched in some tree with the target recall (``min_depth``). At
each depth a text is paired with the least text of its run in every tree and verified
against the one it meets most often; a shorter prefix is taken up only by texts that meet
another class there. Then all pairs with least texts that are still in different classes
are verified, and, in runs that still hold several classes, each text with the member that
has most links so far. What is then outside the largest class of a run meets all members of
runs with that class, in pairs of blocks of bounded size that give out links only. So no
two texts that meet in a run at the shortest depth stay apart unless they were compared.

Verification is exact, on whole sets of 64-bit shingle hashes; it streams the partners of a
text past it, in blocks of bounded total size, however many partners it has.

Classes are the connected components of the links, found by minimum labels with pointer
jumping over written tables; nothing that grows with the documents goes to the driver.
Two texts that are linked are in one class, so links are counted there: all texts of a class
meet in pairs of blocks of bounded total size, and each block pair gives out one sum a text.

Defined results: words are split at white space; a text of fewer than five words has one
shingle, all of them; texts without words, null ones among them, are copies of each other;
a row without doc_id takes no part and has a null class; repeated rows are copies; rows of
one id with different texts each have their own text's class; other columns stay out,
whatever their names; an empty table gives no rows; ties among pairs only decide which is
verified first. ``n_links`` counts other rows: the copies of the text, and those of each
other text of its class at the threshold or above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_rank import row_ranges
from .common import fresh, materialise, shuffle_parts, temporary, text_columns

SHINGLE = 5
BLOCK_SHINGLES = 500_000
MEET_SHINGLES, MEET_ROWS = 50_000, 250
TREE_ROWS = 400_000
HUB_ROUNDS = 2
PAIR, HEAD, TAIL, MEMBER = range(4)


def min_depth(threshold: float, trees: int, recall: float, deepest: int) -> int:
    """The deepest prefix at which a pair at the threshold meets in some tree with this recall."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingles(text: bytes) -> tuple[np.ndarray, bytes]:
    """Sorted distinct 64-bit hashes of the word shingles, and the words joined by blanks."""
    from xxhash import xxh3_64_intdigest

    words = text.split()
    whole = b" ".join(words)
    if not words:
        return np.empty(0, np.uint64), whole
    if len(words) <= SHINGLE:
        return np.array([xxh3_64_intdigest(whole)], np.uint64), whole
    # a shingle is five word hashes mixed in order
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s = (s ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(s), whole


def signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function over the set."""
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 2048):
        block = (s[k : k + 2048, None] * factors[None, :]) >> np.uint64(32)
        np.minimum(out, block.min(axis=0).astype(np.uint32), out=out)
    return (out & 0xFFFF).astype(">u2")


def signed_texts(docs: DataFrame, values: int) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, sig) of the rows with an id; ``sig`` big-endian, ``values`` of 2 bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    src = text_columns(docs).where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    factors = np.random.default_rng(20).integers(0, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for a, b in row_ranges(pc.binary_length(batch.column(1)).to_pylist()):
                rows = []
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    s, whole = shingles(text)
                    h = np.frombuffer(xxh3_128_digest(whole), np.int64)
                    rows.append((doc_id, int(h[0]), int(h[1]), len(s), signature(s, factors).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "h1", "h2", "n_shingles", "sig"])

    return src.mapInArrow(run, "doc_id long, h1 long, h2 long, n_shingles long, sig binary")


def candidates(texts: DataFrame, trees: int, deepest: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts (a < b) with the least text of their run, and the members of runs.

    Pairs come with the longest prefix they share (``depth``, at least the given one) and how
    often they met; members are (tree, label, tid), the label cut to the given depth.
    """
    import pyarrow as pa

    width = 2 * deepest
    labels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.cast("int").alias("tree"), F.substring("sig", t * width + 1, F.lit(width)).alias("label"))))
    rows = texts.select(labels.alias("x"), "tid").select("x.tree", "x.label", "tid")
    spark = texts.sparkSession
    parts = max(shuffle_parts(spark), -(-texts.count() * trees // TREE_ROWS))
    ordered = rows.repartitionByRange(parts, "tree", "label", "tid").sortWithinPartitions("tree", "label", "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # one partition holds some TREE_ROWS rows of 50 bytes
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        tree = np.concatenate([b.column(0).to_numpy() for b in read])
        label = np.frombuffer(b"".join(b"".join(b.column(1).to_pylist()) for b in read), ">u2").reshape(-1, deepest)
        tid = np.concatenate([b.column(2).to_numpy() for b in read])
        same = np.zeros((len(tid), deepest), bool)
        same[1:] = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        pairs, ends = [], None
        for d in range(depth, deepest + 1):
            start = np.flatnonzero(shared < d)
            least = np.repeat(np.minimum.reduceat(tid, start), np.diff([*start, len(tid)]))
            at = np.flatnonzero(least != tid)
            pairs.append(np.stack([least[at], tid[at], np.full(len(at), d)], axis=1))
            if d == depth:
                ends = int(least[0]), int(least[-1])
        found, often = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        run_of = np.cumsum(shared < depth) - 1
        size = np.bincount(run_of)
        size[[0, -1]] = len(tid)  # runs that may go on in another partition
        member = np.flatnonzero(size[run_of] > 1)
        prefix = np.ascontiguousarray(label[:, :depth]).view(f"V{2 * depth}").ravel()
        part = TaskContext.get().partitionId()

        def batch(kind, a, b, tree, label, part, depth):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b), pa.array(part, pa.int32()), pa.array(tree, pa.int32()), pa.array(label, pa.binary()), pa.array(depth, pa.int32())], names=["kind", "a", "b", "part", "tree", "label", "depth"])

        none = [None] * len(found)
        yield batch(PAIR, found[:, 0], found[:, 1], none, none, often.astype(np.int32), found[:, 2])
        yield batch(MEMBER, tid[member], None, tree[member], [x.tobytes() for x in prefix[member]], [part] * len(member), [depth] * len(member))
        yield batch(HEAD, ends[:1], None, tree[:1], [prefix[0].tobytes()], [part - 1], [depth])
        yield batch(TAIL, ends[1:], None, tree[-1:], [prefix[-1].tobytes()], [part], [depth])

    found = materialise(ordered.mapInArrow(run, "kind int, a long, b long, part int, tree int, label binary, depth int"), "candidates")
    # a run that a partition boundary cuts goes on in the next: two rows per partition tell
    heads = found.where(F.col("kind") == HEAD).select("part", "tree", "label", F.col("a").alias("head"))
    tails = found.where(F.col("kind") == TAIL).select("part", "tree", "label", F.col("a").alias("tail"))
    over = heads.join(F.broadcast(tails), ["part", "tree", "label"]).where("head != tail").select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"), F.lit(1).alias("part"), F.lit(depth).alias("depth"))
    pairs = found.where(F.col("kind") == PAIR).select("a", "b", "part", "depth").unionByName(over).groupBy("a", "b").agg(F.sum("part").alias("often"), F.max("depth").alias("depth"))
    return materialise(pairs, "candidate-pairs"), found.where(F.col("kind") == MEMBER).select("tree", "label", F.col("a").alias("tid"))


def shingle_sets(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tid, n_shingles, hashes) of the texts in ``pairs``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    needed = materialise(texts.join(ends, "tid").select("tid", "h1", "h2", "n_shingles", "rep"), "needed-texts")
    src = text_columns(docs).where("text IS NOT NULL").join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for a, b in row_ranges(pc.binary_length(batch.column(1)).to_pylist()):
                made = [shingles(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                h = np.frombuffer(b"".join(xxh3_128_digest(w) for _, w in made), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([s.astype("<u8").tobytes() for s, _ in made], pa.binary())], names=["rep", "h1", "h2", "hashes"])

    sets = src.mapInArrow(run, "rep long, h1 long, h2 long, hashes binary").join(needed, ["rep", "h1", "h2"])
    return materialise(sets.select("tid", "n_shingles", "hashes").dropDuplicates(["tid"]), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs with a Jaccard similarity of at least ``threshold``."""
    import pyarrow as pa

    sizes = sets.select("tid", "n_shingles")
    sized = pairs.join(sizes.withColumnRenamed("tid", "b").withColumnRenamed("n_shingles", "nb"), "b").join(sizes.withColumnRenamed("tid", "a").withColumnRenamed("n_shingles", "na"), "a")
    sized = sized.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))  # no overlap could be enough
    sized = materialise(sized.select("a", "b", "nb"), "sized-pairs")
    blocks = sized.groupBy("a").agg(F.ceil(F.sum("nb") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    firsts = blocks.join(sets.withColumnRenamed("tid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "hashes")
    partners = sized.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
    partners = partners.join(sets.withColumnRenamed("tid", "b"), "b").select("a", "block", "b", "hashes")
    # the text itself sorts before its partners: its b is null
    rows = firsts.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = np.frombuffer(packed, "<u8")
                if b is None:
                    own = s
                    continue
                common = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                if common >= threshold * (len(own) + len(s) - common) - 1e-9:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return materialise(rows.mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(tid, root): the least text of each connected component, for texts with links."""
    both = materialise(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a")), "edges")
    labels = materialise(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")).select(F.col("v").alias("tid"), "root"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("tid", "u"), "u").groupBy(F.col("v").alias("tid")).agg(F.min("root").alias("near"))
        step = labels.join(near, "tid").select("tid", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        step = materialise(step, "labels")
        # pointer jumping: take the label of one's label
        jump = step.select(F.col("tid").alias("next"), F.col("next").alias("to"))
        moved = materialise(step.join(jump, "next", "left").select("tid", F.coalesce(F.least("to", "next"), "next").alias("root"), "was"), "labels")
        labels = moved.select("tid", "root")
        if moved.where("root < was").isEmpty():
            return labels


def in_class(tids: DataFrame, of_class: DataFrame, tid: str, name: str) -> DataFrame:
    """``tids`` with the class of the text in column ``tid``: its own id where it has no links."""
    return tids.join(of_class.select(F.col("tid").alias(tid), F.col("class").alias(name)), tid, "left").withColumn(name, F.coalesce(name, tid))


def apart(pairs: DataFrame, of_class: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes."""
    both = in_class(in_class(pairs, of_class, "a", "ca"), of_class, "b", "cb")
    return materialise(both.where("ca != cb").select(pairs.columns), "pairs-apart")


def best_partners(pairs: DataFrame) -> DataFrame:
    """For each text the pair that met most often in the tries."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("t"), F.struct("often", "b", "a").alias("p"))
    return ends.groupBy("t").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` (tree, label, ..) joined with ``runs`` (tree, label, size, ..; a row a run).

    Runs of more than a partition's share of ``rows`` are fewer than partitions: they are
    broadcast, and their rows stay where they are. All others are joined by run.
    """
    run, parts = ["tree", "label"], shuffle_parts(rows.sparkSession)
    large = F.col("size") * parts > rows.count()
    found = rows.join(F.broadcast(runs.where(large)), run)
    small = rows.join(F.broadcast(runs.where(large).select(*run)), run, "left_anti").join(runs.where(~large), run)
    return found.unionByName(small)


def mixed_runs(members: DataFrame, of_class: DataFrame) -> DataFrame:
    """(tree, label, tid, class, size, main) of runs that hold several classes; ``main``: the largest.

    Runs of two texts are left out: their pair is one with the least text.
    """
    run = ["tree", "label"]
    d = materialise(in_class(members, of_class, "tid", "class"), "run-classes")
    sizes = d.groupBy(*run, "class").agg(F.count("*").alias("n"))
    main = sizes.groupBy(*run).agg(F.max(F.struct("n", F.col("class").alias("main"))).alias("m"), F.count("*").alias("many"), F.sum("n").alias("size")).where("many > 1 AND size > 2").select(*run, "size", "m.main")
    return materialise(with_runs(d, materialise(main, "runs")), "mixed-runs")


def hub_partners(mixed: DataFrame, links: DataFrame) -> DataFrame:
    """Each text outside its run's class of the member with most links so far, paired with the best such hub."""
    run = ["tree", "label"]
    degree = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("n"))
    hubs = mixed.join(degree, "tid").groupBy(*run).agg(F.max(F.struct("n", F.col("tid").alias("hub"), F.col("class").alias("other"))).alias("h"), F.max("size").alias("size"))
    met = with_runs(mixed.drop("size"), materialise(hubs, "hubs")).where("class != h.other").groupBy("tid").agg(F.max("h").alias("h"))
    return met.select(F.least("tid", "h.hub").alias("a"), F.greatest("tid", "h.hub").alias("b")).distinct()


def spark_empty(docs: DataFrame, schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([], schema)


def shared_counts(sets: list[np.ndarray]):
    """A function that gives how many hashes of a set are in each of ``sets``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]

    def count(s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(every, s, side="left"), np.searchsorted(every, s, side="right")
        many = hi - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(owner[at], minlength=len(sets))

    return count


def stragglers(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of texts outside their run's largest class, with members of other classes.

    Outsiders and members of the runs of a largest class meet in pairs of blocks of bounded
    size; a block pair counts common shingles through one sorted list and gives out links only.
    """
    import pyarrow as pa

    mixed = materialise(mixed.select("main", "tid", "class").distinct().join(sets, "tid"), "mixed-texts")
    outside = F.col("class") != F.col("main")
    block = lambda cond: F.greatest(F.lit(1), F.ceil(F.sum(F.when(cond, F.col("n_shingles")).otherwise(0)) / MEET_SHINGLES), F.ceil(F.count_if(cond) / MEET_ROWS)).cast("int")
    blocks = mixed.groupBy("main").agg(block(F.lit(True)).alias("nm"), block(outside).alias("no"))
    placed = mixed.join(blocks, "main")
    own = lambda n: F.pmod(F.xxhash64("tid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where(outside).select("main", own("no").alias("o"), every("nm").alias("m"), "tid", "class", "hashes")
    right = placed.select(F.col("main").alias("main2"), own("nm").alias("m2"), every("no").alias("o2"), F.col("tid").alias("tid2"), F.col("class").alias("class2"), F.col("hashes").alias("hashes2"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            sets_of = [np.frombuffer(h, "<u8") for h in right.column("hashes2").to_pylist()]
            size = np.array([len(s) for s in sets_of])
            shared = shared_counts(sets_of)
            tid, cls = right.column("tid2").to_numpy(), right.column("class2").to_numpy()
            for t, c, packed in zip(left.column("tid").to_pylist(), left.column("class").to_pylist(), left.column("hashes").to_pylist(), strict=True):
                s = np.frombuffer(packed, "<u8")
                common = shared(s)
                hit = np.flatnonzero((common >= threshold * (len(s) + size - common) - 1e-9) & (cls != c))
                found += [(min(t, x), max(t, x)) for x in tid[hit].tolist()]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    met = left.groupBy("main", "o", "m").cogroup(right.groupBy("main2", "o2", "m2"))
    return materialise(met.applyInArrow(meet, "a long, b long").distinct(), "links")


def degrees(texts: DataFrame, of_class: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(tid, others): the rows of the other texts of its class that each text is linked to.

    Every two texts of a class are compared, once, in the pair of their blocks.
    """
    import pyarrow as pa

    members = materialise(of_class.join(sets, "tid").join(texts.select("tid", "copies"), "tid"), "class-members")
    blocks = members.groupBy("class").agg(F.greatest(F.ceil(F.sum("n_shingles") / MEET_SHINGLES), F.ceil(F.count("*") / MEET_ROWS)).cast("int").alias("n"))
    placed = members.join(blocks, "class").withColumn("own", F.pmod(F.xxhash64("tid"), "n").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    placed = placed.select("class", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own", "tid", "copies", "hashes")

    def meet(rows: pa.Table) -> pa.Table:
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        own, tid, copies = (rows.column(c).to_numpy() for c in ("own", "tid", "copies"))
        sets_of = [np.frombuffer(h, "<u8") for h in rows.column("hashes").to_pylist()]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        others = np.zeros(len(tid), np.int64)
        if len(left) and len(right):
            size = np.array([len(sets_of[k]) for k in right])
            shared = shared_counts([sets_of[k] for k in right])
            for k in left.tolist():
                common = shared(sets_of[k])
                hit = right[common >= threshold * (len(sets_of[k]) + size - common) - 1e-9]
                hit = hit[hit != k]
                others[k] += copies[hit].sum()
                if lo != hi:
                    others[hit] += copies[k]
        return pa.table({"tid": pa.array(tid), "others": pa.array(others)})

    met = placed.groupBy("class", "lo", "hi").applyInArrow(meet, "tid long, others long")
    return materialise(met.groupBy("tid").agg(F.sum("others").alias("others")), "degrees")


def merge(of_class: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after these links, as (tid, class) of texts that are in a class with others."""
    ends = in_class(in_class(links, of_class, "a", "ca"), of_class, "b", "cb")
    tops = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).select(F.col("tid").alias("class"), F.col("root").alias("top"))
    moved = of_class.join(tops, "class", "left").select("tid", F.coalesce("top", "class").alias("class"))
    new = tops.join(of_class.select(F.col("tid").alias("class")), "class", "left_anti").select(F.col("class").alias("tid"), F.col("top").alias("class"))
    return materialise(moved.unionByName(new), "classes")


def classes(docs: DataFrame, threshold: float = 0.8, trees: int = 25, deepest: int = 7, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, n_links) of every row; ``class_id`` is the least doc_id of the class."""
    depth = min_depth(threshold, trees, recall, deepest)
    with temporary(docs.sparkSession):
        signed = materialise(signed_texts(docs, trees * deepest), "signed", keep=True)
        texts = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))  # alike in all copies
        texts = materialise(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

        todo, members = candidates(texts, trees, deepest, depth)
        sets = shingle_sets(docs, texts, todo)
        of_class, links = spark_empty(docs, "tid long, class long"), spark_empty(docs, "a long, b long")
        tried = links
        for d in range(deepest, depth - 1, -1):
            picked = materialise(best_partners(todo.where(F.col("depth") >= d)), "picked-pairs")
            found = verified(picked, sets, threshold)
            tried, links, of_class = tried.unionByName(picked), links.unionByName(found), merge(of_class, found)
            todo = apart(todo.join(picked, ["a", "b"], "left_anti"), of_class)
        todo = todo.select("a", "b")
        found = verified(todo, sets, threshold)
        tried, links, of_class = tried.unionByName(todo), links.unionByName(found), merge(of_class, found)
        mixed = mixed_runs(members, of_class)
        for _ in range(HUB_ROUNDS):
            if mixed.isEmpty():
                break
            picked = materialise(hub_partners(mixed, links).join(tried, ["a", "b"], "left_anti"), "picked-pairs")
            found = verified(picked, sets, threshold)
            tried, links, of_class = tried.unionByName(picked), links.unionByName(found), merge(of_class, found)
            mixed = mixed_runs(mixed.select("tree", "label", "tid"), of_class)
        if not mixed.isEmpty():
            of_class = merge(of_class, stragglers(mixed, sets, threshold))

        degree = degrees(texts, of_class, sets, threshold)
        found = texts.join(of_class, "tid", "left").join(degree, "tid", "left").select("tid", "h1", "h2", "rep", "copies", F.coalesce("class", "tid").alias("class"), F.coalesce("others", F.lit(0)).alias("others"))
        found = materialise(found, "text-classes")
        ids = found.groupBy("class").agg(F.min("rep").alias("class_id"))
        found = materialise(found.join(ids, "class").select("h1", "h2", "class_id", (F.col("others") + F.col("copies") - 1).alias("n_links")), "found", keep=True)
    rows = signed.select("doc_id", "h1", "h2").join(found, ["h1", "h2"]).select("doc_id", "class_id", "n_links")
    nameless = text_columns(docs).where("doc_id IS NULL")
    return rows.unionByName(nameless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id, and of its rows the least text.

    Rows without doc_id stay; all columns pass through, whatever their names.
    """
    found = classes(docs, **options).where("class_id = doc_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").select(docs.columns)
    first, n = Window.partitionBy("doc_id").orderBy("text"), fresh(docs.columns, "_n")
    return kept.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n).unionByName(docs.where("doc_id IS NULL"))
