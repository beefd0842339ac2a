"""Each operator on small tables with nulls, empties, ties, repeats and extra columns."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapstore.llm import ann_partitions, best_fit, bpe_rank, jaccard_forest, line_crf, line_dedup, lm_trie, quality_rules, sharding, toxicity

PROSE = "The of and to in is was for that with on as by from house garden river morning people walked slowly towards old town while rain fell over hills".split()


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(PROSE, n)) + "."


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, prose(5)), (6, prose(5)), (6, prose(5)), (7, prose(7, 3000)), (8, "%%% *** ### " * 60), (None, prose(9)), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("score", "kept", "N_Lines", "_t", "tid", "ids", "part", "shard", "n_tokens", "_id", "_hash", "_bitmap", "_text_hash", "_n", "_text", "_bytes", "_row", "class_id"):
        d = d.withColumn(c, F.lit("own"))
    return d


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_quality_rules(odd, empty):
    got = collections.defaultdict(list)
    for r in quality_rules.apply_rules(odd).collect():
        got[r["doc_id"]].append(r)
    assert [got[k][0]["base_failed"] for k in (1, 2, 3, 4)] == [True] * 4 and got[5][0]["kept"] and not got[8][0]["kept"]
    assert got[6][0] == got[6][1] and got[1][0]["n_words"] == 0 and got[5][0]["tid"] == "own"
    assert quality_rules.apply_rules(empty).count() == 0


def test_quality_windows(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        w = rng.choice(["a", "b", "c"], int(rng.integers(0, 60))).tolist()
        if k % 2:
            w += w[3:14]
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        w = text.split()
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert got[k] == len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist(), "x") for k, v in enumerate(rng.normal(size=(300, 6)))]
    rows += [(1000 + k, rows[7][1], "copy") for k in range(60)] + [(20, rows[20][1], "repeat")]
    rows += [(2000, None, ""), (2001, [0.0] * 6, ""), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (2003, [float("nan")] * 6, ""), (2004, [1.0, 2.0], ""), (None, [1.0] * 6, "")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in ann_partitions.nearest(d, d.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {k: v for k, v, _ in rows if k is not None and k < 2000}
    assert sorted(got) == sorted(k for k in usable if k % 20 == 0)
    hit = 0
    for q, found in got.items():
        dot = lambda v: sum(a * b for a, b in zip(usable[q], v))  # noqa: E731, B023
        want = sorted(((-dot(v), k) for k, v in usable.items() if k != q))[:5]
        hit += len({k for _, k in want} & {k for k, _ in found})
        assert all(math.isclose(s, dot(usable[k]), rel_tol=1e-12) for k, s in found) and len(found) == 5
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit >= 0.9 * 5 * len(got)
    assert ann_partitions.nearest(d.limit(0), d.limit(0)).count() == 0


def test_pack(odd, empty):
    got = best_fit.pack(odd, 256).collect()
    assert len(got) >= len(ODD) and sum(r["piece"] == 0 for r in got) == len(ODD)
    assert [(r["length"], r["ids_crc32"]) for r in got if r["doc_id"] in (1, 2, 3)] == [(1, zlib.crc32(bytes(4)))] * 3
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 256
    assert best_fit.pack(empty).count() == 0


def test_bpe_encode_decode(odd, empty):
    d = bpe_rank.encode(odd, decoded=True)
    for r in d.collect():
        assert r["n_tokens"] == len(r["ids"]) // 4 and r["score"] == "own"
    again = bpe_rank.decode(d.drop("decoded")).select("doc_id", "decoded").collect()
    assert sorted(again, key=repr) == sorted(d.select("doc_id", "decoded").collect(), key=repr)
    assert bpe_rank.encode(empty).count() == 0


def test_line_dedup(spark, odd, empty):
    shared = "  This LINE is shared  "
    rows = [(k, f"{shared}\nown line number {k}\nshort\n{shared.lower()}") for k in range(40)] + [(50, None), (51, "a\n\nb"), (None, shared), (3, f"{shared}\nown line number 3\nshort\n{shared.lower()}"), (3, f"x\n{shared}")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_dropped", F.lit("own"))
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(d).collect():
        got[r["doc_id"]].append((r["text"], r["n_lines"], r["n_dropped"]))
    assert got[0] == [(rows[0][1], 4, 0)] and got[5] == [("own line number 5\nshort", 4, 2)]
    assert got[50] == [(None, 1, 0)] and got[51] == [("a\n\nb", 3, 0)] and got[None] == [(shared, 1, 0)]
    assert sorted(got[3]) == [("own line number 3\nshort", 4, 2)] * 2 + [("x", 2, 1)]
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(odd).count() == len(ODD)


def labelled(spark):
    rows, labels = [], []
    for k in range(240):
        toxic, good = k % 4 == 0, k % 3 > 0
        text = prose(k, 40) if good else " ".join(f"{w}%%%" for w in prose(k, 40).upper().split())
        rows.append((k, text + ("\nyou are a pathetic moron and a stupid idiot" if toxic else "\nwe walked home")))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "mod", "left", "bar"), [(toxicity, "toxic", 5, 0, 0.5), (line_crf, "quality", 4, 2, 0.7)])
def test_classifiers(spark, odd, empty, module, label, mod, left, bar):
    docs, labels = labelled(spark)
    model = module.train(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % mod == left]
    assert sum(r["predicted"] == r[label] for r in held) >= 0.9 * len(held) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= bar) for r in rows)
    got = module.score(odd, model).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    blank = module.train(docs, labels.limit(0))
    assert {r["score"] for r in module.score(odd, blank).collect()} == {0.0} and module.score(empty, model).count() == 0


def test_jaccard_classes(spark, odd, empty):
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    rows = [(k, " ".join(f"u{k}x{j}" for j in rng.integers(0, 900, 50))) for k in range(30)]
    rows += [(100 + k, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for k in range(0, 60, 2)] + [(300, rows[0][1]), (301, " ".join(base)), (302, "tiny"), (303, " tiny ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_forest.classes(d).collect()}
    sets = {k: ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}) for k, t in rows}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {k: v[0] for k, v in got.items()} == {k: find(k) for k in sets}
    assert got[0] == (0, 1) and got[302] == (302, 1) and got[1] == (1, 0) and got[100][1] >= 1
    odd_rows = [tuple(r) for r in jaccard_forest.classes(odd).collect()]
    assert len(odd_rows) == len(ODD) and (5, 5, 2) in odd_rows and (3, 1, 2) in odd_rows and (None, None, 0) in odd_rows
    assert jaccard_forest.classes(empty).count() == 0
    kept = jaccard_forest.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 7, 8]
    assert sorted(r[0] for r in jaccard_forest.keep_one(d).select("doc_id").collect()) == sorted(k for k in sets if find(k) == k)


def test_jaccard_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "MEET_SHINGLES", 2500)  # several blocks for the large class
    base, other = [f"w{k}" for k in range(200)], [f"v{k}" for k in range(200)]
    rows = [(k, " ".join([*base[: 2 * k], f"edit{k}", *base[2 * k + 1 :]])) for k in range(90)]
    rows += [(200 + k, rows[5 * k][1]) for k in range(9)] + [(300 + k, " ".join([*other[: 50 * k], "x", *other[50 * k + 1 :]])) for k in range(3)]
    rows += [(400 + k, " ".join([*base[24 * k :], *(f"t{j}" for j in range(24 * k))])) for k in range(6)]  # a chain: one class, not all linked
    got = {r["doc_id"]: r["n_links"] for r in jaccard_forest.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    assert got == {a: sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets) for a in sets}


def test_shards(spark, odd, empty):
    d = spark.createDataFrame([(None, None), (1, ""), (1, "a")] + [(7, "x")] * 3000 + [(9, "y" * 3000)], "doc_id long, text string")
    rows = sharding.shard(d, 4, range_rows=10).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert len(rows) == 3004 and sum(r["size"] for r in rows) == 1 + 1 + 2 + 6000 + 3001
    for found in by.values():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
    sizes = [sum(r["size"] for r in by[k]) for k in range(4)]
    assert max(sizes) - min(sizes) <= 2 * 3001
    assert sharding.shard(empty).count() == 0 and sharding.shard(odd).count() == len(ODD)


def test_language_model(spark, odd, empty):
    rows = [(k, prose(k, 80)) for k in range(30)] + [(90, None), (91, ""), (92, "Unseen wörds only")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    trie = lm_trie.build(d.where("doc_id < 80"), min_count=2)
    c, pairs = collections.Counter(), collections.Counter()
    words = {k: [*(t or "").lower().split(), ""] for k, t in rows}
    for k in range(30):
        c.update(words[k])
        pairs.update(zip(["", *words[k][:-1]], words[k]))
    n, v = sum(c.values()), len(c)
    d1 = min(0.9, sum(x == 1 for x in c.values()) / v) or 0.5
    mass = collections.Counter()
    for (u, _), k in pairs.items():
        mass[u] += k - 0.75 if k > 1 else 0
    for r in lm_trie.score(d, trie).collect():
        w = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(x in c for x in w))
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-12)
        want = 0.0
        for u, x in zip(["", *w[:-1]], w):
            p = (c[x] - d1) / n if c[x] else d1 * v / n
            if c[u]:
                k = pairs[u, x]
                p = (k - 0.75 if k > 1 else 0) / c[u] + (1 - mass[u] / c[u]) * p
            want += math.log10(p)
        assert abs(r["score"] - want) < 0.04 * len(w)
    assert lm_trie.score(odd, trie).count() == len(ODD) and lm_trie.score(empty, trie).count() == 0
    assert lm_trie.score(odd, lm_trie.build(empty)).count() == len(ODD)


@pytest.mark.parametrize("min_count", [1, 2])
def test_language_model_sums_to_one(spark, min_count):
    rows = [(k, " ".join([prose(k, 30)] + ["the"] * 40 + [f"only{k}"])) for k in range(30)]
    trie = lm_trie.build(spark.createDataFrame(rows, "doc_id long, text string"), min_count=min_count)
    scorer, v = lm_trie.Scorer(trie), trie.types
    assert trie.hot and trie.written  # "the" is spread over shards
    ids, counts = np.arange(v), np.zeros(v)
    for s in range(trie.shards):
        if trie.first_id[s] < trie.first_id[s + 1]:
            counts[trie.first_id[s] : trie.first_id[s + 1]] = np.diff(scorer.words.shard(s)[1].get(np.arange(trie.first_id[s + 1] - trie.first_id[s] + 1)).astype(np.int64))
    p = np.append((counts - scorer.d1) / trie.n_tokens, scorer.unknown)
    assert math.isclose(p.sum(), 1)
    for u in range(v):
        q, rest = scorer.discounted(np.full(v + 1, u), np.append(ids, v))
        assert abs((q + rest * p).sum() - 1) < 1e-3
    for s in trie.written:
        os.remove(lm_trie._local(trie.level2(s)))
    with pytest.raises(FileNotFoundError):
        lm_trie.Scorer(trie).scores([b"the the"])


def test_language_model_query_keeps_pairs_seen_once(spark, tmp_path):
    from snapstore.llm.queries import QUERIES

    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    rows = [(k, prose(k, 12)) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {k: [*t.lower().split(), ""] for k, t in rows}
    c, pairs, kinds = collections.Counter(), collections.Counter(), collections.Counter()
    for k in words:
        if not held(k):
            c.update(words[k])
            pairs.update(zip(["", *words[k][:-1]], words[k]))
    for u, _ in pairs:
        kinds[u] += 1
    n, v = sum(c.values()), len(c)
    d1 = min(0.9, sum(x == 1 for x in c.values()) / v) or 0.5
    got = QUERIES["op8_lm_trie"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(x == 1 for x in pairs.values()) > 100
    for r in got:
        w, want = words[r["doc_id"]], 0.0
        for u, x in zip(["", *w[:-1]], w):
            p = (c[x] - d1) / n if c[x] else d1 * v / n
            if c[u]:
                p = max(0, pairs[u, x] - 0.75) / c[u] + 0.75 * kinds[u] / c[u] * p
            want += math.log10(p)
        assert r["held_out"] == held(r["doc_id"]) and abs(r["score"] - want) < 0.04 * len(w)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, d = d, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert d.columns == docs.columns and d.count() <= before.count()
    good = {r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert {r["doc_id"] for r in d.select("doc_id").collect()} <= good
    r = spark.read.parquet(str(tmp_path / "line_dedup")).where("doc_id = 5").first()
    assert r["text"] == prose(5, 40) and r["n_chars"] == len(r["text"]) and hashlib.sha256(r["text"].encode())
