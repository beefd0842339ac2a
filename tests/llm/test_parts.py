"""Pieces of the operators, most without Spark, against plain versions."""

import bisect
import collections
import random
import re

import numpy as np
import pytest

from snapstore.llm import ann_partitions, best_fit, bpe_rank, jaccard_forest, line_crf, sharding, toxicity
from snapstore.llm.boosting import BoostedTrees, Isotonic, sigmoid
from snapstore.llm.elias_fano import EliasFano, pack, unpack


def plain_best_fit(lengths, capacity):
    free, bins = [], []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, (n, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = capacity, len(bins)
            bins.append(0)
        bins[b] += n
        if r - n:
            bisect.insort(free, (r - n, b))
    return bins


def test_run_length_best_fit_equals_item_by_item():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([1, 10, 37, 64, 200])
        lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5))]) for _ in range(rng.randint(0, 300))]
        counts = collections.Counter(lengths)
        plan, bins = best_fit.plan_packing(dict(counts), capacity), plain_best_fit(lengths, capacity)
        length = np.array([n for n in counts for _ in range(counts[n])], np.int64)
        rank = np.array([k for n in counts for k in range(counts[n])], np.int64)
        sequence, offset = plan.place(length, rank) if len(length) else ([], [])
        placed = collections.defaultdict(list)
        for n, s, o in zip(length, sequence, offset):
            placed[int(s)].append((int(o), int(n)))
        for items in placed.values():
            at = 0
            for o, n in sorted(items):
                assert o == at
                at += n
            assert at <= capacity
        assert plan.bins == len(placed) == len(bins)
        assert sorted(sum(n for _, n in v) for v in placed.values()) == sorted(bins)


TEXTS = ["", " \n", "a", "It's WE'LL 'S'T 123 4.5 !!??", "ΑΣ ΟΔΟΣ İstanbul", "é x\xa0y", "<|endoftext|>foo <|startoftext|><|endoftext|> x <|endoftext|", "日本語 😀😀", "x" * 500, "ab" * 3000, "\x1c\x1d a\x85b é\x1cz", "ﬀ ß ẞ Ǆ ΐ K Å", "a\0b", "՘Ᲊ Ɤ", "힣가"]


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe_rank.default_path()
    library, own = tokenizers.Tokenizer.from_file(path), bpe_rank.RankBpe(path)
    rng = random.Random(1)
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x900, 0xD000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(200)]
    texts = TEXTS + wild
    for text, ids, want in zip(texts, own.encode_batch([t.encode() for t in texts]), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert own.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)
    assert [np.frombuffer(i, "<u4").tolist() for i in best_fit.TokenIds(path)([t.encode() for t in TEXTS])] == [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]


class CountingLibrary:
    """A library that notes the texts it is given."""

    def __init__(self, library):
        self.library, self.given = library, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.library.encode_batch_fast(texts, **options)


def test_token_ids_give_the_library_each_word_once():
    pytest.importorskip("tokenizers")
    ids = best_fit.TokenIds(bpe_rank.default_path())
    ids.library = CountingLibrary(ids.library)
    first = ids([b"Repeat repeat, REPEAT!! repeat.", b"repeat;"])
    assert " ".join(ids.library.given).lower().count("repeat") == 1  # it got five
    given = len(ids.library.given)
    assert ids([b"repeat. repeat", b"repeat;"])[1] == first[1] and len(ids.library.given) == given


def test_token_ids_equal_the_library_on_letters_and_punctuation():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe_rank.default_path()
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = [c for c in map(chr, range(0x41, 0x260)) if c.isalpha()]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [c + m for c in letters for m in ("", "!", "'s", "\u030c.", "\u0301'")]
    texts += [a + b for a in ("", "a", "J", "7", "\u20ac", "\u0130", "\x01", "it's") for b in (*marks, "<|endoftext|>", "!\x01", " \x01 ", "'")]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randrange(4)) + rng.choices(marks, k=rng.randrange(4)) + rng.choices("a1'\u00e9\u0308\x01<|", k=rng.randrange(2))) for _ in range(40)) for _ in range(300)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = best_fit.TokenIds(path)
    for _ in range(2):  # all new, all known
        for text, got, w in zip(texts, ids([t.encode() for t in texts]), want, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == w, text


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in [(0, 10), (1, 1), (5, 5), (1000, 1 << 64), (1000, 1200), (3000, 10**12), (50, 1 << 64)]:
        v = np.unique(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True)) if n else np.empty(0, np.uint64)
        e = EliasFano.of(unpack(pack(EliasFano.build(v, universe).arrays())))
        assert (e.get(np.arange(len(v))) == v).all()
        q = np.concatenate([v, rng.integers(0, universe - 1, 300, dtype=np.uint64, endpoint=True), np.array([0, universe - 1], np.uint64)])
        place = {int(x): i for i, x in enumerate(v)}
        assert e.search(q).tolist() == [place.get(int(x), -1) for x in q]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([1, 3, 2])
    unary, change = rng.normal(size=6), rng.normal(size=(2, 2))
    good, expected = line_crf.forward_backward(unary, change, counts)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in counts:
        total, marginal = 0.0, np.zeros(n)
        moves = np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum((2 * s - 1) * u / 2 for s, u in zip(y, unary[at : at + n])) + sum(change[a, b] for a, b in zip(y, y[1:])))
            total += w
            marginal += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += w
        want += list(marginal / total)
        pairs += moves / total
        at += n
    assert np.allclose(good, want) and np.allclose(expected, pairs)


def test_boosting_and_isotonic():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < sigmoid(3 * (x[:, 0] > 0.3) + x[:, 1] - 2)).astype(float)
    m = BoostedTrees(trees=60).fit(x[:2000], y[:2000]).margin(x)
    order = np.argsort(m[2000:])
    rank = np.empty(1000)
    rank[order] = np.arange(1000)
    pos = y[2000:] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.8
    iso = Isotonic.fit(m[:2000], y[:2000])
    p = iso(np.sort(m))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_forest_depth_and_balanced_parts():
    d = jaccard_forest.min_depth(0.8, 25, 0.999, 7)
    assert 1 - (1 - 0.8**d) ** 25 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 25
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 8)) + 3 * np.eye(8)[rng.integers(0, 8, 800)]
    part = ann_partitions.balanced_parts(x, ann_partitions.neighbour_graph(x, 8), 8, rng)
    assert np.bincount(part, minlength=8).max() <= 111


def test_large_runs_are_joined_like_small_ones(spark):
    rows = [(t, f"l{t}".encode(), k) for t, n in enumerate((300, 40, 3, 3)) for k in range(n)] + [(9, b"other", 1)]
    runs = [(t, f"l{t}".encode(), n, 7 * t) for t, n in enumerate((300, 40, 3))] + [(5, b"none", 50, 0)]
    d = spark.createDataFrame(rows, "tree int, label binary, tid long")
    r = spark.createDataFrame(runs, "tree int, label binary, size long, main long")
    got = sorted((x["tree"], x["tid"], x["size"], x["main"]) for x in jaccard_forest.with_runs(d, r).collect())
    assert got == sorted((t, k, runs[t][2], 7 * t) for t, _, k in rows if t < 3)
    assert jaccard_forest.with_runs(d.limit(0), r).count() == 0 and jaccard_forest.with_runs(d, r.limit(0)).count() == 0


def plain_shards(rows, n_shards):
    """Each record's shard from the whole order, one record at a time: the shard of its middle byte."""
    total, at, out = sum(size for _, size in rows), 0, []
    for _, size in rows:
        out.append(min(n_shards - 1, (2 * at + size) * n_shards // (2 * total)))
        at += size
    return out


def test_shards_equal_one_pass_over_the_order(spark):
    rng = np.random.default_rng(8)
    texts = ["same text"] * 120 + ["x" * int(n) for n in rng.integers(0, 400, 200)] + ["y" * 9000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sharding.shard(d, range_rows=25).collect()}
    keys = {r["doc_id"]: r["h"] for r in d.selectExpr("doc_id", "lpad(hex(xxhash64(cast(text as binary))), 16, '0') h").collect()}
    order = sorted((keys[k], k, len(t) + 1) for k, t in enumerate(texts))
    want = plain_shards([(k, size) for _, k, size in order], 16)
    assert {k: s for (_, k, _), s in zip(order, want, strict=True)} == {k: r["shard"] for k, r in got.items()}
    for s in range(16):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(want.count(s)))


def test_toxicity_features_equal_a_plain_recount():
    lexicon = {b"idiot": 2.0, b"scum": 3.5, b"wret*": 2.5}
    text = "You are an IDIOT, and scum! Truly 1d10t you said; the wretched river is calm today."
    words = text.split()
    hits = [k for k, w in enumerate(words) if re.sub("[^a-z]", "", w.lower()) in ("idiot", "scum", "wretched")]
    masked = [words.index("1d10t")]
    you = [k for k, w in enumerate(words) if w.lower() == "you"]
    n, every = len(words), sorted(hits + masked)
    want = {
        "hits": len(every) / n,
        "masked_hits": len(masked) / n,
        "weight": (2.0 + 3.5 + 2.0 + 2.5) / n,
        "any_hit": len(every),
        "hits_near_you": sum(min(abs(k - y) for y in you) <= 5 for k in every) / n,
        "you": len(you) / n,
        "capitals": sum(c.isupper() for c in text) / len(text),
        "caps_words": 1 / n,
        "punctuation": sum(c in ".,;:\"'()-" for c in text) / len(text),
        "bangs": text.count("!") / len(text),
        "queries": 0.0,
        "digits": sum(c.isdigit() for c in text) / len(text),
        "log_words": np.log(n),
    }
    got = dict(zip(toxicity.FEATURES, toxicity.Extractor(lexicon).features([text.encode()])[0], strict=True))
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert not toxicity.Extractor(lexicon).features([b"", b" \n"]).any()


def test_line_features_and_document_score_equal_a_plain_recount():
    texts = [b"The cat is here.\n\nTHE cat is here.\nThe cat is here.", b"", b"go go go 12|"]
    x, length, counts = line_crf.line_features(texts)
    lines = [t.split(b"\n") for t in texts]
    flat = [line for doc in lines for line in doc]
    assert counts.tolist() == [len(doc) for doc in lines] and length.tolist() == [len(line) for line in flat]
    own = x[:, : line_crf.OWN]
    for row, line in zip(own, flat, strict=True):
        size = max(len(line), 1)
        assert row[0] == pytest.approx(sum(97 <= c <= 122 for c in line) / size)
        assert row[1] == pytest.approx(sum(65 <= c <= 90 for c in line) / size)
        assert row[2] == pytest.approx(sum(48 <= c <= 57 for c in line) / size)
        assert row[8] == pytest.approx(line.count(b" ") / size)
    assert own[:, -1].tolist() == [0, 0, 0, 1, 0, 0]  # the fourth line repeats the first
    before, after = x[:, line_crf.OWN : 2 * line_crf.OWN], x[:, 2 * line_crf.OWN : 3 * line_crf.OWN]
    assert (before[1:4] == own[:3]).all() and (after[:3] == own[1:4]).all()
    assert not before[[0, 4, 5]].any() and not after[[3, 4, 5]].any()  # documents don't touch
    good = np.array([0.9, 0.5, 0.2, 0.7, 0.4, 0.3])
    odds = line_crf.weighted_quality(good, length, counts)
    k = 0
    for doc, got in zip(lines, odds, strict=True):
        w = [len(line) + 1 for line in doc]
        q = sum(g * v for g, v in zip(good[k : k + len(doc)], w, strict=True)) / sum(w)
        assert got == pytest.approx(np.log(q / (1 - q)))
        k += len(doc)
