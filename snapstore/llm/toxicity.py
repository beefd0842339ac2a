"""Toxicity by gradient-boosted trees over dense features of a text, calibrated isotonically.

The features are rates: hits of a lexicon (plain, weighted, after undoing obfuscation), hits
near second-person words, second-person words, capitals, punctuation, obfuscated words.
Besides a few insults that start it off, the lexicon is learnt: stems (whole words and
word beginnings) that come in far more toxic than clean documents of the training sample.
Stems are learnt apart for each fold, so that no document's features know its own label.

The classifier is fitted on a bounded sample of labelled rows (``sample_rows``), whose
features alone reach the driver; counts of stems are added up by the executors. Scoring is
one pass without a shuffle: words are looked up in a memo of the task that shrinks to the
words in use at MEMO entries, so the cost follows the bytes of the text.

Defined results: a null or empty text is scored from its all-zero features; repeated rows
score alike; without labels of both kinds every score is the share of toxic labels (0 if
there are none); a null doc_id is never held out; an empty table gives no rows; other
columns pass through, but those named score or predicted are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import BoostedTrees, Isotonic
from .bpe_rank import row_ranges
from .common import fresh, labelled_sample, own_columns, release_memory, remainder, shrunk

HELD_OUT_MOD, HELD_OUT = 5, 0
SAMPLE_ROWS = 12_000
FOLDS = 3
MEMO = 150_000
MIN_DOCS, MIN_ODDS = 3, 2.0
SEED = "idiot moron stupid loser scum trash worthless pathetic disgusting dumb ugly hate kill shut bastard".split()
SECOND = {w.encode() for w in "you your yours yourself u ur du dich dir dein deine deiner euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os".split()}
LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
INNER = re.compile(rb"[a-z\x80-\xff][^a-z\x80-\xff'\-]+[a-z\x80-\xff]|([a-z])\1\1")
#: Flags of a word.
HIT, MASKED, YOU, CAPS, ODD = 1, 2, 4, 8, 16
NEAR = 5
UPPER, PUNCT, BANG, QUERY, DIGIT, SYMBOL = range(1, 7)
CLASS_OF = np.zeros(256, np.uint8)
CLASS_OF[ord("A") : ord("Z") + 1] = UPPER
CLASS_OF[list(b".,;:\"'()-")] = PUNCT
CLASS_OF[ord("!")], CLASS_OF[ord("?")] = BANG, QUERY
CLASS_OF[ord("0") : ord("9") + 1] = DIGIT
CLASS_OF[list(b"#*$%&|<>@_~^+=/\\{}[]`")] = SYMBOL
FEATURES = ("hits", "weight", "any_hit", "distinct_hits", "masked_hits", "hits_near_you", "you", "capitals", "caps_words", "punctuation", "bangs", "queries", "digits", "symbols", "odd_words", "log_words")


def core(word: bytes) -> bytes:
    """The longest run of letters, in lower case."""
    low = word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()
    return low if low.isalpha() else max(LETTERS.findall(low), key=len, default=b"")


def stems(word: bytes) -> list[bytes]:
    """The word itself and its beginnings of 4 to 7 letters (marked by ``*``)."""
    w = core(word)
    if len(w) < 3:
        return []
    s = w.decode("utf-8", "replace")
    return [w, *(s[:k].encode() + b"*" for k in range(4, min(8, len(s))))]


class Extractor:
    """Features of texts under one lexicon of stems and weights."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon
        self.memo: dict[bytes, int] = {}

    def weight(self, word: bytes) -> float:
        return max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0)

    def code(self, word: bytes) -> int:
        """Flags, the lexicon weight in hundredths, and a number that tells hits apart."""
        low = core(word)
        flags = YOU * (low in SECOND) | CAPS * (len(word) > 1 and word.isupper()) | ODD * bool(INNER.search(word.lower()))
        w = self.weight(word)
        flags |= HIT * (w > 0)
        if not w and not word.isalpha() and word.isascii():
            plain = bytes(c for c in word.lower().translate(LEET) if 97 <= c <= 122)
            if (w := self.weight(plain)) > 0:
                flags |= MASKED
        return flags | min(int(100 * w), 4095) << 8 | zlib.crc32(low) << 20 if w else flags

    def features(self, texts: list[bytes]) -> np.ndarray:
        cut = [t.split() for t in texts]
        used = set().union(*cut)
        self.memo = shrunk(self.memo, used, MEMO)
        for w in used.difference(self.memo):
            self.memo[w] = self.code(w)
        out = np.zeros((len(texts), len(FEATURES)))
        for k, (text, words) in enumerate(zip(texts, cut, strict=True)):
            if not words:
                continue
            n = len(words)
            codes = np.fromiter(map(self.memo.__getitem__, words), np.int64, n)
            by = np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=7) / len(text)
            flags = codes & 255
            hit = np.flatnonzero(flags & (HIT | MASKED))
            near = 0
            you = np.flatnonzero(flags & YOU)
            if len(hit) and len(you):
                at = np.searchsorted(you, hit)
                gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(hit - you[np.maximum(at - 1, 0)]))
                near = int((gap <= NEAR).sum())
            weights = (codes[hit] >> 8 & 4095) / 100
            odd, caps = np.count_nonzero(flags & ODD), np.count_nonzero(flags & CAPS)
            out[k] = (len(hit) / n, weights.sum() / n, min(len(hit), 20), len(np.unique(codes[hit] >> 20)), np.count_nonzero(flags & MASKED) / n, near / n, len(you) / n, by[UPPER], caps / n, by[PUNCT], by[BANG], by[QUERY], by[DIGIT], by[SYMBOL], odd / n, np.log(n))
        return out


def learn_lexicon(sample: DataFrame) -> list[dict[bytes, float]]:
    """Stems and weights for each fold (from the other folds' documents), then from all."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for text, y, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.setdefault((fold, y), Counter()).update({s for w in set(text.split()) for s in stems(w)})
        for (fold, y), c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([*c], pa.binary()), pa.array([fold] * len(c), pa.int32()), pa.array([y] * len(c), pa.int32()), pa.array([*c.values()], pa.int64())], names=["stem", "fold", "y", "n"])

    rows = sample.select(F.col("text").cast("binary").alias("text"), "y", fold_of("doc_id").alias("fold")).mapInArrow(count, "stem binary, fold int, y int, n long")
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    totals = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy(fold_of("doc_id").alias("fold"), "y").agg(F.count("*").alias("n")).collect()}
    odds = []
    for left_out in [*range(FOLDS), None]:
        use = [f for f in range(FOLDS) if f != left_out]
        n0, n1 = (sum(totals.get((f, y), 0) for f in use) for y in (0, 1))
        toxic, clean = (sum(F.col(f"n{f}{y}") for f in use) for y in (1, 0))
        odds.append(F.when(toxic >= MIN_DOCS, F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))))
    # the stems that some lexicon takes; the bounded sample bounds how many there are
    found = rows.groupBy("stem").agg(*sums).select("stem", F.array(*odds).alias("odds")).where(F.exists("odds", lambda o: o > MIN_ODDS)).collect()
    out = []
    for k in range(len(odds)):
        lexicon = {s.encode(): 2.0 for s in SEED}
        lexicon |= {bytes(r["stem"]): r["odds"][k] for r in found if r["odds"][k] is not None and r["odds"][k] > MIN_ODDS}
        out.append(lexicon)
    return out


def fold_of(doc_id: str):
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float]
    trees: BoostedTrees | None
    calibration: Isotonic | None
    share: float

    def scores(self, extractor: Extractor, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return self.calibration(self.trees.margin(extractor.features(texts)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on rows whose crc32(doc_id) mod 5 is not 0."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sample = labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT, sample_rows, "toxicity-sample")
    lexicons = learn_lexicon(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the features of a document of fold f come from the lexicon that did not see it
        own = [Extractor(x) for x in lexicons[:FOLDS]]
        try:
            for batch in batches:
                for a, b in row_ranges(pc.binary_length(batch.column(0)).to_pylist()):
                    texts, folds = batch.column(0).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_numpy()
                    apart = np.zeros((b - a, len(FEATURES)))
                    for f in range(FOLDS):
                        at = np.flatnonzero(folds == f)
                        if len(at):
                            apart[at] = own[f].features([texts[i] for i in at])
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(apart.tolist(), pa.list_(pa.float64()))], names=["y", "fold", "apart"])
        finally:
            for extractor in own:
                extractor.memo = {}
            release_memory()

    rows = sample.select(F.col("text").cast("binary").alias("text"), "y", fold_of("doc_id").alias("fold")).mapInArrow(extract, "y int, fold int, apart array<double>").toPandas()
    y = rows["y"].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.0
    if len(np.unique(y)) < 2:
        return ToxicityModel(lexicons[-1], None, None, share)
    order = np.lexsort(np.array(rows["apart"].tolist()).T)  # whatever order the tasks came in
    x, y, fold = np.array(rows["apart"].tolist())[order], y[order], rows["fold"].to_numpy()[order]
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any() and len(np.unique(y[fold != f])) == 2:
            margin[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    return ToxicityModel(lexicons[-1], BoostedTrees().fit(x, y), Isotonic.fit(margin, y), share)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (a probability) and ``predicted`` added."""
    import pyarrow as pa
    import pyarrow.compute as pc

    own = own_columns(docs, ("score", "predicted"))
    d = docs.select(*(docs[c] for c in own), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias(fresh(own, "_bytes")))
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model.lexicon)
        try:
            for batch in batches:
                texts = batch.column(len(own))
                for a, b in row_ranges(pc.binary_length(texts).to_pylist()):
                    s = model.scores(extractor, texts.slice(a, b - a).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)
        finally:
            extractor.memo = {}
            release_memory()

    return d.mapInArrow(run, schema)
