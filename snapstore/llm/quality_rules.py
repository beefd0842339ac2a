"""Quality rules by distribution divergence (native: SQL expressions only).

A document's character-class histogram and its common-word histogram are compared with
those of language references by Jensen-Shannon distance (base 2, so 0 to 1). A document
too short for a histogram to mean anything is not judged by that histogram.

Everything is computed inside the row: there is no shuffle, so no key can be hot, and one
pass over the table is the whole plan. Words, 8-word windows and lines live in arrays of
one document at a time.

Defined results: a null or empty text has no words and fails the base rule; repeated
documents are judged alike, each by itself; columns other than the id and the text are
ignored; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Character classes, in the order of the reference vectors.
CLASSES = ("lower", "upper", "digit", "punctuation", "symbol", "other", "space")
WINDOW = 8
LOWER = r"a-z\x{DF}-\x{F6}\x{F8}-\x{FF}"
UPPER = r"A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}"


@dataclass(frozen=True)
class Language:
    """Shares of the character classes (see CLASSES) and of the common words of running prose."""

    classes: tuple[float, ...]
    words: dict[str, float]


def _words(text: str, share: float) -> dict[str, float]:
    """Common words with shares that fall off as 1/(rank+4), which sum to ``share``."""
    names = text.split()
    weights = [1 / (k + 4) for k in range(len(names))]
    return {w: share * x / sum(weights) for w, x in zip(names, weights, strict=True)}


#: Prose of any of these has some 76 to 79 % small letters, one word in six as space, few others.
REFERENCES: dict[str, Language] = {
    "en": Language((0.790, 0.020, 0.005, 0.020, 0.0005, 0.0005, 0.164), _words("the of and to a in is that for it was on as with be by", 0.36)),
    "de": Language((0.795, 0.035, 0.005, 0.020, 0.0005, 0.0005, 0.144), _words("der die und in den von zu das mit sich des auf ist im nicht ein", 0.34)),
    "fr": Language((0.790, 0.020, 0.005, 0.022, 0.0005, 0.0005, 0.162), _words("de la le et les des en un du une que est pour qui dans par", 0.36)),
    "es": Language((0.790, 0.020, 0.005, 0.020, 0.0005, 0.0005, 0.164), _words("de la que el en y a los se del las un por con una su", 0.38)),
}


@dataclass(frozen=True)
class QualityRules:
    """Parameters: the largest distances that pass, and the least lengths at which they count."""

    languages: dict[str, Language] = field(default_factory=lambda: REFERENCES)
    max_class_distance: float = 0.21
    max_word_distance: float = 0.42
    min_chars: int = 100
    min_words: int = 50
    base_min_words: int = 20
    base_max_repeat_pct: int = 30


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values) -> str:
    return "array(" + ", ".join(_sql(v) if isinstance(v, str) else f"{v!r}D" for v in values) + ")"


def _distance(counts: str, shares: str) -> str:
    """Jensen-Shannon distance of an array of counts to an array of shares (sum 1)."""
    part = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0D END"
    return f"""transform(array(aggregate({counts}, 0D, (s, c) -> s + c)), n -> if(n = 0, CAST(NULL AS DOUBLE), sqrt(greatest(0D,
        aggregate(zip_with(transform({counts}, c -> c / n), {shares}, (p, q) -> ({part.format(a="p", b="q")} + {part.format(a="q", b="p")}) / 2), 0D, (s, v) -> s + v)))))[0]"""


def repeat_words_sql(words: str) -> str:
    """Words inside WINDOW-word windows that a text holds twice or more, by sorted window hashes.

    Windows compare by 64-bit hash within one document: hashes of 2, 4, then 8 words, each
    from two of the half size. The sort runs only where some hash repeats. Lambda
    variables bind each array once.
    """
    k = WINDOW
    flagged = "filter(s, (e, j) -> (j > 0 AND get(s, j - 1).h = e.h) OR get(s, j + 1).h <=> e.h)"
    covered = f"aggregate(transform(p, (x, j) -> if(j = 0, {k}, least({k}, x - get(p, j - 1)))), 0L, (a, x) -> a + x)"
    slow = f"""transform(array(array_sort(transform(ws, (h, i) -> named_struct('h', h, 'i', i)))), s ->
        transform(array(array_sort(transform({flagged}, e -> e.i))), p -> {covered})[0])[0]"""
    pair = "transform(array(transform({h}, (x, i) -> xxhash64(x, get({h}, i + {step})))), {to} -> {then})[0]"
    found = f"transform(array(slice(h8, 1, size(h8) - {k - 1})), ws -> if(size(array_distinct(ws)) = size(ws), 0L, {slow}))[0]"
    eights = pair.format(h="h4", step=4, to="h8", then=found)
    return f"""transform(array(transform({words}, w -> xxhash64(w))), h1 -> if(size(h1) < {k}, 0L,
        {pair.format(h="h1", step=1, to="h2", then=pair.format(h="h2", step=2, to="h4", then=eights))}))[0]"""


def apply_rules(docs: DataFrame, rules: QualityRules | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the measures and verdicts of each row added (general interface).

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, language (closest
    by common words), class_distance, word_distance (null below the length guards),
    base_failed, kept. Columns of ``docs`` with such names are replaced.
    """
    r = rules or QualityRules()
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "language", "class_distance", "word_distance", "base_failed", "kept"]
    names = sorted(r.languages)
    common = sorted({w for x in r.languages.values() for w in x.words})
    either = ", ".join(_sql(w) for w in sorted({*common, *(w.capitalize() for w in common)}))
    space = _sql(f"[{SPACE_CLASS}]+")
    own = [c for c in docs.columns if c not in added]
    # the row's own columns travel in a struct, out of the way of the names used here
    d = docs.select(F.struct(*(docs[c] for c in own)).alias("_own"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_t"))
    d = d.withColumn("_trim", F.expr("trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM _t)"))
    d = d.withColumn("_w", F.expr(f"if(_trim = '', array(), split(_trim, {space}))"))
    d = d.withColumns({
        "_joined": F.expr("char_length(array_join(_w, ''))"),
        "_lines": F.expr(f"filter(split(_t, '\\n'), l -> trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM l) != '')"),
        "_rest": F.expr(f"regexp_replace(_t, {_sql(f'[{LOWER}{SPACE_CLASS}]+')}, '')"),
        "n_repeat_words": F.expr(repeat_words_sql("_w")),
        "_common": F.expr(f"transform(filter(_w, w -> w IN ({either})), w -> lower(w))"),
        "n_words": F.expr("CAST(size(_w) AS BIGINT)"),
        "_chars": F.expr("char_length(_t)"),
    })
    d = d.withColumns({
        "word_chars": F.expr("CAST(_joined AS BIGINT)"),
        "n_symbols": F.expr(r"CAST(char_length(regexp_replace(_rest, '[^#*$%&|<>]+', '')) AS BIGINT)"),
        "n_dup_lines": F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)"),
        "_upper": F.expr(f"char_length(_rest) - char_length(regexp_replace(_rest, {_sql(f'[{UPPER}]+')}, ''))"),
        "_digit": F.expr("char_length(_rest) - char_length(regexp_replace(_rest, '[0-9]+', ''))"),
        "_ascii": F.expr(r"char_length(_rest) - char_length(regexp_replace(_rest, '[!-/:-@\\[-`{-~]+', ''))"),
        "_hits": F.array(*(F.expr(f"size(filter(_common, w -> w IN ({', '.join(map(_sql, r.languages[n].words))})))") for n in names)),
    })
    classes = "array(_chars - char_length(_rest) - (_chars - word_chars), _upper, _digit, _ascii - n_symbols, n_symbols, char_length(_rest) - _upper - _digit - _ascii, _chars - word_chars)"
    best = "CAST(array_position(_hits, array_max(_hits)) AS INT)"
    d = d.withColumns({"_classes": F.expr(f"transform({classes}, c -> CAST(c AS DOUBLE))"), "_best": F.expr(best)})
    lists = "array(" + ", ".join(_array(r.languages[n].words) for n in names) + ")"
    d = d.withColumn("_counts", F.expr(f"transform(element_at({lists}, _best), w -> CAST(size(filter(_common, c -> c = w)) AS DOUBLE))"))
    d = d.withColumn("_counts", F.expr("concat(_counts, array(n_words - aggregate(_counts, 0D, (s, c) -> s + c)))"))
    shares = "array(" + ", ".join(_array([*x.words.values(), 1 - sum(x.words.values())]) for x in (r.languages[n] for n in names)) + ")"
    d = d.withColumns({
        "language": F.expr(f"element_at({_array(names)}, _best)"),
        "class_distance": F.expr(f"if(_chars < {r.min_chars}, CAST(NULL AS DOUBLE), array_min(array({', '.join(_distance('_classes', _array(r.languages[n].classes)) for n in names)})))"),
        "word_distance": F.expr(f"if(n_words < {r.min_words}, CAST(NULL AS DOUBLE), {_distance('_counts', f'element_at({shares}, _best)')})"),
        "base_failed": F.expr(f"n_words < {r.base_min_words} OR 100 * n_repeat_words > {r.base_max_repeat_pct} * n_words"),
        # a filter on ``kept`` must not be pushed below this: it would be written out there
        # in full, and arrays that lambdas refer to would be made anew for every element
        "_row": F.monotonically_increasing_id(),
    })
    d = d.withColumn("kept", F.expr(f"_row >= 0 AND NOT base_failed AND coalesce(class_distance <= {r.max_class_distance}, true) AND coalesce(word_distance <= {r.max_word_distance}, true)"))
    return d.select("_own.*", *added)


def oracle_sql(rules: QualityRules | None = None) -> str:
    """DuckDB SQL for the same measures and verdicts over a view ``documents``."""
    r = rules or QualityRules()
    names = sorted(r.languages)
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    words = lambda n: "[" + ", ".join(map(quote, r.languages[n].words)) + "]"
    either = ", ".join(quote(w) for w in sorted({v for x in r.languages.values() for w in x.words for v in (w, w.capitalize())}))
    vector = lambda v: "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"
    term = "CASE WHEN {a} > 0 THEN {a} * log2({a} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    js = lambda c, s: f"sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform({c}, lambda c: c / list_sum({c})), {s}), lambda z: ({term.format(a='z[1]')} + {term.format(a='z[2]')}) / 2))))"
    pick = lambda f: "CASE best " + " ".join(f"WHEN {k + 1} THEN {f(n)}" for k, n in enumerate(names)) + " END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^{SPACE_CLASS}]+') w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) i FROM d WHERE len(w) >= {WINDOW}),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) j FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT s) n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) s FROM d) WHERE regexp_matches(s, '[^{SPACE_CLASS}]') GROUP BY doc_id),
m AS (SELECT d.doc_id, t, len(w) n_words, length(array_to_string(w, '')) word_chars, regexp_replace(t, '[{LOWER}{SPACE_CLASS}]+', '', 'g') rest,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, coalesce(l.n, 0) n_dup_lines, coalesce(cover.n, 0) n_repeat_words,
    list_transform(list_filter(w, lambda x: x IN ({either})), lambda x: lower(x)) c
    FROM d LEFT JOIN l USING (doc_id) LEFT JOIN cover USING (doc_id)),
k AS (SELECT *, length(rest) - length(regexp_replace(rest, '[{UPPER}]+', '', 'g')) u, length(rest) - length(regexp_replace(rest, '[0-9]+', '', 'g')) g,
    length(rest) - length(regexp_replace(rest, '[!-/:-@\[-`{{-~]+', '', 'g')) a, [{", ".join(f"len(list_filter(c, lambda x: list_contains({words(n)}, x)))" for n in names)}] hits FROM m),
b AS (SELECT *, list_position(hits, list_max(hits)) best, [word_chars - length(rest), u, g, a - n_symbols, n_symbols, length(rest) - u - g - a, length(t) - word_chars]::DOUBLE[] cl FROM k),
f AS (SELECT *, list_transform({pick(words)}, lambda x: len(list_filter(c, lambda y: y = x)))::DOUBLE[] n0 FROM b),
h AS (SELECT *, list_append(n0, n_words - list_sum(n0)) wl FROM f),
v AS (SELECT *, n_words < {r.base_min_words} OR 100 * n_repeat_words > {r.base_max_repeat_pct} * n_words base_failed,
    CASE WHEN length(t) >= {r.min_chars} THEN list_min([{", ".join(js("cl", vector(r.languages[n].classes)) for n in names)}]) END cd,
    CASE WHEN n_words >= {r.min_words} THEN {js("wl", pick(lambda n: vector([*r.languages[n].words.values(), 1 - sum(r.languages[n].words.values())])))} END wd FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT n_repeat_words, base_failed,
    NOT base_failed AND coalesce(cd <= {r.max_class_distance}, true) AND coalesce(wd <= {r.max_word_distance}, true) kept,
    {pick(lambda n: quote(n))} AS language FROM v"""
