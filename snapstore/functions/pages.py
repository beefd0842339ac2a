"""Pages as expressions: slicing, the zero page, dirty bitmaps, record sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DELTA, FULL, PAGE_SIZE, ZERO

WORDS_IN_GROUP, MAX_DIRTY = 64, (1 << 32) - 1


def zero_page() -> Column:
    return F.repeat(F.lit("\0"), F.lit(PAGE_SIZE)).cast("binary")


def is_zero(page: str) -> Column:
    return F.col(page) == zero_page()


def split_pages(df: DataFrame, image: str, pa_base: Column | None = None, most: int | None = None) -> DataFrame:
    """One row per 4 KiB page of the binary column ``image``, the last one padded with zeros.

    Adds ``pa`` (base plus index) and ``page``; an empty or null image has no pages.
    An image of more than ``most`` pages is an error: its addresses would be those of the next.
    """
    base = F.lit(0) if pa_base is None else pa_base
    n = F.octet_length(image)
    last = F.floor((n - 1) / PAGE_SIZE).cast("int")
    if most is not None:
        last = F.when(last < most, last).otherwise(F.raise_error(F.concat(F.lit(f"more than {most} pages in an image: "), n.cast("string"), F.lit(" bytes"))).cast("int"))
    d = df.where(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    part = F.substring(F.col(image), F.col("_i") * PAGE_SIZE + 1, F.lit(PAGE_SIZE))
    return d.withColumns({"pa": (base + F.col("_i")).cast("bigint"), "page": F.rpad(part, F.lit(PAGE_SIZE), F.lit(b"\0"))}).drop("_i", image)


def bitmap_pages(df: DataFrame, words: str, page_count: int | None = None) -> DataFrame:
    """Set bits of an array of 64-bit words as ``pa``; bits at or past ``page_count`` are masked."""
    d = df.select("*", F.posexplode(words).alias("_w", "_word")).drop(words)
    d = d.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr("bit_get(_word, _b)") == 1)
    d = d.withColumn("pa", F.col("_w").cast("bigint") * 64 + F.col("_b")).drop("_w", "_word", "_b")
    return d if page_count is None else d.where(F.col("pa") < page_count)


def word_pages(words: DataFrame) -> DataFrame:
    """(w, pa): the set bits of a bitmap's words (w, word), each word a row."""
    d = words.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr("bit_get(word, _b)") == 1)
    return d.select("w", (F.col("w").cast("bigint") * 64 + F.col("_b")).alias("pa"))


def masked_words(words: DataFrame, page_count: int) -> DataFrame:
    """The words (w, word) of a bitmap without the bits at or past ``page_count``."""
    left = F.lit(page_count).cast("bigint") - F.col("w") * 64
    low = F.expr("shiftleft(1L, CAST(_left AS INT))") - 1
    d = words.withColumn("_left", left)
    masked = F.when(F.col("_left") >= 64, F.col("word")).when(F.col("_left") > 0, F.col("word").bitwiseAND(low)).otherwise(F.lit(0).cast("bigint"))
    return d.withColumn("word", masked).drop("_left")


def dirty_count(words: str) -> Column:
    return F.aggregate(F.col(words), F.lit(0).cast("bigint"), lambda s, w: s + F.bit_count(w))


def group_counts(words: DataFrame) -> DataFrame:
    """(group, dirty): set bits by group of 4,096 pages, from rows (w, word) of a bitmap's words."""
    return words.groupBy(F.floor(F.col("w") / WORDS_IN_GROUP).alias("group")).agg(F.sum(F.bit_count("word")).cast("bigint").alias("dirty"))


def dirty_total(words: DataFrame) -> DataFrame:
    """One row (total): all set bits of a bitmap; over 32 bits are an error."""
    d = words.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("bigint").alias("total"))
    over = F.raise_error(F.lit("more dirty pages than 32 bits count")).cast("bigint")
    return d.select(F.when(F.col("total") <= MAX_DIRTY, F.col("total")).otherwise(over).alias("total"))


def kind_name(kind: str) -> Column:
    k = F.col(kind)
    bad = F.raise_error(F.concat(F.lit("unknown chunk kind "), k.cast("string"))).cast("string")
    return F.when(k == FULL, "full").when(k == DELTA, "delta").when(k == ZERO, "zero").otherwise(bad)


def record_size(kind: str) -> Column:
    """Bytes of a log record: 22, and 8 more for a delta's base key."""
    return F.when(F.col(kind) == DELTA, 30).otherwise(22).cast("bigint")


def byte_address(pa: str) -> Column:
    return F.col(pa) * PAGE_SIZE


def raw_data_offset(count: str) -> Column:
    """Where page data starts in a raw export: count and addresses, rounded up to a page."""
    return (F.ceil((8 + 8 * F.col(count)) / PAGE_SIZE) * PAGE_SIZE).cast("bigint")


def human_bytes(n: str) -> Column:
    """Bytes with a binary unit and two decimals."""
    c = F.col(n)
    unit = lambda name, size: F.format_string(f"%.2f {name}", c / float(size))
    return F.when(c >= 1 << 30, unit("GiB", 1 << 30)).when(c >= 1 << 20, unit("MiB", 1 << 20)).when(c >= 1 << 10, unit("KiB", 1 << 10)).otherwise(F.format_string("%d B", c))


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(part * 100.0 / total)


def hex_rows(df: DataFrame, binary: str) -> DataFrame:
    """16 bytes a row: ``offset``, ``hex``, and ``ascii`` with dots for the unprintable."""
    shown = F.regexp_replace(F.decode(F.col(binary), "ISO-8859-1"), "[^ -~]", ".").cast("binary")  # once a page, a byte a byte
    d = df.where(F.octet_length(binary) > 0).withColumn("_shown", shown)
    d = d.withColumn("offset", F.explode(F.sequence(F.lit(0), F.octet_length(binary) - 1, F.lit(16))))
    part = lambda c: F.substring(F.col(c), F.col("offset") + 1, F.lit(16))
    return d.withColumns({"hex": F.hex(part(binary)), "ascii": part("_shown").cast("string")}).drop(binary, "_shown")


def parse_filter(text: str) -> tuple[int | None, int | None]:
    """(snapshot id, page address): decimal words are snapshots, ``0x`` words addresses; the last wins.

    Words of other characters than plain digits, and numbers over 32 or 64 bits, are passed over.
    """
    snapshot = pa = None
    for word in text.split():
        if re.fullmatch(r"0[xX][0-9a-fA-F]+", word):
            pa = int(word, 16) if int(word, 16) < 1 << 64 else pa
        elif re.fullmatch(r"[0-9]+", word):
            snapshot = int(word) if int(word) < 1 << 32 else snapshot
    return snapshot, pa
