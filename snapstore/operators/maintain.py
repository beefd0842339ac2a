"""Maintenance and inspection of chunk tables: purge, integrity, statistics, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import pack_key, worker_of
from ..functions.pages import kind_name, percent, record_size
from ..schema import DELTA, FULL, PAGE_SIZE, SNAPSHOT_BITS, WORDS, ZERO
from .versions import first_writes


def purge(chunks: DataFrame, threshold: int) -> DataFrame:
    """Chunks up to ``threshold``. Bases are older than their deltas, so none is orphaned."""
    return chunks.where(F.col("snapshot_id") <= threshold)


def purge_summary(chunks: DataFrame, threshold: int) -> DataFrame:
    """How many deduplicated records a purge removes and keeps, and the new greatest snapshot (0 if none)."""
    kept = F.col("snapshot_id") <= threshold
    return chunks.select("pa", "snapshot_id").distinct().agg(F.count_if(~kept).alias("removed"), F.count_if(kept).alias("kept"), F.coalesce(F.max(F.when(kept, F.col("snapshot_id"))), F.lit(0)).alias("max_snapshot_id"))


def without_repeats(chunks: DataFrame) -> DataFrame:
    """Of records with one key the first by ``seq``. Only keys are sorted; the few others are taken out."""
    w = Window.partitionBy("pa", "snapshot_id").orderBy("seq")
    later = chunks.select("pa", "snapshot_id", "seq").withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")
    return chunks.join(later, ["pa", "snapshot_id", "seq"], "left_anti")


def by_address(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows clustered by address, each file a narrow range of addresses."""
    d = chunks.repartitionByRange(parts, "pa", "snapshot_id") if parts else chunks.repartitionByRange("pa", "snapshot_id")
    return d.sortWithinPartitions("pa", "snapshot_id")


def index_order(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """Unique keys clustered by address: the read layout."""
    return by_address(first_writes(chunks, "seq"), parts)


def log_order(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """The same rows snapshot by snapshot: the ingest layout."""
    keys = ("snapshot_id", "pa")
    d = chunks.repartitionByRange(parts, *keys) if parts else chunks.repartitionByRange(*keys)
    return d.sortWithinPartitions(*keys)


def payload_size():
    """Bytes of a chunk's payload: a whole page, 10 bytes per changed word, or none."""
    return F.when(F.col("kind") == FULL, F.octet_length("page")).when(F.col("kind") == DELTA, F.size("patch") * 10).otherwise(0).cast("bigint")


def stats(chunks: DataFrame, snapshot_id: int | None = None) -> DataFrame:
    """Total and non-zero records, duplicates included, of one snapshot or all."""
    d = chunks if snapshot_id is None else chunks.where(F.col("snapshot_id") == snapshot_id)
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("kind") != ZERO).alias("non_zero"))


def stats_by_kind(chunks: DataFrame) -> DataFrame:
    """Records, payload and log bytes by kind, with shares of the whole."""
    d = chunks.groupBy("kind").agg(F.count("*").alias("records"), F.sum(payload_size()).alias("payload_bytes"), F.sum(record_size("kind")).alias("log_bytes"))
    whole = Window.partitionBy()  # three rows
    return d.withColumns({"records_pct": percent(F.col("records"), F.sum("records").over(whole)), "bytes_pct": percent(F.col("payload_bytes"), F.sum("payload_bytes").over(whole))})


def inspect(chunks: DataFrame, snapshot_id: int | None = None, pa: int | None = None) -> DataFrame:
    """Records of exactly this snapshot and address (no floor), by key."""
    d = chunks
    for name, value in (("snapshot_id", snapshot_id), ("pa", pa)):
        d = d if value is None else d.where(F.col(name) == value)
    return d.orderBy("pa", "snapshot_id", "seq")


def with_base_errors(rows: DataFrame) -> DataFrame:
    """(pa, snapshot_id, error) from rows (pa, snapshot_id, kind, base_snapshot, errors): their own, and those of bases.

    One pass and one shuffle of keys: each delta meets the records of its base's key there.
    """
    delta = F.col("kind") == DELTA
    fact = F.struct(F.col("snapshot_id").alias("key"), (F.col("kind") == FULL).cast("int").alias("full"), F.col("errors").alias("own"))
    probe = F.struct(F.col("base_snapshot").alias("key"), F.lit(None).cast("int").alias("full"), F.array().cast("array<string>").alias("own"))
    d = rows.select("pa", "snapshot_id", F.explode(F.when(delta, F.array(fact, probe)).otherwise(F.array(fact))).alias("e")).select("pa", "snapshot_id", "e.*", F.col("e.full").isNull().alias("probe"))
    w = Window.partitionBy("pa", "key")
    n, full = F.count("full").over(w), F.max("full").over(w)
    of_base = F.array(
        F.when((n == 0) | F.col("key").isNull(), "base is missing"),
        F.when((n > 0) & (full == 0), "base is not full"),
        F.when(F.col("key") >= F.col("snapshot_id"), "base is not earlier"),
    )
    d = d.withColumn("errors", F.when(F.col("probe"), F.array_compact(of_base)).otherwise(F.col("own")))
    return d.select("pa", "snapshot_id", F.explode("errors").alias("error"))


def integrity_errors(chunks: DataFrame) -> DataFrame:
    """(pa, snapshot_id, error): malformed payloads, and deltas without an earlier full base."""
    kind = F.col("kind")
    outside = F.exists(F.transform("patch", lambda e: e["w"]), lambda w: (w < 0) | (w >= WORDS))
    own = F.array(
        F.when(~kind.isin(FULL, DELTA, ZERO), "unknown kind"),
        F.when((kind == FULL) & (F.coalesce(F.octet_length("page"), F.lit(0)) != PAGE_SIZE), "full page of wrong size"),
        F.when((kind == DELTA) & F.col("patch").isNull(), "delta without patch"),
        F.when((kind == DELTA) & outside, "patch word outside the page"),
    )
    return with_base_errors(chunks.select("pa", "snapshot_id", "kind", "base_snapshot", F.array_compact(own).alias("errors")))


def integrity_report(chunks: DataFrame) -> DataFrame:
    """One row: records in all and by kind, and errors."""
    counts = chunks.agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(n) for n, k in (("full_count", FULL), ("delta_count", DELTA), ("zero_count", ZERO))))
    return counts.crossJoin(integrity_errors(chunks).agg(F.count("*").alias("errors")))  # one row each


def error_lines(errors: DataFrame, most: int = 50) -> DataFrame:
    """(place, line): the first ``most`` errors in order of their keys, then how many more there are."""
    text = F.concat(F.lit("page "), F.col("pa").cast("string"), F.lit(" snapshot "), F.col("snapshot_id").cast("string"), F.lit(": "), "error")
    order = ["pa", "snapshot_id", "error"]
    first = errors.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows
    more = errors.agg(F.count("*").alias("n")).where(F.col("n") > most)
    return first.select("place", text.alias("line")).unionByName(more.select(F.lit(most + 1).alias("place"), F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line")))


def orphan_deltas(chunks: DataFrame) -> DataFrame:
    """Deltas whose base is not among the full chunks."""
    full = chunks.where(F.col("kind") == FULL).select("pa", F.col("snapshot_id").alias("base_snapshot"))
    return chunks.where(F.col("kind") == DELTA).join(full, ["pa", "base_snapshot"], "left_anti")


def blob_ends(records: DataFrame) -> DataFrame:
    """(worker_id, file_size, records): where the payloads of each worker's file end."""
    d = records.where(F.col("kind") != ZERO)
    return d.groupBy("worker_id").agg(F.max(F.col("offset") + F.col("len")).alias("file_size"), F.count("*").alias("records"))


def worker_file_sizes(chunks: DataFrame, workers: int) -> DataFrame:
    """The same for chunks, were they written to ``workers`` files one after the other: sums alone tell."""
    d = chunks.where(F.col("kind") != ZERO).groupBy(worker_of("pa", workers).alias("worker_id"))
    return d.agg(F.sum(payload_size()).alias("file_size"), F.count("*").alias("records"))


def record_details(chunks: DataFrame, workers: int = 1) -> DataFrame:
    """What an inspector shows of each record: keys in hex, kind, blob file, base, entries or bytes."""
    hex_of = lambda c, width: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), width, "0"))
    delta = F.col("kind") == DELTA
    base = F.shiftleft(F.col("pa").cast("bigint"), SNAPSHOT_BITS).bitwiseOR(F.col("base_snapshot").cast("bigint"))
    return chunks.select(
        "pa", "snapshot_id", hex_of(pack_key("pa", "snapshot_id"), 16).alias("key_hex"), hex_of(F.col("pa"), 11).alias("pa_hex"), kind_name("kind").alias("kind_name"),
        F.when(F.col("kind") != ZERO, F.concat(F.lit("worker_"), worker_of("pa", workers).cast("string"), F.lit(".blob"))).alias("blob"),
        F.when(delta, hex_of(base, 16)).alias("base_key_hex"), F.when(delta, F.size("patch")).alias("patch_entries"), F.when(F.col("kind") == FULL, F.octet_length("page")).alias("page_bytes"),
    )


def patch_rows(chunks: DataFrame) -> DataFrame:
    """Each entry of each patch: its word, xor in hex, and the page's bytes that it changes."""
    d = chunks.where(F.col("kind") == DELTA).select("pa", "snapshot_id", F.explode("patch").alias("e"))
    first = F.col("e.w").cast("bigint") * 8
    return d.select("pa", "snapshot_id", F.col("e.w").cast("bigint").alias("word"), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("e.x")), 16, "0")).alias("xor"), first.alias("first_byte"), (first + 8).alias("end_byte"))


def viewport(rows: DataFrame, selected: int, visible: int, *order: str) -> DataFrame:
    """The ``visible`` rows around the ``selected`` one (from 0, held inside the rows), with their places.

    The selected row is in the middle where there are rows enough before and after it.
    """
    total = rows.count()
    at = min(max(selected, 0), max(total - 1, 0))
    start = 0 if at < visible // 2 else min(at - visible // 2, max(0, total - visible))
    shown = rows.orderBy(*order).offset(start).limit(visible)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1 + start)  # at most ``visible`` rows


def blob_offsets(chunks: DataFrame, group: str = "worker_id", length: str = "len", order: str = "seq") -> DataFrame:
    """Where each payload would start in its worker's append-only file."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))
