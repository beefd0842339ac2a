"""The driver's tables as keyed, versioned rows, in Spark and (as SQL text) for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import split_pages

EPOCH = "1995-01-01"
STRIDE = 64  # pages per document at most
#: Versions of document pages: snapshot ids and what becomes of a page's hex digits.
VERSIONS = (0, 10, 20, 30)

ORDERS_SQL = f"SELECT o_custkey pa, date_diff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE)) snapshot_id, o_orderkey seq, o_totalprice FROM orders"
EVENTS_SQL = "SELECT user_id pa, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 10) AS BIGINT) snapshot_id, event_id seq, event_type, value FROM events"
CONV_SQL = "SELECT conv_id pa, turn snapshot_id, role, text FROM conversations"
DOCPAGES_SQL = f"""SELECT doc_id * {STRIDE} + i pa, rpad(substr(hex(encode(text)), i * 8192 + 1, 8192), 8192, '0') h
FROM (SELECT doc_id, text, unnest(range((strlen(text) - 1) // 4096 + 1)) i FROM documents WHERE strlen(text) > 0)"""
VERSIONS_SQL = f"""SELECT pa, s snapshot_id, CASE s WHEN 0 THEN h
  WHEN 10 THEN substr(h, 1, 16) || 'FFEEDDCCBBAA9988' || substr(h, 33)
  WHEN 20 THEN CASE WHEN pa % 2 = 0 THEN replace(h, '65', '45') ELSE substr(h, 1, 160) || 'AB' || substr(h, 163) END
  ELSE CASE WHEN pa % 5 = 0 THEN repeat('0', 8192) ELSE substr(h, 1, 320) || 'CD' || substr(h, 323) END END h
FROM ({DOCPAGES_SQL}), (VALUES (0), (10), (20), (30)) v(s)
WHERE s = 0 OR s = 10 AND pa % 3 = 0 OR s = 20 OR s = 30 AND pa % 7 < 5"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit(EPOCH).cast("date"))
    return o.select(F.col("o_custkey").alias("pa"), day.alias("snapshot_id"), F.col("o_orderkey").alias("seq"), "o_totalprice")


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.select(F.col("user_id").alias("pa"), F.floor(seconds / 10).cast("int").alias("snapshot_id"), F.col("event_id").alias("seq"), "event_type", "value")


def v_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pa"), F.col("turn").cast("int").alias("snapshot_id"), "role", "text")


def v_docpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("image"))
    return split_pages(d, "image", F.col("doc_id") * STRIDE, STRIDE).select("pa", "page")


def v_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pa, snapshot_id, page): document pages edited over four snapshots."""
    h, pa, s = F.col("h"), F.col("pa"), F.col("snapshot_id")
    d = v_docpages(spark, sf_dir).select("pa", F.hex("page").alias("h")).withColumn("snapshot_id", F.explode(F.array(*map(F.lit, VERSIONS))))
    d = d.where((s == 0) | ((s == 10) & (pa % 3 == 0)) | (s == 20) | ((s == 30) & (pa % 7 < 5)))
    put = lambda at, digits: F.concat(F.substring(h, 1, at), F.lit(digits), F.substring(h, at + len(digits) + 1, 8192))
    second = F.when(pa % 2 == 0, F.replace(h, F.lit("65"), F.lit("45"))).otherwise(put(160, "AB"))
    third = F.when(pa % 5 == 0, F.repeat(F.lit("0"), F.lit(8192))).otherwise(put(320, "CD"))
    edited = F.when(s == 0, h).when(s == 10, put(16, "FFEEDDCCBBAA9988")).when(s == 20, second).otherwise(third)
    return d.select("pa", "snapshot_id", F.unhex(edited).alias("page"))
