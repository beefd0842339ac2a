"""Registered queries that go through stores and files: save, load, convert, purge, export, cache."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintain
from ..operators.encode import resolve
from ..schema import MAX_SNAPSHOT, ZERO
from ..sources import files, page_cache, raw_export, records
from ..sources.scratch import file_path, scratch_folder
from ..sources.store import Store
from ..sources.timing import Timings, write_latencies
from .queries import LOAD_RANGE_SQL, fold_sql, long_snapshot, page_count, query
from .views import DOCPAGES_SQL, VERSIONS, VERSIONS_SQL, table, v_docpages, v_versions

WORKERS, THRESHOLD = 5, 64
_stores: dict[tuple[str, str], str] = {}
_folders: dict[tuple[str, str], str] = {}


def md5(page: str = "page"):
    return F.md5(F.hex(page).cast("binary")).alias("page_md5")


def whole_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store with all versions of all document pages, one save a snapshot; made once a session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        s = Store.create(spark, scratch_folder(spark, "store"), workers=WORKERS, threshold=THRESHOLD)
        d = v_versions(spark, sf_dir)
        for snapshot_id in VERSIONS:
            s.save(d.where(F.col("snapshot_id") == snapshot_id).select("pa", "page"), snapshot_id)
        _stores[key] = s.path
    return Store.open(spark, _stores[key])


def whole_folder(spark: SparkSession, sf_dir: str) -> str:
    """Record files (log and index) of the same chunks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        folder = scratch_folder(spark, "files")
        found = files.write_files(whole_store(spark, sf_dir).chunks(), folder, WORKERS)
        files.write_records(maintain.by_address(found), f"{file_path(folder)}/{files.OWN.names['index']}", "index")
        _folders[key] = folder
    return _folders[key]


def own_folder(spark: SparkSession, sf_dir: str) -> str:
    """Record files of its own, for queries that change them."""
    folder = scratch_folder(spark, "files")
    files.write_files(whole_store(spark, sf_dir).chunks(), folder, WORKERS)
    return folder


KINDS_SQL = f"SELECT pa, snapshot_id, kind, base_snapshot, pa % 5 worker_id FROM ({fold_sql(THRESHOLD)})"


def kinds(d: DataFrame, *more: str) -> DataFrame:
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), F.col("kind").cast("int").alias("kind"), F.col("base_snapshot").cast("bigint").alias("base_snapshot"), F.col("worker_id").cast("bigint").alias("worker_id"), *more)


@query(KINDS_SQL)
def store_save(spark, sf_dir):
    return kinds(whole_store(spark, sf_dir).chunks())


@query(f"SELECT pa, md5(h) page_md5 FROM ({VERSIONS_SQL}) WHERE snapshot_id = 20 AND pa % 3 = 1")
def store_save_bitmap(spark, sf_dir):
    s = Store.create(spark, scratch_folder(spark, "store"), workers=WORKERS)
    pages = v_versions(spark, sf_dir).where("snapshot_id = 20").select("pa", "page")
    marked = v_docpages(spark, sf_dir).where("pa % 3 = 1")
    words = marked.groupBy(F.floor(F.col("pa") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pa % 64 AS INT))")).alias("word"))
    s.save(pages, 20, dirty=words, page_count=page_count(spark, sf_dir))
    return s.all_versions().select("pa", md5())


@query(LOAD_RANGE_SQL)
def store_load_range(spark, sf_dir):
    return whole_store(spark, sf_dir).load_range(0, page_count(spark, sf_dir), 25).select("pa", md5(), "found")


@query(f"SELECT d.pa, 15::BIGINT snapshot_id, md5(f.h) page_md5 FROM ({DOCPAGES_SQL}) d LEFT JOIN (SELECT pa, arg_max(h, snapshot_id) h FROM ({VERSIONS_SQL}) WHERE snapshot_id <= 15 GROUP BY pa) f USING (pa)")
def store_load_pages(spark, sf_dir):
    probes = v_docpages(spark, sf_dir).select("pa", F.lit(15).alias("snapshot_id"))
    return long_snapshot(whole_store(spark, sf_dir).load_pages(probes).select("pa", "snapshot_id", md5()))


@query(f"SELECT pa, md5(arg_max(h, snapshot_id)) page_md5 FROM ({VERSIONS_SQL}) WHERE snapshot_id <= 25 AND pa = (SELECT min(pa) FROM ({DOCPAGES_SQL})) GROUP BY pa")
def store_load_page(spark, sf_dir):
    pa = v_docpages(spark, sf_dir).agg(F.min("pa")).first()[0]
    page = whole_store(spark, sf_dir).load_page(pa, 25)
    return spark.createDataFrame([(pa, bytearray(page))], "pa bigint, page binary").select("pa", md5())


ALL_SQL = f"SELECT pa, snapshot_id::BIGINT snapshot_id, md5(h) page_md5 FROM ({VERSIONS_SQL})"


@query(ALL_SQL)
def store_replay(spark, sf_dir):
    return long_snapshot(whole_store(spark, sf_dir).all_versions().select("pa", "snapshot_id", md5()))


@query("SELECT 2 format_version, 'log' layout, 30 max_snapshot_id, 4 batches, 5 workers, 64 threshold")
def store_open(spark, sf_dir):
    return whole_store(spark, sf_dir).info()


@query(f"SELECT *, 'index' layout FROM ({KINDS_SQL})")
def store_to_index(spark, sf_dir):
    s = whole_store(spark, sf_dir).branch(scratch_folder(spark, "store"))
    s.to_index()
    return kinds(s.chunks()).withColumn("layout", F.lit(Store.open(spark, s.path).layout))


@query(ALL_SQL)
def store_round_trip(spark, sf_dir):
    s = whole_store(spark, sf_dir).branch(scratch_folder(spark, "store"))
    s.to_index()
    s.to_log()
    return long_snapshot(Store.open(spark, s.path).all_versions().select("pa", "snapshot_id", md5()))


@query(f"SELECT pa, snapshot_id, kind, (SELECT count(*) FROM ({VERSIONS_SQL}) WHERE snapshot_id > 15) removed, 10 AS max_snapshot_id FROM ({KINDS_SQL}) WHERE snapshot_id <= 15")
def store_purge(spark, sf_dir):
    s = whole_store(spark, sf_dir).branch(scratch_folder(spark, "store"))
    removed = s.purge(15)
    return kinds(s.chunks()).select("pa", "snapshot_id", "kind", F.lit(removed).cast("bigint").alias("removed"), F.lit(s.max_snapshot_id).alias("max_snapshot_id"))


@query(f"SELECT pa, md5(h) page_md5 FROM ({VERSIONS_SQL}) WHERE snapshot_id = 20")
def store_save_after_purge(spark, sf_dir):
    s = whole_store(spark, sf_dir).branch(scratch_folder(spark, "store"))
    s.purge(15)
    s.save(v_versions(spark, sf_dir).where("snapshot_id = 20").select("pa", "page"), 16)
    return resolve(s.chunks().where("snapshot_id = 16"), s.chunks()).select("pa", md5())


@query("SELECT 1 gone, 1 left_over")
def store_vacuum(spark, sf_dir):
    s = whole_store(spark, sf_dir).branch(scratch_folder(spark, "store"))
    s.to_index()
    s.to_log()
    return spark.createDataFrame([(s.vacuum(), len(s.manifest["batches"]))], "gone int, left_over int")


@query("SELECT 0::BIGINT pa, 0 snapshot_id, '' error WHERE false")
def store_check(spark, sf_dir):
    return whole_store(spark, sf_dir).check()


@query(f"SELECT pa, snapshot_id, kind, base_snapshot, pa % 5 worker_id, row_number() OVER (ORDER BY snapshot_id, pa) - 1 AS seq FROM ({fold_sql(THRESHOLD)})")
def files_log_scan(spark, sf_dir):
    return kinds(files.record_rows(spark, f"{file_path(whole_folder(spark, sf_dir))}/{files.OWN.names['log']}", "log"), "seq")


@query(f"SELECT pa, snapshot_id, kind, base_snapshot, pa % 5 worker_id, row_number() OVER (ORDER BY pa, snapshot_id) - 1 AS seq FROM ({fold_sql(THRESHOLD)})")
def files_index_scan(spark, sf_dir):
    return kinds(files.record_rows(spark, f"{file_path(whole_folder(spark, sf_dir))}/{files.OWN.names['index']}", "index"), "seq")


@query("SELECT unnest(['index', 'log']) layout, 30 max_snapshot_id, 25 updated")
def files_headers(spark, sf_dir):
    folder, rows = file_path(own_folder(spark, sf_dir)), []
    files.write_records(files.open_files(spark, folder)[1], f"{folder}/{files.OWN.names['index']}", "index")
    for name in sorted(files.OWN.names.values()):
        layout = records.detect_layout(f"{folder}/{name}", files.OWN.magics)
        tops = []
        for _ in range(2):
            with open(f"{folder}/{name}", "rb") as f:
                tops.append(records.read_header(f.read(records.HEADER), files.OWN.magics[layout]))
            records.update_header(f"{folder}/{name}", files.OWN.magics[layout], 25)
        rows.append((layout, *tops))
    return spark.createDataFrame(rows, "layout string, max_snapshot_id int, updated int")


@query(f"SELECT pa % 5 worker_id, count(*) records, true fits FROM ({fold_sql(THRESHOLD)}) WHERE kind <> 2 GROUP BY 1")
def files_blob_sizes(spark, sf_dir):
    folder = whole_folder(spark, sf_dir)
    rows = files.with_blob_size(files.open_files(spark, folder)[1].where(F.col("kind") != ZERO), files.blob_files(spark, folder))
    d = rows.groupBy(F.col("worker_id").cast("bigint").alias("worker_id"))
    return d.agg(F.count("*").alias("records"), (F.max(F.col("offset") + F.col("len")) == F.max("blob_size")).alias("fits"))


@query(ALL_SQL)
def files_load(spark, sf_dir):
    c = files.load_files(spark, whole_folder(spark, sf_dir))
    return long_snapshot(resolve(c, c).select("pa", "snapshot_id", md5()))


@query(f"SELECT pa, snapshot_id, 'worker has no blob file' error FROM ({fold_sql(THRESHOLD)}) WHERE pa % 5 = 3")
def files_check(spark, sf_dir):
    folder = own_folder(spark, sf_dir)
    if os.path.exists(lost := f"{file_path(folder)}/blobs/worker_3.blob"):
        os.remove(lost)
    return long_snapshot(files.check_files(spark, folder))


@query("SELECT 2::BIGINT worker_id")
def files_unused_blobs(spark, sf_dir):
    folder = whole_folder(spark, sf_dir)
    kept = files.open_files(spark, folder)[1].where("worker_id <> 2")
    return files.unused_blobs(kept, files.blob_files(spark, folder)).select(F.col("worker_id").cast("bigint").alias("worker_id"))


@query(f"SELECT pa % 5 worker_id, true cut FROM ({fold_sql(THRESHOLD)}) WHERE kind <> 2 AND snapshot_id = 0 AND pa % 5 <> 2 GROUP BY 1")
def files_truncate(spark, sf_dir):
    folder = own_folder(spark, sf_dir)
    kept = files.open_files(spark, folder)[1].where("snapshot_id = 0 AND worker_id <> 2")
    files.truncate_blobs(spark, folder, kept)
    d = files.blob_files(spark, folder).join(maintain.blob_ends(kept), "worker_id", "left")
    return d.select(F.col("worker_id").cast("bigint").alias("worker_id"), (F.col("blob_size") == F.col("file_size")).alias("cut"))


CHAIN_SQL = f"({VERSIONS_SQL}) WHERE snapshot_id > 0 OR h <> repeat('0', 8192)"


@query(f"SELECT pa, snapshot_id, md5(h) page_md5, 30 top FROM {CHAIN_SQL}")
def raw_chain(spark, sf_dir):
    folder = scratch_folder(spark, "chain")
    raw_export.write_raw(v_versions(spark, sf_dir), folder)
    d = raw_export.raw_chain(spark, folder).select("pa", "snapshot_id", md5(), F.lit(raw_export.chain_top(folder)).alias("top"))
    return d.withColumn("snapshot_id", F.col("snapshot_id").cast("int"))


@query(f"SELECT 4096 bytes, md5(h) page_md5 FROM ({VERSIONS_SQL}) WHERE snapshot_id = 0 AND pa = (SELECT min(pa) FROM ({DOCPAGES_SQL}))")
def export_page(spark, sf_dir):
    pa = v_docpages(spark, sf_dir).agg(F.min("pa")).first()[0]
    folder = scratch_folder(spark, "page")
    os.makedirs(file_path(folder))
    n = raw_export.export_page(whole_store(spark, sf_dir).chunks(), pa, 0, f"{folder}/page")
    d = spark.read.format("binaryFile").load(f"file://{file_path(folder)}/page")
    return d.select(F.lit(n).alias("bytes"), md5("content"))


ACCESS_SQL = "SELECT o_custkey << 19 AS key, o_orderkey seq FROM orders"
SET_SQL = f"(key % {page_cache.MODULUS} * {page_cache.MULTIPLIER} % {page_cache.MODULUS} % 64)"


def accesses(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.shiftleft("o_custkey", 19).alias("key"), F.col("o_orderkey").alias("seq"))


@query(f"""WITH l AS (SELECT key, max(seq) seq FROM ({ACCESS_SQL}) GROUP BY key)
SELECT {SET_SQL}::INT AS set, key, (row_number() OVER (PARTITION BY {SET_SQL} ORDER BY seq DESC, key DESC) - 1)::INT age FROM l QUALIFY age < 16""")
def cache_slots(spark, sf_dir):
    return page_cache.resident_slots(accesses(spark, sf_dir), sets=64)


@query(f"WITH l AS (SELECT {SET_SQL} s, count(DISTINCT key) n FROM ({ACCESS_SQL}) GROUP BY 1) SELECT 1024::BIGINT total_slots, sum(least(n, 16))::BIGINT used_slots, (sum(n) - sum(least(n, 16)))::BIGINT evicted FROM l")
def cache_occupancy(spark, sf_dir):
    return page_cache.occupancy(accesses(spark, sf_dir), sets=64)


@query("SELECT 1024::BIGINT total_slots, 1::BIGINT used_slots, 2::BIGINT hits, 1::BIGINT misses, true same, true deleted")
def cache_reads(spark, sf_dir):
    s, path = whole_store(spark, sf_dir), file_path(scratch_folder(spark, "cache"))
    pa = v_docpages(spark, sf_dir).agg(F.min("pa")).first()[0]
    cache = page_cache.PageCache.create(path, s.path, sets=64)
    read = [s.load_page(pa, 5, cache=cache) for _ in range(3)]
    r = page_cache.PageCache.open(path, s.path).report() | {k: cache.report()[k] for k in ("hits", "misses")}
    cache.delete(path)
    row = (r["total_slots"], r["used_slots"], r["hits"], r["misses"], set(read) == {s.load_page(pa, 5)}, not os.listdir(path))
    return spark.createDataFrame([row], "total_slots bigint, used_slots bigint, hits bigint, misses bigint, same boolean, deleted boolean")


@query("SELECT unnest(['load_page', 'load_range']) phase, unnest([2, 1])::BIGINT calls")
def call_counters(spark, sf_dir):
    s = whole_store(spark, sf_dir)
    s.load_range(0, 64, MAX_SNAPSHOT)
    for snapshot_id in (0, 30):
        s.load_page(0, snapshot_id)
    return s.timings.rows(spark).select("phase", "calls")


@query("SELECT 'scan' phase, 2::BIGINT calls")
def timing_report(spark, sf_dir):
    folder, t = scratch_folder(spark, "timing"), Timings()
    for _ in range(2):
        with t.phase("scan"):
            table(spark, sf_dir, "region").count()
    os.makedirs(file_path(folder))
    t.write(f"{file_path(folder)}/timing.json")
    d = spark.read.json(f"file://{file_path(folder)}/timing.json")
    return d.select(F.lit("scan").alias("phase"), F.col("scan.calls").alias("calls"))


@query("SELECT 3 process_id, unnest([0, 1, 2])::BIGINT access_idx, unnest([0, 64, 128])::BIGINT page_idx")
def latency_csv(spark, sf_dir):
    folder = f"{scratch_folder(spark, 'latency')}/log"
    write_latencies(whole_store(spark, sf_dir), [(0, 0), (64, 10), (128, 20)], folder, process_id=3)
    d = spark.read.csv(folder, header=True, schema="process_id int, access_idx bigint, page_idx bigint, latency_ns bigint")
    return d.where("latency_ns > 0").drop("latency_ns")
