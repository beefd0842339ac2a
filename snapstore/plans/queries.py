"""Registered queries of the page store's operators, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, pages
from ..functions.codec import apply_patch, changed_words, compress_page, decode_patch, decompress_page, encode_patch, xor_patch
from ..operators import maintain, versions
from ..operators.encode import encode_batch, encode_history, latest_full, resolve, resolve_at, with_bases
from ..operators.ranges import with_places, with_sums_before
from ..schema import DELTA, FULL, ZERO
from ..sources.raw_export import export_plan
from ..sources.raw_export import ordered_dirty_set as export_dirty_set
from .views import CONV_SQL, DOCPAGES_SQL, EVENTS_SQL, ORDERS_SQL, VERSIONS_SQL, table, v_conv, v_docpages, v_events, v_orders, v_versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


FIRST_ORDERS = f"SELECT * FROM ({ORDERS_SQL}) QUALIFY row_number() OVER (PARTITION BY pa, snapshot_id ORDER BY seq) = 1"
FIRST_EVENTS = f"SELECT * FROM ({EVENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY pa, snapshot_id ORDER BY seq) = 1"
#: A page's hex digits as its 512 words.
CUT = "regexp_extract_all({}, '[0-9A-F]{{16}}')"


def fold_sql(threshold: int) -> str:
    """The fold of a page's four possible versions, step by step: words that differ, then kinds and bases."""
    snaps = (0, 10, 20, 30)
    pairs = [(i, j) for j in range(4) for i in range(j)]
    steps = ["s0 AS (SELECT *, CASE WHEN h0 IS NULL THEN NULL WHEN z0 THEN 2 ELSE 0 END k0, CASE WHEN NOT z0 THEN 0 END b0, NULL::INT x0, NULL::INT f0 FROM m)"]
    for j in range(1, 4):
        x = "CASE b" + str(j - 1) + "".join(f" WHEN {snaps[i]} THEN d{i}{j}" for i in range(j)) + " END"
        steps.append(f"t{j} AS (SELECT *, {x} x{j} FROM s{j - 1})")
        steps.append(f"u{j} AS (SELECT *, CASE WHEN h{j} IS NULL THEN NULL WHEN z{j} THEN 2 WHEN x{j} <= {threshold} THEN 1 ELSE 0 END k{j}, b{j - 1} f{j} FROM t{j})")
        steps.append(f"s{j} AS (SELECT *, CASE WHEN k{j} = 0 THEN {snaps[j]} ELSE b{j - 1} END b{j} FROM u{j})")
    out = " UNION ALL ".join(f"SELECT pa, {snaps[j]}::BIGINT snapshot_id, k{j} kind, CASE WHEN k{j} = 1 THEN f{j} END::BIGINT base_snapshot, CASE WHEN k{j} = 1 THEN x{j} ELSE 0 END::BIGINT words FROM s3 WHERE k{j} IS NOT NULL" for j in range(4))
    return f"""WITH p AS MATERIALIZED (SELECT pa, {", ".join(f"max(h) FILTER (snapshot_id = {s}) h{j}" for j, s in enumerate(snaps))} FROM ({VERSIONS_SQL}) GROUP BY pa),
w AS (SELECT pa, {", ".join(f"unnest({CUT.format(f'h{j}')}) w{j}" for j in range(4))} FROM p),
d AS MATERIALIZED (SELECT pa, {", ".join(f"count(*) FILTER (w{i} <> w{j}) d{i}{j}" for i, j in pairs)} FROM w GROUP BY pa),
m AS MATERIALIZED (SELECT p.*, d.* EXCLUDE (pa), {", ".join(f"h{j} = repeat('0', 8192) z{j}" for j in range(4))} FROM p JOIN d USING (pa)),
{", ".join(steps)} {out}"""


def chunk_rows(spark: SparkSession, sf_dir: str, threshold: int = 64) -> DataFrame:
    return encode_history(v_versions(spark, sf_dir), threshold)


@query(f"SELECT pa, max(snapshot_id)::BIGINT snapshot_id, arg_max(seq, snapshot_id) seq, arg_max(o_totalprice, snapshot_id) o_totalprice FROM ({FIRST_ORDERS}) WHERE snapshot_id <= 1000 GROUP BY pa")
def floor_orders_at(spark, sf_dir):
    d = versions.floor_at(versions.first_writes(v_orders(spark, sf_dir), "seq"), 1000)
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "seq", "o_totalprice")


@query(f"SELECT pa, snapshot_id, seq, o_totalprice FROM ({FIRST_ORDERS}) WHERE pa = 7 AND snapshot_id <= 1500 ORDER BY snapshot_id DESC LIMIT 1")
def floor_point(spark, sf_dir):
    d = versions.floor_point(versions.first_writes(v_orders(spark, sf_dir), "seq"), 7, 1500)
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "seq", "o_totalprice")


@query(f"SELECT o.pa, o.snapshot_id, o.seq FROM ({FIRST_ORDERS}) o JOIN (SELECT DISTINCT pa, snapshot_id FROM ({ORDERS_SQL})) k USING (pa, snapshot_id)")
def exact_lookup(spark, sf_dir):
    o = v_orders(spark, sf_dir)
    d = versions.exact(versions.first_writes(o, "seq"), o.select("pa", "snapshot_id").distinct())
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "seq")


@query(f"""SELECT p.pa, p.snapshot_id, p.probe, e.snapshot_id found_snapshot, e.seq, e.value
FROM (SELECT o_custkey % 200 pa, (o_orderkey * 37) % 259200 snapshot_id, o_orderkey probe FROM orders) p
ASOF LEFT JOIN ({FIRST_EVENTS}) e ON p.pa = e.pa AND p.snapshot_id >= e.snapshot_id""")
def asof_events_probe(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("pa"), ((F.col("o_orderkey") * 37) % 259200).cast("int").alias("snapshot_id"), F.col("o_orderkey").alias("probe"))
    d = versions.as_of(probes, versions.first_writes(v_events(spark, sf_dir), "seq"), "seq", "value")
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "probe", F.col("found_snapshot").cast("bigint").alias("found_snapshot"), "seq", "value")


@query(f"""SELECT r.pa, coalesce(f.o_totalprice, 0) o_totalprice, f.pa IS NOT NULL AS found FROM (SELECT unnest(range(50, 250)) pa) r
LEFT JOIN (SELECT pa, arg_max(o_totalprice, snapshot_id) o_totalprice FROM ({FIRST_ORDERS}) WHERE snapshot_id <= 300 GROUP BY pa) f USING (pa)""")
def dense_range_fill(spark, sf_dir):
    d = versions.floor_at(versions.first_writes(v_orders(spark, sf_dir), "seq"), 300, 50, 250).select("pa", "o_totalprice")
    return versions.dense(d, 50, 200, o_totalprice=F.lit(0.0))


@query(f"SELECT bool_and(f.pa IS NOT NULL) all_found, count(f.pa) hits FROM (SELECT unnest(range(50, 250)) pa) r LEFT JOIN (SELECT DISTINCT pa FROM ({FIRST_ORDERS}) WHERE snapshot_id <= 300) f USING (pa)")
def dense_range_success(spark, sf_dir):
    d = dense_range_fill(spark, sf_dir)
    return d.agg(F.bool_and("found").alias("all_found"), F.count_if("found").alias("hits"))


@query(f"SELECT pa, snapshot_id, seq, o_totalprice FROM ({FIRST_ORDERS})")
def first_write_wins(spark, sf_dir):
    return versions.first_writes(v_orders(spark, sf_dir), "seq").withColumn("snapshot_id", F.col("snapshot_id").cast("bigint"))


@query(f"SELECT pa, snapshot_id, (pa << 19) | snapshot_id AS key, ((pa << 19) | snapshot_id) >> 19 AS pa_back, ((pa << 19) | snapshot_id) & 524287 AS snapshot_back FROM ({ORDERS_SQL})")
def key_pack_unpack(spark, sf_dir):
    d = v_orders(spark, sf_dir).withColumn("key", keys.pack_key("pa", "snapshot_id"))
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "key", keys.key_pa("key").alias("pa_back"), keys.key_snapshot("key").cast("bigint").alias("snapshot_back"))


DIRTY_SQL = "SELECT DISTINCT o_custkey // 64 w, o_custkey pa FROM orders WHERE o_custkey IS NOT NULL"


def dirty_words(spark, sf_dir):
    """(w, word): a bitmap of the customers with orders, each word a row."""
    bit = F.expr("shiftleft(1L, CAST(o_custkey % 64 AS INT))")
    o = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL")
    return o.groupBy(F.floor(F.col("o_custkey") / 64).alias("w")).agg(F.bit_or(bit).alias("word"))


@query(DIRTY_SQL)
def bitmap_expand(spark, sf_dir):
    return pages.word_pages(dirty_words(spark, sf_dir))


@query(f"SELECT w, pa FROM ({DIRTY_SQL}) WHERE pa < (SELECT max(o_custkey) - 10 FROM orders)")
def bitmap_mask(spark, sf_dir):
    top = table(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0] or 0
    return pages.word_pages(pages.masked_words(dirty_words(spark, sf_dir), top - 10))


@query(f"SELECT w, dirty, coalesce(sum(dirty) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT slots_before FROM (SELECT w, count(*) dirty FROM ({DIRTY_SQL}) GROUP BY 1)")
def bitmap_popcount(spark, sf_dir):
    d = dirty_words(spark, sf_dir).withColumn("words", F.array("word")).select("w", pages.dirty_count("words").alias("dirty"))
    return with_sums_before(d, F.col("w"), "dirty", "w", name="slots_before")


@query(f'SELECT pa // 4096 "group", count(*) dirty FROM ({DIRTY_SQL}) GROUP BY 1')
def group_popcount(spark, sf_dir):
    return pages.group_counts(dirty_words(spark, sf_dir))


@query(f"SELECT count(*) total FROM ({DIRTY_SQL})")
def dirty_total(spark, sf_dir):
    return pages.dirty_total(dirty_words(spark, sf_dir))


@query("SELECT o_custkey % 7 worker_id, count(*) records, max(o_orderkey) last_seq FROM orders GROUP BY 1")
def worker_routing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("worker_id", keys.worker_of("o_custkey", 7).cast("bigint"))
    return o.groupBy("worker_id").agg(F.count("*").alias("records"), F.max("o_orderkey").alias("last_seq"))


@query(f"SELECT seq, worker_id, len, coalesce(sum(len) OVER (PARTITION BY worker_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT o_orderkey seq, o_custkey % 7 worker_id, o_orderkey % 100 len FROM orders)")
def prefix_sum_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), keys.worker_of("o_custkey", 7).cast("bigint").alias("worker_id"), (F.col("o_orderkey") % 100).alias("len"))
    return maintain.blob_offsets(d)


@query(f"SELECT pa, snapshot_id, lead(snapshot_id) OVER (PARTITION BY pa ORDER BY snapshot_id) valid_to FROM ({CONV_SQL})")
def validity_intervals(spark, sf_dir):
    d = versions.validity(v_conv(spark, sf_dir))
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), F.col("valid_to").cast("bigint").alias("valid_to"))


@query(f"SELECT pa, md5(h) page_md5 FROM ({DOCPAGES_SQL})")
def paging_documents(spark, sf_dir):
    return v_docpages(spark, sf_dir).select("pa", F.md5(F.hex("page").cast("binary")).alias("page_md5"))


@query("""SELECT page_id * 64 + i pa, md5(rpad(substr(hex(encode(html)), i * 8192 + 1, 8192), 8192, '0')) page_md5
FROM (SELECT page_id, html, unnest(range((strlen(html) - 1) // 4096 + 1)) i FROM pages WHERE strlen(html) > 0)""")
def paging_html(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("image"))
    return pages.split_pages(d, "image", F.col("page_id") * 64, 64).select("pa", F.md5(F.hex("page").cast("binary")).alias("page_md5"))


@query(f"SELECT snapshot_id, count(*) n, count(*) FILTER (h = repeat('0', 8192)) zero_pages FROM ({VERSIONS_SQL}) GROUP BY 1")
def zero_page_detect(spark, sf_dir):
    d = v_versions(spark, sf_dir).groupBy("snapshot_id").agg(F.count("*").alias("n"), F.count_if(pages.is_zero("page")).alias("zero_pages"))
    return d.withColumn("snapshot_id", F.col("snapshot_id").cast("int"))


def page_pairs(spark, sf_dir):
    d = v_versions(spark, sf_dir)
    base = d.where("snapshot_id = 0").select("pa", F.col("page").alias("base"))
    return base.join(d.where("snapshot_id = 20").select("pa", "page"), "pa")


PAIRS_SQL = f"(SELECT a.pa, a.h ha, b.h hb FROM ({VERSIONS_SQL}) a JOIN ({VERSIONS_SQL}) b ON a.pa = b.pa AND a.snapshot_id = 0 AND b.snapshot_id = 20)"
PAIR_WORDS_SQL = f"(SELECT pa, unnest(range(512)) w, unnest({CUT.format('ha')}) wa, unnest({CUT.format('hb')}) wb FROM {PAIRS_SQL})"
SWAP = lambda h: "(" + " || ".join(f"substr({h}, {k}, 2)" for k in range(15, 0, -2)) + ")"


@query(f"SELECT pa, w, xor(('0x' || {SWAP('wa')})::UBIGINT, ('0x' || {SWAP('wb')})::UBIGINT)::VARCHAR x FROM {PAIR_WORDS_SQL} WHERE wa <> wb")
def xor_patch_words(spark, sf_dir):
    d = page_pairs(spark, sf_dir).select("pa", F.explode(xor_patch("base", "page")).alias("e"))
    return d.select("pa", F.col("e.w").cast("bigint").alias("w"), F.conv(F.hex("e.x"), 16, 10).alias("x"))


@query(f"SELECT pa, count(*) FILTER (wa <> wb) words FROM {PAIR_WORDS_SQL} GROUP BY pa")
def patch_size(spark, sf_dir):
    return page_pairs(spark, sf_dir).select("pa", changed_words("base", "page").cast("bigint").alias("words"))


@query(f"SELECT pa, md5(hb) page_md5 FROM {PAIRS_SQL}")
def patch_apply_roundtrip(spark, sf_dir):
    d = page_pairs(spark, sf_dir).select("pa", apply_patch("base", xor_patch("base", "page")).alias("page"))
    return d.select("pa", F.md5(F.hex("page").cast("binary")).alias("page_md5"))


@query(f"""SELECT pa, CASE WHEN any_value(hb) = repeat('0', 8192) THEN 2 WHEN any_value(ha) <> repeat('0', 8192) AND count(*) FILTER (wa <> wb) <= 64 THEN 1 ELSE 0 END kind
FROM (SELECT b.pa, a.h ha, b.h hb, unnest({CUT.format("a.h")}) wa, unnest({CUT.format("b.h")}) wb FROM ({VERSIONS_SQL}) b JOIN ({VERSIONS_SQL}) a ON a.pa = b.pa AND a.snapshot_id = 0 WHERE b.snapshot_id = 30) GROUP BY pa""")
def adaptive_kind_batch(spark, sf_dir):
    d = v_versions(spark, sf_dir)
    first = encode_batch(d.where("snapshot_id = 0"), None)
    return encode_batch(d.where("snapshot_id = 30"), latest_full(first), 64).select("pa", F.col("kind").cast("int").alias("kind"))


@query(f"SELECT pa, snapshot_id, kind, base_snapshot, words FROM ({fold_sql(64)})")
def adaptive_kind_fold(spark, sf_dir):
    d = chunk_rows(spark, sf_dir)
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), F.col("kind").cast("int").alias("kind"), F.col("base_snapshot").cast("bigint").alias("base_snapshot"), F.coalesce(F.size("patch"), F.lit(0)).cast("bigint").alias("words")).withColumn("words", F.greatest("words", F.lit(0)))


@query(f"WITH c AS MATERIALIZED ({fold_sql(64)}) SELECT d.pa, d.snapshot_id, f.snapshot_id base_found FROM c d LEFT JOIN c f ON f.pa = d.pa AND f.snapshot_id = d.base_snapshot AND f.kind = 0 WHERE d.kind = 1")
def delta_base_join(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    d = with_bases(c.where(F.col("kind") == DELTA), c)
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), F.when(F.col("base_page").isNotNull(), F.col("base_snapshot")).cast("bigint").alias("base_found"))


@query(f"WITH c AS MATERIALIZED ({fold_sql(64)}) SELECT pa, snapshot_id FROM c d WHERE kind = 1 AND (pa % 11 = 0 OR NOT EXISTS (SELECT 1 FROM c f WHERE f.pa = d.pa AND f.snapshot_id = d.base_snapshot AND f.kind = 0))")
def orphan_deltas(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    holed = c.where((F.col("kind") == DELTA) | (F.col("pa") % 11 != 0))  # full pages of some addresses are lost
    return maintain.orphan_deltas(holed).select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"))


@query(f"SELECT pa, snapshot_id::BIGINT snapshot_id, md5(h) page_md5 FROM ({VERSIONS_SQL})")
def resolve_all_versions(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    return resolve(c, c).select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), F.md5(F.hex("page").cast("binary")).alias("page_md5"))


LOAD_RANGE_SQL = f"""SELECT r.pa, md5(coalesce(f.h, repeat('0', 8192))) page_md5, f.pa IS NOT NULL AS found FROM (SELECT unnest(range(0, (SELECT max(pa) + 1 FROM ({DOCPAGES_SQL})))) pa) r
LEFT JOIN (SELECT pa, arg_max(h, snapshot_id) h FROM ({VERSIONS_SQL}) WHERE snapshot_id <= 25 GROUP BY pa) f USING (pa)"""


def page_count(spark, sf_dir):
    last = v_docpages(spark, sf_dir).agg(F.max("pa")).first()[0]
    return 0 if last is None else last + 1


@query(LOAD_RANGE_SQL)
def load_range_as_of(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    md5 = lambda page: F.md5(F.hex(page).cast("binary"))
    found = resolve_at(c, 25).select("pa", md5(F.col("page")).alias("page_md5"))  # sums of pages, not pages, meet the range
    d = versions.dense(found, 0, page_count(spark, sf_dir), page_md5=md5(pages.zero_page()))
    return d.select("pa", "page_md5", "found")


@query(f"SELECT pa, snapshot_id, seq FROM ({FIRST_ORDERS}) WHERE snapshot_id <= 1200")
def purge_keep(spark, sf_dir):
    d = maintain.purge(versions.first_writes(v_orders(spark, sf_dir), "seq"), 1200)
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "seq")


@query(f"SELECT count(*) FILTER (snapshot_id > 1200) removed, count(*) FILTER (snapshot_id <= 1200) kept, coalesce(max(snapshot_id) FILTER (snapshot_id <= 1200), 0)::INT max_snapshot_id FROM ({FIRST_ORDERS})")
def purge_summary(spark, sf_dir):
    return maintain.purge_summary(v_orders(spark, sf_dir), 1200)


@query(f"SELECT pa, snapshot_id, row_number() OVER (ORDER BY pa, snapshot_id) - 1 AS place FROM ({FIRST_ORDERS})")
def convert_index_order(spark, sf_dir):
    d = with_places(versions.first_writes(v_orders(spark, sf_dir), "seq"), F.col("pa").cast("double") * float(1 << 19) + F.col("snapshot_id"), "pa", "snapshot_id")
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "place")


@query(f"SELECT pa, snapshot_id, row_number() OVER (ORDER BY snapshot_id, pa) - 1 AS place FROM ({FIRST_ORDERS})")
def convert_log_order(spark, sf_dir):
    d = with_places(versions.first_writes(v_orders(spark, sf_dir), "seq"), F.col("snapshot_id").cast("double") * float(1 << 45) + F.col("pa"), "snapshot_id", "pa")
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), "place")


@query(f"""WITH r AS MATERIALIZED ({fold_sql(64)}), k AS MATERIALIZED (SELECT kind, count(*) records, sum(CASE kind WHEN 0 THEN 4096 WHEN 1 THEN 10 * words ELSE 0 END)::BIGINT payload_bytes, sum(CASE WHEN kind = 1 THEN 30 ELSE 22 END)::BIGINT log_bytes FROM r GROUP BY kind),
w AS (SELECT sum(records) n, sum(payload_bytes) b FROM k)
SELECT k.*, records * 100.0::DOUBLE / n records_pct, CASE WHEN b = 0 THEN 0 ELSE payload_bytes * 100.0::DOUBLE / b END bytes_pct FROM k, w""")
def stats_by_kind(spark, sf_dir):
    return maintain.stats_by_kind(chunk_rows(spark, sf_dir)).withColumn("kind", F.col("kind").cast("int"))


@query(f"SELECT count(*) total, count(*) FILTER (kind <> 2) non_zero FROM ({fold_sql(64)}) WHERE snapshot_id = 30")
def stats_snapshot(spark, sf_dir):
    return maintain.stats(chunk_rows(spark, sf_dir), 30)


@query(f"SELECT pa, snapshot_id, kind FROM ({fold_sql(64)}) WHERE snapshot_id = 20 AND pa = 128")
def inspect_filter(spark, sf_dir):
    snapshot, pa = pages.parse_filter("7 0x80 junk 20")
    d = maintain.inspect(chunk_rows(spark, sf_dir).withColumn("seq", F.col("pa")), snapshot, pa)
    return d.select("pa", F.col("snapshot_id").cast("bigint").alias("snapshot_id"), F.col("kind").cast("int").alias("kind"))


@query(f"SELECT pa, snapshot_id, seq FROM (SELECT *, lag(snapshot_id) OVER (ORDER BY seq) ls, lag(pa) OVER (ORDER BY seq) lp FROM ({ORDERS_SQL})) WHERE ls > snapshot_id OR ls = snapshot_id AND lp > pa")
def order_violations(spark, sf_dir):
    d = versions.order_violations(v_orders(spark, sf_dir).select("pa", "snapshot_id", "seq"), "seq")
    return d.withColumn("snapshot_id", F.col("snapshot_id").cast("bigint"))


@query(f"""SELECT snapshot_id, count(*) pages, min(pa) * 4096 first_address, max(pa) * 4096 last_address, ((8 + 8 * count(*) + 4095) // 4096) * 4096 data_offset,
((8 + 8 * count(*) + 4095) // 4096) * 4096 + count(*) * 4096 file_size FROM ({VERSIONS_SQL}) WHERE snapshot_id > 0 OR h <> repeat('0', 8192) GROUP BY 1""")
def raw_export_plan(spark, sf_dir):
    return export_plan(v_versions(spark, sf_dir))


@query(f"SELECT pa, md5(h) page_md5 FROM ({DOCPAGES_SQL}) WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey * 64 = pa)")
def semi_dirty_pages(spark, sf_dir):
    dirty = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 64).alias("pa"))
    return versions.dirty_pages(v_docpages(spark, sf_dir), dirty).select("pa", F.md5(F.hex("page").cast("binary")).alias("page_md5"))


@query(f"SELECT worker_id, max(\"offset\" + len)::BIGINT file_size, count(*) records FROM (SELECT pa % 5 worker_id, CASE kind WHEN 0 THEN 4096 ELSE 10 * words END len, coalesce(sum(CASE kind WHEN 0 THEN 4096 ELSE 10 * words END) OVER (PARTITION BY pa % 5 ORDER BY snapshot_id, pa ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM ({fold_sql(64)}) WHERE kind <> 2) GROUP BY 1")
def worker_file_sizes(spark, sf_dir):
    return maintain.worker_file_sizes(chunk_rows(spark, sf_dir), 5).withColumn("worker_id", F.col("worker_id").cast("bigint"))


@query("SELECT n, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0) ELSE n || ' B' END human FROM (SELECT o_orderkey * o_orderkey * 7 n FROM orders)")
def human_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.col("o_orderkey") * 7).alias("n"))
    return d.select("n", pages.human_bytes("n").alias("human"))


#: For each byte what a dump shows of it, as an SQL string.
SHOWN = "'" + "".join(chr(b) if 32 <= b <= 126 else "." for b in range(256)).replace("'", "''") + "'"
DIGIT = "instr('123456789ABCDEF', hex[{}])"
ASCII_SQL = " || ".join(f"substr({SHOWN}, {DIGIT.format(2 * k + 1)} * 16 + {DIGIT.format(2 * k + 2)} + 1, 1)" for k in range(16))


@query(f"SELECT *, {ASCII_SQL} ascii FROM (SELECT pa, unnest(range(0, 4096, 16)) \"offset\", unnest(regexp_extract_all(h, '[0-9A-F]{{32}}')) hex FROM ({DOCPAGES_SQL}))")
def hex_dump(spark, sf_dir):
    d = pages.hex_rows(v_docpages(spark, sf_dir), "page")
    return d.select("pa", F.col("offset").cast("bigint").alias("offset"), "hex", "ascii")


def long_snapshot(d):
    return d.withColumn("snapshot_id", F.col("snapshot_id").cast("bigint"))


@query(f"SELECT pa, md5(string_agg(printf('%02X%02X', w % 256, w // 256) || x, '' ORDER BY w)) patch_md5 FROM (SELECT pa, w, printf('%08X%08X', xor(('0x' || wa[1:8])::UBIGINT, ('0x' || wb[1:8])::UBIGINT), xor(('0x' || wa[9:16])::UBIGINT, ('0x' || wb[9:16])::UBIGINT)) x FROM {PAIR_WORDS_SQL} WHERE wa <> wb) GROUP BY pa")
def patch_bytes(spark, sf_dir):
    d = page_pairs(spark, sf_dir).select("pa", encode_patch(xor_patch("base", "page")).alias("bytes")).where(F.octet_length("bytes") > 0)
    return d.select("pa", F.md5(F.hex("bytes").cast("binary")).alias("patch_md5"))


@query(f"SELECT pa, md5(hb) page_md5 FROM {PAIRS_SQL}")
def patch_bytes_roundtrip(spark, sf_dir):
    d = page_pairs(spark, sf_dir).select("pa", "base", encode_patch(xor_patch("base", "page")).alias("bytes"))
    return d.select("pa", F.md5(F.hex(apply_patch("base", decode_patch("bytes"))).cast("binary")).alias("page_md5"))


@query(f"SELECT pa, md5(h) page_md5 FROM ({DOCPAGES_SQL})")
def compress_roundtrip(spark, sf_dir):
    d = v_docpages(spark, sf_dir).select("pa", compress_page("page").alias("blob"))
    return d.select("pa", F.md5(F.hex(decompress_page("blob")).cast("binary")).alias("page_md5"))


@query(f"SELECT pa, snapshot_id, CASE kind WHEN 0 THEN 'full' WHEN 1 THEN 'delta' ELSE 'zero' END kind_name FROM ({fold_sql(64)})")
def kind_names(spark, sf_dir):
    return long_snapshot(chunk_rows(spark, sf_dir).select("pa", "snapshot_id", pages.kind_name("kind").alias("kind_name")))


@query(f"SELECT pa, snapshot_id, last_value(CASE WHEN kind = 0 THEN snapshot_id END IGNORE NULLS) OVER (PARTITION BY pa ORDER BY snapshot_id)::BIGINT current_base FROM ({fold_sql(64)})")
def current_bases(spark, sf_dir):
    d = versions.current_bases(chunk_rows(spark, sf_dir).select("pa", "snapshot_id", "kind"))
    return long_snapshot(d.select("pa", "snapshot_id", F.col("current_base").cast("bigint").alias("current_base")))


@query(f"SELECT pa, snapshot_id, kind FROM ({fold_sql(64)}) QUALIFY row_number() OVER (PARTITION BY pa ORDER BY snapshot_id) = 1")
def first_versions(spark, sf_dir):
    d = versions.first_versions(chunk_rows(spark, sf_dir).select("pa", "snapshot_id", F.col("kind").cast("int").alias("kind")))
    return long_snapshot(d)


@query(f"SELECT snapshot_id, pa, row_number() OVER (PARTITION BY snapshot_id ORDER BY pa) - 1 AS place FROM ({VERSIONS_SQL})")
def ordered_dirty_set(spark, sf_dir):
    return export_dirty_set(v_versions(spark, sf_dir).select("pa", "snapshot_id"))


ATTEMPTS_SQL = "SELECT o_orderkey seq, (o_orderkey * 7919) % 600000 snapshot_id FROM orders"


@query(f"SELECT seq, snapshot_id, coalesce(snapshot_id <= 524287 AND snapshot_id > coalesce(max(CASE WHEN snapshot_id <= 524287 THEN snapshot_id END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) accepted FROM ({ATTEMPTS_SQL})")
def accepted_saves(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") * 7919) % 600000).alias("snapshot_id"))
    return versions.accepted_saves(d, "seq")


@query(f"SELECT seq, snapshot_id <= 524287 AS in_range FROM ({ATTEMPTS_SQL})")
def snapshot_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") * 7919) % 600000).alias("snapshot_id"))
    return d.select("seq", keys.snapshot_in_range("snapshot_id").alias("in_range"))


def damaged(spark, sf_dir):
    """Chunks without the full pages of some addresses, and with others cut."""
    c = chunk_rows(spark, sf_dir)
    holed = c.where((F.col("kind") == DELTA) | (F.col("kind") == ZERO) | (F.col("pa") % 11 != 0))
    cut = F.when((F.col("kind") == FULL) & (F.col("pa") % 13 == 0), F.substring("page", 1, 100)).otherwise(F.col("page"))
    return holed.withColumn("page", cut)


DAMAGED_SQL = "SELECT pa, snapshot_id, 'base is missing' error FROM c WHERE kind = 1 AND pa % 11 = 0 UNION ALL SELECT pa, snapshot_id, 'full page of wrong size' FROM c WHERE kind = 0 AND pa % 13 = 0 AND pa % 11 <> 0"


@query(f"WITH c AS MATERIALIZED ({fold_sql(64)}) {DAMAGED_SQL}")
def check_report(spark, sf_dir):
    return long_snapshot(maintain.integrity_errors(damaged(spark, sf_dir)))


@query(f"""WITH c AS MATERIALIZED ({fold_sql(64)}), e AS ({DAMAGED_SQL}), o AS (SELECT *, row_number() OVER (ORDER BY pa, snapshot_id, error) n FROM e)
SELECT n::INT place, 'page ' || pa || ' snapshot ' || snapshot_id || ': ' || error line FROM o WHERE n <= 50
UNION ALL SELECT 51, 'and ' || (count(*) - 50) || ' more' FROM e HAVING count(*) > 50""")
def error_lines(spark, sf_dir):
    return maintain.error_lines(maintain.integrity_errors(damaged(spark, sf_dir)))


@query(f"""WITH c AS MATERIALIZED ({fold_sql(64)}), e AS ({DAMAGED_SQL}), k AS (SELECT * FROM c WHERE kind <> 0 OR pa % 11 <> 0)
SELECT count(*) total, count(*) FILTER (kind = 0) full_count, count(*) FILTER (kind = 1) delta_count, count(*) FILTER (kind = 2) zero_count, (SELECT count(*) FROM e) errors FROM k""")
def integrity_report(spark, sf_dir):
    return maintain.integrity_report(damaged(spark, sf_dir))


@query(f"""WITH c AS (SELECT pa, snapshot_id, kind, row_number() OVER (ORDER BY pa, snapshot_id) - 1 place FROM ({fold_sql(64)})), n AS (SELECT count(*) n FROM c),
s AS (SELECT least(least(400, n - 1) - 20, greatest(0, n - 40)) start FROM n) SELECT pa, snapshot_id, kind, place::INT place FROM c, s WHERE place >= start AND place < start + 40""")
def viewport(spark, sf_dir):
    d = chunk_rows(spark, sf_dir).select("pa", "snapshot_id", F.col("kind").cast("int").alias("kind"))
    return long_snapshot(maintain.viewport(d, 400, 40, "pa", "snapshot_id"))


@query(f"""SELECT pa, snapshot_id, printf('0x%016x', (pa << 19) | snapshot_id) key_hex, printf('0x%011x', pa) pa_hex, CASE kind WHEN 0 THEN 'full' WHEN 1 THEN 'delta' ELSE 'zero' END kind_name,
CASE WHEN kind <> 2 THEN 'worker_' || pa % 5 || '.blob' END blob, CASE WHEN kind = 1 THEN printf('0x%016x', (pa << 19) | base_snapshot) END base_key_hex, CASE WHEN kind = 1 THEN words::INT END patch_entries, CASE WHEN kind = 0 THEN 4096 END page_bytes FROM ({fold_sql(64)})""")
def record_details(spark, sf_dir):
    return long_snapshot(maintain.record_details(chunk_rows(spark, sf_dir), 5))


@query(f"""SELECT pa, w word, printf('0x%016x', xor(('0x' || {SWAP('wa')})::UBIGINT, ('0x' || {SWAP('wb')})::UBIGINT)) xor, w * 8 first_byte, w * 8 + 8 end_byte FROM {PAIR_WORDS_SQL} WHERE wa <> wb""")
def patch_rows(spark, sf_dir):
    d = page_pairs(spark, sf_dir).select("pa", F.lit(20).alias("snapshot_id"), F.lit(DELTA).alias("kind"), xor_patch("base", "page").alias("patch"))
    return maintain.patch_rows(d).drop("snapshot_id")
