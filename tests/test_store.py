"""Write, convert, read and purge scenarios against retained copies of the pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapstore.functions import codec, keys, pages
from snapstore.operators import maintain, versions
from snapstore.operators.encode import encode_history, resolve
from snapstore.schema import DELTA, FULL, MAX_PA, MAX_SNAPSHOT, ZERO
from snapstore.sources import raw_export, records
from snapstore.sources.store import Store

ZEROS = bytes(4096)


def random_pages(n, seed):
    rng = np.random.default_rng(seed)
    return {i: rng.integers(0, 256, 4096, dtype=np.uint8).tobytes() for i in range(n)}


def edited(page, *places):
    b = bytearray(page)
    for p in places:
        b[p] ^= 0x5A
    return bytes(b)


def frame(spark, found):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in found.items()], "pa bigint, page binary")


def kinds(store, snapshot):
    return {r["pa"]: r["kind"] for r in store.chunks().where(F.col("snapshot_id") == snapshot).select("pa", "kind").collect()}


def test_floor_over_a_delta_chain_in_both_layouts(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), workers=2, threshold=256)
    p10 = random_pages(4, 7)
    p20 = {k: edited(v, 10, 11) for k, v in p10.items()}
    p40 = {k: edited(v, 4000) for k, v in p20.items()}
    for snap, p in ((10, p10), (20, p20), (40, p40)):
        s.save(frame(spark, p), snap)
    assert set(kinds(s, 10).values()) == {FULL} and set(kinds(s, 20).values()) == set(kinds(s, 40).values()) == {DELTA}
    assert {r["base_snapshot"] for r in s.chunks().where("kind = 1").collect()} == {10}
    for convert in (lambda: None, s.to_index, s.to_log):
        convert()
        assert s.check().count() == 0
        for snap, want in ((0, None), (10, p10), (15, p10), (20, p20), (39, p20), (40, p40), (MAX_SNAPSHOT, p40)):
            assert s.load_page(2, snap) == (want and want[2])
    got = Store.open(spark, s.path).load_range(2, 4, 25).orderBy("pa").collect()
    assert [(r["pa"], bytes(r["page"]), r["found"]) for r in got] == [(2, p20[2], True), (3, p20[3], True), (4, ZEROS, False), (5, ZEROS, False)]
    assert s.vacuum() == 4


def test_threshold_rebases_and_zero_pages_keep_the_base(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), threshold=4)
    a = random_pages(2, 9)
    b = {k: edited(v, *range(0, 1600, 8)) for k, v in a.items()}
    c = {0: edited(b[0], 1), 1: ZEROS}
    d = {0: c[0], 1: edited(b[1], 9)}
    for snap, p in enumerate((a, b, c, d), 1):
        s.save(frame(spark, p), snap)
    assert kinds(s, 2) == {0: FULL, 1: FULL} and kinds(s, 3) == {0: DELTA, 1: ZERO} and kinds(s, 4) == {0: DELTA, 1: DELTA}
    assert s.load_page(1, 3) == ZEROS and s.load_page(1, 4) == d[1]
    rows = [(pa, snap, bytearray(v)) for snap, p in enumerate((a, b, c, d), 1) for pa, v in p.items()]
    folded = encode_history(spark.createDataFrame(rows, "pa bigint, snapshot_id int, page binary"), 4)
    cols = ["pa", "snapshot_id", "kind", "base_snapshot"]
    assert sorted(folded.select(cols).collect()) == sorted(s.chunks().select(cols).collect())
    back = resolve(folded, folded).collect()
    assert {(r[0], r[1]): bytes(r[2]) for r in back} == {(pa, snap): bytes(v) for pa, snap, v in rows}


def test_dirty_bitmap_session_base_and_no_shadow(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), workers=3)
    p = random_pages(70, 3)
    words = spark.createDataFrame([([-(1 << 63) | 1, 0b11],)], "words array<bigint>")
    s.save(frame(spark, p), 0, dirty=words, page_count=65)
    assert sorted(kinds(s, 0)) == [0, 63, 64]  # bit 65 is past the page count
    s = Store.open(spark, s.path)
    s.save(frame(spark, {0: edited(p[0], 5)}), 1, session_scoped_base=True)
    assert kinds(s, 1) == {0: FULL}  # a reopened handle knows no base
    s.save(frame(spark, {0: p[0]}), 2)
    assert kinds(s, 2) == {0: DELTA}
    plain = Store.create(spark, str(tmp_path / "n"), use_shadow=False)
    for snap in (1, 2):
        plain.save(frame(spark, {0: p[0]}), snap)
    assert kinds(plain, 2) == {0: FULL}


def test_validation_consumes_nothing(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), workers=4)
    s.save(frame(spark, {0: ZEROS}), 5)
    for bad in (5, 4, MAX_SNAPSHOT + 1, -1):
        with pytest.raises(ValueError):
            s.save(frame(spark, {0: ZEROS}), bad)
    with pytest.raises(Exception, match="4096"):
        s.save(frame(spark, {0: b"short"}), 6)
    s.save(frame(spark, {0: ZEROS}), 6)
    s.save(spark.createDataFrame([], "pa bigint, page binary"), 7)
    assert s.max_snapshot_id == 7 and s.load_page(9, 7) is None
    with pytest.raises(FileNotFoundError):
        Store.open(spark, str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        Store.create(spark, s.path)
    with pytest.raises(ValueError):
        Store.create(spark, str(tmp_path / "w"), workers=0)


def test_purge_on_both_layouts(spark, tmp_path):
    for layout in ("log", "index"):
        s = Store.create(spark, str(tmp_path / layout), workers=4, use_shadow=False)
        p = random_pages(16, 99)
        s.save(frame(spark, p), 1)
        for snap in (2, 3):
            s.save(frame(spark, {0: edited(p[0], snap)}), snap)
        if layout == "index":
            s.to_index()
        assert s.purge(1) == 2 and s.purge(1) == 0 and s.layout == layout
        assert s.load_page(0, 3) == p[0] and s.max_snapshot_id == 1
        assert s.purge(0) == 16 and s.chunks().count() == 0
        s.save(frame(spark, {0: p[1]}), 1)
        assert s.stats(1).first()["total"] == 1


def test_first_write_wins_and_stats_count_duplicates(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    rows = [(0, 1, k, FULL, 0, None, bytearray(bytes([k]) * 4096), None) for k in (3, 1, 2)]
    s.append_records(spark.createDataFrame(rows, s.raw_chunks().schema))
    assert s.load_page(0, 1) == b"\1" * 4096
    assert s.stats().first()["total"] == 3 and s.inspect(1, 0).count() == 3
    s.to_index()
    assert s.raw_chunks().count() == 1


def test_integrity_errors(spark):
    page = bytearray(b"x" * 4096)
    rows = [
        (0, 0, 0, FULL, 0, None, page, None),
        (0, 1, 1, DELTA, 0, 0, None, [(0, 1)]),  # its base is page 0, snapshot 0: fine
        (1, 0, 2, FULL, 0, None, page[:10], None),
        (2, 1, 3, DELTA, 0, 0, None, [(0, 1)]),
        (3, 0, 4, ZERO, 0, None, None, None),
        (3, 1, 5, DELTA, 0, 0, None, [(600, 1)]),
        (4, 1, 6, FULL, 0, None, page, None),
        (4, 2, 7, DELTA, 0, 2, None, [(0, 1)]),
    ]
    d = spark.createDataFrame(rows, "pa bigint, snapshot_id int, seq bigint, kind tinyint, worker_id smallint, base_snapshot int, page binary, patch array<struct<w:smallint,x:bigint>>")
    got = {(r["pa"], r["error"]) for r in maintain.integrity_errors(d).collect()}
    assert got == {(1, "full page of wrong size"), (2, "base is missing"), (3, "patch word outside the page"), (3, "base is not full"), (4, "base is not full"), (4, "base is not earlier")}
    with pytest.raises(Exception, match="no full base"):
        resolve(d.where("pa = 2"), d).collect()


def test_codecs_agree(spark, tmp_path):
    p = random_pages(3, 5)
    rows = [(0, bytearray(p[0]), bytearray(edited(p[0], 0, 7, 8, 4095))), (1, bytearray(p[1]), bytearray(p[1])), (2, bytearray(ZEROS), bytearray(p[2]))]
    d = spark.createDataFrame(rows, "pa bigint, a binary, b binary")
    d = d.select("*", codec.xor_patch("a", "b").alias("p"), codec.native_patch(F.col("a"), F.col("b")).alias("n"), codec.changed_words("a", "b").alias("c"))
    d.write.parquet(str(tmp_path / "p"))  # native_apply looks the patch up per word: it must be a stored column
    d = spark.read.parquet(str(tmp_path / "p"))
    got = d.select("pa", "b", "p", "n", "c", codec.apply_patch("a", "p").alias("x"), codec.native_apply(F.col("a"), F.col("p")).alias("y")).orderBy("pa").collect()
    assert [r["c"] for r in got] == [3, 0, 512]
    for r in got:
        assert r["p"] == r["n"] and bytes(r["x"]) == bytes(r["y"]) == bytes(r["b"])
        patch = [(e["w"], e["x"]) for e in r["p"]]
        assert codec.parse_patch(codec.patch_bytes(patch)) == patch
    for bad in (b"123", codec.ENTRY.pack(512, 1)):
        with pytest.raises(ValueError):
            codec.parse_patch(bad)


def test_keys_at_their_limits(spark):
    d = spark.createDataFrame([(MAX_PA, MAX_SNAPSHOT), (0, 0), (1 << 44, 3)], "pa bigint, s int").withColumn("k", keys.pack_key("pa", "s"))
    for r in d.select("*", keys.key_pa("k").alias("p2"), keys.key_snapshot("k").alias("s2")).collect():
        assert (r["p2"], r["s2"]) == (r["pa"], r["s"])
    with pytest.raises(ValueError):
        keys.worker_of("pa", 256)


def test_as_of_misses_and_ties(spark):
    facts = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "pa bigint, snapshot_id int, v string")
    probes = spark.createDataFrame([(1, 4), (1, 5), (1, 8), (1, 9), (3, 7), (2, 0)], "pa bigint, snapshot_id int")
    got = {(r["pa"], r["snapshot_id"]): (r["found_snapshot"], r["v"]) for r in versions.as_of(probes, facts, "v").collect()}
    assert got == {(1, 4): (None, None), (1, 5): (5, "a"), (1, 8): (5, "a"), (1, 9): (9, "b"), (3, 7): (None, None), (2, 0): (None, None)}


def test_raw_files(spark, tmp_path):
    p = random_pages(3, 4)
    rows = [(0, 0, p[0]), (1, 0, ZEROS), (2, 0, p[2]), (1, 4, ZEROS), (2, 4, p[1])]
    d = spark.createDataFrame([(a, s, bytearray(v)) for a, s, v in rows], "pa bigint, snapshot_id int, page binary")
    folder = str(tmp_path / "raw")
    assert sorted(map(tuple, raw_export.write_raw(d, folder).collect())) == [(0, 2), (4, 2)] and raw_export.chain_top(folder) == 4
    assert raw_export.read_raw(f"{folder}/0") == [(0, p[0]), (2, p[2])]
    assert raw_export.read_raw(f"{folder}/4") == [(1, ZEROS), (2, p[1])]


def test_record_files(spark, tmp_path):
    log_magic, index_magic = b"TESTLOG\0", b"TESTIDX\0"
    rows = [(5, 1, 0, 2, 0, 100, None), (5, 2, 1, 2, 100, 20, 1), (6, 2, 2, 0, 0, 0, None), (MAX_PA, MAX_SNAPSHOT, 0, 1, 7, 9, None)]
    log, index = tmp_path / "log", tmp_path / "index"
    log.write_bytes(records.header(log_magic, 2) + b"".join(records.log_record(*r) for r in rows) + b"torn")
    index.write_bytes(records.header(index_magic, 2) + b"".join(records.index_record(*r) for r in rows))
    spark.dataSource.register(records.RecordFiles)
    for layout, path in (("log", log), ("index", index)):
        d = spark.read.format("page_records").options(path=str(path), layout=layout, log_magic=log_magic.hex(), index_magic=index_magic.hex()).load()
        got = [tuple(r[1:]) for r in d.orderBy("seq").collect()]
        assert got == rows
    with pytest.raises(ValueError):
        records.read_header(log.read_bytes(), index_magic)
    with pytest.raises(ValueError):
        records.read_header(records.header(log_magic, 0, version=2), log_magic)


def test_stream_equals_batch(spark, tmp_path):
    from snapstore.streaming.fold import encode_stream

    p = random_pages(2, 8)
    steps = [p, {0: edited(p[0], 3), 1: ZEROS}, {0: edited(p[0], *range(0, 4096, 8)), 1: edited(p[1], 1)}]
    rows = [(pa, snap, bytearray(v)) for snap, q in enumerate(steps) for pa, v in q.items()]
    d = spark.createDataFrame(rows, "pa bigint, snapshot_id int, page binary")
    for snap in range(3):
        d.where(F.col("snapshot_id") == snap).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = encode_stream(stream, 256).writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    cols = ["pa", "snapshot_id", "kind", "base_snapshot"]
    assert sorted(spark.table("encoded").select(cols).collect()) == sorted(encode_history(d, 256).select(cols).collect())


def test_helpers(spark):
    assert pages.parse_filter("12 0x1F junk 7") == (7, 31)
    assert pages.parse_filter("-5 +7 1_000 ٣ 0x 99999999999 0xg") == (None, None)
    d = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,), (3 << 30,)], "n bigint").select(pages.human_bytes("n").alias("h"))
    assert [r["h"] for r in d.collect()] == ["0 B", "1023 B", "1.50 KiB", "5.00 MiB", "3.00 GiB"]
    d = pages.hex_rows(spark.createDataFrame([(bytearray(b"A\x00z" * 6),)], "b binary"), "b").orderBy("offset").collect()
    assert (d[0]["hex"][:6], d[0]["ascii"][:3], d[1]["offset"], d[1]["ascii"]) == ("41007A", "A.z", 16, ".z")
    with pytest.raises(Exception, match="unknown chunk kind"):
        spark.createDataFrame([(7,)], "k tinyint").select(pages.kind_name("k")).collect()
