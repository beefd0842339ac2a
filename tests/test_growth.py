"""What must not grow faster than the input: pages that move between tasks, and what one task reads or holds."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapstore.functions import codec, pages
from snapstore.operators.encode import resolve
from snapstore.plans.queries import QUERIES
from snapstore.sources import files, store
from snapstore.sources.store import Store
from test_store import edited, frame, random_pages


def exchanges(d):
    return d._jdf.queryExecution().executedPlan().toString().count("partitioning(")


def test_pages_stay_in_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET", 16)
    s = Store.create(spark, str(tmp_path / "s"), threshold=4)
    a = random_pages(70, 1)
    b = {k: edited(v, 1) if k % 2 else edited(v, *range(0, 800, 8)) for k, v in a.items()}
    s.save(frame(spark, a), 1)
    s.save(frame(spark, b), 2)
    want = {(k, n): v for n, p in ((1, a), (2, b)) for k, v in p.items()}
    plans = []
    monkeypatch.setattr(Store, "_write", lambda self, d, *more, write=Store._write: plans.append(exchanges(d)) or write(self, d, *more))
    for convert in (lambda: None, s.to_index, s.to_log):
        convert()
        d = s.all_versions()
        assert exchanges(d) == 0 and {(r["pa"], r["snapshot_id"]): bytes(r["page"]) for r in d.collect()} == want
    assert plans == [0, 0]
    s.save(frame(spark, {k: edited(v, 9) for k, v in b.items()}), 3)
    assert plans[2:] == [1]  # the pages that are saved; their bases stay
    assert {r["base_snapshot"] for r in s.chunks().where("snapshot_id = 3 and pa % 2 = 0").collect()} == {2}


@pytest.mark.parametrize("convert", ["to_index", "to_log"])
def test_a_store_that_outgrows_its_buckets(spark, tmp_path, monkeypatch, convert):
    monkeypatch.setattr(store, "BUCKET", 1)
    s = Store.create(spark, str(tmp_path / "s"))
    a = random_pages(40, 2)
    s.save(frame(spark, {0: a[0]}), 1)
    s.save(frame(spark, {k: edited(v, 3) for k, v in a.items()}), 2)
    assert [x["buckets"] for x in s.manifest["batches"]] == [1, 64]
    assert {r["pa"] for r in s.chunks().where("kind = 1").collect()} == {0}
    getattr(s, convert)()
    assert [x["buckets"] for x in s.manifest["batches"]] == [64]
    got = {(r["pa"], r["snapshot_id"]): bytes(r["page"]) for r in s.all_versions().collect()}
    assert got == {(0, 1): a[0]} | {(k, 2): edited(v, 3) for k, v in a.items()}


def test_far_ranges_of_bases(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    a = random_pages(1, 3)[0]
    at = [k << store.RANGE_BITS for k in range(0, 2 * store.MAX_RANGES + 4, 2)]
    s.save(frame(spark, dict.fromkeys(at, a)), 1)
    for n, some in ((2, at[:3]), (3, at)):  # a few ranges, and more than are told apart
        s.save(frame(spark, dict.fromkeys(some, edited(a, 5))), n)
        assert s.chunks().where((F.col("snapshot_id") == n) & (F.col("base_snapshot") == 1)).count() == len(some)


def test_a_blob_is_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 32)
    monkeypatch.setattr(files, "READ", 1 << 16)
    s = Store.create(spark, str(tmp_path / "s"), threshold=4)
    a = random_pages(300, 4) | {300: bytes(4096), 301: bytes(4096)}
    b = {k: edited(v, 7) for k, v in a.items()}
    s.save(frame(spark, a), 1)
    s.save(frame(spark, b), 2)
    folder = str(tmp_path / "files")
    files.write_files(s.chunks(), folder, 1)
    assert sorted(x.name for x in (tmp_path / "files" / "blobs").iterdir()) == ["worker_0.blob"]
    dealt = [r["count"] for r in spark.read.parquet(f"{folder}/.records").groupBy("part").count().collect()]
    assert sum(dealt) == 604 and len(dealt) > 8 and max(dealt) < 200
    end = 0
    for r in files.open_files(spark, folder)[1].where("kind <> 2").orderBy("seq").collect():  # one after the other, without gaps
        assert r["offset"] == end
        end += r["len"]
    assert end == (tmp_path / "files" / "blobs" / "worker_0.blob").stat().st_size
    c = files.load_files(spark, folder)
    got = {(r["pa"], r["snapshot_id"]): bytes(r["page"]) for r in resolve(c, c).collect()}
    assert got == {(k, n): v for n, p in ((1, a), (2, b)) for k, v in p.items()}
    assert files._payloads(files.open_files(spark, folder)[1], folder, files.OWN).rdd.getNumPartitions() > 8


def test_codec_work_is_cut_in_slices(spark, monkeypatch):
    most = []
    monkeypatch.setattr(codec, "LIMIT", 8)
    codec._in_slices("int")(lambda *arrays: most.append(max(map(len, arrays))) or arrays[0]).func(pa.array(range(50)), pa.array(range(50)))
    assert len(most) == 7 and max(most) == 8


def test_slices_agree_with_whole_batches(spark, tmp_path):
    n = codec.LIMIT + 88
    a = random_pages(n, 6)
    d = spark.createDataFrame([(k, bytearray(v), bytearray(edited(v, k % 4096)) if k % 3 else None) for k, v in a.items()], "pa bigint, a binary, b binary").coalesce(1)
    patch = codec.xor_patch("a", "b")
    got = d.select("pa", codec.changed_words("a", "b").alias("n"), codec.apply_patch("a", codec.decode_patch(codec.encode_patch(patch))).alias("x")).collect()
    assert {r["pa"]: (r["n"], r["x"] and bytes(r["x"])) for r in got} == {k: (1, edited(v, k % 4096)) if k % 3 else (None, None) for k, v in a.items()}


def test_load_range_as_of_folds_once(spark):
    d = QUERIES["load_range_as_of"](spark, "/root/testdata/sf0.001")
    assert d._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_hex_rows_shows_every_byte(spark):
    b = bytes(range(256)) + b"ab"
    d = pages.hex_rows(spark.createDataFrame([(bytearray(b),), (bytearray(),), (None,)], "b binary"), "b")
    assert "transform(" not in d._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in d.orderBy("offset").collect()]
    assert got == [(k, b[k : k + 16].hex().upper(), "".join(chr(c) if 32 <= c <= 126 else "." for c in b[k : k + 16])) for k in range(0, 258, 16)]
