"""Queries that take whole tables, against brute force on small ones with far addresses."""

import datetime

import pytest

from snapstore.plans.queries import QUERIES


def test_hex_dump(spark, tmp_path):
    texts = {3: "x" * 5000, 10: "ten", 5000: "wörds far away", 5001: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for k, t in texts.items():
        b = t.encode()
        for i in range(-(-len(b) // 4096)):
            page = b[i * 4096 : (i + 1) * 4096].ljust(4096, b"\0")
            want += [(k * 64 + i, at, page[at : at + 16].hex().upper()) for at in range(0, 4096, 16)]
    assert sorted(map(tuple, QUERIES["hex_dump"](spark, str(tmp_path)).drop("ascii").collect())) == sorted(want)


def orders(spark, path, keys):
    d = spark.createDataFrame(list(enumerate(keys)), "o_orderkey long, o_custkey long")
    d.write.parquet(str(path / "orders.parquet"))


def test_bitmap_expand(spark, tmp_path):
    keys = [0, 1, 63, 63, 64, 126, 127, 999, 1000, 14_999, 70_000]
    orders(spark, tmp_path, keys)
    got = QUERIES["bitmap_expand"](spark, str(tmp_path)).collect()
    assert sorted((r["w"], r["pa"]) for r in got) == sorted({(k // 64, k) for k in keys})


def test_subsets_gone(spark, tmp_path):
    keys = [0, 1, 63, 64, 127, 5000, 70_000]
    d = spark.createDataFrame([(k, c, datetime.date(1996, 1, 1 + k), 1.0) for k, c in enumerate(keys)], "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double")
    d.write.parquet(str(tmp_path / "orders.parquet"))
    texts = {0: "x" * 5000, 63: "y", 5000: "far away", 6000: "no order"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r["pa"] for r in rows("exact_lookup")) == keys
    assert sorted((r["w"], r["dirty"], r["slots_before"]) for r in rows("bitmap_popcount")) == [(0, 3, 0), (1, 2, 3), (78, 1, 5), (1093, 1, 6)]
    assert sorted(r["pa"] for r in rows("semi_dirty_pages")) == [0, 63 * 64, 5000 * 64]
    got = rows("load_range_as_of")
    assert sorted(r["pa"] for r in got) == list(range(6000 * 64 + 1)) and sorted(r["pa"] for r in got if r["found"]) == [0, 1, 63 * 64, 5000 * 64, 6000 * 64]


@pytest.mark.parametrize(("name", "table", "schema"), [("paging_documents", "documents", "doc_id long, text string"), ("paging_html", "pages", "page_id long, html string")])
def test_too_many_pages(spark, tmp_path, name, table, schema):
    for size in (64 * 4096, 64 * 4096 + 1):
        path = tmp_path / str(size)
        spark.createDataFrame([(0, "x" * size), (1, "y")], schema).write.parquet(str(path / f"{table}.parquet"))
        if size == 64 * 4096:
            assert sorted(r["pa"] for r in QUERIES[name](spark, str(path)).collect()) == list(range(65))
        else:
            with pytest.raises(Exception, match="more than 64 pages"):
                QUERIES[name](spark, str(path)).collect()
