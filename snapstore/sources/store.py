"""A versioned page store in Parquet: batches of chunks and numbered manifests that publish them.

A save writes its batch first and then a manifest with the next number, made by renaming a
whole file; readers take the highest number. So a batch is there whole or not at all,
nothing that a reader needs is ever deleted, and a failed call consumes no snapshot id.
Manifests hold the ranges of snapshots and addresses of each batch: reads and purges pass
over batches that cannot matter. Files that no manifest needs go with :meth:`Store.vacuum`.
One writer at a time is assumed.

Batches are bucketed by address (as Spark's tables are, without a catalog): a save shuffles its
own pages only, and meets the bases of its deltas, full pages of earlier batches, where they lie.
Conversions, purges and whole reads move no pages between tasks. Where buckets don't fit (a store
that has outgrown its number, batches of an older store) Spark shuffles and results are the same.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import check_snapshot, checked_pa, worker_of
from ..functions.pages import bitmap_pages, masked_words, word_pages, zero_page
from ..operators import maintain
from ..operators.encode import encode_batch, latest_full, resolve, resolve_at
from ..operators.versions import as_of, dirty_pages, floor_point
from ..schema import CHUNKS, DELTA, FULL, PAGE_SIZE, SNAPSHOT_BITS
from .timing import Timings

VERSION = 2
BUCKET = 1 << 14  # pages of a save in a bucket, about
GROWN = 8  # times as many: the number of buckets is too small
RANGE_BITS, MAX_RANGES = 20, 64  # a save reads bases only of ranges of addresses (of so many pages) that it touches


class Store:
    def __init__(self, spark: SparkSession, path: str, manifest: dict, number: int = 0):
        self.spark, self.path, self.manifest, self.number = spark, path.rstrip("/"), manifest, number
        self._opened_at = len(manifest["batches"])
        self.timings = Timings()

    # manifests

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    @classmethod
    def _numbers(cls, spark: SparkSession, path: str) -> list[int]:
        fs, p = cls._fs(spark, f"{path.rstrip('/')}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    @classmethod
    def create(cls, spark: SparkSession, path: str, workers: int = 1, threshold: int = 0, use_shadow: bool = True) -> Store:
        if not 1 <= workers <= 255:
            raise ValueError("workers must be 1 to 255")
        if cls.exists(spark, path):
            raise FileExistsError(path)
        first = {"format_version": VERSION, "layout": "log", "max_snapshot_id": None, "batches": [], "buckets": None, "workers": workers, "threshold": threshold, "use_shadow": use_shadow, "next_seq": 0, "duplicates": False}
        store = cls(spark, path, first)
        store._publish()
        return store

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return bool(cls._numbers(spark, path))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        numbers = cls._numbers(spark, path)
        if not numbers:
            raise FileNotFoundError(path)
        name = f"{path.rstrip('/')}/manifests/{numbers[-1]:010d}.json"
        manifest = json.loads("\n".join(r[0] for r in spark.read.text(name, wholetext=True).collect()))
        if manifest.get("format_version") != VERSION:
            raise ValueError(f"unknown store version {manifest.get('format_version')}")
        return cls(spark, path, manifest, numbers[-1])

    def branch(self, path: str) -> Store:
        """A store of its own at ``path`` that begins with this one's batches, without copying them.

        The batches stay where they are: this store must keep them (no vacuum after a purge or conversion).
        """
        if self.exists(self.spark, path):
            raise FileExistsError(path)
        whole = lambda name: name if ":" in name or name.startswith("/") else f"{self.path}/{name}"
        own = self.manifest | {"batches": [b | {"name": whole(b["name"])} for b in self.manifest["batches"]]}
        store = Store(self.spark, path, own)
        store._publish()
        return store

    def _publish(self, **changes) -> None:
        """Write the manifest with these changes under the next number; only then does this handle have them."""
        new, number = self.manifest | changes, self.number + 1
        fs, final = self._fs(self.spark, f"{self.path}/manifests/{number:010d}.json")
        _, part = self._fs(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(part, final):
            raise OSError(f"could not publish {final.toString()}: another writer was there")
        self.manifest, self.number = new, number

    @property
    def max_snapshot_id(self) -> int | None:
        return self.manifest["max_snapshot_id"]

    @property
    def layout(self) -> str:
        return self.manifest["layout"]

    def info(self) -> DataFrame:
        """One row: layout, greatest snapshot id, batches, workers, threshold."""
        m = self.manifest
        row = (m["format_version"], m["layout"], m["max_snapshot_id"], len(m["batches"]), m["workers"], m["threshold"])
        return self.spark.createDataFrame([row], "format_version int, layout string, max_snapshot_id int, batches int, workers int, threshold int")

    def _at(self, name: str) -> str:
        return name if ":" in name or name.startswith("/") else f"{self.path}/{name}"

    def _buckets(self, rows: int) -> int:
        """Buckets for a batch of so many rows: the store's own, until they are far too few."""
        own, wanted = self.manifest.get("buckets"), 1 << max(0, -(-rows // BUCKET) - 1).bit_length()
        return own if own and wanted <= GROWN * own else wanted

    def _write(self, chunks: DataFrame, buckets: int, *order: str) -> list[dict]:
        """The written batch with its ranges, as a list: empty if it has no rows. Each bucket is in this order."""
        name = f"batches/{uuid.uuid4().hex}"
        fs, p = self._fs(self.spark, self._at(name))
        table = f"snapstore_{uuid.uuid4().hex}"  # only a table can be written in buckets; its entry goes at once
        columns = self.spark.createDataFrame([], CHUNKS).columns
        try:
            w = chunks.select(*columns).write.bucketBy(buckets, "pa").sortBy(*order).format("parquet")
            w.options(compression="zstd", path=fs.makeQualified(p).toString()).saveAsTable(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # an entry with a path of its own: the files stay
        batch = {"name": name, "buckets": buckets}
        r = self._read([batch]).agg(F.min("snapshot_id"), F.max("snapshot_id"), F.min("pa"), F.max("pa"), F.count("*")).first()
        return [] if r[0] is None else [batch | {"snapshots": [r[0], r[1]], "pages": [r[2], r[3]], "rows": r[4]}]

    # reads

    def _batches(self, lo: int | None = None, hi: int | None = None, upto: int | None = None) -> list[dict]:
        """Batches that may hold addresses from ``lo`` to below ``hi`` of snapshots up to ``upto``."""
        return [b for b in self.manifest["batches"] if (lo is None or b["pages"][1] >= lo) and (hi is None or b["pages"][0] < hi) and (upto is None or b["snapshots"][0] <= upto)]

    def _read(self, batches: list[dict]) -> DataFrame:
        found = self.spark.createDataFrame([], CHUNKS)
        by: dict[int | None, list[str]] = {}
        for b in batches:
            by.setdefault(b.get("buckets"), []).append(self._at(b["name"]))
        for k, (buckets, names) in enumerate(sorted(by.items(), key=lambda x: x[0] or 0)):
            d = self._read_buckets(names, buckets, found) if buckets else self.spark.read.schema(CHUNKS).parquet(*names)
            found = found.unionByName(d) if k else d
        return found

    def _read_buckets(self, names: list[str], buckets: int, like: DataFrame) -> DataFrame:
        """One relation over these folders that knows its buckets, as ``DataFrameReader`` has no words for them."""
        jvm, session = self.spark._jvm, self.spark._jsparkSession
        seq, option = jvm.PythonUtils.toSeq, jvm.scala.Option
        try:
            spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, seq(["pa"]), seq([]))
            source = jvm.org.apache.spark.sql.execution.datasources.DataSource(
                session, "parquet", seq(names), option.apply(like._jdf.schema()), seq([]), option.apply(spec), jvm.PythonUtils.toScalaMap({}), option.empty()
            )
            return DataFrame(session.baseRelationToDataFrame(source.resolveRelation(True, True)), self.spark)
        except (Py4JError, TypeError):  # another version of Spark: the same rows, with shuffles
            return self.spark.read.schema(CHUNKS).parquet(*names)

    def raw_chunks(self) -> DataFrame:
        """All records as written, duplicates too."""
        return self._read(self.manifest["batches"])

    def chunks(self, lo: int | None = None, hi: int | None = None, upto: int | None = None) -> DataFrame:
        """Records with unique keys, the first write of each; optionally only of some addresses and snapshots."""
        d = self._read(self._batches(lo, hi, upto))
        for cond in (None if lo is None else F.col("pa") >= lo, None if hi is None else F.col("pa") < hi, None if upto is None else F.col("snapshot_id") <= upto):
            d = d if cond is None else d.where(cond)
        return maintain.without_repeats(d) if self.manifest["duplicates"] else d

    def load_page(self, pa: int, snapshot_id: int, cache=None) -> bytes | None:
        """The page as of the snapshot; None where there is no version so early.

        ``cache``: a ``PageCache`` of this store that keeps full pages.
        """
        check_snapshot(snapshot_id)
        with self.timings.phase("load_page"):
            chunks = self.chunks(pa, pa + 1, snapshot_id)
            if cache is None:
                row = resolve(floor_point(chunks, pa, snapshot_id), chunks).first()
                return None if row is None else bytes(row["page"])
            row = floor_point(chunks.drop("page"), pa, snapshot_id).first()
            if row is None:
                return None
            if row["kind"] not in (FULL, DELTA):
                return bytes(PAGE_SIZE)
            full = row["base_snapshot"] if row["kind"] == DELTA else row["snapshot_id"]
            key = pa << SNAPSHOT_BITS | full
            page = cache.get(key)
            if page is None:
                found = chunks.where((F.col("snapshot_id") == full) & (F.col("kind") == FULL)).select("page").first()
                if found is None:
                    raise ValueError(f"no full base for a delta of page {pa}")
                page = bytes(found["page"])
                cache.put(key, page)
            if row["kind"] == FULL:
                return page
            words = bytearray(page)
            for e in row["patch"]:
                at = slice(8 * e["w"], 8 * e["w"] + 8)
                words[at] = (int.from_bytes(words[at], "little") ^ (e["x"] & (1 << 64) - 1)).to_bytes(8, "little")
            return bytes(words)

    def load_pages(self, probes: DataFrame) -> DataFrame:
        """Each probe (pa, snapshot_id) with its page as of it (null: no version so early)."""
        with self.timings.phase("load_pages"):
            chunks = self.chunks()
            found = as_of(probes.select("pa", "snapshot_id"), chunks.select("pa", "snapshot_id"))
            wanted = found.where("found_snapshot IS NOT NULL").select("pa", F.col("found_snapshot").alias("snapshot_id")).distinct()
            pages = resolve(chunks.join(wanted, ["pa", "snapshot_id"], "left_semi"), chunks).withColumnRenamed("snapshot_id", "found_snapshot")
            return found.join(pages, ["pa", "found_snapshot"], "left").select("pa", "snapshot_id", "page")

    def load_range(self, lo: int, count: int, snapshot_id: int) -> DataFrame:
        """(pa, page, found) for count addresses from lo; pages without a version are zero."""
        check_snapshot(snapshot_id)
        with self.timings.phase("load_range"):
            chunks = self.chunks(lo, lo + count, snapshot_id)
            pages = resolve_at(chunks, snapshot_id).select("pa", "page", F.lit(True).alias("_hit"))
            d = self.spark.range(lo, lo + count).withColumnRenamed("id", "pa").join(pages, "pa", "left")
            return d.select("pa", F.coalesce("page", zero_page()).alias("page"), F.coalesce("_hit", F.lit(False)).alias("found"))

    def all_versions(self) -> DataFrame:
        """(pa, snapshot_id, page) of every version; deltas never chain, so rows are independent."""
        chunks = self.chunks()
        return resolve(chunks, chunks)

    # writes

    def save(self, pages: DataFrame, snapshot_id: int, dirty: DataFrame | None = None, page_count: int | None = None, session_scoped_base: bool = False) -> None:
        """Append the pages (pa, page) as a snapshot; with ``dirty`` only those it marks.

        ``dirty`` is a bitmap: one row of ``words`` (array<bigint>), or a row a word (w, word).

        Ids must rise. Bases are the newest full pages of the whole store, or, session
        scoped, of what this handle has saved.
        """
        check_snapshot(snapshot_id)
        if self.max_snapshot_id is not None and snapshot_id <= self.max_snapshot_id:
            raise ValueError(f"snapshot id {snapshot_id} is not above {self.max_snapshot_id}")
        with self.timings.phase("save"):
            d = pages.select(checked_pa("pa").alias("pa"), "page")
            if dirty is not None:
                if "word" in dirty.columns:
                    marked = word_pages(dirty if page_count is None else masked_words(dirty, page_count))
                else:
                    marked = bitmap_pages(dirty, "words", page_count)
                d = dirty_pages(d, marked)
            wrong = F.raise_error(F.lit(f"pages must have {PAGE_SIZE} bytes")).cast("binary")
            d = d.select("pa", F.lit(snapshot_id).alias("snapshot_id"), F.when(F.octet_length("page") == PAGE_SIZE, F.col("page")).otherwise(wrong).alias("page"))
            touched = {r[0]: r[1] for r in d.groupBy(F.shiftright("pa", RANGE_BITS)).count().collect()}  # ranges of a million pages
            buckets = self._buckets(sum(touched.values()))
            bases = None
            if self.manifest["use_shadow"] and touched:
                own = self.manifest["batches"][self._opened_at :] if session_scoped_base else self._batches(min(touched) << RANGE_BITS, max(touched) + 1 << RANGE_BITS)
                bases = latest_full(_of_ranges(self._read(own), touched)) if own else None
            # dealt by bucket first, so that neither a broadcast of few bases nor none leaves many files a bucket
            encoded = encode_batch(d.repartition(buckets, "pa"), bases, self.manifest["threshold"])
            encoded = encoded.withColumns({"seq": F.lit(self.manifest["next_seq"]).cast("bigint") + F.col("pa"), "worker_id": worker_of("pa", self.manifest["workers"])})
            written = self._write(encoded, buckets, "pa")
            self._publish(batches=self.manifest["batches"] + written, buckets=buckets if written else self.manifest.get("buckets"), max_snapshot_id=snapshot_id, next_seq=self.manifest["next_seq"] + (1 << 45))

    def append_records(self, chunks: DataFrame) -> None:
        """Records from elsewhere, in order of their ``seq``, after all that is there; keys may repeat."""
        top = chunks.agg(F.max("snapshot_id").alias("s"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n")).first()
        if top["s"] is None:
            return
        start = self.manifest["next_seq"]
        buckets = self._buckets(top["n"])
        written = self._write(chunks.withColumn("seq", F.col("seq") - top["lo"] + start).repartition(buckets, "pa"), buckets, "seq")
        self._publish(batches=self.manifest["batches"] + written, buckets=buckets, max_snapshot_id=max(top["s"], self.max_snapshot_id or 0), duplicates=True, next_seq=start + top["hi"] - top["lo"] + 1)

    def _replace(self, layout: str, *order: str) -> None:
        """All chunks as one batch in this order, bucket by bucket."""
        batches, chunks = self.manifest["batches"], self.chunks()
        buckets = self._buckets(sum(b.get("rows", 0) for b in batches))
        if {b.get("buckets") for b in batches} == {buckets}:  # a window keeps the rows of an address where they are
            newest = Window.partitionBy("pa").orderBy("snapshot_id")
            chunks = chunks.withColumn("_n", F.row_number().over(newest)).where("_n > 0").drop("_n")
        else:
            chunks = chunks.repartition(buckets, "pa")
        written = self._write(chunks, buckets, *order)
        self._opened_at = 0
        self._publish(batches=written, buckets=buckets, layout=layout, duplicates=False)

    def to_index(self) -> None:
        """Recluster by address: unique keys, all versions of an address together and in address order in each bucket."""
        with self.timings.phase("to_index"):
            self._replace("index", "pa", "snapshot_id")

    def to_log(self) -> None:
        """Snapshot by snapshot in each bucket."""
        with self.timings.phase("to_log"):
            self._replace("log", "snapshot_id", "pa")

    def purge(self, threshold: int) -> int:
        """Drop snapshots above ``threshold``; how many records went. Dropped ids may be used again.

        Batches wholly above it leave the manifest; only one that lies across it is rewritten.
        """
        with self.timings.phase("purge"):
            batches = self.manifest["batches"]
            above = [b for b in batches if b["snapshots"][1] > threshold]
            if not above:
                return 0
            removed = self._read(above).where(F.col("snapshot_id") > threshold).select("pa", "snapshot_id").distinct().count()
            kept: list[dict] = []
            for b in batches:
                if b["snapshots"][1] <= threshold:
                    kept.append(b)
                elif b["snapshots"][0] <= threshold:
                    buckets = b.get("buckets") or self._buckets(b.get("rows", 0))
                    kept += self._write(maintain.purge(self._read([b]), threshold), buckets, *(("pa", "snapshot_id") if self.layout == "index" else ("snapshot_id", "pa")))
            self._opened_at = min(self._opened_at, len(kept))
            self._publish(batches=kept, max_snapshot_id=max((b["snapshots"][1] for b in kept), default=None))
            return removed

    def vacuum(self) -> int:
        """Delete batches and manifests that the newest manifest does not need; how many batches went."""
        fs, root = self._fs(self.spark, f"{self.path}/batches")
        live, gone = {b["name"] for b in self.manifest["batches"]}, 0
        for status in fs.listStatus(root) if fs.exists(root) else []:
            if f"batches/{status.getPath().getName()}" not in live:
                fs.delete(status.getPath(), True)
                gone += 1
        old = self._fs(self.spark, f"{self.path}/bases")[1]  # of stores that kept bases apart
        if fs.exists(old):
            fs.delete(old, True)
        for k in self._numbers(self.spark, self.path)[:-1]:
            fs.delete(self._fs(self.spark, f"{self.path}/manifests/{k:010d}.json")[1], False)
        return gone

    def check(self) -> DataFrame:
        return maintain.integrity_errors(self.raw_chunks())

    def require_whole(self) -> None:
        """An error that names the first faults if the check finds any."""
        lines = [r["line"] for r in maintain.error_lines(self.check()).orderBy("place").collect()]  # at most 51
        if lines:
            raise ValueError("\n".join(lines))

    def stats(self, snapshot_id: int | None = None) -> DataFrame:
        return maintain.stats(self.raw_chunks(), snapshot_id)

    def inspect(self, snapshot_id: int | None = None, pa: int | None = None) -> DataFrame:
        return maintain.inspect(self.raw_chunks(), snapshot_id, pa)


def _of_ranges(chunks: DataFrame, ranges: dict[int, int]) -> DataFrame:
    """Chunks of these ranges of addresses, in terms that Parquet can skip by; many ranges count as one."""
    spans: list[list[int]] = []
    for r in sorted(ranges):
        if spans and spans[-1][1] == r:
            spans[-1][1] = r + 1
        else:
            spans.append([r, r + 1])
    if len(spans) > MAX_RANGES:
        spans = [[spans[0][0], spans[-1][1]]]
    inside = F.lit(False)
    for lo, hi in spans:
        inside |= (F.col("pa") >= lo << RANGE_BITS) & (F.col("pa") < hi << RANGE_BITS)
    return chunks.where(inside)
