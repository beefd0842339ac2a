"""A page cache of fixed size: sets of 16 slots, the slot used longest ago goes first.

Two forms of the same rules. :func:`resident_slots` says in one DataFrame plan which keys of
a stream of accesses are in the cache at its end: of each set the last 16 distinct keys. And
:class:`PageCache` is such a cache in a memory-mapped file, for point reads by one driver
(``Store.load_page(..., cache=...)``); it carries the path of the store it belongs to.

A key is the page address and the snapshot of the full page, packed as in ``functions.keys``.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PAGE_SIZE

SETS, WAYS = 8192, 16
#: Multiplier of the hash that spreads keys over sets (modulo 2**31 - 1).
MULTIPLIER, MODULUS = 48271, (1 << 31) - 1


def set_of(key: Column, sets: int = SETS) -> Column:
    """The set of a key."""
    return F.pmod(F.pmod(key, F.lit(MODULUS)) * MULTIPLIER % MODULUS, F.lit(sets)).cast("int")


def resident_slots(accesses: DataFrame, sets: int = SETS, ways: int = WAYS) -> DataFrame:
    """(set, key, age) of the keys in the cache after all accesses (key, seq); age 0 was used last."""
    last = accesses.groupBy("key").agg(F.max("seq").alias("seq")).withColumn("set", set_of(F.col("key"), sets))
    newest = Window.partitionBy("set").orderBy(F.desc("seq"), F.desc("key"))
    d = last.withColumn("age", F.row_number().over(newest) - 1)
    return d.where(F.col("age") < ways).select("set", "key", "age")


def occupancy(accesses: DataFrame, sets: int = SETS, ways: int = WAYS) -> DataFrame:
    """One row: slots in all, slots in use, distinct keys that were evicted."""
    n = accesses.select("key").distinct().withColumn("set", set_of(F.col("key"), sets)).groupBy("set").agg(F.count("*").alias("n"))
    used = F.coalesce(F.sum(F.least("n", F.lit(ways))), F.lit(0))
    return n.agg(F.lit(sets * ways).cast("bigint").alias("total_slots"), used.alias("used_slots"), (F.coalesce(F.sum("n"), F.lit(0)) - used).alias("evicted"))


class PageCache:
    """Slots in one mapped file: keys, times of last use, pages."""

    def __init__(self, path: str, sets: int):
        self.path, self.sets = path, sets
        n = sets * WAYS
        self.keys = np.memmap(f"{path}/keys", np.int64, "r+", shape=(sets, WAYS))
        self.used = np.memmap(f"{path}/used", np.int64, "r+", shape=(sets, WAYS))
        self.pages = np.memmap(f"{path}/pages", np.uint8, "r+", shape=(n, PAGE_SIZE))
        self.clock = int(self.used.max()) if n else 0
        self.hits = self.misses = 0

    @classmethod
    def create(cls, path: str, identity: str, sets: int = SETS) -> PageCache:
        """A new cache for the store ``identity``; one that is there for the same store is opened as it is."""
        if os.path.exists(f"{path}/identity.json"):
            with open(f"{path}/identity.json") as f:
                if json.load(f) == {"identity": identity, "sets": sets}:
                    return cls.open(path, identity)
            cls.delete(path)
        os.makedirs(path, exist_ok=True)
        for name, shape, value in (("keys", (sets, WAYS), -1), ("used", (sets, WAYS), 0), ("pages", (sets * WAYS, PAGE_SIZE), 0)):
            m = np.memmap(f"{path}/{name}", np.uint8 if name == "pages" else np.int64, "w+", shape=shape)
            if value:
                m[:] = value
            m.flush()
        with open(f"{path}/.identity", "w") as f:  # last: a cache without it is not whole
            json.dump({"identity": identity, "sets": sets}, f)
        os.replace(f"{path}/.identity", f"{path}/identity.json")
        return cls(path, sets)

    @classmethod
    def open(cls, path: str, identity: str) -> PageCache:
        try:
            with open(f"{path}/identity.json") as f:
                found = json.load(f)
        except FileNotFoundError:
            raise FileNotFoundError(f"no cache at {path}: create one first") from None
        if found["identity"] != identity:
            raise ValueError(f"the cache belongs to {found['identity']}")
        return cls(path, found["sets"])

    @staticmethod
    def delete(path: str) -> None:
        for name in ("identity.json", "keys", "used", "pages"):
            if os.path.exists(f"{path}/{name}"):
                os.remove(f"{path}/{name}")

    def _set(self, key: int) -> int:
        return key % MODULUS * MULTIPLIER % MODULUS % self.sets

    def _touch(self, s: int, way: int) -> None:
        self.clock += 1
        self.used[s, way] = self.clock

    def get(self, key: int) -> bytes | None:
        s = self._set(key)
        way = np.flatnonzero(self.keys[s] == key)
        if not len(way):
            self.misses += 1
            return None
        self.hits += 1
        self._touch(s, int(way[0]))
        return self.pages[s * WAYS + int(way[0])].tobytes()

    def put(self, key: int, page: bytes) -> None:
        """Into the key's own slot, else a free one, else the one used longest ago."""
        if len(page) != PAGE_SIZE:
            raise ValueError(f"pages must have {PAGE_SIZE} bytes")
        s = self._set(key)
        own = np.flatnonzero(self.keys[s] == key)
        way = int(own[0]) if len(own) else int(self.used[s].argmin())
        self.pages[s * WAYS + way] = np.frombuffer(page, np.uint8)
        self.keys[s, way] = key
        self._touch(s, way)

    def slots(self, spark: SparkSession) -> DataFrame:
        """(set, way, key, used) of the slots in use."""
        s, w = np.nonzero(self.used)
        rows = zip(s.tolist(), w.tolist(), self.keys[s, w].tolist(), self.used[s, w].tolist(), strict=True)
        return spark.createDataFrame(list(rows), "set int, way int, key bigint, used bigint")

    def report(self) -> dict[str, int]:
        return {"total_slots": self.sets * WAYS, "used_slots": int((self.used > 0).sum()), "hits": self.hits, "misses": self.misses}
