"""Counters of calls and time by phase, and logs of latencies."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession


class Timings:
    """Calls and nanoseconds of named phases, counted on the driver (tasks have Spark's own metrics)."""

    def __init__(self):
        self.calls: dict[str, int] = defaultdict(int)
        self.ns: dict[str, int] = defaultdict(int)

    @contextlib.contextmanager
    def phase(self, name: str):
        start = time.perf_counter_ns()
        try:
            yield
        finally:
            self.calls[name] += 1
            self.ns[name] += time.perf_counter_ns() - start

    def rows(self, spark: SparkSession) -> DataFrame:
        """(phase, calls, total_ns)."""
        return spark.createDataFrame([(k, n, self.ns[k]) for k, n in self.calls.items()], "phase string, calls bigint, total_ns bigint")

    def write(self, path: str) -> None:
        """One JSON object: for each phase its calls and nanoseconds."""
        with open(f"{path}.part", "w") as f:
            json.dump({k: {"calls": n, "total_ns": self.ns[k]} for k, n in sorted(self.calls.items())}, f)
        os.replace(f"{path}.part", path)


def write_latencies(store, probes: list[tuple[int, int]], path: str, process_id: int = 0, cache=None) -> None:
    """Load each (page address, snapshot id) and write its latency as a CSV row below ``path``."""
    rows = []
    for k, (pa, snapshot_id) in enumerate(probes):
        start = time.perf_counter_ns()
        store.load_page(pa, snapshot_id, cache=cache)
        rows.append((process_id, k, pa, time.perf_counter_ns() - start))
    d = store.spark.createDataFrame(rows, "process_id int, access_idx bigint, page_idx bigint, latency_ns bigint")
    d.coalesce(1).write.option("header", True).csv(path)
