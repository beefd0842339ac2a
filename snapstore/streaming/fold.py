"""The encoder as a stateful stream: each address keeps its latest full page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.encode import ENCODED, Shadow

STATE = "last_snapshot int, base_snapshot int, base_page binary"


def encode_stream(pages: DataFrame, threshold: int = 0) -> DataFrame:
    """A stream of (pa, snapshot_id, page) as chunks; an id not above the address's last is an error.

    Within a micro-batch an address's rows are taken in snapshot order.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, base_snapshot, base_page = state.get if state.exists else (None, None, None)
        shadow = Shadow(threshold, base_snapshot, None if base_page is None else bytes(base_page))
        rows = pd.concat(list(frames)).sort_values("snapshot_id")
        out = []
        for snapshot_id, page in zip(rows["snapshot_id"], rows["page"], strict=True):
            if last is not None and snapshot_id <= last:
                raise ValueError(f"snapshot id {snapshot_id} of page {key[0]} is not above {last}")
            last = int(snapshot_id)
            out.append((key[0], last, *shadow.encode(last, bytes(page))))
        state.update((last, shadow.snapshot_id, shadow.page))
        yield pd.DataFrame(out, columns=["pa", "snapshot_id", "kind", "base_snapshot", "page", "patch"]).astype({"base_snapshot": "Int32"})

    return pages.select("pa", "snapshot_id", "page").groupBy("pa").applyInPandasWithState(fold, ENCODED, STATE, "append", "NoTimeout")
