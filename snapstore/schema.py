"""Constants and explicit schemas of the page store."""

from __future__ import annotations

PAGE_SIZE = 4096
WORDS = 512
SNAPSHOT_BITS = 19
MAX_SNAPSHOT = (1 << SNAPSHOT_BITS) - 1
MAX_PA = (1 << 45) - 1
DEFAULT_THRESHOLD = 256
FULL, DELTA, ZERO = 0, 1, 2

PATCH = "array<struct<w:smallint,x:bigint>>"
PAGES = "pa bigint, snapshot_id int, page binary"
CHUNKS = f"pa bigint, snapshot_id int, seq bigint, kind tinyint, worker_id smallint, base_snapshot int, page binary, patch {PATCH}"
