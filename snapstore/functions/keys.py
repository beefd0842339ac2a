"""Combined keys: page address in the high bits, 19 bits of snapshot id below.

Keys are BIGINT bit patterns: from address 2**44 on bit 63 is set, so sort by
(pa, snapshot_id), never by the key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_PA, MAX_SNAPSHOT, SNAPSHOT_BITS


def pack_key(pa: str, snapshot_id: str) -> Column:
    return F.shiftleft(F.col(pa).cast("bigint"), SNAPSHOT_BITS).bitwiseOR(F.col(snapshot_id).cast("bigint").bitwiseAND(F.lit(MAX_SNAPSHOT)))


def key_pa(key: str) -> Column:
    return F.shiftrightunsigned(F.col(key), SNAPSHOT_BITS)


def key_snapshot(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(MAX_SNAPSHOT)).cast("int")


def worker_of(pa: str, workers: int) -> Column:
    if not 1 <= workers <= 255:
        raise ValueError("workers must be 1 to 255")
    return F.pmod(F.col(pa), F.lit(workers)).cast("smallint")


def check_snapshot(snapshot_id: int) -> int:
    if not 0 <= snapshot_id <= MAX_SNAPSHOT:
        raise ValueError(f"snapshot id {snapshot_id} is outside 0..{MAX_SNAPSHOT}")
    return snapshot_id


def snapshot_in_range(snapshot_id: str) -> Column:
    """Whether an id fits its 19 bits (false for null)."""
    return F.coalesce(F.col(snapshot_id).between(0, MAX_SNAPSHOT), F.lit(False))


def checked_pa(pa: str) -> Column:
    """The address, or an error in the plan where it does not fit 45 bits."""
    return F.when(F.col(pa).between(0, MAX_PA), F.col(pa)).otherwise(F.raise_error(F.lit("page address outside 45 bits")).cast("bigint"))
