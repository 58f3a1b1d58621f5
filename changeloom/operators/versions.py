"""Versioned rows: latest state per key, tombstones, replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_versions(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """A1, W4. The last row of each key by ``order`` (most significant first), tombstones included.

    A top-1 window: Spark keeps one row a key on each map task before the shuffle (WindowGroupLimit), so a key with any
    number of versions sends one row a task. Rows are picked whole: a NULL in the winner stays NULL.
    """
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")


def live_rows(rows: DataFrame, deleted: str = "_is_deleted") -> DataFrame:
    """F13."""
    return rows.filter(~F.col(deleted))


def latest_state(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, soft_delete: bool = False, deleted: str = "_is_deleted") -> DataFrame:
    """A1. What a key's last version says; ``soft_delete`` keeps keys whose last version is a tombstone."""
    last = latest_versions(rows, keys, order)
    return last if soft_delete else live_rows(last, deleted)


def arg_max(rows: DataFrame, keys: Sequence[str], value: str, version: str) -> DataFrame:
    """A2. ``value`` at the greatest version where it is not NULL; NULL where it always is."""
    present = F.when(F.col(value).isNotNull(), F.col(version))
    return rows.groupBy(*keys).agg(F.max_by(value, present).alias(value))


def keyless_state(rows: DataFrame, *, merge_by_lsn: bool = False) -> DataFrame:
    """Tables without a key append by (lsn, tuple_idx), so replays collapse and rows of one record stay apart.

    ``merge_by_lsn`` is the mode in which the lsn alone is the key: of rows that share one, the last tuple stays.
    """
    return latest_versions(rows, ["lsn"], ["tuple_idx"]) if merge_by_lsn else rows.dropDuplicates(["lsn", "tuple_idx"])


def previous_image(rows: DataFrame, keys: Sequence[str], value: str | Column, order: str, name: str = "prev") -> DataFrame:
    """W8. The last ``value`` that is not NULL of the same key before each row, to fill in what a partial row lacks."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))


def union_loads(*loads: DataFrame) -> DataFrame:
    """U2. Baseline, replay and live rows together; a latest state over them takes the highest version of each key."""
    out = loads[0]
    for more in loads[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def rekeyed_tombstones(rows: DataFrame, keys: Sequence[str], old_keys: Sequence[str]) -> DataFrame:
    """Tombstones for the old keys of updates that change a key (an option: by default the old key stays live)."""
    moved = rows.filter(F.col("op").isin("U", "H"))
    changed = None
    for new, old in zip(keys, old_keys, strict=True):
        differs = F.col(old).isNotNull() & ~F.col(new).eqNullSafe(F.col(old))
        changed = differs if changed is None else changed | differs
    stones = moved.filter(changed).withColumns({new: F.col(old) for new, old in zip(keys, old_keys, strict=True)})
    return stones.withColumn("_is_deleted", F.lit(True))


def compact(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], floor: int, version: str = "_lsn") -> DataFrame:
    """A smaller table of equal state: last versions, without tombstones below the resume ``floor``.

    Newer tombstones stay, as a replay from the floor could bring their keys back.
    """
    return latest_versions(rows, keys, order).filter(~(F.col("_is_deleted") & (F.col(version) < floor)))
