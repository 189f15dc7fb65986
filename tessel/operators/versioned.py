"""Reads and maintenance of version logs: rows with a commit index and a tombstone flag.

A log holds at most one version of a key at a commit, so the newest version has no ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMIT, DELETED = "_commit_index", "_deleted"


def latest(log: DataFrame, keys: Sequence[str], read_at: int | Column | None = None, commit: str = COMMIT) -> DataFrame:
    """The newest version of each key at or before read_at, tombstones included. One aggregation
    with map-side combining; no window, so no sort of whole histories."""
    if read_at is not None:
        log = log.filter(F.col(commit) <= read_at)
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(commit)).alias("_v"))
    return newest.select(*keys, *(F.col("_v")[c].alias(c) for c in rest)).select(*log.columns)


def snapshot(log: DataFrame, keys: Sequence[str], read_at: int | Column | None = None, commit: str = COMMIT, deleted: str = DELETED) -> DataFrame:
    """The rows visible at read_at, without the log's own columns."""
    return latest(log, keys, read_at, commit).filter(~F.col(deleted)).drop(commit, deleted)


def snapshot_over_base(base: DataFrame, changes: DataFrame, keys: Sequence[str], commit: str = COMMIT, deleted: str = DELETED) -> DataFrame:
    """As snapshot() of base and later changes, where base has one version of each key: only the
    changes are aggregated, and base is not shuffled if they are small enough for Spark to broadcast."""
    now = latest(changes, keys, None, commit)
    kept = base.filter(~F.col(deleted)).join(now.select(*keys), list(keys), "left_anti").select(*base.columns)
    return kept.unionByName(now.filter(~F.col(deleted))).drop(commit, deleted)


def overlay(visible: DataFrame, writes: DataFrame, keys: Sequence[str], deleted: str = DELETED) -> DataFrame:
    """A transaction's own view: its puts and deletes (one a key) hide the committed rows."""
    kept = visible.join(writes.select(*keys), list(keys), "left_anti").select(*visible.columns)
    return kept.unionByName(writes.filter(~F.col(deleted)).select(*visible.columns))


def conflicts(writes: DataFrame, log: DataFrame, keys: Sequence[str], read_at: int | Column, commit: str = COMMIT) -> DataFrame:
    """The written keys that another transaction has committed after read_at, with its newest commit."""
    newer = log.filter(F.col(commit) > read_at).groupBy(*keys).agg(F.max(commit).alias(commit))
    return writes.select(*keys).distinct().join(newer, list(keys))


def vacuum(log: DataFrame, keys: Sequence[str], floor: int | Column, commit: str = COMMIT, deleted: str = DELETED) -> DataFrame:
    """The log without what no read at or above floor sees: later versions stay, and of those up to
    floor the newest of each key unless it is a tombstone."""
    old = F.col(commit) <= floor
    rank = F.row_number().over(Window.partitionBy(*keys, old).orderBy(F.col(commit).desc()))
    return log.withColumn("_rank", rank).filter(~old | ((F.col("_rank") == 1) & ~F.col(deleted))).drop("_rank")


def key_errors(log: DataFrame, keys: Sequence[str], commit: str = COMMIT) -> DataFrame:
    """Keys with more than one version at a commit, or with a null: a valid log has none."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return log.groupBy(*keys, commit).agg(F.count("*").alias("versions")).filter((F.col("versions") > 1) | null)
