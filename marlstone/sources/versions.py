"""Version logs: every row of a table as it was written, and what a reader at a time sees.

A log has the table's columns and ``_pk`` (the key as text), ``_commit_ts`` and
``_deleted``. A snapshot is the newest version of each key that is no later than
its time, without those that are deletions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("_pk", "_commit_ts", "_deleted")


def versions(df: DataFrame, key: str, commit_ts: int | Column, deleted: bool = False) -> DataFrame:
    """``df``'s rows as versions written at one time."""
    ts = commit_ts if isinstance(commit_ts, Column) else F.lit(commit_ts)
    return df.withColumns({"_pk": F.col(key).cast("string"), "_commit_ts": ts.cast("long"), "_deleted": F.lit(deleted)})


def tombstones(keys: DataFrame, log: DataFrame, key: str, commit_ts: int) -> DataFrame:
    """Deletions of ``keys`` (a column ``key``) in the shape of ``log``."""
    kinds = dict(log.dtypes)
    rest = [F.lit(None).cast(kinds[c]).alias(c) if c != key else F.col(key) for c in log.columns if c not in META]
    return versions(keys.select(*rest), key, commit_ts, deleted=True)


def latest(log: DataFrame, snapshot_ts: int | None = None) -> DataFrame:
    """The newest visible version of each key, deletions included; partial maxima, then one exchange."""
    seen = log if snapshot_ts is None else log.where(F.col("_commit_ts") <= snapshot_ts)
    rest = [c for c in log.columns if c != "_pk"]
    newest = seen.groupBy("_pk").agg(F.max_by(F.struct(*rest), F.col("_commit_ts")).alias("_row"))
    return newest.select("_pk", "_row.*")


def snapshot(log: DataFrame, snapshot_ts: int | None = None) -> DataFrame:
    """The table as of ``snapshot_ts``."""
    live = latest(log, snapshot_ts).where(~F.col("_deleted"))
    return live.select(*[c for c in log.columns if c not in META])


def overlay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``base`` with changed keys replaced. Both have ``_pk``; ``changes`` has one row a key, and ``_deleted``.

    Rows that are not in ``base`` come in too. The exchange is of keys only if the
    changes are small enough to broadcast, which adaptive execution sees.
    """
    kept = base.join(changes.select("_pk"), "_pk", "left_anti")
    return kept.unionByName(changes.where(~F.col("_deleted")).select(*base.columns))


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def key_range(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Keys from ``low`` up to but not including ``high``, in the key's own order; either may be open."""
    out = df
    if low is not None:
        out = out.where(F.col(key) >= low)
    return out if high is None else out.where(F.col(key) < high)


def text_range(df: DataFrame, key: str, low: str = "", high: str | None = None) -> DataFrame:
    """As ``key_range``, by the bytes of the key's text: ``['9', '91')`` holds 9, 90, 900 and 909."""
    text = F.col(key).cast("string")
    out = df.where(text >= low)
    return out if high is None else out.where(text < high)
