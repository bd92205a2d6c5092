"""From an operation log to the records that are live."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.values import path


def now_nanos() -> int:
    return time.time_ns()


def visible(now: int) -> Column:
    """Not past its deadline; 0 and null never expire."""
    return F.coalesce(F.col("expires_at"), F.lit(0)).isin(0) | (F.col("expires_at") > F.lit(now))


def latest(log: DataFrame, order: str = "seq") -> DataFrame:
    """The last entry of each id by log position; deletes carry no rev, so rev can't order entries."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("e")).select("id", "e.*")


def live(log: DataFrame, now: int | None = None, order: str = "seq") -> DataFrame:
    """Live records: id, key, rev, ts, expires_at, data.  One aggregation with partial results before its shuffle."""
    return records(latest(log, order).where("op <> 'delete'"), now)


def live_split(plain: DataFrame, changing: DataFrame, now: int | None = None) -> DataFrame:
    """live() of a log in two parts: inserts of distinct ids, and everything else.

    Only the changes are aggregated; the inserts lose the ids that changed by an anti-join, whose small side Spark broadcasts
    while it is small, so unchanged records are scanned with their predicates and not shuffled.
    """
    touched = changing.select("id").distinct()
    return records(plain.join(touched, "id", "left_anti"), now).unionByName(live(changing, now))


def records(entries: DataFrame, now: int | None) -> DataFrame:
    """Records of entries that are each the last of their id."""
    return entries.where(visible(now_nanos() if now is None else now)).select("id", F.try_variant_get("data", path("_key"), "string").alias("key"), "rev", "ts", F.coalesce("expires_at", F.lit(0)).alias("expires_at"), "data")
