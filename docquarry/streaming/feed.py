"""Change feed and replication over a collection's log.

``changes`` is a batch of what was committed after a position; ``watch`` is the same as a stream over the log's file sets.
A filter is applied to the record's data, so deletes, which have none, pass no filter but the empty one.
Replication copies log entries in order and skips those a follower has.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.errors import Conflict
from docquarry.operators.filters import where
from docquarry.plans.collection import EVENTS, Collection, Subscription
from docquarry.plans.storage import COLUMNS

__all__ = ["EVENTS", "Subscription", "changes", "each_in_order", "events", "follow", "lag", "position", "promote", "replicate", "watch"]


def events(log: DataFrame, filter: Any = None) -> DataFrame:
    """op, id, data, ts and seq of log entries, in no order; works on streams too."""
    kind = F.coalesce(*(F.when(F.col("op") == k, F.lit(v)) for k, v in EVENTS.items()))
    return where(log, filter, "data").select(kind.alias("op"), "id", "data", "ts", "seq")


def changes(c: Collection, after_seq: int = 0, filter: Any = None) -> DataFrame:
    """Events committed after a position, by position."""
    return events(c.log().where(F.col("seq") > after_seq), filter).orderBy("seq")


def position(c: Collection) -> int:
    return c.storage.version().next_seq - 1


def watch(c: Collection, filter: Any = None, from_seq: int | None = None, files_per_trigger: int = 64) -> DataFrame:
    """A stream of events after ``from_seq`` (now by default).  Back-pressure bounds a batch; none is dropped.

    File sets appear in the streamed folder once their commit stands, so a writer that was forestalled leaves no event.
    Compaction writes elsewhere, so it repeats none.
    """
    start = position(c) if from_seq is None else from_seq
    c.storage.files.mkdirs(f"{c.storage.path}/data")
    stream = c.spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{c.storage.path}/data")
    return events(stream.where(F.col("seq") > start), filter)


def each_in_order(sink: Callable[[list], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands a batch's events to ``sink`` by position, in parts of bounded size."""

    def run(batch: DataFrame, _: int) -> None:
        part = []
        for row in batch.orderBy("seq").toLocalIterator():
            part.append(row)
            if len(part) == 1000:
                sink(part)
                part = []
        if part:
            sink(part)

    return run


def replicate(leader: Collection, follower: Collection) -> int:
    """Appends the leader's entries beyond the follower's position; how many.

    Running it again, or after a failure, adds none twice: the position moves with the commit.  From the first time on the follower
    takes no entries of its own, which would be numbered like the leader's next ones, until it is promoted.
    """
    base = follower.storage.version()
    if base.number and not base.replica:
        raise Conflict("the follower has entries of its own")
    top = position(leader)
    news = leader.log().where((F.col("seq") >= base.next_seq) & (F.col("seq") <= top))
    n = news.count()
    if not n:
        return 0
    name = follower.storage.write(news)
    v = leader.storage.version()
    # Only entries that replace others make a follower's reads look for the last of each id
    changes = not follower.storage.log(base, [name]).where("op <> 'insert'").limit(1).isEmpty()
    try:
        follower.storage.commit(base, [*base.sets, name], max(base.next_id, v.next_id), top + 1, base.log_rows + n, "replicate", [*base.changing, *[name] * changes], replica=True)
    except Conflict:
        follower.storage.discard(name)
        raise
    return n


def lag(leader: Collection, follower: Collection) -> int:
    return position(leader) - position(follower)


def promote(leader: Collection, follower: Collection, open_writes: Callable[[], None], most_lag: int = 0) -> None:
    """Lets a follower take writes unless it lacks more than ``most_lag`` entries."""
    behind = lag(leader, follower)
    if behind > most_lag:
        raise Conflict(f"the follower lacks {behind} entries")
    follower.open_writes()
    open_writes()


def follow(leader: Collection, follower: Collection, stop: Callable[[], bool], every_seconds: float = 1.0, on_error: Callable[[Exception], None] | None = None) -> int:
    """Replicates until ``stop`` says so; failed rounds are reported and tried again after a longer wait.  How many entries came."""
    total, wait = 0, every_seconds
    while not stop():
        try:
            total += replicate(leader, follower)
            wait = every_seconds
        except Exception as e:  # noqa: BLE001  the leader may be away for a while
            if on_error:
                on_error(e)
            wait = min(2 * wait, 60 * every_seconds)
        if not stop():
            time.sleep(wait)
    return total
