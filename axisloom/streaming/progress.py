"""Reports of progress while a job or a stream runs, to a callback."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent


def by_blocks(df: DataFrame, key: str, n: int, blocks: int, action: Callable[[DataFrame], Any], callback: Callable[[int, int, int], None]) -> None:
    """Runs an action on blocks of positions (0 .. n - 1 of key), and after each calls back with the blocks done, all blocks, and the
    rows so far. On a layout clustered by the key a block reads only its own row groups; rows outside 0 .. n - 1 belong to none."""
    size, rows = -(-n // max(1, blocks)), 0
    bounds = list(range(0, n, size)) if n else []
    for done, lo in enumerate(bounds, 1):
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        action(df.where((F.col(key) >= lo) & (F.col(key) < min(lo + size, n))).observe(seen, F.count(F.lit(1)).alias("rows")))
        rows += seen.get["rows"]
        callback(done, len(bounds), rows)


def by_tasks(spark: SparkSession, action: Callable[[], Any], callback: Callable[[int, int], None], every: float = 0.2) -> Any:
    """Runs an action and calls back with the tasks done and those of stages begun so far whenever these change. Both only rise; the last call is at the end."""
    sc, group, out = spark.sparkContext, f"progress-{uuid.uuid4().hex}", {}

    def run() -> None:
        sc.setJobGroup(group, "with progress")
        try:
            out["value"] = action()
        except BaseException as e:  # the caller's thread raises it
            out["error"] = e

    thread, tracker, said, stages = InheritableThread(target=run), sc.statusTracker(), (0, 0), {}
    thread.start()
    while True:
        thread.join(every)
        ended = not thread.is_alive()
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s is not None and (s.numActiveTasks or s.numCompletedTasks):  # skipped stages never begin
                    was = stages.get(stage, (0, 0))
                    stages[stage] = (max(was[0], s.numCompletedTasks), max(was[1], s.numTasks))
        now = (sum(d for d, _ in stages.values()), sum(t for _, t in stages.values()))
        if now != said:
            said = now
            callback(*now)
        if ended:
            break
    if "error" in out:
        raise out["error"]
    return out["value"]


class Watch(StreamingQueryListener):
    """Adds up the rows of every batch, by query."""

    def __init__(self, callback: Callable[[str, int, int], None]):
        self.callback, self.rows = callback, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if p.numInputRows:
            self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
            self.callback(p.name or str(p.id), p.batchId, self.rows[str(p.id)])

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


@contextmanager
def watching(spark: SparkSession, callback: Callable[[str, int, int], None]) -> Iterator[Watch]:
    """While it lasts, callback(query, batch, rows so far) after each batch that had rows, of any stream of the session."""
    w = Watch(callback)
    spark.streams.addListener(w)
    try:
        yield w
    finally:
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)  # reports on their way
        spark.streams.removeListener(w)
