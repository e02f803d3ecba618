"""Keeping a streaming query alive: restarts with growing pauses, and counts of what each batch carried."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

OBSERVED = "records"


def observed(df: DataFrame, moment: str | None = None, name: str = OBSERVED) -> DataFrame:
    """The stream with its rows counted on the way, and the newest `moment` where one is named; no extra job."""
    newest = [F.max(moment).alias("newest")] if moment else []
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *newest)


@dataclass
class Feed(StreamingQueryListener):
    """What `observed` streams have carried so far: rows and batches by query name, and the newest moment seen.

    Add it with `spark.streams.addListener`. A batch that is repeated after a failure reports once, when it succeeds.
    """
    rows: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    newest: dict[str, float | None] = field(default_factory=dict)
    failures: dict[str, int] = field(default_factory=dict)
    observation: str = OBSERVED
    _names: dict = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self._names[event.runId] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.observation)
        name = progress.name or str(progress.id)
        if seen is None or not progress.numInputRows:
            return
        self.rows[name] = self.rows.get(name, 0) + seen["rows"]
        self.batches[name] = self.batches.get(name, 0) + 1
        if "newest" in seen.asDict() and seen["newest"] is not None:
            self.newest[name] = max(seen["newest"], self.newest.get(name) or seen["newest"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            name = self._names.get(event.runId, str(event.id))
            self.failures[name] = self.failures.get(name, 0) + 1

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, rows, batches, newest, failures): input of `feed_status`."""
        names = sorted({*self.rows, *self.failures})
        return spark.createDataFrame(
            [(n, self.rows.get(n, 0), self.batches.get(n, 0), self.newest.get(n), self.failures.get(n, 0)) for n in names],
            "name string, rows bigint, batches bigint, newest double, failures bigint")


@dataclass
class Pauses:
    """Seconds before a restart: doubled each time up to the longest, for a number of restarts in a row."""
    restarts: int = 5
    first: float = 1.0
    longest: float = 60.0

    def seconds(self, failure: int) -> float:
        return min(self.longest, self.first * 2.0 ** (failure - 1))


def supervise(start: Callable[[], StreamingQuery], pauses: Pauses | None = None, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Run a query to its end, starting it anew when it fails; returns the run that ended well.

    `start` must use the same checkpoint each time: a new run takes up the batch that failed, so with a
    sink that replaces or recognises a batch every row arrives once. A run that gets further than the
    one before counts as a recovery and the pauses begin anew. After too many failures in a row the
    last error is raised.
    """
    pauses = pauses or Pauses()
    failures, reached = 0, -1
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            got_to = max((p["batchId"] for p in query.recentProgress), default=-1)
            failures = 1 if got_to > reached else failures + 1
            reached = max(reached, got_to)
            if failures > pauses.restarts:
                raise
            sleep(pauses.seconds(failures))
