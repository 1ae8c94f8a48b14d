"""What a running query says about itself, after every batch, without another pass over its rows.

Counts and the newest record are observed while the rows go by; a listener keeps them as they arrive, in a table of one
row for each batch that outlives the query.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "heartbeat"
#: A row of progress; updated_at is the batch's time, seconds how long it took.
PROGRESS = "run string, batch bigint, seen bigint, good bigint, bad bigint, last_ord bigint, last_qid string, last_status string, updated_at string, seconds double"


def observed(rows: DataFrame, key: str = "qid", order: str = "ord", status: str = "status") -> DataFrame:
    """The same rows; their counts and newest record are noticed on the way."""
    good: Column = F.col(status) == "ok"
    last = F.max(F.struct(F.col(order).cast("long").alias("ord"), F.col(key).cast("string").alias("qid"), F.col(status).alias("status")))
    return rows.observe(NAME, F.count(F.lit(1)).alias("seen"), F.count_if(good).alias("good"), F.count_if(F.col(status) == "error").alias("bad"), last.alias("last"))


class Heartbeat(StreamingQueryListener):
    """Hands a row of PROGRESS to `keep` for every batch that had rows; ``wait`` returns once a query has ended."""

    def __init__(self, keep: Callable[[tuple], None]) -> None:
        self.keep = keep
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self._end(str(event.runId))

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        row = (p.observedMetrics or {}).get(NAME)
        if row is not None and row["seen"]:
            last = row["last"]
            self.keep((str(p.runId), p.batchId, row["seen"], row["good"], row["bad"], last["ord"], last["qid"], last["status"], p.timestamp, p.batchDuration / 1000))

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self._end(str(event.runId)).set()

    def wait(self, run: str, seconds: float = 60) -> bool:
        return self._end(run).wait(seconds)
