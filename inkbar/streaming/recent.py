"""Repeat marks on a stream that remember a request for a stated time only.

A request is a repeat if one of the same text and options came before it, or at most the time limit
before it, in event time; each request renews the memory.  The state of a fingerprint is the latest
time at which it was asked.  An event-time timer drops it when the watermark has passed
that time and the limit, so the state is bounded by the distinct texts of a stretch as
long as the limit and the watermark's delay together, and a drained run ends.

Inside an Arrow batch, requests fall into runs without a gap beyond the limit.  All of a run but its
first are repeats for certain and need no state; they are spread over lanes.  A run's first
request asks the state, with the time at which the run ends.

Defined cases.  No request is dropped: one that is later than the watermark is judged by what is
remembered when it comes.  It is a repeat if its fingerprint still is, also
where the time remembered is later than its own, and else it is not; it is then remembered until
the watermark moves on.  Requests of one time follow their ``req_id``.  A request without a time is
never a repeat and is not remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkbar.operators.dedup import with_fingerprint
from inkbar.streaming.stream import keyed

LANES = 64
MARKS = "req_id long, fp string, cached boolean"
_RUNS = "req_id long, fp string, at long, until long, lane int"


def runs_of_batch(limit: int) -> Callable:
    """Requests ``(req_id, fp, at)`` with a lane: 0 asks the state, -1 has no time, the others are repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["fp", "at", "req_id"]).reset_index(drop=True)
            timed = b["at"].notna()
            gap = b.groupby("fp")["at"].diff()
            head = timed & ~(gap <= limit)
            number = head.cumsum()
            until = b["at"].groupby(number).transform("max")
            lane = 1 + b["req_id"].fillna(0).astype("int64") % LANES
            lane[head], lane[~timed] = 0, -1
            yield b.assign(at=b["at"].astype("Int64"), until=until.astype("Int64"), lane=lane.astype("int32"))

    return run


class Recent(StatefulProcessor):
    """Decides the first requests of runs; ``limit`` is in microseconds."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "at long")

    def _timer(self, at: int) -> int:
        """The millisecond at which a request asked for at ``at`` is forgotten."""
        return (at + self.limit) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fp, lane = key
        if lane != 0:
            for b in rows:
                yield pd.DataFrame({"req_id": b["req_id"], "fp": b["fp"], "cached": lane > 0})
            return
        # a row for each run of an Arrow batch, so a short list
        runs = pd.concat(list(rows))
        if len(runs) > 1:
            runs = runs.sort_values(["at", "req_id"])
        last = before = int(self.asked.get()[0]) if self.asked.exists() else None
        cached = []
        for at, until in zip(runs["at"].tolist(), runs["until"].tolist()):
            cached.append(last is not None and at - last <= self.limit)
            last = int(until) if last is None else max(last, int(until))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.asked.update((last,))
            # a timer must lie ahead: what is behind the watermark goes when it moves on
            now = timerValues.getCurrentWatermarkInMs()
            self.handle.registerTimer(max(self._timer(last), now + 1))
        yield pd.DataFrame({"req_id": runs["req_id"], "fp": fp, "cached": cached})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # of a late request the timer was set ahead, so there may be an earlier one: only the due one counts
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.asked.exists() and self._timer(int(self.asked.get()[0])) <= due:
            self.asked.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_mark_recent(requests: DataFrame, limit: str, delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``req_id, fp, cached`` for a stream of requests with a time; ``limit`` and ``delay`` are intervals.

    The watermark times the forgetting only.  Its column is left out before the state, so that
    Spark drops no late request.
    """
    micros = int(pd.Timedelta(limit).total_seconds() * 1_000_000)
    timed = requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    keys = with_fingerprint(timed).select("req_id", "fp", F.unix_micros(time).alias("at"))
    laned = keyed(keys.mapInPandas(runs_of_batch(micros), _RUNS))
    return laned.groupBy("asks", "lane").transformWithStateInPandas(
        statefulProcessor=Recent(micros), outputStructType=MARKS, outputMode="append", timeMode="EventTime"
    )
