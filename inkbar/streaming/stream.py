"""The same detection on a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkbar import schema as S
from inkbar.functions.rules import Rule
from inkbar.operators.dedup import with_fingerprint
from inkbar.operators.detect import detect_pii
from inkbar.operators.validate import text_checks, with_verdict
from inkbar.plans.job import redact_per_row_options

LANES = 64
BUCKET_DIGITS = 3  # of a fingerprint, which is hexadecimal: 4096 buckets
SETTLED = 256  # groups of settled rows
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKS = "req_id long, fp string, cached boolean"


def stream_redact(
    requests: DataFrame,
    extra_rules: tuple[Rule, ...] = (),
    max_bytes: int = S.MAX_TEXT_BYTES,
) -> DataFrame:
    """Validate, detect and redact every arriving request.

    A refused request stays in the output with its status and reason and without
    spans.  The plan keeps no state, so order and lateness do not matter and the
    same function serves batch tables.
    """
    judged = with_verdict(requests, text_checks(requests, max_bytes))
    refused = F.col("status").isNotNull()
    guarded = judged.withColumn("_text", F.col("text")).withColumn(
        "text", F.when(~refused, F.col("text"))
    )
    done = redact_per_row_options(detect_pii(guarded, extra_rules=extra_rules))
    return done.withColumn("text", F.col("_text")).drop("_text")


def first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle repeats inside one Arrow batch.

    Only the earliest request of a fingerprint in a batch still has to ask the
    state (lane 0).  The others are repeats for certain and are spread over the
    other lanes.
    """
    for b in batches:
        open_rows = b.sort_values("req_id").drop_duplicates("fp").index
        lane = 1 + b["req_id"] % LANES
        lane.loc[open_rows] = 0
        yield b.assign(lane=lane.astype("int32"))


def keyed(laned: DataFrame) -> DataFrame:
    """``laned`` with the key ``asks, lane`` of a Python call: a fingerprint that asks the state, or any settled rows.

    A call for each settled text and lane would be nearly one for each row.  Settled rows keep the sign of their lane.
    """
    spread = F.pmod(F.xxhash64("req_id", "fp"), F.lit(SETTLED)).cast("int")
    settled = F.when(F.col("lane") > 0, 1 + spread).otherwise(-1 - spread)
    asking = F.col("lane") == 0
    return laned.withColumns(
        {"asks": F.when(asking, F.col("fp")).otherwise(""), "lane": F.when(asking, F.col("lane")).otherwise(settled)}
    )


def _decide(
    key: tuple[Any, ...],
    batches: Iterator[pd.DataFrame],
    state: GroupState,
    ttl_ms: int | None,
) -> Iterator[pd.DataFrame]:
    fp, lane = key
    if lane > 0:
        for b in batches:
            yield pd.DataFrame({"req_id": b["req_id"], "fp": b["fp"], "cached": True})
        return
    if state.hasTimedOut:
        state.remove()
        return
    # One id per Arrow batch that held this fingerprint, so a short list.
    ids = pd.concat([b["req_id"] for b in batches])
    cached = pd.Series(True, index=range(len(ids)))
    if not state.exists:
        cached[int(ids.to_numpy().argmin())] = False
        state.update((int(ids.min()),))
    if ttl_ms is not None:
        state.setTimeoutDuration(ttl_ms)
    yield pd.DataFrame({"req_id": ids.to_numpy(), "fp": fp, "cached": cached.to_numpy()})


class Seen(StatefulProcessor):
    """Which fingerprints of a bucket were asked for: a map, of which a batch reads and adds single entries."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "fp string", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] > 0:
            for b in rows:
                yield pd.DataFrame({"req_id": b["req_id"], "fp": b["fp"], "cached": True})
            return
        # a row for each fingerprint of the bucket and Arrow batch
        asked = pd.concat(list(rows)).sort_values(["fp", "req_id"])
        cached, last = [], None
        for fp, first in zip(asked["fp"].tolist(), asked["req_id"].tolist()):
            known = fp == last or self.seen.containsKey((fp,))
            if not known:
                self.seen.updateValue((fp,), (int(first),))
            cached.append(known)
            last = fp
        yield pd.DataFrame({"req_id": asked["req_id"], "fp": asked["fp"], "cached": cached})

    def close(self) -> None:
        pass


def stream_mark_cached(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``req_id, fp, cached`` for a stream.

    The state is one number for each distinct text: without a time limit it grows with
    the number of distinct texts for as long as the stream runs.  It is then a map for each
    bucket of fingerprints, which needs the RocksDB store that ``start_to_files`` chooses.
    With ``ttl_ms`` a fingerprint is forgotten when it was not asked for that
    long; Spark then keeps running batches to look for expired keys, so such a
    stream is for a continuous trigger and does not end under ``availableNow``.

    The text is replaced by its fingerprint before anything is shuffled.  Within
    each Arrow batch all but one request of a fingerprint are settled on the spot
    and spread over lanes, so a text that makes up a third of the stream does not
    run through one task.
    """
    keys = with_fingerprint(requests).select("req_id", "fp")
    laned = keys.mapInPandas(first_of_batch, "req_id long, fp string, lane int")

    if ttl_ms is None:
        bucket = F.when(F.col("lane") == 0, F.substring("fp", 1, BUCKET_DIGITS)).otherwise("")
        return keyed(laned).withColumn("asks", bucket).groupBy("asks", "lane").transformWithStateInPandas(
            statefulProcessor=Seen(), outputStructType=MARKS, outputMode="append", timeMode="None"
        )

    def decide(key, batches, state):
        yield from _decide(key, batches, state, ttl_ms)

    return keyed(laned).groupBy("asks", "lane").applyInPandasWithState(
        decide,
        MARKS,
        "first long",
        "append",
        GroupStateTimeout.NoTimeout
        if ttl_ms is None
        else GroupStateTimeout.ProcessingTimeTimeout,
    )


def start_to_files(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append a stream to parquet files.

    State is kept in RocksDB, on the executors' disks, with its changes in the checkpoint
    folder; the store is chosen for this query only.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        return _started(stream, path, checkpoint, available_now)
    finally:
        if before is None:
            conf.unset(STORE)
        else:
            conf.set(STORE, before)


def _started(stream: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
