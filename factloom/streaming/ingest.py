"""Structured Streaming: idempotent ingest, a token bucket, and jobs with leases over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators import snapshots as S
from factloom.operators.stateful import LEASE_WAITS_US, STALE_US, Lease


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Append each micro-batch, last row of a key first settled within it; a replayed batch overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        S.last_write(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """What ingest() has stored: the last row of each key over all batches, late ones too."""
    return S.last_write(spark.read.option("basePath", path).parquet(path), keys, order).drop("batch")


def limited(stream: DataFrame, capacity: float, seconds: float) -> DataFrame:
    """user_id, calls and allowed of each micro-batch (user_id, at in microseconds), by a token bucket kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, stamp = state.get if state.exists else (capacity, -1)
        calls = allowed = 0
        for batch in batches:  # a user's rows come in portions, each read in its own order; what is late refills nothing
            for at in sorted(batch["at"]):
                if stamp >= 0:
                    tokens = min(capacity, tokens + max(0, at - stamp) / 1e6 * capacity / seconds)
                stamp = max(stamp, at)
                calls += 1
                if tokens >= 1:
                    tokens, allowed = tokens - 1, allowed + 1
        state.update((float(tokens), int(stamp)))
        yield pd.DataFrame({"user_id": [key[0]], "calls": [calls], "allowed": [allowed]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, calls long, allowed long", "tokens double, stamp long", "append", GroupStateTimeout.NoTimeout)


def leased(stream: DataFrame, late: str = "10 seconds", stale: int = STALE_US, waits: tuple[int, ...] = LEASE_WAITS_US) -> DataFrame:
    """job, at, kind, worker, status, retries and note of each event of each job (stream: job, at as a timestamp, kind, worker), and of each lease that ends.

    A job's lease is a timer of event time: where the watermark passes it and the worker was not heard of, the job is
    queued again or has failed, also if no event of the job comes any more (kind EXPIRED).  Events of a job within a batch are
    taken in the order of their times.
    """
    fields = "job string, at timestamp, kind string, worker string, status string, retries int, note string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease, out = Lease(stale, waits, state.get if state.exists else None), []

        def told(at: int, kind: str, worker: str, note: str) -> None:
            out.append((key[0], pd.Timestamp(at, unit="us"), kind, worker, lease.status, lease.retries, note))

        if state.hasTimedOut:
            at = (lease.ends or 0) + 1
            if note := lease.expire(at):
                told(at, "EXPIRED", "", note)
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "kind"], kind="stable")
            for at, kind, worker in zip(rows["at"].astype("datetime64[us]").astype("int64"), rows["kind"], rows["worker"], strict=True):
                told(at, kind, worker, lease.step(at, kind, worker).rsplit(":", 1)[1])
        state.update(lease.held)
        if lease.ends is not None:
            state.setTimeoutTimestamp(max(lease.ends // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job", "at", "kind", "worker", "status", "retries", "note"])

    return stream.withWatermark("at", late).groupBy("job").applyInPandasWithState(
        step, fields, "status string, worker string, retries int, heard long, not_before long", "append", GroupStateTimeout.EventTimeTimeout
    )
