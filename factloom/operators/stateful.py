"""Folds in which each row depends on what was decided before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def fold(df: DataFrame, key: str, order: list[str | Column], make: Callable[[], Callable[..., object]], inputs: list[str], out: str, kind: str) -> DataFrame:
    """df with a column that a step function, made anew for each key, returns row by row in that order.

    Rows of a key stand together and sorted in one partition and are read in batches, so a key may be of any length:
    only the step's own state is held.  Values come as Python's own (whole numbers stay whole, null is None and a key
    like any other).  A step per row is what the order asks for: each decision depends on the one before.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {kind}"
    arrow = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for b in batches:
            got = []
            for k, *values in zip(b.column(key).to_pylist(), *[b.column(c).to_pylist() for c in inputs], strict=True):
                if k != now:
                    now, step = k, make()
                got.append(step(*values))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow)], names=[*b.schema.names, out])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def sliding_limiter(limit: int, window: int) -> Callable[[], Callable[[int], bool]]:
    """Allows a call if fewer than limit allowed ones are no older than window; denied calls are not recorded."""

    def make() -> Callable[[int], bool]:
        hits: deque[int] = deque()

        def step(at: int) -> bool:
            while hits and at - hits[0] > window:
                hits.popleft()
            if len(hits) >= limit:
                return False
            hits.append(at)
            return True

        return step

    return make


def token_bucket(capacity: float, per: int) -> Callable[[], Callable[[int], bool]]:
    """Refills capacity in `per` units of time, capped; a denied call spends nothing."""

    def make() -> Callable[[int], bool]:
        tokens, stamp = capacity, None

        def step(at: int) -> bool:
            nonlocal tokens, stamp
            if stamp is not None:
                tokens = min(capacity, tokens + (at - stamp) * capacity / per)
            stamp = at
            if tokens < 1:
                return False
            tokens -= 1
            return True

        return step

    return make


def budget(most: int) -> Callable[[], Callable[[int | None], bool | None]]:
    """Takes a size if it fits into what is left; one that does not fit is passed over and takes nothing, a null size too."""

    def make() -> Callable[[int | None], bool | None]:
        used = 0

        def step(size: int | None) -> bool | None:
            nonlocal used
            if size is None:
                return None
            if used + size > most:
                return False
            used += size
            return True

        return step

    return make


def batches(most: int, limit: int | None = None) -> Callable[[], Callable[[int | None], int | None]]:
    """The number of a size's batch: a batch closes when the next would not fit; over the budget but within the limit
    (the budget, if none is given) a size has a batch of its own, over the limit it is -1; a null size has none."""
    sent = most if limit is None else limit

    def make() -> Callable[[int | None], int | None]:
        used, n, batch = 0, 0, 0

        def step(size: int | None) -> int | None:
            nonlocal used, n, batch
            if size is None:
                return None
            if size > sent:
                return -1
            if n and used + size > most:
                used, n, batch = 0, 0, batch + 1
            used, n = used + size, n + 1
            return batch

        return step

    return make


#: A running job whose worker has not been heard of for so long is stale.
STALE_US = 90_000_000
#: How long a job that failed waits before each further attempt; there are no more attempts than waits.
LEASE_WAITS_US = (5_000_000, 20_000_000, 60_000_000)


class Lease:
    """One job as its events go by (times in microseconds): which worker holds it, and what becomes of it if that worker is lost.

    Only the worker that holds a job keeps it alive, ends it or gives it back; what a worker says that has lost it
    changes nothing.  A stale job is queued again at once, one that failed after its wait, both within the attempts; then it has FAILED.
    """

    def __init__(self, stale: int = STALE_US, waits: tuple[int, ...] = LEASE_WAITS_US, held: tuple | None = None) -> None:
        self.stale, self.waits = stale, waits
        self.status, self.worker, self.retries, self.heard, self.not_before = held or ("NONE", "", 0, 0, 0)

    @property
    def held(self) -> tuple:
        return self.status, self.worker, self.retries, self.heard, self.not_before

    @property
    def ends(self) -> int | None:
        """When the lease of a running job ends unless its worker is heard of."""
        return self.heard + self.stale if self.status == "RUNNING" else None

    def expire(self, now: int) -> str:
        """Give back a running job whose lease has ended: RECOVERED or, out of attempts, INTERRUPTED; else nothing."""
        if self.ends is None or now <= self.ends:
            return ""
        self.worker = ""
        if self.retries < len(self.waits):
            self.status, self.retries, self.not_before = "QUEUED", self.retries + 1, 0
            return "RECOVERED"
        self.status = "FAILED"
        return "INTERRUPTED"

    def step(self, at: int, kind: str, worker: str) -> str:
        """An event (SUBMIT, CLAIM, HEARTBEAT, FAIL or DONE): the status after it, the attempts so far, and what had expired before it."""
        note, own = self.expire(at), self.status == "RUNNING" and self.worker == worker
        if kind == "SUBMIT" and self.status not in ("QUEUED", "RUNNING"):
            self.status, self.worker, self.retries, self.not_before = "QUEUED", "", 0, at
        elif kind == "CLAIM" and self.status == "QUEUED" and at >= self.not_before:
            self.status, self.worker, self.heard = "RUNNING", worker, at
        elif kind == "HEARTBEAT" and own and self.status == "RUNNING":
            self.heard = at
        elif kind == "DONE" and own and self.status == "RUNNING":
            self.status, self.worker = "SUCCEEDED", ""
        elif kind == "FAIL" and own and self.status == "RUNNING":
            self.worker = ""
            if self.retries < len(self.waits):
                self.status, self.not_before, self.retries = "QUEUED", at + self.waits[self.retries], self.retries + 1
            else:
                self.status = "FAILED"
        return f"{self.status}:{self.retries}:{note}"


def leases(stale: int = STALE_US, waits: tuple[int, ...] = LEASE_WAITS_US) -> Callable[[], Callable[[int, str, str], str]]:
    """Lease.step() for fold()."""
    return lambda: Lease(stale, waits).step


def debounced(interval: int) -> Callable[[], Callable[[int], bool]]:
    """Whether a check is made: not while the last one that was made is no older than the interval."""

    def make() -> Callable[[int], bool]:
        last: int | None = None

        def step(at: int) -> bool:
            nonlocal last
            if last is not None and at - last <= interval:
                return False
            last = at
            return True

        return step

    return make


#: Waits in microseconds before the second and the third attempt of a job.
BACKOFF = (5_000_000, 20_000_000)


def job_queue() -> Callable[[], Callable[[int, str, int, bool], int | None]]:
    """When a job of an exclusive key starts: first come, first served, one at a time.

    A request whose fingerprint is queued or running is answered by that job (null).  A job that fails is tried again
    after each wait of BACKOFF, and then given up; its key is taken all the while.
    """

    def make() -> Callable[[int, str, int, bool], int | None]:
        free, until = 0, {}

        def step(at: int, fingerprint: str, takes: int, fails: bool) -> int | None:
            nonlocal free
            if until.get(fingerprint, -1) > at:
                return None
            start = max(at, free)
            free = start + takes + (sum(BACKOFF) + len(BACKOFF) * takes if fails else 0)
            until[fingerprint] = free
            return start

        return step

    return make
