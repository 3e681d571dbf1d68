"""Leases of jobs as a changelog: over a table, and as the state of a stream whose timers end leases without any input."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "job long, ts long, id long, op string, worker long, fence long"
NAMES = [c.split()[0] for c in LOG.split(", ")]


class Lease(NamedTuple):
    """Who holds a job until when (microseconds); worker is None for nobody. fence counts its leases, whoever had them."""

    worker: int | None = None
    until: int = 0
    fence: int = 0

    def ended(self, now: int) -> tuple[Lease, list[tuple]]:
        """The lease at a time, and the row that says that it has ended by then."""
        if self.worker is None or now < self.until:
            return self, []
        return Lease(None, 0, self.fence), [(self.until, None, "expired", self.worker, self.fence)]

    def asked(self, ts: int, i: int, worker: int, settles: bool, seconds: int) -> tuple[Lease, list[tuple]]:
        """A worker asks at a time, and settles if it holds the job: claimed, renewed, settled or refused. A settled job may be claimed again."""
        free, rows = self.ended(ts)
        until = ts + seconds * 1_000_000
        if free.worker is None:
            new, op = Lease(worker, until, free.fence + 1), "claimed"
        elif free.worker != worker:
            new, op = free, "refused"
        elif settles:
            new, op = Lease(None, 0, free.fence), "settled"
        else:
            new, op = free._replace(until=until), "renewed"
        return new, [*rows, (ts, i, op, worker, new.fence)]


def lease_log(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """LOG of requests (job, ts in microseconds, id, worker, settles) in the order of (ts, id): each request's outcome, and the ends of leases that nobody
    settled. One job's state is held, not its rows. A repeated request is one more; a null worker or time is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lease = None, Lease()
        for frame in frames:
            rows = []
            for job, ts, i, worker, settles in frame.itertuples(index=False):
                if job != at:
                    rows += [(at, *r) for r in lease.ended(lease.until)[1]]
                    at, lease = job, Lease()
                lease, told = lease.asked(ts, i, worker, settles, seconds)
                rows += [(job, *r) for r in told]
            yield _frame(rows)
        yield _frame([(at, *r) for r in lease.ended(lease.until)[1]])

    return _plain(requests).repartition("job").sortWithinPartitions("job", "ts", "id").mapInPandas(run, LOG)


def _plain(requests: DataFrame) -> DataFrame:
    return requests.where("job IS NOT NULL AND ts IS NOT NULL AND worker IS NOT NULL").select("job", "ts", "id", "worker", F.coalesce("settles", F.lit(False)).alias("settles"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"job": "Int64", "ts": "Int64", "id": "Int64", "worker": "Int64", "fence": "Int64", "op": object})


def stream_leases(requests: DataFrame, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """lease_log of a stream. A lease is a key's state with a timer at its end, so that it ends when the watermark has passed that, without a request.

    Requests later than the watermark by more than ``late`` are dropped, as they can't be told apart from those that ended leases have answered.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Leases(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("lease", "worker long, until long, fence long")

        def _lease(self) -> Lease:
            return Lease(*self.state.get()) if self.state.exists() else Lease()

        def _keep(self, before: Lease, after: Lease) -> None:
            if before.worker is not None and before.until != after.until:
                self.handle.deleteTimer(self._at(before))
            if after.worker is not None and before.until != after.until:
                self.handle.registerTimer(self._at(after))
            self.state.update((after.worker, after.until, after.fence))

        @staticmethod
        def _at(lease: Lease) -> int:
            return -(-lease.until // 1000)

        # the arguments are passed by these names
        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before = lease = self._lease()
            asked = sorted(x for frame in rows for x in frame[["ts", "id", "worker", "settles"]].itertuples(index=False, name=None))
            out = []
            for ts, i, worker, settles in asked:
                lease, told = lease.asked(ts, i, worker, bool(settles), seconds)
                out += [(key[0], *r) for r in told]
            self._keep(before, lease)
            yield _frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            lease, told = self._lease().ended(expiredTimerInfo.getExpiryTimeInMs() * 1000)
            if told:
                self.state.update((lease.worker, lease.until, lease.fence))
            yield _frame([(key[0], *r) for r in told])

        def close(self) -> None:
            pass

    timed = _plain(requests).withColumn("at", F.timestamp_micros("ts")).withWatermark("at", late)
    return timed.groupBy("job").transformWithStateInPandas(Leases(), LOG, "Append", "EventTime")
