"""Order-dependent folds by key: token bucket, sliding limiter, pointer swap, poll reconciliation.

A fold runs over rows sorted by (key, time, id) within partitions and carries its state from batch to batch, so memory is
bounded by one key's state however many rows the key has. The same step functions drive the streaming operators.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bucket:
    """Tokens up to capacity, capacity a minute; a cooldown drains it and is only ever extended."""

    def __init__(self, capacity: float) -> None:
        self.capacity, self.tokens, self.at, self.cooldown = capacity, capacity, None, 0.0

    def available(self, now: float, capacity: float | None = None) -> float:
        cap = self.capacity if capacity is None else capacity
        elapsed = 0.0 if self.at is None else max(0.0, now - self.at)
        return min(min(self.tokens + elapsed * self.capacity / 60.0, self.capacity), cap)

    def take(self, now: float, need: float, capacity: float | None = None) -> tuple[bool, float]:
        """Whether granted, and the seconds to wait otherwise."""
        cap = self.capacity if capacity is None else capacity
        have, wait = self.available(now, cap), max(0.0, self.cooldown - now)
        granted = wait == 0 and have >= need
        self.tokens, self.at, self.capacity = have - need if granted else have, now, cap
        return granted, 0.0 if granted else wait + max(need - have, 0.0) * 60.0 / cap

    def cool(self, now: float, seconds: float) -> None:
        self.tokens, self.at, self.cooldown = 0.0, max(now, self.cooldown), max(self.cooldown, now + seconds)


class Budget:
    """A fleet's bucket and a worker's own, of at most fallback a minute, for the time that the fleet's can't be reached.

    What the fleet grants is spent in the own one too, so that an outage doesn't begin with a full one; a cooldown that is reported
    meanwhile holds at once for the own one and for the fleet's when it is back.
    """

    def __init__(self, capacity: float, fallback: float) -> None:
        self.fleet, self.own, self.pending = Bucket(capacity), Bucket(min(capacity, fallback)), None

    def take(self, now: float, need: float, cool: float | None, reached: bool) -> tuple[bool, float]:
        if cool is not None:
            self.own.cool(now, cool)
            if not reached:
                self.pending = max(self.pending or 0.0, now + cool)
        if not reached:
            return self.own.take(now, need)
        if self.pending is not None:
            if self.pending > now:
                self.fleet.cool(now, self.pending - now)
            self.pending = None
        if cool is not None:
            self.fleet.cool(now, cool)
        granted, wait = self.fleet.take(now, need)
        if granted:
            self.own.tokens, self.own.at = max(0.0, self.own.available(now) - need), now
        return granted, wait


def token_bucket(requests: DataFrame, capacity: float = 60.0, fallback: float = 2.0) -> DataFrame:
    """requests (forge, ts in seconds, id, need, cool, and maybe reached): forge, ts, id, granted, retry_after. cool is the seconds of a
    cooldown that a row reports, or null; reached tells whether the fleet's bucket could be (without the column it always is)."""

    names = ["forge", "ts", "id", "granted", "retry_after"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for frame in frames:
            rows = []
            for forge, ts, i, need, cool, reached in frame.itertuples(index=False):
                if forge != at:
                    at, state = forge, Budget(capacity, fallback)
                rows.append((forge, ts, i, *state.take(ts, need, cool if cool is not None and cool == cool else None, reached)))
            yield pd.DataFrame(rows, columns=names)

    reached = F.coalesce("reached", F.lit(True)) if "reached" in requests.columns else F.lit(True)
    chosen = requests.select("forge", "ts", "id", "need", "cool", reached.alias("reached"))
    return chosen.repartition("forge").sortWithinPartitions("forge", "ts", "id").mapInPandas(run, "forge string, ts double, id long, granted boolean, retry_after double")


def auth_failures(requests: DataFrame, most: int = 60, window: float = 60.0, remembered: int = 1024) -> DataFrame:
    """requests (service, ts, id, token, valid): service, ts, id, outcome, retry_after of the guard before a look-up of tokens.

    outcome is accepted, rejected (looked up and wrong: a failure), cached (rejected within the window: blocked without a look-up) or
    limited (a token not known to be right, while the service has had most failures within the window). A service remembers the last
    accepted and rejected tokens, by a digest, up to a number of each.
    """
    names = ["service", "ts", "id", "outcome", "retry_after"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = object()
        for frame in frames:
            rows = []
            for service, ts, i, token, valid in frame.itertuples(index=False):
                if service != at:
                    at, failures, rejected, accepted = service, deque(), OrderedDict(), OrderedDict()
                while failures and failures[0] <= ts - window:
                    failures.popleft()
                known, wait = hashlib.sha256(token.encode()).digest(), 0.0
                if known in rejected and rejected[known] > ts - window:
                    outcome, wait = "cached", window - (ts - rejected[known])
                elif known in accepted:
                    outcome = "accepted"
                    accepted.move_to_end(known)
                elif len(failures) >= most:
                    outcome, wait = "limited", window - (ts - failures[0])
                elif valid:
                    outcome, accepted[known] = "accepted", ts
                else:
                    outcome, rejected[known] = "rejected", ts
                    rejected.move_to_end(known)
                    failures.append(ts)
                for cache in (rejected, accepted):
                    if len(cache) > remembered:
                        cache.popitem(last=False)
                rows.append((service, ts, i, outcome, wait))
            yield pd.DataFrame(rows, columns=names)

    return requests.select("service", "ts", "id", "token", "valid").repartition("service").sortWithinPartitions("service", "ts", "id").mapInPandas(run, "service string, ts double, id long, outcome string, retry_after double")


def sliding_limiter(requests: DataFrame, most: int, window: float) -> DataFrame:
    """requests (credential, ts, id): admitted if fewer than most admitted ones lie within the window; a boundary one has left; rejected ones don't count."""

    names = ["credential", "ts", "id", "admitted", "retry_after"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = object(), deque()
        for frame in frames:
            rows = []
            for who, ts, i in frame.itertuples(index=False):
                if who != at:
                    at, seen = who, deque()
                while seen and seen[0] <= ts - window:
                    seen.popleft()
                ok = len(seen) < most
                rows.append((who, ts, i, ok, 0.0 if ok else window - (ts - seen[0])))
                if ok:
                    seen.append(ts)
            yield pd.DataFrame(rows, columns=names)

    return requests.select("credential", "ts", "id").repartition("credential").sortWithinPartitions("credential", "ts", "id").mapInPandas(run, "credential long, ts double, id long, admitted boolean, retry_after double")


def pointer_swap(results: DataFrame) -> DataFrame:
    """results (repo_id, ts, id, commit_sha, synced, superseded): the pointer after each.

    A result swaps the pointer if its job still holds; a superseded one does so only if its commit is the one last
    synced, or there is no pointer, or the pointer's commit isn't the one last synced.
    """
    names = ["repo_id", "ts", "id", "swapped", "pointer"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pointer = object(), None
        for frame in frames:
            rows = []
            for repo, ts, i, commit, synced, superseded in frame.itertuples(index=False):
                if repo != at:
                    at, pointer = repo, None
                swap = not superseded or commit == synced or pointer is None or pointer != synced
                pointer = commit if swap else pointer
                rows.append((repo, ts, i, bool(swap), pointer))
            yield pd.DataFrame(rows, columns=names)

    return results.select("repo_id", "ts", "id", "commit_sha", "synced", "superseded").repartition("repo_id").sortWithinPartitions("repo_id", "ts", "id").mapInPandas(run, "repo_id long, ts double, id long, swapped boolean, pointer string")


def poll_reconcile(observations: DataFrame) -> DataFrame:
    """observations (repo_id, ts, id, head, included): moved tells whether the head differs from the last one consumed, and action whether it is fetched, pending or none."""
    names = ["repo_id", "ts", "id", "moved", "action"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, consumed = object(), None
        for frame in frames:
            rows = []
            for repo, ts, i, head, included in frame.itertuples(index=False):
                if repo != at:
                    at, consumed = repo, None
                moved = head != consumed
                rows.append((repo, ts, i, moved, "none" if not moved else "fetch" if included else "pending"))
                consumed = head if moved and included else consumed
            yield pd.DataFrame(rows, columns=names)

    return observations.select("repo_id", "ts", "id", "head", "included").repartition("repo_id").sortWithinPartitions("repo_id", "ts", "id").mapInPandas(run, "repo_id long, ts double, id long, moved boolean, action string")


def complete_fetch(results: DataFrame, repos: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of fetch results (repo_id, commit_sha): the included repositories' new positions, and the index jobs to enqueue where none is open."""
    done = results.join(repos.where("state = 'included'").select("repo_id"), "repo_id", "left_semi").select("repo_id", F.col("commit_sha").alias("last_synced_commit"))
    open_jobs = jobs.where("kind = 'index' AND state <> 'done'").select("repo_id")
    return done, done.select("repo_id", F.lit("index").alias("kind")).distinct().join(open_jobs, "repo_id", "left_anti")


def stream_token_bucket(requests: DataFrame, capacity: float = 60.0) -> DataFrame:
    """token_bucket on a stream: the bucket is the key's state; rows of a micro-batch are taken in order, late ones at the bucket's time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Bucket(capacity)
        if state.exists:
            b.tokens, b.at, b.cooldown = state.get
        rows = []
        for frame in frames:
            rows += list(frame[["ts", "id", "need", "cool"]].itertuples(index=False))
        out = []
        for ts, i, need, cool in sorted(rows, key=lambda r: (r[0], r[1])):
            now = ts if b.at is None else max(ts, b.at)
            if cool == cool and cool is not None:
                b.cool(now, cool)
            out.append((key[0], ts, i, *b.take(now, need)))
        state.update((b.tokens, b.at if b.at is not None else 0.0, b.cooldown))
        yield pd.DataFrame(out, columns=["forge", "ts", "id", "granted", "retry_after"])

    return requests.groupBy("forge").applyInPandasWithState(run, "forge string, ts double, id long, granted boolean, retry_after double", "tokens double, at double, cooldown double", "append", GroupStateTimeout.NoTimeout)
