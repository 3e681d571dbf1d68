"""The loop around the queue: claim, work under a lease that is kept alive, settle."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any


class Heartbeat:
    """Renews a lease each third of its length, in a thread, as long as the block lasts; lost if a renewal was refused."""

    def __init__(self, renew: Callable[[], bool], lease: float) -> None:
        self.renew, self.every, self.lost = renew, lease / 3, False
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._beat, daemon=True)

    def _beat(self) -> None:
        while not self._over.wait(self.every):
            try:
                if not self.renew():
                    self.lost = True
                    return
            except Exception:  # noqa: BLE001, S112  the next beat tries again, the lease outlasts two that fail
                continue

    def __enter__(self) -> Heartbeat:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        """No renewal is under way after it: what settles the job next is alone."""
        self._over.set()
        self._thread.join()


def work_once(claim: Callable[[], Any], run: Callable[[Any], Any], renew: Callable[[Any], bool], settle: Callable[[Any, str, Any], bool], lease: float) -> bool:
    """Claims a job and does it; false if there was none. settle gets the job, done or failed, and the result or the error; a job whose lease was lost isn't settled."""
    if (job := claim()) is None:
        return False
    beat = Heartbeat(lambda: renew(job), lease)
    try:
        with beat:
            outcome, result = "done", run(job)
    except Exception as e:  # noqa: BLE001  whatever went wrong is the job's result
        outcome, result = "failed", str(e)
    if not beat.lost:
        settle(job, outcome, result)
    return True


def drain(step: Callable[[], bool], stop: threading.Event, idle: float = 2.0, loops: int = 6) -> None:
    """Runs step in loops side by side until stop is set, each again at once while it finds work and after a pause if not."""

    def loop() -> None:
        while not stop.is_set():
            if not step():
                stop.wait(idle)

    threads = [threading.Thread(target=loop, daemon=True) for _ in range(loops)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
