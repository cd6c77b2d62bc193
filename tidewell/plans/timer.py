"""Work at the ends of calendar periods: roll-ups that run by themselves."""

from __future__ import annotations

import heapq
import itertools
import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from tidewell.plans.rollup import backfill, next_fire
from tidewell.plans.scheme import linked
from tidewell.types import INTERVALS

log = logging.getLogger(__name__)


class Timer:
    """Calls functions at given times (epoch ms) on one thread. A function gets its time and gives the next one, or None if it is done."""

    def __init__(self, now: Callable[[], int] = lambda: int(time.time() * 1000)) -> None:
        self.now = now
        self._due: list[tuple[int, int, Callable[[int], int | None]]] = []
        self._order = itertools.count()
        self._wake = threading.Condition()
        self._ended = False
        self._thread: threading.Thread | None = None

    def add(self, at: int, call: Callable[[int], int | None]) -> None:
        with self._wake:
            heapq.heappush(self._due, (at, next(self._order), call))
            self._wake.notify()

    def next_time(self) -> int | None:
        with self._wake:
            return self._due[0][0] if self._due else None

    def run_due(self) -> int:
        """Calls what is due now; how many calls. One that fails is logged and isn't called again."""
        n = 0
        while True:
            with self._wake:
                if not self._due or self._due[0][0] > self.now():
                    return n
                at, _, call = heapq.heappop(self._due)
            n += 1
            try:
                again = call(at)
            except Exception:
                log.exception("work at %s failed", at)
                continue
            if again is not None:
                self.add(again, call)

    def start(self) -> None:
        def run() -> None:
            while not self._ended:
                self.run_due()
                with self._wake:
                    if not self._ended:
                        wait = 60.0 if not self._due else max(0.0, (self._due[0][0] - self.now()) / 1000)
                        self._wake.wait(min(wait, 60.0))

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        with self._wake:
            self._ended = True
            self._wake.notify()
        if self._thread:
            self._thread.join()


class RollupTimer:
    """At the end of each period of an interval, the coarser series of that interval are brought up to date from the finer ones."""

    def __init__(self, store, timer: Timer | None = None) -> None:
        self.store = store
        self.timer = timer or Timer()

    def watch(self, *intervals: str) -> None:
        for i in intervals or [i for i in INTERVALS if i != "raw"]:
            self.timer.add(next_fire(self.timer.now(), i), lambda at, i=i: self._fire(at, i))

    def _fire(self, at: int, interval: str) -> int:
        self.run(interval)
        return next_fire(at, interval)

    def run(self, interval: str) -> int:
        """Rows that were appended."""
        links = linked(self.store.scheme.ls()).where(F.col("dst_interval") == interval)
        return self.store.append_frame(backfill(self.store.rows(), links)).writed
