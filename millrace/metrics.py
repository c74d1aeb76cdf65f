"""A timer that can be paused, read in laps and merged."""

from __future__ import annotations

import time


class Timer:
    def __init__(self) -> None:
        self.total, self.laps, self.since, self.lap = 0.0, [], None, 0.0

    def start(self) -> Timer:
        if self.since is None:
            self.since = time.perf_counter()
        return self

    def pause(self) -> Timer:
        if self.since is not None:
            self.total += time.perf_counter() - self.since
            self.since = None
        return self

    @property
    def seconds(self) -> float:
        return self.total + (time.perf_counter() - self.since if self.since is not None else 0.0)

    def snapshot(self, name: str) -> float:
        """Keep the time since the last snapshot, or the start, under a name; pauses don't count."""
        now = self.seconds
        self.laps.append((name, now - self.lap))
        self.lap = now
        return self.laps[-1][1]

    def merge(self, other: Timer) -> Timer:
        """Add another timer's time and laps; the time isn't part of the next lap."""
        self.total += other.seconds
        self.lap += other.seconds
        self.laps += other.laps
        return self

    def __str__(self) -> str:
        return ", ".join(f"{name} {1000 * s:.0f} ms" for name, s in [*self.laps, ("total", self.seconds)])
