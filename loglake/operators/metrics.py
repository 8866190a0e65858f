"""Counters and a latency histogram in the Prometheus text format."""

from __future__ import annotations

import threading
from bisect import bisect_left

#: Upper bounds of the latency buckets in seconds; one more is unbounded.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


class Metrics:
    def __init__(self, prefix: str = "loglake") -> None:
        self.prefix, self._lock = prefix, threading.Lock()
        self.counters: dict[str, float] = {}
        self.buckets, self.total, self.count = [0] * (len(BOUNDS) + 1), 0.0, 0

    def add(self, name: str, by: float = 1) -> None:
        with self._lock:
            self.counters[name] = self.counters.get(name, 0) + by

    def observe(self, seconds: float) -> None:
        with self._lock:
            self.buckets[bisect_left(BOUNDS, seconds)] += 1
            self.total += seconds
            self.count += 1

    def text(self) -> str:
        with self._lock:
            out = []
            for name in sorted(self.counters):
                out += [f"# TYPE {self.prefix}_{name} counter", f"{self.prefix}_{name} {self.counters[name]:g}"]
            name, upto = f"{self.prefix}_query_seconds", 0
            out.append(f"# TYPE {name} histogram")
            for bound, n in zip([*map(str, BOUNDS), "+Inf"], self.buckets, strict=True):
                upto += n
                out.append(f'{name}_bucket{{le="{bound}"}} {upto}')
            return "\n".join([*out, f"{name}_sum {self.total:g}", f"{name}_count {self.count}", ""])
