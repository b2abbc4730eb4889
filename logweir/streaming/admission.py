"""Scheduling on the driver: lanes for queries, a cache of state, figures of what ran. Nothing here decides what a query answers."""

from __future__ import annotations

import threading
import time
from collections import Counter, deque
from contextlib import contextmanager

from ..model import Settings


class Lane:
    """So many at a time, the others in order of arrival."""

    def __init__(self, slots: int):
        self.free, self.waiting, self.lock = slots, deque(), threading.Lock()

    @contextmanager
    def slot(self):
        with self.lock:
            turn = None
            if self.free and not self.waiting:
                self.free -= 1
            else:
                turn = threading.Event()
                self.waiting.append(turn)
        if turn:
            turn.wait()
        try:
            yield
        finally:
            with self.lock:
                if self.waiting:
                    self.waiting.popleft().set()  # the slot is handed on
                else:
                    self.free += 1


class Gate:
    """A lane for counts that the pre-aggregate bounds, one for those that scan, one for pages that search texts."""

    def __init__(self, settings: Settings = Settings()):
        self.lanes = {"bounded": Lane(settings.bounded_slots), "scan": Lane(settings.scan_slots), "marker": Lane(1)}

    def busy(self) -> bool:
        """Whether a query waits for its turn."""
        return any(lane.waiting for lane in self.lanes.values())

    @contextmanager
    def admitted(self, lane: str):
        began = time.perf_counter()
        with self.lanes[lane].slot():
            yield (time.perf_counter() - began) * 1000


class CachedState:
    """A state that is read at most once in ttl seconds, by one caller at a time; if reading fails, the fallback holds until the next try."""

    def __init__(self, read, ttl: float = 1.0, fallback=None, clock=time.monotonic):
        self.read, self.ttl, self.fallback, self.clock = read, ttl, fallback, clock
        self.lock, self.until, self.value = threading.Lock(), float("-inf"), fallback

    def get(self):
        with self.lock:
            if self.clock() >= self.until:
                try:
                    self.value = self.read()
                except Exception:  # noqa: BLE001  any failure means: answer from rows
                    self.value = self.fallback
                self.until = self.clock() + self.ttl
            return self.value


class Reservoir:
    """The last samples of a latency."""

    def __init__(self, size: int = 4096):
        self.samples: deque[float] = deque(maxlen=size)

    def record(self, ms: float) -> None:
        self.samples.append(ms)

    def percentiles(self) -> dict:
        xs = sorted(self.samples)
        if not xs:
            return {"count": 0, "p50": 0, "p95": 0, "p99": 0}
        return {"count": len(xs)} | {f"p{p}": round(xs[min(len(xs) - 1, p * len(xs) // 100)], 2) for p in (50, 95, 99)}


class Metrics:
    """Counters, reservoirs, and a ring of the last traces."""

    def __init__(self, traces: int = 128):
        self.counts: Counter[str] = Counter()
        self.latency: dict[str, Reservoir] = {}
        self.traces: deque[dict] = deque(maxlen=traces)

    @contextmanager
    def timed(self, name: str, **fields):
        trace, began = dict(fields, name=name), time.perf_counter()
        try:
            yield trace
        finally:
            trace["ms"] = (time.perf_counter() - began) * 1000
            self.counts[name] += 1
            self.latency.setdefault(name, Reservoir()).record(trace["ms"])
            self.traces.append(trace)

    @contextmanager
    def stage(self, trace: dict, name: str):
        """Adds the time of a stage to a trace."""
        began = time.perf_counter()
        try:
            yield
        finally:
            trace[f"{name}_ms"] = trace.get(f"{name}_ms", 0.0) + (time.perf_counter() - began) * 1000

    def decomposition(self) -> dict:
        """By name and path of the traces in the ring: how many, the mean time, and of it the mean of each stage and of what no stage holds."""
        groups: dict[tuple, list[dict]] = {}
        for t in self.traces:
            groups.setdefault((t["name"], t.get("path")), []).append(t)
        out = {}
        for (name, path), own in groups.items():
            stages = sorted({k for t in own for k in t if k.endswith("_ms")})
            mean = {k: sum(t.get(k, 0.0) for t in own) / len(own) for k in stages}
            whole = sum(t["ms"] for t in own) / len(own)
            out[name if path is None else f"{name} {path}"] = {"traces": len(own), "ms": whole, **mean, "other_ms": whole - sum(mean.values())}
        return out

    def snapshot(self) -> dict:
        return {"counts": dict(self.counts), "latency": {k: r.percentiles() for k, r in self.latency.items()}}


class IngestFloor:
    """The oldest accepted instant of the last seconds: a figure only, no part of any answer."""

    def __init__(self, seconds: int = 12):
        self.slots: dict[int, int] = {}
        self.seconds = seconds

    def note(self, oldest_us: int, now_us: int) -> None:
        second = now_us // 1_000_000
        self.slots = {s: v for s, v in self.slots.items() if s > second - self.seconds}
        self.slots[second] = min(oldest_us, self.slots.get(second, oldest_us))

    def floor(self, now_us: int) -> int | None:
        second = now_us // 1_000_000
        return min((v for s, v in self.slots.items() if s > second - self.seconds), default=None)
