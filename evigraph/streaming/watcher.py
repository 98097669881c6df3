"""Watching a tree from the driver: polling, back-off, coalescing, retries, and a status file."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from evigraph.streaming.changes import Coalescer

Snapshot = dict[str, tuple[int, int]]


def difference(before: Snapshot, now: Snapshot) -> dict[str, str]:
    """path -> added, modified or deleted."""
    out = {p: "added" for p in now.keys() - before.keys()} | {p: "deleted" for p in before.keys() - now.keys()}
    return out | {p: "modified" for p in before.keys() & now.keys() if before[p] != now[p]}


@dataclass
class Backoff:
    """The pause between polls: it doubles while nothing changes, up to `idle`, and starts again at `base` on a change."""

    base: float = 0.25
    idle: float = 5.0
    pause: float = 0.0

    def after(self, changed: bool) -> float:
        self.pause = self.base if changed or not self.pause else min(self.idle, self.pause * 2)
        return self.pause


def fresh(status: dict, now: float, timeout: float = 10.0) -> bool:
    """Is the index up to date by the watcher's word: idle, nothing pending, a recent heartbeat, a live process?"""
    try:
        os.kill(int(status["pid"]), 0)
    except (KeyError, ValueError, OSError):
        return False
    return status.get("state") == "idle" and status.get("pending") == 0 and now - status.get("heartbeat", 0) <= timeout


@dataclass
class Watcher:
    """poll() once in a while: it lists the tree, gathers changes, and calls refresh when they have settled.

    A refresh that fails leaves the state degraded, and is tried again after `retry` seconds with all that has changed."""

    listing: Callable[[], Snapshot]
    refresh: Callable[[dict[str, str]], object]
    path: str | None = None
    clock: Callable[[], float] = time.time
    retry: float = 30.0
    coalescer: Coalescer = field(default_factory=lambda: Coalescer(0.5, 2.0))
    backoff: Backoff = field(default_factory=Backoff)
    diagnostics: list[dict] = field(default_factory=list)
    state: str = "idle"
    retry_at: float | None = None
    left: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.before = self.listing()

    def poll(self) -> float:
        """Returns the pause until the next poll."""
        now, listed = self.clock(), self.listing()
        changes = difference(self.before, listed)
        self.before = listed
        for p, c in sorted(changes.items()):
            self.coalescer.push(p, c, now)
        due = self.coalescer.ready(now) or (self.retry_at is not None and now >= self.retry_at)
        if due:
            self.left |= self.coalescer.flush()
            try:
                self.refresh(dict(self.left))
                self.left, self.state, self.retry_at = {}, "idle", None
            except Exception as e:
                self.state, self.retry_at = "degraded", now + self.retry
                self.diagnostics.append({"severity": "error", "code": "scan", "message": f"{type(e).__name__}: {e}", "source": "watcher"})
        elif self.coalescer.states:
            self.state = "pending" if self.retry_at is None else "degraded"
        self.write()
        return self.backoff.after(bool(changes))

    def run(self, events: Callable[[], Iterable] | None = None, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], object] = time.sleep) -> None:
        """Polls until stop(). `events`, such as `watchfiles.watch` over the tree, says when to look; once it fails, pauses do."""
        if events is not None:
            try:
                for _ in events():
                    if stop():
                        return
                    self.poll()
            except Exception as e:
                self.diagnostics.append({"severity": "warning", "code": "watcher", "message": f"polling instead: {type(e).__name__}: {e}", "source": "watcher"})
        while not stop():
            sleep(self.poll())

    def status(self) -> dict:
        counts = {s: sum(d["severity"] == s for d in self.diagnostics) for s in ("error", "warning", "info")}
        return {"state": self.state, "pending": len(self.coalescer.states) + len(self.left), "heartbeat": self.clock(), "pid": os.getpid(), "retry_at": self.retry_at, "diagnostics": self.diagnostics[-50:], "counts": counts}

    def write(self) -> None:
        """The status as JSON, in one step: readers see the old file or the new one."""
        if self.path:
            with open(f"{self.path}.tmp", "w") as f:
                json.dump(self.status(), f, sort_keys=True)
            os.replace(f"{self.path}.tmp", self.path)
