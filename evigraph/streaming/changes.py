"""Coalescing of file changes, as a state machine that runs in a stream or over a table, and windows over event time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FLUSHED = "repository string, flushed_at double, path string, change string"


@dataclass
class Coalescer:
    """Changes of paths until they are quiet for `debounce` seconds, or `max_delay` seconds old.

    A deleted path that is added again is modified; an added one that is modified stays added; an added one that is
    deleted is forgotten."""

    debounce: float
    max_delay: float
    states: dict[str, str] = field(default_factory=dict)
    first: float | None = None
    last: float | None = None

    def push(self, path: str, change: str, now: float) -> None:
        self.first = now if self.first is None else self.first
        self.last = now
        before = self.states.get(path)
        if change == "added":
            self.states[path] = "modified" if before == "deleted" else "added"
        elif change == "modified":
            self.states[path] = "added" if before == "added" else "modified"
        elif before == "added":
            del self.states[path]
        else:
            self.states[path] = "deleted"
        if not self.states:
            self.first = self.last = None

    def due(self) -> float | None:
        """When the changes are ready, if nothing more comes."""
        if self.first is None or self.last is None:
            return None
        return min(self.last + self.debounce, self.first + max(self.max_delay, self.debounce))

    def ready(self, now: float) -> bool:
        return (due := self.due()) is not None and now >= due

    def flush(self) -> dict[str, str]:
        out, self.states, self.first, self.last = self.states, {}, None, None
        return out

    def dump(self) -> tuple[str, float | None, float | None]:
        return json.dumps(self.states), self.first, self.last


def coalesced(changes: DataFrame, debounce: float, max_delay: float) -> DataFrame:
    """changes (repository, path, change, at in seconds) -> (repository, flushed_at, path, change), a table at once. Within a repository changes go by time, then path."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c, out = Coalescer(debounce, max_delay), []
        name = rows["repository"].iloc[0]
        for x in rows.sort_values(["at", "path", "change"]).itertuples():
            if c.ready(x.at):
                due = c.due()
                out += [(name, due, p, s) for p, s in sorted(c.flush().items())]
            c.push(x.path, x.change, x.at)
        if (due := c.due()) is not None:
            out += [(name, due, p, s) for p, s in sorted(c.flush().items())]
        return pd.DataFrame(out, columns=["repository", "flushed_at", "path", "change"])

    return changes.groupBy("repository").applyInPandas(run, FLUSHED)


def coalesce_stream(changes: DataFrame, debounce: float, max_delay: float) -> DataFrame:
    """The same over a stream, by processing time: a repository's state waits for its timer."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Coalescer(debounce, max_delay)
        if state.exists:
            states, c.first, c.last = state.get
            c.states = json.loads(states)
        now = state.getCurrentProcessingTimeMs() / 1000
        if state.hasTimedOut:
            rows = [(key[0], now, p, s) for p, s in sorted(c.flush().items())] if c.ready(now) else []
        else:
            rows = []
            for x in sorted((r for b in batches for r in b.itertuples()), key=lambda r: (r.at, r.path, r.change)):
                c.push(x.path, x.change, now)
            if c.ready(now):
                rows = [(key[0], now, p, s) for p, s in sorted(c.flush().items())]
        if (due := c.due()) is None:
            state.remove()
        else:
            state.update(c.dump())
            state.setTimeoutDuration(max(1, round((due - now) * 1000)))
        if rows:
            yield pd.DataFrame(rows, columns=["repository", "flushed_at", "path", "change"])

    return changes.groupBy("repository").applyInPandasWithState(run, FLUSHED, "states string, first double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def timed(rows: DataFrame, column: str, late: str | None = None) -> DataFrame:
    """Event time must be a timestamp with a zone; late: how long a stream waits."""
    out = rows.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if late else out


def windowed(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def snapshot_stream(listings: DataFrame, publish) -> object:
    """A stream of listings (listing, path, size, mtime): each micro-batch's last listing is compared with the one before, and publish(changes, id) gets the difference."""
    from evigraph.sources.store import snapshot_diff

    held: dict[str, DataFrame] = {}

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        last = batch.agg(F.max("listing")).first()[0]
        now = batch.filter(F.col("listing") == last).select("path", "size", "mtime").persist()
        before = held.get("now", now.limit(0))
        publish(snapshot_diff(before, now), number)
        held["now"] = now

    return listings.writeStream.foreachBatch(step)
