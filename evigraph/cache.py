"""A bounded cache of what the driver has computed for a generation of an index."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass


@dataclass
class Stats:
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    size: int = 0

    def hit_rate(self) -> float:
        return round(self.hits / (self.hits + self.misses), 4) if self.hits + self.misses else 0.0


class Bounded:
    """Keeps the last `most` values that were used; another generation empties it."""

    def __init__(self, most: int):
        self.most, self.generation, self.stats = most, None, Stats()
        self.held: OrderedDict[Hashable, object] = OrderedDict()

    def get(self, key: Hashable, build: Callable[[], object], generation: object = None) -> object:
        if generation != self.generation:
            self.held.clear()
            self.generation = generation
        if key in self.held:
            self.stats.hits += 1
            self.held.move_to_end(key)
        else:
            self.stats.misses += 1
            self.held[key] = build()
            if len(self.held) > self.most:
                self.held.popitem(last=False)
                self.stats.evictions += 1
        self.stats.size = len(self.held)
        return self.held[key]
