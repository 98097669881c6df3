"""Evidence under a token budget."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.text import compact, estimate_tokens

OVERHEAD, OVERLAP, LEAST = 25, 0.55, 100
#: Languages whose evidence is never shortened. Fixed values.
WHOLE = ("yaml", "properties", "sql")
PACKED = "query string, path string, start_line int, end_line int, content string, score double, rank int, cost long, truncated boolean"


def tokens_of(text: str) -> int:
    return max(1, math.ceil(len(text.encode()) / 3.6)) if text else 0


@dataclass
class Budget:
    """What is chosen so far for a query: it skips what doesn't fit and goes on."""

    tokens: int
    per_file: int = 3
    used: int = 0
    chosen: list[dict] = field(default_factory=list)

    def _overlaps(self, x: dict) -> bool:
        for y in self.chosen:
            common = min(x["end_line"], y["end_line"]) - max(x["start_line"], y["start_line"]) + 1
            shorter = min(x["end_line"] - x["start_line"], y["end_line"] - y["start_line"]) + 1
            if x["path"] == y["path"] and max(0, common) / max(1, shorter) >= OVERLAP:
                return True
        return False

    def offer(self, x: dict) -> None:
        if self.used >= self.tokens or sum(y["path"] == x["path"] for y in self.chosen) >= self.per_file or self._overlaps(x):
            return
        cost, cut = tokens_of(x["content"]) + OVERHEAD, False
        if cost > self.tokens - self.used:
            if self.chosen:
                return
            room = max(LEAST, self.tokens - self.used - OVERHEAD)
            most = max(80, int(room * 3.6))
            if len(x["content"]) > most:
                x = x | {"content": x["content"][:most] + "\n... [truncated]"}
            cost, cut = tokens_of(x["content"]) + OVERHEAD, True
        self.used += cost
        self.chosen.append(x | {"cost": cost, "truncated": cut})


def greedy_pack(ranked: DataFrame, tokens: int = 2400, per_file: int = 3, used: int = 0) -> DataFrame:
    """ranked (query, path, start_line, end_line, content, score, rank) -> the chosen rows of each query.

    However many the candidates, a task holds what is chosen and a batch of them: they come sorted, and a full budget takes none."""
    columns = [c.split()[0] for c in PACKED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget: Budget | None = None
        held = None
        for frame in frames:
            done: list[dict] = []
            for query, rows in frame.assign(query=frame["query"].astype(object).where(frame["query"].notna(), None)).groupby("query", sort=False, dropna=False):
                query = query if isinstance(query, str) else None
                if budget is None or query != held:
                    done += budget.chosen if budget else []
                    budget, held = Budget(tokens, per_file, used), query
                if budget.used < tokens:
                    for x in rows.to_dict("records"):
                        budget.offer(x | {"query": query})
            yield pd.DataFrame(done, columns=columns)
        if budget:
            yield pd.DataFrame(budget.chosen, columns=columns)

    order = ["query", "rank", "path", "start_line"]
    rows = ranked.select("query", "path", "start_line", "end_line", "content", "score", "rank").repartition("query").sortWithinPartitions(*order)
    return rows.mapInPandas(run, PACKED)


def budget_prefix(ranked: DataFrame, tokens: int) -> DataFrame:
    """The longest prefix by rank whose costs fit: the variant that stops at the first that doesn't."""
    cost = ranked.withColumn("cost", estimate_tokens(F.col("content")) + OVERHEAD)
    total = F.sum("cost").over(W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return cost.withColumn("used", total).filter(F.col("used") <= tokens)


def evidence_levels(ranked: DataFrame, lines: int = 14) -> DataFrame:
    """The first item of a query whole; of the others 14 lines, but for configuration and SQL."""
    short = compact(F.col("content"), lines)
    whole = (F.col("rank") == 1) | F.col("language").isin(*WHOLE)
    return ranked.withColumn("content", F.when(whole, F.col("content")).otherwise(short)).withColumn("compressed", ~whole & (F.size(F.split("content", "\n")) > lines))


class TokenBudgetError(ValueError):
    """Nothing is left to drop, and the bundle is still over its budget."""


def within_budget(bundle: dict, budget: int, count: Callable[[str], int] = tokens_of, rounds: int = 12) -> dict:
    """Drops evidence, then architecture lines, from their ends, then the task's text, until the JSON, which states its own tokens, fits."""
    out = bundle | {"evidence": list(bundle.get("evidence", [])), "architecture": list(bundle.get("architecture", [])), "dropped": 0}
    while True:
        out = settled(out, budget, count, rounds)
        if out["usage"]["tokens"] <= budget:
            return out
        if len(out["evidence"]) > 0:
            out["evidence"] = out["evidence"][:-1]
            out["dropped"] += 1
        elif out["architecture"]:
            out["architecture"] = out["architecture"][:-1]
        elif out.get("task"):
            out["task"] = ""
        else:
            raise TokenBudgetError(f"{out['usage']['tokens']} tokens are over {budget}")


def settled(bundle: dict, budget: int, count: Callable[[str], int] = tokens_of, rounds: int = 12) -> dict:
    """The bundle with its own tokens in usage: counted again until the number no longer changes the text."""
    tokens = 0
    for _ in range(rounds):
        out = bundle | {"usage": {"tokens": tokens, "budget": budget, "remaining": max(0, budget - tokens)}}
        now = count(json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        if now == tokens:
            return out
        tokens = max(tokens, now)
    return out
