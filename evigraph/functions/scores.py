"""Scores and their combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noisy_or(scores: Column) -> Column:
    """1 - the product of 1 - s over an array, each s within 0 and 0.99."""
    return 1 - F.aggregate(scores, F.lit(1.0), lambda acc, s: acc * (1 - F.greatest(F.lit(0.0), F.least(F.lit(0.99), s))))


def noisy_or_agg(score: Column) -> Column:
    return 1 - F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)))


def bm25_norm(raw: Column) -> Column:
    return F.abs(raw) / (1 + F.abs(raw))


def lexical(rank: Column, norm: Column) -> Column:
    return F.least(F.lit(0.88), F.lit(0.35) + F.lit(0.35) / F.sqrt(rank) + F.lit(0.25) * norm)


def graph_score(distance: Column) -> Column:
    return F.lit(0.64) / F.greatest(F.lit(1), distance)


def overlap_ratio(path_a: Column, start_a: Column, end_a: Column, path_b: Column, start_b: Column, end_b: Column) -> Column:
    """The lines that both have, over those of the shorter; 0 in different files."""
    common = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)
    return F.when(path_a == path_b, common / F.greatest(F.lit(1), F.least(end_a - start_a + 1, end_b - start_b + 1))).otherwise(F.lit(0.0))


def credits(tokens: Column, usd: Column) -> Column:
    return F.bround(tokens * usd / 10000, 6)


def health(files: Column, degraded: Column, stale: Column, fresh: Column) -> tuple[Column, Column]:
    """(state, score): 100 less 40 for an empty index, 45 if degraded, 25 if stale and 20 without a fresh daemon."""
    lost = F.when(F.coalesce(files, F.lit(0)) == 0, 40).otherwise(0) + F.when(degraded, 45).otherwise(0) + F.when(stale, 25).otherwise(0) + F.when(~fresh, 20).otherwise(0)
    score = F.greatest(F.lit(0), F.lit(100) - lost)
    return F.when(degraded | (score < 45), "critical").when(stale | ~fresh, "attention").otherwise("healthy"), score
