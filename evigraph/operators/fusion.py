"""Hybrid retrieval: channels of candidates, tag boosts, fusion, threshold, and assessment of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.scores import noisy_or_agg
from evigraph.functions.text import casefold, exact_terms

TASK_TAG, PERSONA_TAG, SAME_FILE, MOST_EXACT = 0.48, 0.20, 0.72, 0.97
MIN_SCORE, SHARE, CAP = 0.05, 0.40, 0.45
CLARIFY_SCORE, CLARIFY_MARGIN = 0.72, 0.12

# Words that say little of what is meant, and words that name no target.
VAGUE = ("again", "code", "earlier", "feature", "issue", "problem", "something", "stuff", "that", "thing", "this")
GENERIC = (*VAGUE, "add", "application", "bug", "change", "class", "config", "context", "create", "data", "error", "file", "fix", "function", "handler", "implement", "implementation", "improve", "logic", "make", "manager", "modify", "module", "project", "refactor", "service", "system", "update")


def fuse(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates (*keys, channel_order, reason, score, distance) -> score by noisy-or, reasons in order and once each, smallest distance."""
    found = candidates.groupBy(*keys).agg(noisy_or_agg(F.col("score")).alias("score"), F.array_sort(F.collect_list(F.struct("channel_order", "reason"))).alias("r"), F.min("distance").alias("distance"))
    return found.withColumn("reasons", F.array_distinct(F.transform("r", lambda x: x["reason"]))).drop("r")


def tag_boosts(chunks: DataFrame, keys: list[str], tags: list[str], boost: float, label: str, order: int) -> DataFrame:
    """A candidate row for each chunk with one of the tags."""
    common = F.array_sort(F.array_intersect(F.col("tags"), F.array(*[F.lit(t) for t in tags]).cast("array<string>")))
    rows = chunks.withColumn("common", common).filter(F.size("common") > 0)
    return rows.select(*keys, F.lit(order).alias("channel_order"), F.concat(F.lit(f"{label}:"), F.array_join("common", ",")).alias("reason"), F.lit(boost).alias("score"), F.lit(None).cast("int").alias("distance"))


def above_threshold(fused: DataFrame, query: str | None = None, least: float = MIN_SCORE) -> DataFrame:
    """Those of at least the larger of `least` and the lesser of .45 and .4 times the best score."""
    best = F.max("score").over(W.partitionBy(*([query] if query else [])))
    return fused.withColumn("best", best).filter(F.col("score") >= F.greatest(F.lit(least), F.least(F.lit(CAP), SHARE * F.col("best")))).drop("best")


def assess(ranked: DataFrame, tasks: DataFrame) -> DataFrame:
    """ranked (query, rank, score, reasons), tasks (query, text) -> (query, ambiguous, confidence) for each task."""
    top = ranked.groupBy("query").agg(F.count("*").alias("hits"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.sum(F.array_contains("reasons", "exact-symbol").cast("int")).alias("exact"))
    words = F.regexp_extract_all(casefold(F.col("text")), F.lit(r"(?U)(\w+)"), F.lit(1))
    named = F.filter(exact_terms(F.col("text")), lambda w: ~casefold(w).isin(*GENERIC))
    t = tasks.select("query", F.arrays_overlap(words, F.array(*[F.lit(w) for w in VAGUE])).alias("vague"), (F.size(named) < 2).alias("few"))
    j = t.join(top, "query", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "s1": F.coalesce("s1", F.lit(0.0)), "exact": F.coalesce("exact", F.lit(0))})
    j = j.withColumn("competing", (F.col("hits") >= 2) & (F.col("s1") - F.coalesce("s2", F.lit(0.0)) < CLARIFY_MARGIN)).withColumn("low", F.col("s1") < CLARIFY_SCORE)
    any_exact = F.col("exact") > 0
    ambiguous = (F.col("hits") == 0) | (~any_exact & (F.col("low") | F.col("competing") | F.col("few"))) | ((F.col("exact") > 1) & F.col("competing")) | (F.col("vague") & (F.col("competing") | F.col("few")))
    factor = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(1.0))
    confidence = F.col("s1") * factor(~any_exact, 0.88) * factor(F.col("competing"), 0.75) * factor(F.col("vague"), 0.85) * factor(F.col("few"), 0.9)
    return j.select("query", ambiguous.alias("ambiguous"), F.round(F.when(F.col("hits") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))), 3).alias("confidence"))


def per_path(ranked: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """The first `most` rows of each path."""
    return ranked.withColumn("in_path", F.row_number().over(W.partitionBy("path").orderBy(*order))).filter(F.col("in_path") <= most)
