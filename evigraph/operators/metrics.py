"""Aggregates over the metric log, index counts and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.95, 0.99)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


def token_estimate(files: DataFrame) -> DataFrame:
    return files.agg(F.ceil(F.coalesce(F.sum("size_bytes"), F.lit(0)) / F.lit(3.6)).cast("long").alias("tokens"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def summary(metrics: DataFrame, by: str = "operation") -> DataFrame:
    return metrics.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"), F.round(F.avg("estimated_tokens"), 6).alias("avg_tokens"), F.round(F.avg("result_count"), 6).alias("avg_results"))


def latencies(metrics: DataFrame, by: str = "operation") -> DataFrame:
    """mean, min, p50, p95, p99 and max; percentiles interpolate between the two nearest values."""
    p = [F.round(F.percentile("duration_ms", q), 6).alias(f"p{int(q * 100)}") for q in PERCENTILES]
    return metrics.groupBy(by).agg(F.round(F.avg("duration_ms"), 6).alias("mean"), F.min("duration_ms").alias("min"), *p, F.max("duration_ms").alias("max"))


def ratio(a: Column, b: Column, digits: int) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))


def savings(contexts: DataFrame, by: list[str], current: Column) -> DataFrame:
    """contexts (delivered, baseline, cache_hit, confidence), a row for each context request -> what was saved.

    A missing or zero baseline is the current estimate of the whole repository. Avoided tokens are the sum of baselines less
    the sum delivered, at least 0: not the sum of what each request avoided."""
    base = F.when(F.coalesce("baseline", F.lit(0)) == 0, current).otherwise(F.col("baseline"))
    sums = contexts.groupBy(*by).agg(
        F.count("*").alias("context_requests"), F.sum(base).cast("long").alias("baseline_tokens"), F.sum(F.coalesce("delivered", F.lit(0))).cast("long").alias("tokens_delivered"),
        F.sum(F.coalesce("cache_hit", F.lit(False)).cast("int")).cast("long").alias("cache_hits"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("average_confidence"),
    )
    avoided = F.greatest(F.lit(0), F.col("baseline_tokens") - F.col("tokens_delivered"))
    return sums.withColumn("tokens_avoided", avoided).withColumns({"savings_rate": ratio(avoided, F.col("baseline_tokens"), 4), "cache_hit_rate": ratio(F.col("cache_hits"), F.col("context_requests"), 4)})


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(*[F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).cast("long").alias(s) for s in ("error", "warning", "info")])
