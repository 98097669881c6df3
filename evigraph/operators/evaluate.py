"""Quality of retrieval against expectations, and gates on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds: name of the metric, kind of bound, value. Fixed values.
GATES = (
    ("routing_accuracy", "min", 1.0), ("file_precision", "min", 0.4), ("file_recall", "min", 0.9), ("symbol_recall", "min", 0.9), ("context_type_recall", "min", 0.8), ("mrr", "min", 0.8),
    ("forbidden_hits", "max", 0.0), ("max_estimated_tokens", "max", 6000.0),
)


def cases(retrieved: DataFrame, expected: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """retrieved (case, item, rank), expected (case, item) -> (case, precision, recall, rr, forbidden_hits).

    Precision is null where nothing is retrieved, recall and reciprocal rank where nothing is expected."""
    got = retrieved.groupBy("case", "item").agg(F.min("rank").alias("rank"))
    want = expected.select("case", "item").distinct().withColumn("wanted", F.lit(True))
    both = got.join(want, ["case", "item"], "full_outer")
    hit = F.col("wanted") & F.col("rank").isNotNull()
    out = both.groupBy("case").agg(F.count("rank").alias("n_got"), F.count("wanted").alias("n_want"), F.sum(hit.cast("int")).alias("n_hit"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    if forbidden is not None:
        bad = got.join(forbidden.select("case", "item").distinct(), ["case", "item"], "left_semi").groupBy("case").agg(F.count("*").alias("forbidden_hits"))
        out = out.join(bad, "case", "left")
    else:
        out = out.withColumn("forbidden_hits", F.lit(0))
    hits, want_n, got_n = F.coalesce("n_hit", F.lit(0)), F.col("n_want"), F.col("n_got")
    return out.select(
        "case", F.when(got_n > 0, F.round(hits / got_n, 3)).alias("precision"), F.when(want_n > 0, F.round(hits / want_n, 3)).alias("recall"),
        F.when(want_n > 0, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 3)).alias("rr"), F.coalesce("forbidden_hits", F.lit(0)).cast("long").alias("forbidden_hits"),
    )


def totals(per_case: DataFrame) -> DataFrame:
    """Means over the cases that have a value, and the sum of forbidden hits."""
    return per_case.agg(F.count("*").alias("cases"), F.round(F.avg("precision"), 3).alias("file_precision"), F.round(F.avg("recall"), 3).alias("file_recall"), F.round(F.avg("rr"), 3).alias("mrr"), F.sum("forbidden_hits").cast("long").alias("forbidden_hits"))


def gates(row: DataFrame, bounds: tuple = GATES) -> DataFrame:
    """One row of metrics -> (metric, bound, limit, value, passed) for each bound whose metric there is; a null value fails."""
    known = [(m, b, v) for m, b, v in bounds if m in row.columns]
    stack = ", ".join(f"'{m}', '{b}', {v}D, cast({m} as double)" for m, b, v in known)
    out = row.selectExpr(f"stack({len(known)}, {stack}) as (metric, bound, limit_value, value)")
    passed = F.when(F.col("bound") == "min", F.col("value") >= F.col("limit_value")).otherwise(F.col("value") <= F.col("limit_value"))
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))
