"""Evaluation of an index against a dataset, and timings."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.classify import context_type, path_matches, symbol_matches
from evigraph.operators import evaluate, metrics, search
from evigraph.plans.context import context
from evigraph.sources import store


def run(index: store.Store, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per case, one row of totals). Cases are few; each is one query."""
    spark, got, meta, chunks = index.spark, [], [], []
    for c in cases.collect():
        began = time.perf_counter()
        b = context(index, c["query"], profile=c["profile"] or "auto")
        meta.append((c["id"], b["persona"] == c["expected_persona"] if c["expected_persona"] else None, (time.perf_counter() - began) * 1000, b["usage"]["tokens"]))
        got += [(c["id"], x["path"], k + 1) for k, x in enumerate(b["evidence"])]
        chunks += [(c["id"], x["id"]) for x in b["evidence"]]
    found = spark.createDataFrame(got, "case string, item string, rank int")

    def named(column: str) -> DataFrame:
        """What of the expected paths was found, by the rules for paths, under the name that was found."""
        want = cases.select(F.col("id").alias("case"), F.explode(column).alias("want"))
        hit = want.join(found.select("case", "item").distinct(), "case", "left").withColumn("ok", path_matches(F.col("item"), F.col("want")))
        return hit.groupBy("case", "want").agg(F.max(F.when(F.col("ok"), F.col("item"))).alias("item")).select("case", F.coalesce("item", "want").alias("item"))

    per_case = evaluate.cases(found, named("expected_files"), named("forbidden_files"))
    info = spark.createDataFrame(meta, "case string, routed boolean, ms double, tokens long")
    shown = spark.createDataFrame(chunks, "case string, chunk_id string")  # a budget holds few chunks a case
    kind = context_type(F.col("path"), F.col("language"), F.col("tags")).alias("type")
    whole = index.read("chunks").join(F.broadcast(shown), "chunk_id")
    seen = search.chunk_docs(whole, index.read("nodes")).select("case", "symbol")
    per_case = info.join(per_case, "case", "left").join(symbols_found(seen, wanted(cases, "expected_symbols")).withColumnRenamed("recall", "symbol_recall"), "case", "left")
    per_case = per_case.join(types_found(whole.select("case", kind), wanted(cases, "expected_context_types")).withColumnRenamed("recall", "context_type_recall"), "case", "left")
    total = per_case.agg(
        F.count("*").alias("cases"), F.round(F.avg(F.col("routed").cast("double")), 3).alias("routing_accuracy"), F.round(F.avg("precision"), 3).alias("file_precision"), F.round(F.avg("recall"), 3).alias("file_recall"),
        F.round(F.avg("symbol_recall"), 3).alias("symbol_recall"), F.round(F.avg("context_type_recall"), 3).alias("context_type_recall"),
        F.round(F.avg("rr"), 3).alias("mrr"), F.sum(F.coalesce("forbidden_hits", F.lit(0))).alias("forbidden_hits"), F.round(F.avg("ms"), 3).alias("avg_latency_ms"), F.max("tokens").alias("max_estimated_tokens"),
    )
    return per_case, total


def wanted(cases: DataFrame, column: str) -> DataFrame:
    """(case, want): what the cases name in a column; nothing if they don't have it."""
    named = F.col(column) if column in cases.columns else F.array().cast("array<string>")
    return cases.select(F.col("id").alias("case"), F.explode(named).alias("want")).distinct()


def types_found(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """actual (case, type), expected (case, want) -> (case, recall)."""
    hit = actual.select("case", F.col("type").alias("want")).distinct().withColumn("ok", F.lit(1.0))
    return expected.join(hit, ["case", "want"], "left").groupBy("case").agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 3).alias("recall"))


def symbols_found(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """actual (case, symbol), expected (case, want) -> (case, recall)."""
    both = expected.join(actual, "case", "left").withColumn("ok", symbol_matches(F.col("symbol"), F.col("want")))
    return both.groupBy("case", "want").agg(F.max(F.coalesce("ok", F.lit(False))).alias("ok")).groupBy("case").agg(F.round(F.avg(F.col("ok").cast("double")), 3).alias("recall"))


def timings(index: store.Store, operations: dict[str, Callable[[], object]], warm: int = 1, runs: int = 5) -> DataFrame:
    """The first call of each operation as cold, then `runs` calls after `warm` more as warm: mean, min, p50, p95, p99 and max."""
    rows = []
    for name, f in operations.items():
        for k in range(1 + warm + runs):
            began = time.perf_counter()
            f()
            if k == 0 or k > warm:
                rows.append((f"{name}:{'cold' if k == 0 else 'warm'}", (time.perf_counter() - began) * 1000))
    return metrics.latencies(index.spark.createDataFrame(rows, "operation string, duration_ms double"))
