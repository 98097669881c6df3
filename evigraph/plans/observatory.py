"""Views over indexes: a project's contents, health and savings, and a fleet's."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.scores import health
from evigraph.operators import graph, metrics
from evigraph.plans import index as plans
from evigraph.sources import store

METRIC = "created_at timestamp, operation string, repository string, duration_ms double, estimated_tokens long, result_count long, payload string"


def record(index: store.Store, operation: str, repository: str, duration_ms: float, tokens: int, results: int, **payload) -> None:
    """Appends a row to the metric log."""
    row = index.spark.createDataFrame([(operation, repository, float(duration_ms), tokens, results, json.dumps(payload, sort_keys=True))], "operation string, repository string, duration_ms double, estimated_tokens long, result_count long, payload string")
    index.append_metric(row.withColumn("created_at", F.current_timestamp()))


def log(index: store.Store) -> DataFrame:
    """The metric log, which may not be there yet."""
    try:
        return index.spark.read.schema(METRIC).parquet(f"{index.path}/metrics")
    except PySparkException:
        return index.spark.createDataFrame([], METRIC)


def contexts(rows: DataFrame) -> DataFrame:
    """Context requests of a metric log, as savings takes them."""
    get = lambda key, kind: F.get_json_object("payload", f"$.{key}").cast(kind)
    return rows.filter("operation = 'context'").select("repository", F.col("estimated_tokens").alias("delivered"), get("repository_token_estimate", "long").alias("baseline"), get("cache_hit", "boolean").alias("cache_hit"), get("confidence", "double").alias("confidence"))


def project(index: store.Store, current_commit: str | None = None, watcher_fresh: bool = False, limit: int = 48) -> dict:
    """Kinds, the best-connected nodes with their edges, savings, recent latencies and health."""
    nodes, edges, files = (index.read(t) for t in ("nodes", "edges", "files"))
    s = plans.status(index)
    top = graph.overview(nodes, edges, limit)
    current = metrics.token_estimate(files.select(F.col("size").alias("size_bytes"))).first()["tokens"]
    rows = log(index)
    state, score = health(F.lit(s["tables"].get("files", 0)), F.lit(bool(s["degraded"])), F.lit(current_commit is not None and current_commit != s["commit"]), F.lit(watcher_fresh))
    h = index.spark.range(1).select(state.alias("state"), score.alias("score")).first()
    return {
        "status": s, "health": h["state"], "score": h["score"], "tokens": current, "kinds": {r["kind"]: r["n"] for r in metrics.histogram(nodes, "kind").collect()},
        "nodes": [r.asDict() for r in top.collect()], "edges": [r.asDict() for r in graph.induced(edges, top, 4 * limit).collect()],
        "savings": metrics.savings(contexts(rows), [], F.lit(current)).first().asDict(), "latencies": [r.asDict() for r in metrics.latencies(rows).collect()],
    }


def overview(spark: SparkSession, projects: dict[str, str]) -> list[dict]:
    """A line for each project; one that can't be read is told as an error and stops no other."""
    out = []
    for name, path in projects.items():
        try:
            s = plans.status(store.Store(spark, path))
            if not s["tables"]:
                raise ValueError("there is no index")
            out.append({"project": name, "health": "critical" if s["degraded"] else "healthy", **s["tables"]})
        except Exception as e:
            out.append({"project": name, "health": "error", "message": f"{type(e).__name__}: {str(e)[:200]}"})
    return out


def diagnostics(spark: SparkSession, index: store.Store, watcher: Iterable[dict] = ()) -> DataFrame:
    """(severity, code, message, source, path): files that failed, and what a watcher reports."""
    m = index.manifest()["metadata"]
    rows = [("error", "parse", "the file could not be analysed; its old analysis is kept", "scan", p) for p in m.get("failed") or []]
    rows += [(d["severity"], d["code"], d["message"], d["source"], d.get("path")) for d in watcher]
    return spark.createDataFrame(rows, "severity string, code string, message string, source string, path string")
