"""Snapshots: merging, cascades, publication, and incremental derivation that equals the full one."""

import pytest
from pyspark.sql import functions as F

from evigraph.extract import registry
from evigraph.operators import resolve
from evigraph.plans.fixtures import FILES
from evigraph.sources import store

NODE = "node_id string, kind string, name string, qualified_name string, path string, start_line int, end_line int"
EDGE = "source_id string, relation string, target_id string, evidence_path string, start_line int, end_line int, confidence double"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, k, i, i, p, 1, 2) for i, k, p in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(a, r, b, p, 1, 1, 1.0) for a, r, b, p in rows], EDGE)


def test_diff(spark):
    a = spark.createDataFrame([("A", 1, 1), ("gone", 1, 1), ("same", 1, 1)], "path string, size int, mtime int")
    b = spark.createDataFrame([("A", 2, 1), ("B", 1, 1), ("same", 1, 1)], "path string, size int, mtime int")
    assert {(r["path"], r["change"]) for r in store.snapshot_diff(a, b).collect()} == {("A", "modified"), ("B", "added"), ("gone", "deleted")}


def test_merge_nodes_field_by_field(spark):
    old = nodes(spark, ("a", "x", "p"), ("b", "x", "p"))
    new = spark.createDataFrame([("a", "y", "a", "q1", None, 0, -1, 1), ("a", "z", "a", "q2", None, 7, 0, 2), ("c", "n", "c", "c", "r", 3, 4, 3)], NODE + ", seq long")
    got = {r["node_id"]: tuple(r)[1:] for r in store.merge_nodes(old, new).collect()}
    assert got == {"a": ("z", "a", "q2", "p", 7, 2), "b": ("x", "b", "b", "p", 1, 2), "c": ("n", "c", "c", "r", 3, 4)}


def test_delete_cascades(spark):
    n = nodes(spark, ("a", "x", "A"), ("b", "x", "B"), ("c", "x", "C"), ("t", "table", None))
    e = edges(spark, ("a", "R", "b", "A"), ("b", "R", "c", "B"), ("c", "R", "t", "C"), ("c", "R", "t", "B"))
    chunks = spark.createDataFrame([("k1", "A", "b"), ("k2", "B", "b"), ("k3", "C", "c")], "chunk_id string, path string, symbol_id string")
    left, kept, rest = store.delete_paths(n, e, chunks, spark.createDataFrame([("B",)], "path string"))
    assert {r[0] for r in left.select("node_id").collect()} == {"a", "c", "t"}
    assert [(r["source_id"], r["evidence_path"]) for r in kept.collect()] == [("c", "C")]
    assert {(r["chunk_id"], r["symbol_id"]) for r in rest.collect()} == {("k1", None), ("k3", "c")}


def test_generations(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    assert s.manifest()["generation"] == 0
    n, e = nodes(spark, ("a", "x", "A"), ("b", "x", "B")), edges(spark, ("a", "R", "b", "A"))
    assert s.publish({"nodes": n, "edges": e}, {"commit": "1"}) == 1
    with pytest.raises(ValueError):
        s.publish({"edges": edges(spark, ("a", "R", "missing", "A"))})
    assert s.manifest()["generation"] == 1 and s.manifest()["metadata"] == {"commit": "1"}
    cache: dict = {}
    assert s.on_generation(lambda g: g, cache) == 1
    pinned = s.read("nodes")
    assert s.publish({"nodes": nodes(spark, ("a", "x", "A"), ("b", "x", "B"), ("c", "x", "C"))}) == 2
    assert pinned.count() == 2 and s.read("nodes").count() == 3 and s.read("edges").count() == 1
    assert s.on_generation(lambda g: g, cache) == 2 and list(cache) == [2]
    s.set_metadata(degraded=True)
    assert s.manifest()["metadata"] == {"commit": "1", "degraded": True}
    s._put(s.manifest() | {"version": 1})
    with pytest.raises(store.IndexCompatibilityError):
        s.manifest()


def test_incremental_equals_full(spark):
    """Replacing one file's facts and deriving its owners anew gives what deriving all gives."""
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    changed = "shop/OrderService.java"
    text = FILES[changed].replace("public Order load(", "public Order fetch(")
    new = files.filter(F.col("path") != changed).union(spark.createDataFrame([(changed, text)], "path string, content string"))
    derive = lambda f: {tuple(r) for r in resolve.derived_edges(registry.edges(f), registry.nodes(f).dropDuplicates(["node_id"])).collect()}
    before, full = registry.facts(files).cache(), registry.facts(new).cache()
    parts = before.filter(F.col("file") != changed).unionByName(registry.facts(new.filter(F.col("path") == changed)))
    assert derive(parts) == derive(full) != derive(before)


def test_replace_layer(spark):
    e = edges(spark, ("a", "R", "b", "A"), ("a", "RESOLVED_R", "b", "@derived:A"), ("c", "RESOLVED_R", "b", "@derived:C"))
    new = edges(spark, ("n", "RESOLVED_R", "b", "@derived:N"))
    assert {r["evidence_path"] for r in store.replace_layer(e, "@derived", new).collect()} == {"A", "@derived:N"}
    owners = spark.createDataFrame([("@derived:A",)], "evidence_path string")
    assert {r["evidence_path"] for r in store.replace_layer(e, "@derived", new, owners).collect()} == {"A", "@derived:C", "@derived:N"}
