"""Building and refreshing an index of a source tree."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import shutil
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import cache
from evigraph.extract import registry
from evigraph.functions.classify import frameworks, generic_layer
from evigraph.operators import chunking, graph, resolve, search
from evigraph.sources import files, personas, store
from evigraph.streaming import watcher

VERSION = "2"


def fingerprint(**settings) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def file_tags(found: DataFrame, read: DataFrame) -> DataFrame:
    """(path, tags): language, layers of the file's symbols, and frameworks by its imports and text."""
    imports = found.filter("fact = 'edge' and relation = 'IMPORTS'").groupBy(F.col("file").alias("path")).agg(F.collect_set(F.regexp_replace("target_id", "^external::[^:]*::", "")).alias("imports"))
    layers = found.filter("fact = 'node' and path is not null and kind in ('class', 'interface', 'method')").select(F.col("file").alias("path"), F.coalesce(F.get_json_object("metadata", "$.layer"), generic_layer(F.col("name"), F.col("file"))).alias("layer"))
    layers = layers.groupBy("path").agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    none = F.array().cast("array<string>")
    joined = read.select("path", "language", "content").join(imports, "path", "left").join(layers, "path", "left")
    return joined.select("path", F.array_distinct(F.concat(F.array("language"), F.coalesce("layers", none), frameworks(F.coalesce("imports", none), F.col("content")))).alias("tags"))


def analyse(read: DataFrame, plugins: tuple = (registry.WEB,)) -> dict[str, DataFrame]:
    """files (path, language, content, ...) -> facts, nodes, edges, chunks and failures of them."""
    found = registry.facts(read, plugins).persist()
    good = read.join(found.filter("fact = 'error'").select(F.col("file").alias("path")), "path", "left_anti")
    symbols = registry.nodes(found).filter("path is not null and kind in ('class', 'interface', 'record', 'enum', 'method', 'configuration_key')").select("path", F.col("node_id").alias("symbol_id"), "kind", "name", "start_line", F.greatest("end_line", F.coalesce(F.get_json_object("metadata", "$.body_end").cast("int"), F.lit(0))).alias("end_line"))
    return {"facts": found, "nodes": registry.nodes(found), "edges": registry.edges(found), "chunks": chunking.build_chunks(good.select("path", "language", "content"), symbols, file_tags(found, good)), "failed": found.filter("fact = 'error'").select(F.col("file").alias("path"), F.col("metadata").alias("message")), "good": good}


def as_layer(edges: DataFrame, extractor: str = "derived") -> DataFrame:
    """Edges (source_id, relation, target_id, evidence_path, confidence), each once, as the store keeps them."""
    keys = edges.select("source_id", "relation", "target_id", "evidence_path", "confidence").distinct()
    return keys.withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "extractor": F.lit(extractor), "metadata": F.lit("{}")})


def changed_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of nodes that came, went or differ in what references go by, old and new."""
    what = ("node_id", "kind", "name", "qualified_name", "path")
    before, now = old.select(*what), new.select(*what)
    return before.subtract(now).union(now.subtract(before))


def affected(old_nodes: DataFrame, nodes: DataFrame, old_edges: DataFrame, edges: DataFrame, gone: DataFrame, changed: DataFrame) -> DataFrame:
    """(path) whose resolved references may differ: those of nodes that changed, of sources with evidence in the paths gone (path), and of references that may mean a node that changed."""
    sources = None
    for e, n in ((old_edges, old_nodes), (edges, nodes)):
        hit = e.join(gone.distinct(), F.col("evidence_path") == F.col("path"), "left_semi").select(F.col("source_id").alias("node_id")).distinct()
        at = n.join(hit, "node_id", "left_semi").select("path")
        sources = at if sources is None else sources.union(at)
    owners = sources.union(changed.select("path")).union(resolve.affected_owners(edges, nodes, changed))
    return owners.filter("path is not null").distinct()


def structure(nodes: DataFrame, resolved: DataFrame, repository: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the derived layer beside resolved references: the repository and its files, tests, and controllers that reach a repository through a service."""
    layer = F.coalesce(F.get_json_object("metadata", "$.layer"), generic_layer(F.col("name"), F.coalesce("path", F.lit(""))))
    layers = nodes.filter("kind in ('class', 'interface')").select("node_id", "name", layer.alias("layer"))
    owner = F.concat(F.lit("@derived:"), "path").alias("evidence_path")
    contains = nodes.filter("kind = 'file' and path is not null").select(F.lit(repository).alias("source_id"), F.lit("CONTAINS").alias("relation"), F.col("node_id").alias("target_id"), owner, F.lit(1.0).alias("confidence"))
    placed = nodes.filter("path is not null").select(F.col("node_id").alias("source_id"), owner)
    tests = resolve.test_links(layers).join(placed, "source_id")
    uses = resolved.filter("relation = 'RESOLVED_DEPENDS_ON'").select("source_id", "target_id")
    best = resolve.layered(uses, layers)
    of = lambda who, at: best.select("controller", F.col(at).alias("source_id")).distinct().join(uses, "source_id").join(layers.filter(F.col("layer") == who).select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select("controller", F.col("target_id").alias("member"))
    members = best.select("controller", F.col("controller").alias("member")).union(of("service", "controller")).union(of("repository", "service"))
    pattern = F.concat(F.lit("pattern::layered::"), "controller")
    sure = F.lit(resolve.CONFIDENCE["layers"]).alias("confidence")
    evidence = placed.withColumnRenamed("source_id", "controller")
    follows = best.join(evidence, "controller").select(F.col("controller").alias("source_id"), F.lit("FOLLOWS_PATTERN").alias("relation"), pattern.alias("target_id"), "evidence_path", sure)
    has = members.join(evidence, "controller").select(pattern.alias("source_id"), F.lit("HAS_MEMBER").alias("relation"), F.col("member").alias("target_id"), "evidence_path", sure)
    shape = F.lit("Controller-Service-Repository")
    found = nodes.join(best.select(F.col("controller").alias("node_id")), "node_id", "left_semi").filter("path is not null")
    patterns = found.select(F.concat(F.lit("pattern::layered::"), "node_id").alias("node_id"), F.lit("pattern").alias("kind"), shape.alias("name"), F.concat(shape, F.lit("::"), "qualified_name").alias("qualified_name"), owner.alias("path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("{}").alias("metadata"))
    root = nodes.sparkSession.createDataFrame([(repository, "repository", name, name, "@derived", 0, 0, "{}")], patterns.schema)
    edges = contains.unionByName(tests.select(contains.columns)).unionByName(follows).unionByName(has)
    return root.unionByName(patterns), as_layer(edges)


def scan(spark: SparkSession, root: str, index: store.Store, ignore: Iterable[str] = (), full: bool = False, plugins: tuple = (registry.WEB,), known: dict[str, personas.Persona] | None = None) -> dict:
    """Brings the index up to date with the tree below root; returns counts.

    Nothing is read if the commit, the settings and a clean tree say that nothing changed. Else only files whose size or
    time differ are read, and of these only those whose content differs are analysed; where the index is of a clean
    commit, Git names the files to look at, and no others are listed. A file that fails keeps its old analysis and leaves
    the index degraded. References are resolved again where their file, or a node that they may mean, has changed; a
    refreshed index equals one that is built at once. `known` personas are kept as a layer of their own; None leaves the
    layer as it is."""
    began, m = time.time(), index.manifest()
    meta, settings = m["metadata"], fingerprint(version=VERSION, ignore=list(ignore), plugins=[p.plugin_id for p in plugins])
    head, dirty = (files._git(root, "rev-parse", "HEAD") or "").strip(), bool(files._git(root, "status", "--porcelain"))
    same = m["generation"] > 0 and meta.get("settings") == settings and not meta.get("degraded")
    marks = personas.fingerprint(known) if known is not None else meta.get("personas")
    if same and not full and head and head == meta.get("commit") and not dirty and not meta.get("dirty") and marks == meta.get("personas"):
        return {"skipped": True, "generation": m["generation"], "changed": 0, "deleted": 0, "failed": []}
    fresh = m["generation"] == 0 or meta.get("settings") != settings or full
    named = files.git_changes(root, meta["commit"]) if same and not full and head and meta.get("commit") and not meta.get("dirty") else None
    listed = files.listing(spark, root, ignore=ignore, changed=None if named is None else named.changed)
    now = files.snapshot(listed)  # names, sizes and times alone: no file is opened for it
    if named is not None:
        others = spark.createDataFrame([(p,) for p in named.changed | named.deleted], "path string")
        now = index.read("files").select("path", "size", "mtime").join(others, "path", "left_anti").unionByName(now)
    now = now.persist()
    if fresh:
        changes = now.select("path", F.lit("added").alias("change"))
    else:
        changes = store.snapshot_diff(index.read("files").select("path", "size", "mtime"), now)
    changes = changes.persist()
    wanted = changes.filter("change <> 'deleted'").select("path")
    read = files.read_files(listed.join(wanted, "path", "left_semi")).persist()
    if not fresh:  # an equal content needs no analysis, only a new size and time
        read = read.join(index.read("files").select("path", "content_hash"), ["path", "content_hash"], "left_anti").persist()
    parts = analyse(read, plugins)
    failed = parts["failed"].collect()
    parts |= {k: index.stage(f"new_{k}", parts[k]) for k in ("nodes", "edges", "chunks")}
    good = parts["good"].select("path", "content_hash", "language")
    gone = good.select("path").union(changes.filter("change = 'deleted'").select("path"))
    if fresh:
        nodes, edges, chunks, hashes = None, None, None, good
    else:
        old_nodes = index.read("nodes").filter(~store.of_layer("path"))
        raw = index.read("edges").filter(~store.of_layer("evidence_path"))
        nodes, _, chunks = store.delete_paths(old_nodes, raw, index.read("chunks"), gone)
        edges = raw.join(gone.distinct(), F.col("evidence_path") == F.col("path"), "left_anti")
        hashes = index.read("files").select("path", "content_hash", "language").join(gone, "path", "left_anti").unionByName(good)
    seq = parts["nodes"].withColumn("seq", F.xxhash64("node_id", "path", "metadata"))
    nodes = store.merge_nodes(nodes if nodes is not None else parts["nodes"].limit(0), seq)
    edges = parts["edges"] if edges is None else edges.unionByName(parts["edges"])
    chunks = parts["chunks"] if chunks is None else chunks.unionByName(parts["chunks"])
    lost = graph.orphans(nodes, edges).select("node_id")
    nodes = index.stage("nodes", nodes.join(lost, "node_id", "left_anti"))
    ends = nodes.select("node_id")
    edges = edges.join(ends, F.col("source_id") == F.col("node_id"), "left_semi").join(ends, F.col("target_id") == F.col("node_id"), "left_semi")
    edges = index.stage("edges", edges)
    if fresh:
        resolved = as_layer(resolve.derived_edges(edges, nodes))
    else:
        moved = index.stage("moved", changed_nodes(old_nodes, nodes))
        owners = index.stage("owners", affected(old_nodes, nodes, raw, edges, gone, moved))
        was = index.read("edges").filter(F.startswith("evidence_path", F.lit("@derived:")) & F.startswith("relation", F.lit("RESOLVED_")))
        theirs = nodes.join(owners, "path", "left_semi").select(F.col("node_id").alias("source_id"))
        again = as_layer(resolve.derived_edges(edges.join(theirs, "source_id", "left_semi"), nodes))
        resolved = store.replace_layer(was, "@derived", again, owners.select(F.concat(F.lit("@derived:"), "path").alias("evidence_path")))
    resolved = index.stage("resolved", resolved)
    more_nodes, more_edges = structure(nodes, resolved, files.repository_id(root), root.rstrip("/").rsplit("/", 1)[-1])
    if known is not None:
        who = personas.policy_nodes(spark, known), as_layer(personas.policy_edges(spark, known), "personas")
    elif meta.get("personas"):
        who = index.read("nodes").filter("path = '@persona'"), index.read("edges").filter("evidence_path = '@persona'")
    else:
        who = None
    whole = edges.unionByName(resolved).unionByName(more_edges)
    whole = index.stage("whole", whole if who is None else whole.unionByName(who[1]))
    all_nodes = nodes.unionByName(more_nodes)
    all_nodes = index.stage("all_nodes", all_nodes if who is None else all_nodes.unionByName(who[0]))
    chunks = index.stage("chunks", chunks)
    had = None if fresh or "postings" not in m.get("tables", []) else (index.read("postings"), index.read("lengths"))
    posted, sizes = search.refreshed(search.chunk_docs(chunks, nodes), "chunk_id", list(search.CHUNK_WEIGHTS), had)
    table = now.join(hashes, "path")
    n = index.publish({"files": table, "nodes": all_nodes, "edges": whole, "chunks": chunks, "postings": posted, "lengths": sizes}, {"commit": head, "dirty": dirty, "settings": settings, "personas": marks, "degraded": bool(failed), "failed": [r["path"] for r in failed]})
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    index.clear_stages()
    for df in (now, changes, read, parts["facts"]):
        df.unpersist()
    return {"skipped": False, "generation": n, "changed": counts.get("added", 0) + counts.get("modified", 0), "deleted": counts.get("deleted", 0), "failed": [tuple(r) for r in failed], "seconds": round(time.time() - began, 3)}


def status(index: store.Store, caches: dict[str, cache.Bounded] | None = None) -> dict:
    """Counts of the current generation, what the manifest says, and how caches have fared."""
    m = index.manifest()
    tables = {t: index.read(t).count() for t in ("files", "nodes", "edges", "chunks") if t in m.get("tables", [])}
    fared = {k: vars(c.stats) | {"hit_rate": c.stats.hit_rate()} for k, c in (caches or {}).items()}
    return {"generation": m["generation"], "tables": tables, "caches": fared, **{k: m["metadata"].get(k) for k in ("commit", "dirty", "degraded", "failed")}}


def doctor(index: store.Store, root: str, watching: dict | None = None) -> dict:
    """What a user would check first: the tree, Git, the index, what optional readers are there, and a watcher by its status."""
    there = lambda name: importlib.util.find_spec(name) is not None
    out = {"workspace": os.path.isdir(root), "git": shutil.which("git") is not None, "repository": files._git(root, "rev-parse", "HEAD") is not None}
    try:
        m = index.manifest()
        out |= {"index": m["generation"] > 0, "generation": m["generation"], "degraded": bool(m["metadata"].get("degraded"))}
    except store.IndexCompatibilityError:
        out |= {"index": False, "generation": None, "degraded": True}
    out |= {"native_watcher": there("watchfiles"), "yaml": there("yaml"), "tokenizers": there("tokenizers")}
    return out | {"watcher": None if watching is None else watcher.fresh(watching, time.time())}
